"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Each source's documents stand in a seeded order, and their words are cut into blocks of
equal size (the last of a source may be short).  The blocks of the mix are apportioned to
the sources by highest quotients target / (2 k + 1).  The method is house monotone: the seats
of the first j shards contain those of the first j - 1, so each shard has an integer quota of
every source, and all quotas add up to the apportionment of the whole mix.  A source's
quota is then filled with its blocks in a seeded order; once all are taken, they are
taken again.

Only sizes and hashes of documents are shuffled, never texts.  Running totals are taken
within bins of the seeded order and over the bins' sums, so the documents of a hot source
are spread over as many tasks as it has bins.  What is held for one task is one row for
each source and shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tendersift.llm.common import attached, read_table, stored, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Factors of the seeded order of blocks; the first that doesn't divide a source's number of blocks is its own.
FACTORS = (179_424_673, 160_481_183, 141_650_939)
#: Documents of one bin of the seeded order on average; there are 65,536 bins at most.
BIN_ROWS = 500


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by code point, null last, repeated in turn; total: words of the mix per word of all documents; most: how often a source's words may be taken.

    block: words of a block at most; smaller where the documents hold under `fine` such
    blocks, so that small tables are met as closely.  shards: parts of the mix.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    total: tuple[int, int] = (3, 2)
    most: int = 2
    block: int = 1024
    fine: int = 1_000_000
    shards: int = 64
    seed: int = 11

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights) < 1 or min(self.total) < 1 or min(self.most, self.block, self.fine, self.shards) < 1:
            raise ValueError("weights, shares, blocks and shards are positive")
        if self.total[0] > self.most * self.total[1]:
            raise ValueError("the mix is larger than the sources may give")

    def words(self, all_words: int) -> int:
        """Words of one block."""
        return max(1, min(self.block, all_words // self.fine))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (words of the whole text, null has none) and place, the hash that orders a source's documents.

    place is of the id and the text, so rows that share it are alike and any order of them gives the same rows.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole_text().cast("binary"))).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"), place.alias("place"))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """number (by code point, null last), source, source_size, weight and target of sizes(source, source_size), one row for each source.

    A source's target is its weight times the level that spreads total over all sources of
    which none exceeds `most` times its size; those with the least size for their weight
    are full first.  Sources of 0 words have the target 0.
    """
    c, every = F.col, W.partitionBy(F.lit(0))
    number = F.row_number().over(every.orderBy(c("source").isNull(), "source")) - 1
    rows = sizes.withColumn("number", number).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (c("number") % len(mix.weights) + 1).cast("int")).cast("bigint"))
    rows = rows.withColumn("full", c("source_size") * mix.most)
    # Sources in the order in which they fill up; numbers break ties.  At each, the level if it and all after it stay below their limit.
    filling = every.orderBy(c("full").cast("double") / c("weight"), "number")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * mix.total[0] - F.coalesce(F.sum("full").over(before), F.lit(0)) * mix.total[1]
    open_ = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))) * mix.total[1]
    rows = rows.withColumns({"rest": rest, "open": open_})
    fits = c("rest") * c("weight") <= c("full") * c("open")
    # The first that stays below its limit sets the level of itself and all after it.
    level = F.first(F.when(fits, F.struct("rest", "open")), True).over(filling.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("level", level)
    exact = (c("weight") * c("level.rest")).cast("double") / c("level.open").cast("double")
    return rows.select("number", "source", "source_size", "weight", F.coalesce(exact, c("full").cast("double")).alias("target"))


def quotas(targets: DataFrame, words: int, shards: int) -> DataFrame:
    """number, shard (from 0), quota and upto: blocks of each source in each shard, and in it and all before.

    The mix has the sum of the rounded target / words as its number of blocks, and the first
    j shards the share j / shards of it.  With n sources, the quotients in question for a house
    of h seats are those of seats between target * (h - n) / all and target * (h + n) / all,
    rounded: the ones below are taken in any case, those above never, so at most 3 n
    of them are ranked for each shard.  Equal quotients go to the lesser number.
    """
    c = F.col
    whole = targets.agg(F.sum("target").alias("all_target"), F.count("*").alias("n"), F.sum(F.floor(c("target") / words + 0.5)).alias("all_seats"))
    house = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("upto_shard")).withColumn("house", F.floor(c("all_seats") * c("upto_shard") / shards))
    rows = targets.filter("target > 0").select("number", "target").crossJoin(F.broadcast(house))  # one row for each source and shard
    share = lambda seats: F.floor(c("target") * seats / c("all_target") + 0.5)
    rows = rows.withColumns({"sure": F.greatest(share(c("house") - c("n")) - 1, F.lit(0)), "most": F.greatest(share(c("house") + c("n")) + 1, F.lit(1))})
    open_seats = c("house") - F.sum("sure").over(W.partitionBy("upto_shard"))
    asked = rows.withColumn("open", open_seats).select("*", F.explode(F.sequence(c("sure"), c("most"))).alias("seat"))
    rank = F.row_number().over(W.partitionBy("upto_shard").orderBy((c("target") / (2 * c("seat") + 1)).desc(), "number", "seat"))
    given = asked.withColumn("rank", rank).groupBy("number", "upto_shard").agg((F.max("sure") + F.count_if(c("rank") <= c("open"))).alias("upto"))
    earlier = F.coalesce(F.lag("upto").over(W.partitionBy("number").orderBy("upto_shard")), F.lit(0))
    return given.select("number", (c("upto_shard") - 1).alias("shard"), (c("upto") - earlier).alias("quota"), "upto")


def laid_out(sizes: DataFrame, known: DataFrame) -> DataFrame:
    """sizes(doc_id, source, size, place) with start, the words of its source before a document in the seeded order, and the columns of known(source, ...), one row for each source."""
    c = F.col
    bins = max(1, min(1 << 16, sizes.count() // BIN_ROWS))
    rows = sizes.withColumn("bin", F.floor(F.conv(F.substring("place", 1, 4), 16, 10).cast("bigint") * bins / 65536).cast("int"))
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    below = F.sum("in_bin").over(W.partitionBy("source").orderBy("bin")) - c("in_bin")  # at most `bins` rows a source
    sums = sums.select(c("source").alias("of"), c("bin").alias("of_bin"), below.alias("below"))
    sums = sums.join(known.withColumnRenamed("source", "of_source"), c("of").eqNullSafe(c("of_source"))).drop("of_source")
    inner = F.sum("size").over(W.partitionBy("source", "bin").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - c("size")
    keyed = rows.withColumn("start", inner).withColumn("key", F.xxhash64("source", c("source").isNull(), "bin"))
    keys = stored(sums.withColumn("key", F.xxhash64("of", c("of").isNull(), "of_bin")), "bins")
    if keys.select("key").distinct().count() < keys.count():
        raise ValueError("two bins share a key")
    return attached(keyed, keys.drop("of", "of_bin"), "key", "place").withColumn("start", c("start") + c("below")).drop("key", "below", "bin", "place")


def times(block: Column, blocks: Column, upto: Column, factor: Column, shift: Column) -> Column:
    """How often a block is among the first upto of its source's endless seeded order of blocks."""
    turn = F.pmod(block * factor + shift, blocks)
    return F.greatest(F.floor((upto - turn + blocks - 1) / blocks), F.lit(0))


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, int]:
    """Documents with source, size, source_size, target and what tells their blocks apart; quotas of sources and shards; words of a block.

    The first table has doc_id, source, size, source_size, target, number, start, blocks (of the
    source), upto (blocks that the mix takes), factor and shift.
    """
    c = F.col
    sizes = stored(measured(docs, mix.seed), "sizes")
    sums = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    words = mix.words(sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n)
    goal = stored(targets(sums, mix), "targets")
    share = stored(quotas(goal, words, mix.shards), "quotas")
    known = goal.join(share.groupBy("number").agg(F.max("upto").alias("upto")), "number", "left").fillna({"upto": 0})
    blocks = F.greatest(F.ceil(c("source_size") / words), F.lit(1))
    known = known.withColumn("blocks", blocks)
    factor = F.coalesce(*[F.when(c("blocks") % f != 0, F.lit(f)) for f in FACTORS])
    known = known.withColumns({"factor": factor.cast("bigint"), "shift": F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(mix.seed)), "number").cast("binary")), 1, 7), 16, 10).cast("bigint"), c("blocks"))})
    return laid_out(sizes, known.drop("weight")), share, words


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of each row of docs.

    A null text has no words, an empty table gives an empty one; repeated rows are rows of
    their own; columns besides doc_id, source and text don't matter.  The same rows give the
    same result whatever their order and partitions.  Each source's taken words differ
    from its target by at most one and a half blocks, and by as many short last blocks as it is repeated.
    """
    c = F.col
    rows, _, words = plan(docs, mix)
    first, last = F.floor(c("start") / words), F.floor((c("start") + c("size") - 1) / words)
    overlap = lambda b: F.least((b + 1) * words, c("start") + c("size")) - F.greatest(b * words, c("start"))
    taken = F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda s, b: s + overlap(b) * times(b, c("blocks"), c("upto"), c("factor"), c("shift")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(c("size") > 0, taken).otherwise(F.lit(0)).cast("bigint").alias("taken"))


def pieces(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, shard, from_word, to_word (end exclusive): the parts of documents that each shard of the mix holds, a row for every time.

    Words count from 0 within the document.  A shard's parts of a source are the blocks of its quota.
    """
    c = F.col
    rows, share, words = plan(docs, mix)
    each = rows.filter("size > 0").select("*", F.explode(F.sequence(F.floor(c("start") / words), F.floor((c("start") + c("size") - 1) / words))).alias("block"))
    again = times(c("block"), c("blocks"), c("upto"), c("factor"), c("shift"))
    turn = F.pmod(c("block") * c("factor") + c("shift"), c("blocks"))
    each = each.withColumn("again", again).filter("again > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), c("again") - 1)).alias("round")).withColumn("slot", turn + c("round") * c("blocks"))
    ends = share.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("ends"))  # one entry for each shard
    shard = F.size(F.filter("ends", lambda e: e["upto"] <= c("slot")))
    begin = F.greatest(c("block") * words, c("start")) - c("start")
    end = F.least((c("block") + 1) * words, c("start") + c("size")) - c("start")
    return attached(each, stored(ends, "shard-ends"), "number", "doc_id", F.size("ends")).select("doc_id", "source", shard.alias("shard"), begin.alias("from_word"), end.alias("to_word"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents")).drop("source")


# The seats are those of a plain ranking of all quotients, the blocks are listed one by one.
ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
sums AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][number % 3 + 1]::BIGINT AS weight, 2 * source_size AS most, sum(source_size) OVER () AS all_words FROM sums),
settled AS (
    SELECT 0 AS step, [-1]::BIGINT[] AS full_ones
    UNION ALL
    SELECT step + 1, found.f FROM settled, LATERAL (
        SELECT list(number ORDER BY number)::BIGINT[] AS f FROM weighed w,
            (SELECT 3 * max(all_words) - 2 * coalesce(sum(most) FILTER (number IN (SELECT unnest(full_ones))), 0) AS rest,
                2 * coalesce(sum(weight) FILTER (number NOT IN (SELECT unnest(full_ones))), 0) AS open FROM weighed) l
        WHERE number IN (SELECT unnest(full_ones)) OR w.weight * l.rest > w.most * l.open) found
    WHERE found.f IS NOT NULL AND found.f <> full_ones),
final AS (SELECT full_ones FROM settled ORDER BY step DESC LIMIT 1),
level AS (
    SELECT 3 * max(all_words) - 2 * coalesce(sum(most) FILTER (number IN (SELECT unnest(full_ones) FROM final)), 0) AS rest,
        2 * coalesce(sum(weight) FILTER (number NOT IN (SELECT unnest(full_ones) FROM final)), 0) AS open FROM weighed),
goal AS (
    SELECT w.*, CASE WHEN number IN (SELECT unnest(full_ones) FROM final) OR open = 0 THEN most::DOUBLE ELSE (weight * rest)::DOUBLE / open::DOUBLE END AS target,
        greatest(1, least(1024, all_words // 1000000))::BIGINT AS words FROM weighed w, level),
seats AS (
    SELECT number, unnest(range(0, ceil(target / words)::BIGINT + 1)) AS seat, target, sum(0) OVER () AS z FROM goal WHERE target > 0),
house AS (SELECT sum(floor(target / words + 0.5))::BIGINT AS h FROM goal),
ranked AS (SELECT number, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, number, seat) AS r FROM seats),
quota AS (SELECT number, count(*) AS upto FROM ranked, house WHERE r <= h GROUP BY number),
known AS (
    SELECT g.*, coalesce(upto, 0) AS upto, greatest(1, ceil(source_size / words))::BIGINT AS blocks FROM goal g LEFT JOIN quota USING (number)),
ready AS (
    SELECT *, CASE WHEN blocks % 179424673 <> 0 THEN 179424673 WHEN blocks % 160481183 <> 0 THEN 160481183 ELSE 141650939 END AS factor,
        ('0x' || left(md5('11:' || number::VARCHAR), 7))::BIGINT % blocks AS shift FROM known),
laid AS (
    SELECT s.*, k.* EXCLUDE (source), sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
    FROM sized s JOIN ready k ON s.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE list_sum([(least((b + 1) * words, start + size) - greatest(b * words, start))
        * greatest(0, (upto - (b * factor + shift) % blocks + blocks - 1) // blocks) FOR b IN range(start // words, (start + size - 1) // words + 1)]) END::BIGINT AS taken
FROM laid
"""
