"""Two unsupervised detectors, calibration, ensemble and stability.

Rows are in long form where a step treats features alike: ident, feature, value.  All that is
fitted comes from the training rows; scoring rows never change it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tendersift.functions.robust import compare, running_counts
from tendersift.joins import BROADCAST_CELLS, free_name, same_population
from tendersift.operators import tree_growth
from tendersift.sources.manifest import digest, table_digest
from tendersift.storage import stored

IDENT = ["transaction_id", "award_id"]


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """transaction_id, award_id, feature, value; values may be null."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*IDENT, F.inline(each))


def float_exactness(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, present, inexact and largest_error: what a 32-bit float loses of each feature's values."""
    value, rounded = F.col("value"), F.col("value").cast("float").cast("double")
    return long_form(df, features).groupBy("feature").agg(F.count("value").alias("present"), F.count_if(value != rounded).alias("inexact"), F.max(F.abs(value - rounded)).alias("largest_error"))


def oriented(scores: DataFrame, higher_is_more_anomalous: bool, column: str = "score") -> DataFrame:
    """Scores of which a higher one is more anomalous."""
    return scores if higher_is_more_anomalous else scores.withColumn(column, -F.col(column))


def tail_counts(training: DataFrame, features: list[str]) -> DataFrame:
    """feature, value and n of the training rows: all that the empirical-tail detector learns."""
    return long_form(training, features).filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))


def tail_scores(training: DataFrame, scoring: DataFrame, features: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """tail_scores_by() of the counts of the training rows."""
    return tail_scores_by(stored(tail_counts(training, features), "tail-training"), scoring, features, training is scoring, keep)


def tail_scores_by(counts: DataFrame, scoring: DataFrame, features: list[str], inside: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """ident, keep, left, right, skewed and score of the empirical-tail detector, from its stored tail_counts().

    inside: counts are those of the scoring rows, which saves adding their values to them.  keep:
    columns of scoring that stay in their rows, so nobody joins them again.

    The surprise of a value is -ln of the share of training values at or beyond it, at
    least one; the skew side of a feature is the sign of its third central moment, 0 is right.
    Surprises are added up in the order of the features' names, so equal rows have equal scores.
    """
    rows, parts = _surprised(scoring, _surprises(counts, scoring, features, inside), sorted(features), keep=keep)
    return rows.filter(F.coalesce(*map(F.col, parts)).isNotNull()).select(*IDENT, *keep, *_sums(parts)).withColumn("score", F.greatest("left", "right", "skewed"))


def _sums(parts: list[str]) -> list[Column]:
    """left, right and skewed: the sums of the surprises in those columns, added up in their order."""
    return [reduce(lambda s, p: s + F.coalesce(F.col(p)[x], F.lit(0.0)), parts, F.lit(0.0)).alias(x) for x in ("left", "right", "skewed")]


def _surprises(counts: DataFrame, scoring: DataFrame, features: list[str], inside: bool) -> DataFrame:
    """The stored left, right and skewed surprise of each feature's values, those of scoring too."""
    c = F.col
    means = counts.groupBy("feature").agg((F.sum(c("value") * c("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("size"))
    sides = counts.join(F.broadcast(means), "feature").groupBy("feature", "size").agg((F.sum(c("n") * F.pow(c("value") - c("mean"), 3)) < 0).alias("to_left"))
    if not inside:
        each = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("value")) for f in features])
        asked = scoring.select(F.inline(each)).filter("value IS NOT NULL").distinct().withColumn("n", F.lit(0).cast("bigint"))
    known = counts if inside else stored(counts.select("feature", "value", "n").union(asked).groupBy("feature", "value").agg(F.sum("n").alias("n")), "tail-counts")
    runs = running_counts(known, ["feature"]).drop("size")
    left = -F.log(F.greatest(c("before") + c("n"), F.lit(1)) / c("size"))
    right = -F.log(F.greatest(c("size") - c("before"), F.lit(1)) / c("size"))
    found = runs.join(F.broadcast(sides), "feature").select("feature", "value", left.alias("left"), right.alias("right"), F.when(c("to_left"), left).otherwise(right).alias("skewed"))  # one side for each feature
    return stored(found, "tail-surprises")


#: Surprises of up to so many values of all features together are broadcast.
BROADCAST_VALUES = 300_000


def _surprised(scoring: DataFrame, surprises: DataFrame, features: list[str], limit: int = BROADCAST_VALUES, *, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The scoring rows with keep and a struct (left, right, skewed) for each feature, and the names of those columns.

    A feature whose values fit what is left of the limit is looked up in place, the one with the fewest
    first; each other one takes one shuffle of the rows, which stay one row each.
    """
    sizes = {r.feature: r["n"] for r in surprises.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row for each feature
    names = {f: free_name(scoring, f"surprise_{i}") for i, f in enumerate(features)}
    values = {f: free_name(scoring, f"value_{i}") for i, f in enumerate(features)}
    rows = scoring.select(*IDENT, *keep, *[F.col(f).cast("double").alias(v) for f, v in values.items()])
    for f in sorted(features, key=lambda f: sizes.get(f, 0)):
        n, value = sizes.get(f, 0), values[f]
        mine = surprises.filter(F.col("feature") == f).select(F.col("value").alias(value), F.struct("left", "right", "skewed").alias(names[f]))
        rows = rows.join(F.broadcast(mine), value, "left") if n <= limit else rows.join(mine, value, "left")  # adaptive execution splits a hot value
        rows, limit = rows.drop(value), limit - (n if n <= limit else 0)
    return rows, list(names.values())


def score_counts(training: DataFrame) -> DataFrame:
    """value and n of the training scores: all that a calibration learns."""
    return training.filter("score IS NOT NULL").groupBy(F.col("score").alias("value")).agg(F.count("*").alias("n"))


def calibrated(training: DataFrame, scores: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """calibrated_by() of the counts of the training scores (column score, higher is more anomalous)."""
    return calibrated_by(score_counts(training), scores, keep)


def _spread_out(counts: DataFrame) -> None:
    """ValueError unless there are two training scores at least, not all equal."""
    span = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.min("value") < F.max("value")).alias("differ")).first()
    if span.n < 2 or not span.differ:
        raise ValueError("calibration takes two different training scores at least")


def calibrated_members(matrix: DataFrame, members: dict[str, list[str]], digits: int) -> DataFrame:
    """ident and <member>_lower, <member>_mid and <member>_upper for each member, a tail detector over some of the features, calibrated on its own scores rounded to digits.

    All members tell of the same rows of the matrix, so these stay whole: a feature's surprises are looked
    up once for all members, and no member is joined with another.  ValueError if a row has no
    value of one member's features but of another's.
    """
    c, features = F.col, sorted({f for mine in members.values() for f in mine})
    surprises = _surprises(stored(tail_counts(matrix, features), "tail-training"), matrix, features, True)
    rows, parts = _surprised(matrix, surprises, features)
    part = dict(zip(features, parts, strict=True))
    scored = []
    for name, mine in members.items():
        left, right, skewed = _sums([part[f] for f in sorted(mine)])
        score = F.round(F.greatest(left, right, skewed), digits)
        scored.append(F.when(F.coalesce(*[c(part[f]) for f in mine]).isNotNull(), score).alias(f"{name}_score"))
    scores = [f"{n}_score" for n in members]
    rows = stored(rows.select(*IDENT, *scored).filter(F.coalesce(*scores).isNotNull()), "member-scores")
    if rows.filter(F.greatest(*[c(x).isNull() for x in scores])).head(1):
        raise ValueError("different rows: a row has values for one member and none for another")
    tables = []
    for name in members:
        counts = stored(rows.groupBy(c(f"{name}_score").alias("value")).agg(F.count("*").alias("n")), "score-counts")
        _spread_out(counts)
        found = running_counts(counts.select(F.lit("all").alias("group"), "value", "n"), ["group"])
        less, equal, n = c("before"), c("n"), c("size")
        found = found.select(c("value").alias(f"{name}_score"), (less / n).alias(f"{name}_lower"), F.try_divide(less + equal / 2, n).alias(f"{name}_mid"), ((less + equal) / n).alias(f"{name}_upper"))
        tables.append((counts.count(), name, stored(found, "calibration")))
    for n, name, found in sorted(tables, key=lambda x: x[:2]):
        rows = rows.join(F.broadcast(found) if n <= BROADCAST_CELLS else found, f"{name}_score", "left").drop(f"{name}_score")  # adaptive execution splits a hot score
    return rows


def calibrated_by(counts: DataFrame, scores: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """ident, keep, score, lower, mid, upper, z and distance of each score among the training scores of score_counts(); at least two of them, not all equal.  keep: columns of scores that stay."""
    _spread_out(counts)
    counts = counts.select(F.lit("all").alias("group"), "value", "n")
    asked = scores.select("score").filter("score IS NOT NULL").distinct()
    # What is said of a row is up to its score alone, so equal scores are compared once.
    found = compare(asked.select(F.lit("all").alias("group"), F.col("score").alias("value"), F.lit(None).cast("double").alias("own")), counts, [])
    less, equal, n = F.col("less"), F.col("equal"), F.col("peers")
    found = found.select(F.col("value").alias("score"), (less / n).alias("lower"), F.col("position").alias("mid"), ((less + equal) / n).alias("upper"), "z", "distance")
    found = stored(found, "calibration")
    rows = scores.select(*IDENT, *keep, "score").filter("score IS NOT NULL").join(F.broadcast(found) if found.count() <= BROADCAST_CELLS else found, "score", "left")
    return rows.select(*IDENT, *keep, "score", "lower", "mid", "upper", "z", "distance")


def _median(parts: list[Column]) -> Column:
    x, n = F.sort_array(F.array(*parts)), len(parts)
    return (x[(n - 1) // 2] + x[n // 2]) / 2


def ensemble(members: dict[str, DataFrame], weights: dict[str, float] | None = None, method: str = "weighted_mean") -> DataFrame:
    """ident, lower, mid, upper and disagreement of calibrated members; all members must hold the same rows."""
    return ensembles(members, {method: weights}).drop("method")


def ensembles(members: dict[str, DataFrame], methods: dict[str, dict[str, float] | None]) -> DataFrame:
    """ensemble() by each of the methods, with its name as method; the members are joined once for all of them."""
    _fitting(list(members), methods)
    same_population(members, IDENT)
    named = [m.select(*IDENT, *[F.col(x).alias(f"{name}_{x}") for x in ("lower", "mid", "upper")]) for name, m in members.items()]
    return _combined(reduce(lambda a, b: a.join(b, IDENT), named), list(members), methods)


def ensembles_of(rows: DataFrame, members: list[str], methods: dict[str, dict[str, float] | None]) -> DataFrame:
    """ensembles() of members that stand in the same rows, as of calibrated_members()."""
    _fitting(members, methods)
    return _combined(rows, members, methods)


def _fitting(members: list[str], methods: dict[str, dict[str, float] | None]) -> None:
    """ValueError unless each method suits the members."""
    for method, weights in methods.items():
        if len(members) < 2 or (method == "weighted_mean") != (weights is not None):
            raise ValueError("an ensemble has two members at least, and weights with weighted_mean alone")
        if weights is not None and (set(weights) != set(members) or abs(sum(weights.values()) - 1) > 1e-12 or min(weights.values()) <= 0):
            raise ValueError("weights are positive and sum to 1")


def _combined(rows: DataFrame, members: list[str], methods: dict[str, dict[str, float] | None]) -> DataFrame:

    def combined(method: str, x: str) -> Column:
        parts = [F.col(f"{name}_{x}") for name in members]
        if method == "maximum":
            return F.greatest(*parts)
        return _median(parts) if method == "median" else reduce(lambda a, b: a + b, [F.lit(methods[method][n]) * F.col(f"{n}_{x}") for n in members])

    mids = [F.col(f"{name}_mid") for name in members]
    each = [F.struct(F.lit(m).alias("method"), *[combined(m, x).alias(x) for x in ("lower", "mid", "upper")]) for m in methods]
    return rows.select(*IDENT, F.inline(F.array(*each)), (F.greatest(*mids) - F.least(*mids)).alias("disagreement"))


def stability(runs: dict[str, DataFrame]) -> DataFrame:
    """ident, runs, least, most, median and mad of mid over several runs of the same rows."""
    if len(runs) < 2:
        raise ValueError("stability takes two runs at least")
    same_population(runs, IDENT)
    every = reduce(lambda a, b: a.unionByName(b), [r.select(*IDENT, "mid") for r in runs.values()])
    return _stable(every.groupBy(*IDENT).agg(F.sort_array(F.collect_list("mid")).alias("x")))  # as many values as runs


def stability_of(rows: DataFrame, members: list[str]) -> DataFrame:
    """stability() of members that stand in the same rows, as of calibrated_members()."""
    if len(members) < 2:
        raise ValueError("stability takes two runs at least")
    return _stable(rows.select(*IDENT, F.sort_array(F.array(*[f"{n}_mid" for n in members])).alias("x")))


def _stable(lists: DataFrame) -> DataFrame:
    middle = lambda x: F.when(F.size(x) % 2 == 1, x[F.floor(F.size(x) / 2).cast("int")]).otherwise((x[(F.size(x) / 2).cast("int") - 1] + x[(F.size(x) / 2).cast("int")]) / 2)
    rows = lists.withColumn("median", middle(F.col("x")))
    rows = rows.withColumn("away", F.sort_array(F.transform("x", lambda v: F.abs(v - F.col("median")))))
    return rows.select(*IDENT, F.size("x").alias("runs"), F.array_min("x").alias("least"), F.array_max("x").alias("most"), "median", middle(F.col("away")).alias("mad"))


def spearman(a: DataFrame, b: DataFrame, column: str = "mid") -> DataFrame:
    """rho, the rank correlation of two runs over the same rows; null if either is constant."""
    same_population({"the first run": a, "the second": b}, IDENT)
    value = lambda df, name: df.select(*IDENT, F.col(column).alias(name))
    return rank_correlation(value(a, "x").join(value(b, "y"), IDENT), "x", "y")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho of two columns of the same rows; null if either is constant.

    Equal pairs of values are counted, so what is shuffled are two numbers a pair; a value's
    rank, the mean of those of its equals, comes from the counts of its column.  Pairs with a
    null are left out, after they have taken their ranks.
    """
    c = F.col
    pairs = df.groupBy(c(x).alias("x"), c(y).alias("y")).agg(F.count("*").alias("n"))
    rows = pairs = stored(pairs, "rank-pairs")
    for name in ("x", "y"):
        counts = stored(pairs.groupBy(F.lit(1).alias("g"), c(name).alias("value")).agg(F.sum("n").alias("n")), "rank-counts")
        # From the middle of all ranks, so that sums of squares lose no digits.
        rank = c("before") + (c("n") + 1) / 2 - (c("size") + 1) / 2
        rows = rows.join(running_counts(counts, ["g"]).select(c("value").alias(name), rank.alias(f"{name}_rank")), name).drop(name)
    total = lambda *k: F.sum(reduce(lambda p, q: p * c(f"{q}_rank"), k, c("n").cast("double")))
    sums = rows.agg(F.sum("n").alias("n"), total("x").alias("x"), total("y").alias("y"), total("x", "x").alias("xx"), total("y", "y").alias("yy"), total("x", "y").alias("xy"), F.max("x_rank") > F.min("x_rank"), F.max("y_rank") > F.min("y_rank"))
    sums = sums.toDF("n", "x", "y", "xx", "yy", "xy", "x_differs", "y_differs")
    moment = lambda p, q, pq: c(pq) / c("n") - c(p) / c("n") * (c(q) / c("n"))
    rho = F.when(c("x_differs") & c("y_differs"), F.try_divide(moment("x", "y", "xy"), F.sqrt(moment("x", "x", "xx") * moment("y", "y", "yy"))))
    return sums.select(F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


#: A tree of more rows is grown by levels, and its forest is a table.
MOST_ROWS = 1 << 16


@dataclass(frozen=True)
class Forest:
    """Isolation trees over the named features; a tree is its nodes (feature, cut, left, right, depth), grown from sample rows."""

    features: tuple[str, ...]
    sample: int
    trees: tuple[tuple[tuple[int, float, int, int, float], ...], ...]

    def fingerprint(self) -> str:
        """sha256 of the features, the sample and every node."""
        return digest([self.features, self.sample, self.trees])


@dataclass(frozen=True)
class ForestTable:
    """The same with its nodes in a table (tree_growth.NODES), for trees that no driver or task should hold."""

    features: tuple[str, ...]
    sample: int
    count: int
    nodes: DataFrame

    def fingerprint(self) -> str:
        return digest([self.features, self.sample, self.count, table_digest(self.nodes)])


def _part(asked: int | float, whole: int) -> int:
    """asked, at most whole; of a float that share of whole, at least one."""
    if isinstance(asked, float):
        if not 0 < asked <= 1:
            raise ValueError("a share lies in (0, 1]")
        return max(1, int(asked * whole))
    if asked < 1:
        raise ValueError("a number is positive")
    return min(asked, whole)


def fit_forest(training: DataFrame, features: list[str], trees: int = 100, sample: int | float = 256, seed: int = 0, tree_features: int | float = 1.0, bootstrap: bool = False, most_rows: int = MOST_ROWS) -> Forest | ForestTable:
    """Isolation trees, each grown from the rows with the smallest hashes of (row, tree, seed).

    sample and tree_features: rows and features of a tree, as a number or as a share (a
    float) of all.  bootstrap: rows are drawn with replacement, so fewer of them stand
    several times.  Trees of up to most_rows rows are grown in a task each, larger ones level by
    level over all rows; both draw alike and give the same trees.  Values are not null.
    """
    n = training.count()
    if not n or not features:
        raise ValueError("a forest takes one row and one feature at least")
    size, width = _part(sample, n), _part(tree_features, len(features))
    limit, columns = int(np.ceil(np.log2(max(2, size)))), tree_growth.tree_columns(seed, trees, len(features), width)
    near = lambda t: F.pmod(F.xxhash64(*IDENT, t, F.lit(seed)), F.lit(1 << tree_growth.HASH_BITS))
    share = 1.0 if size > most_rows else min(1.0, (2 * size + 40) / n)
    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: near(t) < int(share * (1 << tree_growth.HASH_BITS)))
    rows = training.select(*IDENT, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.explode(wanted).alias("tree"))
    rows = rows.withColumn("h", near(F.col("tree")))
    if size > most_rows:
        return _large_forest(rows, tuple(features), size, n, trees, seed, columns, limit, bootstrap)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # Which rows are drawn is up to their hashes; draws with replacement tell only how often each stands.
        times = np.unique(np.random.default_rng([seed, tree]).integers(0, n, size), return_counts=True)[1] if bootstrap else np.ones(size, int)
        x = np.array(pdf.sort_values(["h", *IDENT], kind="stable").head(len(times))["x"].tolist())
        nodes = tree_growth.grown(x, times[: len(x)], columns[tree], seed, tree, limit)
        return pd.DataFrame({"tree": tree, **{k: [v[i] for v in nodes] for i, k in enumerate(("node", "feature", "cut", "size", "depth"))}})

    found = rows.select("tree", "h", *IDENT, "x").groupBy("tree").applyInPandas(grow, tree_growth.NODES).orderBy("tree", "node").collect()  # at most 2 * most_rows nodes a tree
    out: dict[int, list[tuple]] = {}
    for r in found:
        out.setdefault(r.tree, []).append((r.node, r.feature, r.cut, r.depth))
    return Forest(tuple(features), size, tuple(map(tree_growth.as_arrays, out.values())))


def _large_forest(rows: DataFrame, features: tuple[str, ...], size: int, n: int, trees: int, seed: int, columns: list[list[int]], limit: int, bootstrap: bool) -> ForestTable:
    """The forest as a table; with replacement, how often the rows stand is drawn row by row of a table of `size` draws a tree, and the rows are dealt the counts in the order of their hashes."""
    c = F.col
    if bootstrap:
        draws = rows.sparkSession.range(size * trees).select((c("id") % trees).cast("int").alias("tree"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("place"))
        rows = stored(rows, "forest-rows")
        bin_ = F.shiftright("h", tree_growth.HASH_BITS - tree_growth.BIN_BITS)
        below = rows.groupBy("tree", bin_.alias("bin")).agg(F.count("*").alias("in_bin"))
        below = below.withColumn("below", F.sum("in_bin").over(W.partitionBy("tree").orderBy("bin")) - c("in_bin")).drop("in_bin")  # at most 2^BIN_BITS rows a tree
        inner = F.row_number().over(W.partitionBy("tree", "bin").orderBy("h", *IDENT)) - 1
        placed = rows.withColumn("bin", bin_).withColumn("inner", inner).join(below, ["tree", "bin"]).withColumn("place", c("inner") + c("below"))
        chosen = placed.join(draws.groupBy("tree", "place").agg(F.count("*").alias("weight")), ["tree", "place"])
    else:
        chosen = tree_growth.nearest(stored(rows, "forest-rows"), size, IDENT).withColumn("weight", F.lit(1).cast("bigint"))
    chosen = stored(chosen.select("tree", "x", "weight"), "forest-sample")
    return ForestTable(features, size, trees, tree_growth.grown_by_levels(chosen, len(features), columns, seed, limit))


def forest_scores(scoring: DataFrame, forest: Forest | ForestTable) -> DataFrame:
    """ident and score: 2 ** -(mean depth / mean depth by chance); higher is more anomalous.  The trees of a Forest are broadcast, a ForestTable is joined level by level."""
    features, norm = list(forest.features), max(float(tree_growth.average_path(forest.sample)), 1e-12)
    if isinstance(forest, ForestTable):
        rows = stored(scoring.select(*IDENT, F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "walk-rows")
        depths = tree_growth.walked(rows, forest.nodes, forest.count, IDENT)
        return depths.select(*IDENT, F.pow(F.lit(2.0), -(F.col("depth") / forest.count / norm)).alias("score"))
    shared = scoring.sparkSession.sparkContext.broadcast([np.array(t) for t in forest.trees])
    kinds = ", ".join(f"{i} {dict(scoring.dtypes)[i]}" for i in IDENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, depth = pdf[features].to_numpy(float), np.zeros(len(pdf))
            for t in shared.value:
                at = np.zeros(len(pdf), int)
                while (inner := np.flatnonzero(t[at, 0] >= 0)).size:
                    node = t[at[inner]]
                    below = x[inner, node[:, 0].astype(int)] < node[:, 1]
                    at[inner] = np.where(below, node[:, 2], node[:, 3]).astype(int)
                depth += t[at, 4]
            yield pdf[IDENT].assign(score=2.0 ** -(depth / max(1, len(shared.value)) / norm))

    return scoring.select(*IDENT, *features).mapInPandas(run, f"{kinds}, score double")
