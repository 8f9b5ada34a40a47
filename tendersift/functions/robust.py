"""Order statistics of groups in which each member is compared with all the others.

The others of a member are its group without one equal value.  A type-7 quantile of the
others needs the group's order statistics at three fixed places: the one at place k of
the others is x[k] if x[k] < own value, else x[k + 1].  The median of the others takes at
most three values in a group; for each, the deviations from it are ordered once, and the
same rule gives the median absolute deviation of the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tendersift.joins import attached
from tendersift.storage import stored

#: Median absolute deviation of a normal distribution with standard deviation 1.
NORMAL_MAD = 0.6744897501960817
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def modified_z(value: Column, median: Column, mad: Column) -> Column:
    return F.try_divide(F.lit(NORMAL_MAD) * (value - median), F.nullif(mad, F.lit(0.0)))


def iqr_distance(value: Column, median: Column, iqr: Column) -> Column:
    return F.try_divide(value - median, F.nullif(iqr, F.lit(0.0)))


#: A group of more distinct values than this is ordered in BINS pieces.
LARGE, BINS = 200_000, 64
#: The statistics of up to so many groups are broadcast.
BROADCAST_GROUPS = 200_000


def running_counts(counts: DataFrame, group: list[str], value: str = "value", large: int = LARGE) -> DataFrame:
    """The stored table counts(group, value, n) with before (members with a smaller value) and size (all members).

    No task orders a whole group of more than large values: the values of such groups are
    cut at their own approximate quantiles, and the pieces ordered by their totals.
    """
    rows = counts.select(*group, value, "n")
    before, size = F.sum("n").over(W.partitionBy(*group).orderBy(value)) - F.col("n"), F.sum("n").over(W.partitionBy(*group))
    heavy = rows.groupBy(*group).agg(F.count("*").alias("values")).filter(F.col("values") > large)
    if not heavy.head(1):
        return rows.select(*group, value, "n", size.alias("size"), before.alias("before"))
    heavy = stored(heavy.drop("values"), "large-groups")
    marks = [(i + 1) / BINS for i in range(BINS - 1)]
    edges = stored(rows.join(F.broadcast(heavy), group).groupBy(*group).agg(F.percentile_approx(value, F.lit(marks), F.lit(10 * BINS)).alias("edges")), "edges")
    cut = rows.join(F.broadcast(edges), group, "left").withColumn("bin", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col(value))), F.lit(0))).drop("edges")
    bins = cut.groupBy(*group, "bin").agg(F.sum("n").alias("in_bin"))
    bins = bins.withColumns({"below": F.sum("in_bin").over(W.partitionBy(*group).orderBy("bin")) - F.col("in_bin"), "size": F.sum("in_bin").over(W.partitionBy(*group))})
    inner = F.sum("n").over(W.partitionBy(*group, "bin").orderBy(value)) - F.col("n")
    joined = cut.join(bins.drop("in_bin"), [*group, "bin"])
    return joined.select(*group, value, "n", "size", (F.col("below") + inner).alias("before"))


def _order_statistics(runs: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Per group and quantile: for the others of a member the values at the lower place and the two after it with a weight; and the quantile of all."""
    size, aggs = F.col("size"), [F.max("size").alias("size")]
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))
    for name, p in points.items():
        h, full = (size - 2) * F.lit(p), (size - 1) * F.lit(p)
        aggs += [at(F.floor(h) + k).alias(f"{name}_{k}") for k in range(3)]
        aggs += [F.max(h - F.floor(h)).alias(f"{name}_w"), at(F.floor(full)).alias("_lo_" + name), at(F.floor(full) + 1).alias("_hi_" + name), F.max(full - F.floor(full)).alias("_w_" + name)]
    out = runs.groupBy(*group).agg(*aggs)
    for name in points:
        lo = F.col("_lo_" + name)
        out = out.withColumn(f"{name}_all", lo + (F.coalesce(F.col("_hi_" + name), lo) - lo) * F.col("_w_" + name)).drop(*["_lo_" + name, "_hi_" + name, "_w_" + name])
    return out


def summaries(counts: DataFrame, method: str = "linear") -> DataFrame:
    """group, size, least, q1, median, q3, most, iqr and mad of counts(group, value, n); values are doubles without nulls.

    method: linear interpolates between two places (type 7), nearest_rank takes the value
    at the least place that covers the share; mad uses the same method.
    """
    if method not in ("linear", "nearest_rank"):
        raise ValueError("the methods are linear and nearest_rank")
    counts = stored(counts.select("group", "value", F.col("n").cast("bigint")), "value-counts")

    def quantiles(rows: DataFrame, points: dict[str, float]) -> DataFrame:
        runs, out = running_counts(rows, ["group"]), []
        at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))
        for name, p in points.items():
            if method == "linear":
                place = (F.col("size") - 1) * F.lit(p)
                low, share = at(F.floor(place)), F.max(place - F.floor(place))
                out.append((low + (F.coalesce(at(F.floor(place) + 1), low) - low) * share).alias(name))
            else:
                out.append(at(F.greatest(F.ceil(F.col("size") * F.lit(p)) - 1, F.lit(0))).alias(name))
        return runs.groupBy("group").agg(F.max("size").alias("size"), F.min("value").alias("least"), F.max("value").alias("most"), *out)

    found = stored(quantiles(counts, QUARTILES), "quartiles")
    away = counts.join(found.select("group", "median"), "group").groupBy("group", F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))
    spread = quantiles(stored(away, "deviations"), {"mad": 0.5}).select("group", "mad")
    return found.join(spread, "group").select("group", "size", "least", "q1", "median", "q3", "most", (F.col("q3") - F.col("q1")).alias("iqr"), "mad")


def column_quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...]) -> dict[str, list[float] | None]:
    """The type-7 quantiles of each column's values without nulls, None for a column without values; from counts, so no task holds or orders a whole column."""
    each = F.array(*[F.struct(F.lit(c).alias("group"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.inline(each)).filter("value IS NOT NULL").groupBy("group", "value").agg(F.count("*").alias("n"))
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))
    out = []
    for p in points:
        place = (F.col("size") - 1) * F.lit(float(p))
        low, share = at(F.floor(place)), F.max(place - F.floor(place))
        out.append(low + (F.coalesce(at(F.floor(place) + 1), low) - low) * share)
    found = {r.group: r.q for r in running_counts(stored(counts, "value-counts"), ["group"]).groupBy("group").agg(F.array(*out).alias("q")).collect()}  # one row for each column
    return {c: found.get(c) for c in columns}


def _others(name: str, own: Column) -> Column:
    """The quantile without the value own, or of all if own is null, from the statistics of the whole group."""
    x0, x1, x2, w = (F.col(f"{name}_{k}") for k in (0, 1, 2, "w"))
    low = F.when(x0 < own, x0).otherwise(x1)
    high = F.coalesce(F.when(x1 < own, x1).otherwise(x2), low)
    return F.when(own.isNull(), F.col(f"{name}_all")).otherwise(low + (high - low) * w)


def compare(targets: DataFrame, counts: DataFrame, ident: list[str], inside: bool = False) -> DataFrame:
    """targets(ident, group, value, own) against the members of their groups without one that equals own.

    counts: group, value, n (members with that value); doubles without nulls.  own null:
    nothing is left out.  Adds peers, less, equal, position (equal values count half), q1,
    median, q3, iqr, mad, z and distance; z and distance are null where mad or iqr is 0,
    all but the counts where there are no peers.  inside: each target is a member, own is
    its value, which saves adding the targets' values to the counts.
    """
    counts = stored(counts.select("group", "value", F.col("n").cast("bigint")), "value-counts")
    known = counts
    if not inside:
        asked = targets.select("group", "value", F.lit(0).cast("bigint").alias("n")).distinct()
        known = stored(counts.union(asked).groupBy("group", "value").agg(F.sum("n").alias("n")), "asked-counts")
    runs = stored(running_counts(known, ["group"]), "running-counts")
    stats = stored(_order_statistics(runs, ["group"], "value", QUARTILES), "order-statistics")
    own, value = F.col("own"), F.col("value")

    mid = lambda a, b: F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * F.col("median_w")
    centers = [mid("median_0", "median_1"), mid("median_0", "median_2"), mid("median_1", "median_2"), *([] if inside else [F.col("median_all")])]
    candidates = stats.select("group", F.explode(F.array_distinct(F.array(*centers))).alias("center")).filter("center IS NOT NULL")  # the medians that others of the group can have
    candidates = F.broadcast(candidates) if stats.count() <= BROADCAST_GROUPS else candidates
    away = counts.join(candidates, "group").groupBy("group", "center", F.abs(value - F.col("center")).alias("away")).agg(F.sum("n").alias("n"))
    spread = _order_statistics(running_counts(stored(away, "deviations"), ["group", "center"], "away"), ["group", "center"], "away", {"mad": 0.5}).drop("size")

    # Many rows may share a group and its center, so neither join sends them to one task.
    rows = targets.select(*ident, "group", "value", "own").join(runs.select("group", "value", "n", "before"), ["group", "value"])
    rows = attached(rows, stats, "group", "value", limit=BROADCAST_GROUPS).withColumn("center", _others("median", own))
    rows = attached(rows, stored(spread, "spreads"), ["group", "center"], "value", limit=4 * BROADCAST_GROUPS)
    rows = rows.withColumns({q: _others(q, own) for q in QUARTILES})
    rows = rows.withColumns({"mad": _others("mad", F.abs(own - F.col("median"))), "iqr": F.col("q3") - F.col("q1")})
    out = lambda condition: F.coalesce(condition.cast("int"), F.lit(0))
    peers, less, equal = F.col("size") - out(own.isNotNull()), F.col("before") - out(own < value), F.col("n") - out(own == value)
    return rows.select(
        *ident,
        "group",
        "value",
        peers.alias("peers"),
        less.alias("less"),
        equal.alias("equal"),
        F.try_divide(less + equal / 2, peers).alias("position"),
        *[F.when(peers > 0, F.col(c)).alias(c) for c in ("q1", "median", "q3", "iqr", "mad")],
        F.when(peers > 0, modified_z(value, F.col("median"), F.col("mad"))).alias("z"),
        F.when(peers > 0, iqr_distance(value, F.col("median"), F.col("iqr"))).alias("distance"),
    )


def leave_one_out(members: DataFrame, ident: list[str]) -> DataFrame:
    """Each member of members(ident, group, value) against the others of its group."""
    counts = members.groupBy("group", "value").agg(F.count("*").alias("n"))
    return compare(members.withColumn("own", F.col("value")), counts, ident)


#: Members and targets of a group that one task may hold beside others, and of the groups of a task on average.
GROUP_ROWS, TASK_ROWS = 200_000, 100_000


def _quantile_of(x: np.ndarray, start: np.ndarray, size: np.ndarray, left_out: np.ndarray, own: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """_others() of rows: the quantile of each row's group without own, or of all where none is left out; and which of the pairs of places it lies between.

    x: the members' values, ordered in each group; start and size: of the row's group.
    """

    def at(place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < size)
        return np.where(inside, x[np.where(inside, start + place, 0)] if len(x) else np.nan, np.nan)

    h = np.where(left_out, (size - 2) * p, (size - 1) * p)
    place = np.floor(h).astype(np.int64)
    x0, x1, x2 = (at(place + k) for k in range(3))
    low = np.where(left_out & ~(x0 < own), x1, x0)
    high = np.where(left_out & ~(x1 < own), x2, x1)
    pair = np.where(left_out, np.where(x1 < own, 0, np.where(x0 < own, 1, 2)), 3)
    return low + (np.where(np.isnan(high), low, high) - low) * (h - np.floor(h)), pair


def _compared_rows(group: np.ndarray, value: np.ndarray, member: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """position, z and distance of the rows that are not members, as of compare(), nan for null; left_out: whether one member equal to the row is left out."""
    group = np.unique(group, return_inverse=True)[1]
    order = np.lexsort((value, group))
    order = order[member[order]]
    of, x = group[order], value[order]
    t = np.flatnonzero(~member)
    g, v, out = group[t], value[t], left_out[t]
    first = np.searchsorted(of, np.arange(group.max() + 2))
    start, size = first[g], (first[1:] - first[:-1])[g]
    # A target's place among the members of its group, from the order of all rows.
    every = np.lexsort((value, group))
    run = np.empty(len(every), np.int64)
    new = (group[every[1:]] != group[every[:-1]]) | (value[every[1:]] != value[every[:-1]])
    run[every] = np.cumsum(np.r_[True, new]) - 1
    times = np.bincount(run[member], minlength=run.max() + 1)
    less, equal = (np.cumsum(times) - times)[run[t]] - start, times[run[t]] - out
    own = np.where(out, v, np.nan)
    q1, median, q3 = (_quantile_of(x, start, size, out, own, p) for p in QUARTILES.values())
    middle, pair = median
    mad = np.full(len(t), np.nan)
    for k in np.unique(pair):  # the targets of a group that lie in the same place have the same median
        rows = np.flatnonzero(pair == k)
        center = np.full(len(first) - 1, np.nan)
        center[g[rows]] = middle[rows]
        away = np.abs(x - center[of])
        away = away[np.lexsort((away, of))]
        mad[rows] = _quantile_of(away, start[rows], size[rows], out[rows], np.abs(own - middle)[rows], 0.5)[0]
    peers, iqr = size - out, q3[0] - q1[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        none = peers <= 0
        position = np.where(none, np.nan, (less + equal / 2) / peers)
        z = np.where(none | (mad == 0), np.nan, NORMAL_MAD * (v - middle) / mad)
        distance = np.where(none | (iqr == 0), np.nan, (v - middle) / iqr)
    return position, z, distance


def compared_values(x: np.ndarray, value: np.ndarray, left_out: bool) -> dict[str, np.ndarray]:
    """peers, position, z and distance of the values against the ordered members x of one group, as of compare(), nan for null; left_out: each value is a member, which is left out of its own group."""
    none = np.zeros(len(value), np.int64)
    if not len(x):
        return {"peers": none, **{k: np.full(len(value), np.nan) for k in ("position", "z", "distance")}}
    size, out = none + len(x), none.astype(bool) | left_out
    own = np.where(out, value, np.nan)
    q1, median, q3 = (_quantile_of(x, none, size, out, own, p)[0] for p in QUARTILES.values())
    mad = np.full(len(value), np.nan)
    for m in np.unique(median[~np.isnan(median)]):  # at most three
        rows = np.flatnonzero(median == m)
        mad[rows] = _quantile_of(np.sort(np.abs(x - m)), none[rows], size[rows], out[rows], np.abs(own[rows] - m), 0.5)[0]
    less = np.searchsorted(x, value, "left")
    equal, peers, iqr = np.searchsorted(x, value, "right") - less - left_out, size - left_out, q3 - q1
    with np.errstate(divide="ignore", invalid="ignore"):
        position = np.where(peers > 0, (less + equal / 2) / peers, np.nan)
        z = np.where((peers > 0) & (mad != 0), NORMAL_MAD * (value - median) / mad, np.nan)
        distance = np.where((peers > 0) & (iqr != 0), (value - median) / iqr, np.nan)
    return {"peers": peers, "position": position, "z": z, "distance": distance}


def compared_in_groups(targets: DataFrame, members: DataFrame, ident: str, values: list[str], rows: int) -> DataFrame:
    """ident and, for each of the values, position, z and distance as <value>_position ...: compare() of several values at once, of groups that fit a task.

    targets: ident, group (long), the values and left_out (whether one member equal to the row is
    left out); members: group and values; null values are not compared and not members.  rows:
    of both together.  Whole groups are dealt over tasks of TASK_ROWS rows on average, so a row is
    shuffled once for all values; no group may have more than GROUP_ROWS rows or so.
    """
    c = F.col
    kind = dict(targets.dtypes)[ident]
    names = [f"{v}_{k}" for v in values for k in ("position", "z", "distance")]
    every = targets.select(ident, "group", *values, "left_out").unionByName(members.select(F.lit(None).cast(kind).alias(ident), "group", *values, F.lit(None).cast("boolean").alias("left_out")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["left_out"]
        member, out, group = left.isna().to_numpy(), (left == True).to_numpy(bool), pdf["group"].to_numpy()  # noqa: E712
        found = {n: np.full(len(pdf), np.nan) for n in names}
        for v in values:
            value = pdf[v].to_numpy(float)
            there = np.flatnonzero(~np.isnan(value))
            if (asked := there[~member[there]]).size:
                for k, x in zip(("position", "z", "distance"), _compared_rows(group[there], value[there], member[there], out[there]), strict=True):
                    found[f"{v}_{k}"][asked] = x
        return pd.DataFrame({ident: pdf[ident], **found})[~member]

    task = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(max(1, rows // TASK_ROWS))).alias("task")
    done = every.select("*", task).groupBy("task").applyInPandas(run, f"{ident} {kind}, {', '.join(f'{n} double' for n in names)}")
    return done.select(ident, *[F.nanvl(c(n), F.lit(None).cast("double")).alias(n) for n in names])
