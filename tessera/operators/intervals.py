"""Interval merge, linkage clustering, range joins and coverage.

A genome has few chromosomes, so a window over a chromosome alone would put a tenth of all rows in
one task. Every operator here therefore works in two levels: rows are first reduced inside
(key, coordinate bin), and windows over a key hold one row for each bin. number_groups and
share_gaps take merged groups, whose number a genome bounds, not the reads.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

BIN = 1 << 16
SLAB = 100_000  # intervals gathered in a row
ALIKE = 1000  # rows of one place gathered in a row


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str, extra: int, into: str) -> DataFrame:
    """df with the number of its island inside keys: a new one begins where start > every earlier end + extra."""
    w = Window.partitionBy(*_cols(keys)).orderBy(F.col(start), F.col(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + extra), 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_fresh", fresh).withColumn(into, F.sum("_fresh").over(running)).drop("_fresh")


def _across_bins(local: DataFrame, keys: Sequence[str], extra: int) -> DataFrame:
    """local (keys, _bin, _s, _e: islands inside bins) with _g, the first start of the group that each island falls in.

    What reaches into a bin from the left is the largest end of all bins before it. An island that begins beyond it
    begins a group; others belong to the last group begun, in this bin or an earlier one. In each bin
    that last one can only be the island that begins last, so one window over bins (of which a key has as many as its
    length allows) finds both what reaches in and what is open, and one join brings them to the islands.
    """
    on = [*keys, "_bin"]
    before = Window.partitionBy(*_cols(keys)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = local.groupBy(*_cols(on)).agg(F.max("_e").alias("_m"), F.max("_s").alias("_top")).withColumn("_reach", F.max("_m").over(before))
    fresh = lambda s: F.when(F.col("_reach").isNull() | (F.col(s) > F.col("_reach") + extra), F.col(s))
    bins = bins.withColumn("_last", fresh("_top")).withColumn("_open", F.max("_last").over(before)).drop("_m", "_top", "_last")
    rows = _by_bin(local, bins, keys).withColumn("_fresh", fresh("_s"))
    own = F.max("_fresh").over(Window.partitionBy(*_cols(on)).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_g", F.coalesce(own, F.col("_open"))).drop("_fresh", "_open", "_reach")


def _by_bin(rows: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the other columns of their (keys, _bin) row of bins; null keys are equal."""
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_bin"])}
    right = bins.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in bins.columns])
    cond = F.col("_bin") == F.col(names["_bin"])
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(names[k]))
    return rows.join(right, cond).drop(*names.values())


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", extra: int = 0, bin_width: int = BIN) -> DataFrame:
    """Groups (keys, g_start, g_end, n) of intervals closer than extra; n counts the intervals.

    Intervals with a null start or end belong to no group.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.select(*_cols(keys), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    rows = rows.withColumn("_bin", F.floor(F.col("_s") / bin_width))
    local = _islands(rows, [*keys, "_bin"], "_s", "_e", extra, "_i")
    local = local.groupBy(*_cols(keys), "_bin", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count("*").alias("_n"))
    wide = _across_bins(local, keys, extra)
    return wide.groupBy(*_cols(keys), "_g").agg(F.min("_s").alias("g_start"), F.max("_e").alias("g_end"), F.sum("_n").alias("n")).drop("_g")


def number_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """group_id: consecutive from 1 over keys in order, then start. Two levels: by key, then an offset for each key."""
    w = Window.partitionBy(*_cols(keys)).orderBy("g_start", "g_end")
    sizes = groups.groupBy(*_cols(keys)).agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(*_cols(keys)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_before"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = groups.withColumn("_r", F.row_number().over(w)).join(sizes, cond)
    return out.withColumn("group_id", (F.col("_r") + F.col("_before")).cast("long")).drop("_r", "_before", *[f"_k{i}" for i in range(len(keys))])


def share_gaps(groups: DataFrame, keys: Sequence[str], first_start: int = 0) -> DataFrame:
    """Groups widened to their neighbours' edges: from the end before + 1 to the next start - 1.

    Neighbours thus overlap in the gap between them. The first begins at first_start; the last keeps its end.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy("g_start", "g_end")
    start = F.coalesce(F.lag("g_end").over(w) + 1, F.lit(first_start).cast("long"))
    end = F.coalesce(F.lead("g_start").over(w) - 1, F.col("g_end"))
    return groups.select(*_cols(keys), start.alias("w_start"), end.alias("w_end"), "g_start", "g_end")


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_start: str, a_end: str, b_start: str, b_end: str, bin_width: int = BIN, how: str = "overlap") -> DataFrame:
    """Pairs of a and b rows of equal keys whose closed intervals overlap (or, how="contains": b contains a).

    Both sides are put in the bins that they touch and meet by (keys, bin); a pair that shares
    several bins is kept only in the one where the later of the two starts lies, so there is no
    distinct. b's keys don't return; other names must differ.
    """
    left = a.withColumn("_bin", F.explode(_bins(F.col(a_start), F.col(a_end), bin_width)))
    if how == "contains":  # the containing row touches the bin of a's start
        left = a.withColumn("_bin", F.floor(F.col(a_start) / bin_width))
    right = b.select(*[F.col(f"`{k}`").alias(f"_b_{k}") for k in keys], *[F.col(f"`{c}`") for c in b.columns if c not in keys], F.explode(_bins(F.col(b_start), F.col(b_end), bin_width)).alias("_bbin"))
    cond = F.col("_bin") == F.col("_bbin")
    for k in keys:
        cond = cond & (F.col(f"`{k}`") == F.col(f"`_b_{k}`"))
    if how == "contains":
        cond = cond & (F.col(b_start) <= F.col(a_start)) & (F.col(a_end) <= F.col(b_end))
    else:
        cond = cond & (F.col(b_start) <= F.col(a_end)) & (F.col(a_start) <= F.col(b_end)) & (F.col("_bin") == F.floor(F.greatest(a_start, b_start) / bin_width))
    return left.join(right, cond).drop("_bin", "_bbin", *[f"_b_{k}" for k in keys])


def span_width(b: DataFrame, start: str, end: str) -> int:
    """A bin width that suits b: a quarter of its mean length, so that b takes a few bins a row and a bin holds little that meets nothing."""
    mean = b.agg(F.avg(F.col(end).cast("double") - F.col(start))).first()[0]
    return max(1, int((mean or 0) / 4))


def holders(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, a_start: str, a_end: str, b_start: str, b_end: str, name: str, into: str, slab: int = SLAB, alike: int = ALIKE, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """a with `into`: the sorted distinct names of the b rows of equal keys that contain it, or what shown makes of them.

    a_id tells a's rows apart. b's rows of a bin (span_width) are gathered in a list, and a row of a meets the list of its
    start's bin; rows of a with equal keys, start and end meet it once, in lots of at most `alike`. So no pair is shuffled, and
    none is stored. Lists hold at most `slab` rows: a bin of more has several, whose names are put together in the task that met them.
    """
    width = span_width(b, b_start, b_end)
    item = F.struct(F.col(name).alias("v"), F.col(b_start).cast("long").alias("x"), F.col(b_end).cast("long").alias("y"))
    each = b.select(*_cols(keys), item.alias("_t")).distinct().withColumn("_bin", F.explode(_bins(F.col("_t.x"), F.col("_t.y"), width)))
    on = [*keys, "_bin"]
    bin_of = Window.partitionBy(*_cols(on))
    each = each.withColumn("_slab", F.floor((F.row_number().over(bin_of.orderBy("_t.v")) - 1) / slab)).withColumn("_several", F.count("*").over(bin_of) > slab)
    lists = each.groupBy(*_cols(on), "_slab", "_several").agg(F.sort_array(F.collect_list("_t")).alias("_list"))
    lists = stored(lists.withColumn("_twice", F.size(F.array_distinct("_list.v")) < F.size("_list")))

    rest = [c for c in a.columns if c not in (*keys, a_start, a_end)]
    place = [*on, a_start, a_end, "_lot"]
    rows = a.withColumn("_bin", F.floor(F.col(a_start) / width)).repartition(*_cols(on))  # all that follows needs no other shuffle of them
    lot = F.row_number().over(Window.partitionBy(*_cols(place[:-1])).orderBy(a_id))
    rows = rows.withColumn("_lot", F.floor((lot - 1) / alike)).groupBy(*_cols(place)).agg(F.collect_list(F.struct(*_cols(rest))).alias("_rows"))
    rows = rows.withColumns({"_from": F.col(a_start).cast("long"), "_to": F.col(a_end).cast("long")}).join(lists, on, "left")
    fits = F.transform(F.filter("_list", lambda t: (F.col("_to") <= t["y"]) & (t["x"] <= F.col("_from"))), lambda t: t["v"])
    none = F.array().cast("array<string>")
    rows = rows.withColumn(into, F.coalesce(F.when(F.col("_twice"), F.array_distinct(fits)).otherwise(fits), none))
    out = rows
    if not lists.where("_several").isEmpty():
        parts = rows.where("_several").groupBy(*_cols(place)).agg(F.first("_rows").alias("_rows"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(into)))).alias(into))
        out = rows.where("_several is null or not _several").select(*parts.columns).unionByName(parts)
    out = out if shown is None else out.withColumn(into, shown(F.col(into)))
    return out.withColumn("_row", F.explode("_rows")).select(*[F.col(f"_row.`{c}`" if c in rest else f"`{c}`") for c in a.columns], into)


def linkage_clusters(df: DataFrame, keys: Sequence[str], position: str, gap: int, into: str, bin_width: int = BIN) -> DataFrame:
    """df with `into`: the smallest position of its single-linkage cluster, where neighbours are at most gap apart."""
    rows = df.withColumn("_bin", F.floor(F.col(position) / bin_width))
    local = _islands(rows, [*keys, "_bin"], position, position, gap, "_i")
    heads = local.groupBy(*_cols(keys), "_bin", "_i").agg(F.min(position).alias("_s"), F.max(position).alias("_e"))
    heads = _across_bins(heads, keys, gap)
    heads = heads.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_kb"), F.col("_i").alias("_ki"), F.col("_g").alias(into))
    cond = (F.col("_bin") == F.col("_kb")) & (F.col("_i") == F.col("_ki"))
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return local.join(heads, cond).drop("_bin", "_i", "_kb", "_ki", *[f"_k{i}" for i in range(len(keys))])


def two_level_clusters(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 35) -> DataFrame:
    """df with cluster_start and cluster_end_key: linkage by start, then by end inside each start cluster; rank_by_end orders a cluster."""
    out = linkage_clusters(df, keys, start, gap, "cluster_start")
    out = linkage_clusters(out, [*keys, "cluster_start"], end, gap, "cluster_end_key")
    w = Window.partitionBy(*_cols(keys), "cluster_start", "cluster_end_key").orderBy(end, start)
    return out.withColumn("rank_by_end", F.row_number().over(w).cast("long"))


def cluster_extents(clustered: DataFrame, keys: Sequence[str], start: str, end: str, first: str = "c_start", last: str = "c_end", **also: Column) -> DataFrame:
    """(keys, cluster_start, cluster_end_key, first, last) of two_level_clusters' rows, and further aggregates by name."""
    by = [*_cols(keys), F.col("cluster_start"), F.col("cluster_end_key")]
    return clustered.groupBy(*by).agg(F.min(start).alias(first), F.max(end).alias(last), *[c.alias(n) for n, c in also.items()])


def running_sum(df: DataFrame, keys: Sequence[str], position: str, value: str, into: str, bin_width: int = BIN) -> DataFrame:
    """df with the sum of value over rows of the key up to each position (inclusive); positions are unique inside keys."""
    rows = df.withColumn("_bin", F.floor(F.col(position) / bin_width))
    sums = rows.groupBy(*_cols(keys), "_bin").agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*_cols(keys)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_kb"), F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_before"))
    cond = F.col("_bin") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(value).over(Window.partitionBy(*_cols(keys), "_bin").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(into, inside).join(sums, cond).withColumn(into, F.col(into) + F.col("_before")).drop("_bin", "_kb", "_before", *[f"_k{i}" for i in range(len(keys))])


def coverage_segments(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: str, bin_width: int = BIN) -> DataFrame:
    """(keys, seg_start, seg_end, depth): maximal runs of equal summed weight > 0 under half-open intervals.

    Weights are summed as decimals with 6 places, so that a depth that returns to a value is equal to it.
    """
    w = F.col(weight).cast("decimal(28,6)")
    ends = df.select(*_cols(keys), F.explode(F.array(F.struct(F.col(start).cast("long").alias("p"), w.alias("d")), F.struct(F.col(end).cast("long").alias("p"), (-w).cast("decimal(28,6)").alias("d")))).alias("x"))
    steps = ends.groupBy(*_cols(keys), F.col("x.p").alias("seg_start")).agg(F.sum("x.d").alias("_d")).where("_d <> 0")
    depth = running_sum(steps, keys, "seg_start", "_d", "depth", bin_width)
    depth = depth.withColumn("_bin", F.floor(F.col("seg_start") / bin_width))
    own = Window.partitionBy(*_cols(keys), "_bin").orderBy("seg_start")
    firsts = depth.groupBy(*_cols(keys), "_bin").agg(F.min("seg_start").alias("_first"))
    nxt = F.lead("_first").over(Window.partitionBy(*_cols(keys)).orderBy("_bin"))
    firsts = firsts.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_kb"), nxt.alias("_next"))
    cond = F.col("_bin") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = depth.withColumn("_lead", F.lead("seg_start").over(own)).join(firsts, cond)
    return out.where("depth > 0").select(*_cols(keys), "seg_start", F.coalesce("_lead", "_next").alias("seg_end"), F.col("depth").cast("double").alias("depth"))
