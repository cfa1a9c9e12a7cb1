"""Counts: support, proportional splits, expectation maximisation, normalisation, comparison and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import absolute_difference, c_round, ratio_difference
from ..ordering import attach
from ..storage import stored


def distinct_support(df: DataFrame, keys: Sequence[str], reader: str, perfect: str) -> DataFrame:
    """(keys, n_perfect, n_all): distinct readers, and those perfect at least once. Two partial aggregations, no sets."""
    once = df.groupBy(*keys, reader).agg(F.max(F.col(perfect).cast("int")).alias("_p"))
    return once.groupBy(*keys).agg(F.sum("_p").cast("long").alias("n_perfect"), F.count("*").alias("n_all"))


def high_confidence(tag: Column, n_perfect: Column, n_all: Column, least: int, ratio: float) -> Column:
    """Annotated (tag 2), or with a motif (tag 1) and enough perfect reads."""
    return (tag == 2) | ((tag == 1) & (n_perfect >= least) & (n_perfect >= n_all * ratio))


def best_record(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_margin(df: DataFrame, keys: Sequence[str], value: str, *tie: str, into: str = "best") -> DataFrame:
    """(keys, into: the row of the largest value as a struct, then by least tie; second: the next value, null for none)."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *[F.asc(t) for t in tie])
    top = df.withColumn("_at", F.row_number().over(w)).where("_at <= 2")
    row = lambda i, x: F.max(F.when(F.col("_at") == i, x))
    return top.groupBy(*keys).agg(F.first(F.when(F.col("_at") == 1, F.struct(*rest)), ignorenulls=True).alias(into), row(2, F.col(value)).alias("second"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys only a has, only b has, and both have."""
    side = lambda df, name: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(1))
    x = side(a, "_a").join(side(b, "_b"), key, "full_outer")
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return x.agg(count(F.col("_b").isNull(), "only_a"), count(F.col("_a").isNull(), "only_b"), count(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both"))


def proportional_split(df: DataFrame, keys: Sequence[str], weight: str, total: str, into: str, copies: str | None = None) -> DataFrame:
    """df with total shared out inside keys by weight (equally where all weights are 0), to 2 places as C prints them; copies: how often a row stands (1), each with that share."""
    w = Window.partitionBy(*keys)
    times = F.lit(1) if copies is None else F.col(copies)
    whole = F.sum(F.col(weight) * times).over(w)
    share = F.when(whole == 0, 1 / F.sum(times).over(w)).otherwise(F.try_divide(F.col(weight), whole))
    return df.withColumn(into, c_round(share * F.col(total)))


def per_million(df: DataFrame, sample: str, value: str, into: str) -> DataFrame:
    """df with value per million of its sample's total, 2 places; 0 where the total is 0."""
    totals = df.groupBy(F.col(sample).alias("_s")).agg(F.sum(value).alias("_t"))
    out = df.join(totals, F.col(sample).eqNullSafe(F.col("_s")), "left")
    return out.withColumn(into, c_round(F.coalesce(F.try_divide(F.col(value) * 1e6, F.col("_t")), F.lit(0.0)))).drop("_s", "_t")


#: Evidence rows (one for each target) that one task may hold; groups with more are iterated as joins.
EM_ROWS = 500_000


def _c2(x: np.ndarray) -> np.ndarray:
    """Two places as C prints them: the exact binary value, half to even."""
    near = np.round(x, 2)
    tie = np.flatnonzero(np.abs(np.abs(x * 100 - np.floor(x * 100)) - 0.5) < np.maximum(1e-6, np.abs(x) * 1e-10))  # only near a half can the two differ
    if len(tie):
        near[tie] = [float(f"{v:.2f}") for v in x[tie].tolist()]
    return near


def em_rounds(direct: np.ndarray, evidence: np.ndarray, target: np.ndarray, n: np.ndarray, unit: np.ndarray, max_iterate: int = 100, converged: float = 0.1, per_read: bool = False, trace: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """(the targets' values in each round of expectation maximisation, from round 0 (the last alone without trace); each unit's last round).

    direct: count of each target; unit: its stop test's number; evidence, target, n: for each evidence row and each of its
    targets, the evidence's number, the target's place in direct and the count. An evidence's count is split by its
    targets' current values (equally where they are all 0), each share to 2 places; new values are direct plus
    shares, to 2 places. The sum of more than two values is rounded to 2 places, as it depends on their order; that of two is
    taken as it is. A unit ends when none of its values moves by as much as converged, or after max_iterate
    rounds. per_read: what is split is one read of each evidence, and values are rounded only to compare them.
    """
    rounds, units = [direct.astype(float)], int(unit.max()) + 1 if len(unit) else 0
    last, live = np.zeros(units, int), np.ones(units, bool)
    size = np.bincount(evidence).astype(float) if len(evidence) else np.zeros(0)
    for r in range(1, max_iterate + 1):
        if not live.any():
            break
        now, rows = rounds[-1], np.flatnonzero(live[unit[target]])
        e, t, alone = evidence[rows], target[rows], np.ones(len(rows)) if per_read else n[rows]
        total = np.bincount(e, weights=now[t], minlength=len(size))[e]
        total = total if per_read else np.where(size[e] > 2, np.round(total, 2), total)  # whatever the order of rows: two values have one sum
        part, some = alone / size[e], total > 0  # equal where all are 0
        part[some] = alone[some] * (now[t][some] / total[some])
        part = n[rows] * _c2(part) if per_read else _c2(part)
        new = direct + np.bincount(t, weights=part, minlength=len(direct))
        new = np.where(live[unit], new if per_read else _c2(new), now)
        moved = np.zeros(units)
        np.maximum.at(moved, unit, _c2(np.abs(new - now)))
        rounds = [*rounds, new] if trace else [new]
        last[live] = r
        live &= moved >= converged
    return rounds, last


def em_allocate(direct: DataFrame, evidence: DataFrame, group: str, target: str, count: str = "n", max_iterate: int = 100, converged: float = 0.1, per_read: bool = False, trace: bool = False, rows_in_task: int = EM_ROWS) -> DataFrame:
    """(group, target, em), with trace (group, round, target, em) of every round from 0.

    direct: (group, target, n); evidence: (group, evidence, target, n), a row for each target of an evidence and
    n the same in all of them. group is the unit of the stop test. Targets without a direct row start at 0. See
    em_rounds for a round. Groups of at most rows_in_task evidence rows are iterated in tasks of about so many rows,
    in numpy; larger ones all together, a join and two aggregations a round, until the last of them stops. Both
    inputs should be stored.
    """
    start = direct.groupBy(group, target).agg(F.sum(count).cast("double").alias("n"))
    rows = evidence.select(group, "evidence", target, F.col(count).cast("double").alias("n"))
    sizes = stored(rows.groupBy(group).agg(F.count("*").alias("_rows")))
    large = sizes.where(F.col("_rows") > rows_in_task).select(group)
    many, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    names = [group, "round", target, "em"] if trace else [group, target, "em"]
    kind = {f.name: f.dataType.simpleString() for f in direct.schema}
    schema = ", ".join(f"{c} {'int' if c == 'round' else 'double' if c == 'em' else kind[c]}" for c in names)
    bundles = max(int(direct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(many or 0) // max(rows_in_task, 1)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([a[[group, target]], b[[group, target]]], ignore_index=True)
        place = both.groupby([group, target], sort=False).ngroup().to_numpy()
        first = both[~both.duplicated()].reset_index(drop=True)
        value = np.zeros(len(first))
        value[place[: len(a)]] = a["n"].to_numpy()
        of = b.groupby([group, "evidence"], sort=False).ngroup().to_numpy() if len(b) else np.zeros(0, int)
        unit = pd.factorize(first[group])[0]
        rounds, last = em_rounds(value, of, place[len(a) :], b["n"].to_numpy(), unit, max_iterate, converged, per_read, trace)
        out = []
        for r, v in enumerate(rounds):
            shown = first[last[unit] >= r] if trace else first
            out.append(shown.assign(round=r, em=v[shown.index]))
        return pd.concat(out, ignore_index=True)[names]

    none = (most or 0) <= rows_in_task
    small = lambda d: (d if none else d.join(F.broadcast(large), group, "left_anti")).withColumn("_bundle", F.pmod(F.xxhash64(group), F.lit(bundles)))
    done = small(start).groupBy("_bundle").cogroup(small(rows).groupBy("_bundle")).applyInPandas(run, schema)
    if none:
        return done
    big = _em_joins(start.join(F.broadcast(large), group), rows.join(F.broadcast(large), group), group, target, max_iterate, converged, per_read)
    return done.unionByName(big.select(*names) if trace else big.withColumn("_last", F.max("round").over(Window.partitionBy(group, target))).where("round = _last").select(*names))


def _em_joins(start: DataFrame, rows: DataFrame, group: str, target: str, max_iterate: int, converged: float, per_read: bool) -> DataFrame:
    """em_rounds of many groups at once, as (group, round, target, em): each round is written, and groups that stopped take no part in the next."""
    rows = stored(rows.withColumn("_of", F.count("*").over(Window.partitionBy(group, "evidence"))))
    held = stored(rows.groupBy(group, target).agg(F.count("*").alias("_n")))
    total = rows.count()
    every = start.select(group, target, "n").unionByName(held.select(group, target, F.lit(0.0).alias("n"))).groupBy(group, target).agg(F.sum("n").alias("direct"))
    every = stored(every.withColumn("em", F.col("direct")).withColumn("round", F.lit(0)))
    out, now = every, every
    for r in range(1, max_iterate + 1):
        known = stored(held.join(now.select(group, target, "em"), [group, target]))
        live = rows if r == 1 else rows.join(F.broadcast(now.select(group).distinct()), group)
        each = attach(live, known, [group, target], total)
        total_of = F.sum("em") if per_read else F.when(F.max("_of") > 2, F.round(F.sum("em"), 2)).otherwise(F.sum("em"))
        sums = each.groupBy(group, "evidence").agg(total_of.alias("_sum"))
        alone = F.lit(1.0) if per_read else F.col("n")
        part = c_round(F.when(F.col("_sum") > 0, alone * F.try_divide("em", "_sum")).otherwise(alone / F.col("_of")))
        part = F.col("n") * part if per_read else part
        parts = stored(each.join(sums, [group, "evidence"]).select(group, target, part.alias("part"))).groupBy(group, target).agg(F.sum("part").alias("part"))
        new = F.col("direct") + F.coalesce("part", F.lit(0.0))
        moved = now.join(parts, [group, target], "left").select(group, target, "direct", F.col("em").alias("before"), (new if per_read else c_round(new)).alias("em"), F.lit(r).alias("round"))
        moved = stored(moved)
        out = out.unionByName(moved.drop("before"))
        going = moved.groupBy(group).agg(F.max(c_round(F.abs(F.col("em") - F.col("before")))).alias("_m")).where(F.col("_m") >= converged).select(group)
        now = stored(moved.drop("before").join(F.broadcast(going), group, "left_semi"))
        if now.isEmpty():
            break
    return out.select(group, "round", target, "em")


def full_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join on keys (null keys match nothing) with <value>_a and <value>_b; null is absence."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, list(keys), "full_outer")


def set_compare(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """Keys whose item sets differ: only_a, only_b and both, each sorted."""
    left, right = a.select(key, F.col(items).alias("_a")), b.select(key, F.col(items).alias("_b"))
    none = F.array().cast(a.schema[items].dataType)
    x, y = F.coalesce("_a", none), F.coalesce("_b", none)
    out = left.join(right, key, "full_outer").select(key, F.array_sort(F.array_except(x, y)).alias("only_a"), F.array_sort(F.array_except(y, x)).alias("only_b"), F.array_sort(F.array_intersect(x, y)).alias("both"))
    return out.where((F.size("only_a") > 0) | (F.size("only_b") > 0))


def with_differences(df: DataFrame, value: str) -> DataFrame:
    a, b = (F.coalesce(F.col(f"{value}_{x}"), F.lit(0.0)) for x in "ab")
    return df.withColumn("abs_diff", absolute_difference(a, b)).withColumn("ratio_diff", ratio_difference(a, b))


def bh_fdr(df: DataFrame, p: str, into: str, *tie: str) -> DataFrame:
    """df with Benjamini-Hochberg adjusted p values over all rows.

    The global rank comes from equal-p groups: p values are counted first, and only the distinct
    ones meet in a running sum, in ranges of p. Equal p values get the same adjusted value.
    """
    tests = df.agg(F.count(p)).first()[0]
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_bin", F.floor(-F.log10(F.greatest(F.col("_p"), F.lit(1e-300))) * 64))
    sums = counts.groupBy("_bin").agg(F.sum("_c").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("_bin").orderBy("_p")
    ranked = counts.join(sums.select("_bin", before.alias("_before")), "_bin").withColumn("_rank", F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    ranked = ranked.withColumn("_q", F.col("_p") * F.lit(tests) / F.col("_rank"))
    lows = ranked.groupBy("_bin").agg(F.min("_q").alias("_low"))
    later = F.min("_low").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.join(lows.select("_bin", later.alias("_later")), "_bin")
    tail = F.min("_q").over(own.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.select("_p", F.least(tail, F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias(into))
    return df.join(ranked, F.col(p) == F.col("_p"), "left").drop("_p")


def chi_square(df: DataFrame, keys: Sequence[str], row: str, column: str, value: str) -> DataFrame:
    """(keys, chi2, dof) of each key's row x column table; Yates' correction where dof is 1, as is usual."""
    cell = df.groupBy(*keys, row, column).agg(F.sum(value).cast("double").alias("o"))
    rows, cols = Window.partitionBy(*keys, row), Window.partitionBy(*keys, column)
    r = cell.groupBy(*keys, row).agg(F.sum("o").alias("r"))
    c = cell.groupBy(*keys, column).agg(F.sum("o").alias("c"))
    t = cell.groupBy(*keys).agg(F.sum("o").alias("t"))
    shape = r.groupBy(*keys).agg(F.count("*").alias("nr")).join(c.groupBy(*keys).agg(F.count("*").alias("nc")), list(keys)).join(t, list(keys))
    grid = r.join(c, list(keys)).join(cell, [*keys, row, column], "left").join(shape, list(keys))
    expected = F.col("r") * F.col("c") / F.col("t")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    off = F.abs(F.coalesce("o", F.lit(0.0)) - expected)
    off = F.when(dof == 1, off - F.least(off, F.lit(0.5))).otherwise(off)
    return grid.groupBy(*keys).agg(F.sum(F.try_divide(off * off, expected)).alias("chi2"), F.first(dof).alias("dof"))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - lead * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, dof: float) -> float:
    """P(X >= x) of the chi-square distribution."""
    return _gamma_q(dof / 2, x / 2)


def chi2_ppf(q: float, dof: float) -> float:
    """x with P(X <= x) = q."""
    low, high = 0.0, 1.0
    while 1 - chi2_sf(high, dof) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_sf(mid, dof) < q else (low, mid)
    return (low + high) / 2


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def binomial_sf(k: np.ndarray, n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """P(X >= k) of n trials, for whole arrays: sums of terms by their ratio, all rows a term at a time, from k up or from k - 1 down, whichever tail is the smaller."""
    k, n, p = np.broadcast_arrays(np.asarray(k, np.int64), np.asarray(n, np.int64), np.asarray(p, float))
    shape, (k, n, p) = k.shape, (x.ravel() for x in (k, n, p))
    out = np.where(k <= 0, 1.0, 0.0)
    todo = np.flatnonzero((k > 0) & (p > 0) & (k <= n))
    out[todo[p[todo] >= 1]] = 1.0
    todo = todo[p[todo] < 1]
    k, n, p = k[todo], n[todo], p[todo]
    up = k >= ((n + 1) * p).astype(np.int64)
    i = np.where(up, k, k - 1).astype(float)
    term = np.exp(_lgamma(n + 1.0) - _lgamma(i + 1) - _lgamma(n - i + 1) + i * np.log(p) + (n - i) * np.log1p(-p)) if len(k) else np.zeros(0)
    total, odds = np.zeros(len(k)), p / (1 - p)
    live = np.arange(len(k))
    while len(live):
        total[live] += term[live]
        at, m, u = i[live], n[live], up[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            term[live] *= np.where(u, (m - at) / (at + 1) * odds[live], at / (m - at + 1) / odds[live])
        i[live] += np.where(u, 1, -1)
        live = live[(i[live] >= 0) & (i[live] <= n[live]) & (term[live] > total[live] * 1e-17)]
    out[todo] = np.clip(np.where(up, total, 1 - total), 0, 1)
    return out.reshape(shape)


def balanced_bins(sizes: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """(key, size, bin): keys dealt so that bins hold about target each; a key larger than target has a bin of its own.

    Keys in falling order of size are cut by their running total. The running total is taken in two
    levels, by (size, hash of the key), so that no window holds all keys, nor all of one size; the
    upper one has a row for each size and hash.
    """
    rows = sizes.select(key, F.col(size).cast("long").alias(size)).withColumn("_h", F.pmod(F.xxhash64(key), F.lit(64)))
    part = rows.groupBy(size, "_h").agg(F.sum(size).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy(F.desc(size), "_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(size).over(Window.partitionBy(size, "_h").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_own", own).join(part.select(size, "_h", before.alias("_before")), [size, "_h"])
    start = F.col("_own") + F.col("_before") - F.col(size)
    return out.select(key, size, F.floor(start / target).cast("long").alias("bin"))
