"""Exact linear-interpolated quantiles, global and per group, at any table size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.operators.ranking import ROWS_PER_BUCKET, rank_values, values_at_positions

# Rows up to which one aggregate may hold a column's value counts in one buffer: none, so that every table takes the same way.
ONE_BUFFER_ROWS = 0
SKETCH = 10_000
# Most candidate rows around all wanted quantiles that may be counted towards the driver.
MAX_CANDIDATES = 200_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], one_buffer_rows: int = ONE_BUFFER_ROWS,
                    rows_per_bucket: int = ROWS_PER_BUCKET,
                    max_candidates: int = MAX_CANDIDATES) -> dict[str, list[float | None]]:
    """Quantiles per column as a plain dict: a bounded fit result.

    A mergeable sketch brackets every wanted quantile; the next pass counts the rows below
    and inside the brackets, the last one counts the distinct values inside (a few rows in
    ten thousand). The sketch only chooses where to look: ranks and values are exact, and a
    bracket that is too wide or misses is searched by ``values_at_positions``.
    """
    near = 2.0 / SKETCH
    pairs = [(c, float(p)) for c, probs in wanted.items() for p in probs]
    edges = {c: [max(0.0, min(1.0, p + side * near)) for p in probs for side in (-1, 1)] for c, probs in wanted.items()}
    first = df.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges[c], SKETCH).alias("e")).alias(c)
                     for c in wanted]).first()
    sizes = {c: first[c]["n"] for c in wanted}
    if max(sizes.values()) <= one_buffer_rows:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(c)
                       for c, probs in wanted.items()]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(wanted[c]) for c in wanted}

    def between(c: str, low: float, high: float) -> Column:
        return (F.col(c) >= F.lit(low)) & (F.col(c) <= F.lit(high))

    brackets: dict[int, tuple[float, float]] = {}
    for i, (c, p) in enumerate(pairs):
        if sizes[c]:
            j = 2 * sum(d == c for d, _ in pairs[:i])
            low, high = first[c]["e"][j], first[c]["e"][j + 1]
            brackets[i] = (float("-inf") if p <= near else low, float("inf") if p >= 1 - near else high)
    row = df.agg(*[F.struct(F.sum((F.col(pairs[i][0]) < F.lit(low)).cast("bigint")).alias("below"),
                            F.sum(between(pairs[i][0], low, high).cast("bigint")).alias("inside")).alias(f"b{i}")
                   for i, (low, high) in brackets.items()]).first()
    at = {i: (sizes[pairs[i][0]] - 1) * pairs[i][1] for i in brackets}
    good = [i for i in brackets if (row[f"b{i}"]["below"] or 0) <= math.floor(at[i])
            and math.ceil(at[i]) < (row[f"b{i}"]["below"] or 0) + (row[f"b{i}"]["inside"] or 0)]
    found: dict[int, dict[int, float]] = {i: {} for i in brackets}
    exact = [i for i in good if brackets[i][0] == brackets[i][1]]  # one value fills the bracket
    for i in exact:
        found[i] = {k: float(brackets[i][0]) for k in (math.floor(at[i]), math.ceil(at[i]))}
    small, total = [], 0
    for i in sorted(set(good) - set(exact), key=lambda i: row[f"b{i}"]["inside"]):
        total += row[f"b{i}"]["inside"]
        if total <= max_candidates:
            small.append(i)
    if small:
        hits = F.array(*[F.when(between(pairs[i][0], *brackets[i]), F.struct(
            F.lit(i).alias("i"), F.col(pairs[i][0]).cast("double").alias("v"))) for i in small])
        anywhere = reduce(lambda a, b: a | b, [between(pairs[i][0], *brackets[i]) for i in small])
        counted = df.where(anywhere).select(F.explode(F.array_compact(hits)).alias("h")).groupBy("h.i", "h.v").count().collect()
        for i in small:
            rank = row[f"b{i}"]["below"]
            for value, ties in sorted((r["v"], r["count"]) for r in counted if r["i"] == i):
                for k in (math.floor(at[i]), math.ceil(at[i])):
                    if rank <= k < rank + ties:
                        found[i][k] = value
                rank += ties
    for i in brackets:
        if i in small or i in exact:
            continue
        c = pairs[i][0]
        inside, skip = (df.where(between(c, *brackets[i])), row[f"b{i}"]["below"]) if i in good else (df, 0)
        ks = [math.floor(at[i]), math.ceil(at[i])]
        picked = values_at_positions(inside, c, [k - skip for k in ks], rows_per_bucket)
        found[i] = {k: float(picked[k - skip]) for k in ks}
    result: dict[str, list[float | None]] = {c: [] for c in wanted}
    for i, (c, _) in enumerate(pairs):
        if i not in brackets:
            result[c].append(None)
            continue
        low, high = found[i][math.floor(at[i])], found[i][math.ceil(at[i])]
        result[c].append(low if low == high else low + (high - low) * (at[i] - math.floor(at[i])))
    return result


def grouped_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float],
                      one_buffer_rows: int = ONE_BUFFER_ROWS,
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(groups, quantiles ARRAY<DOUBLE>) with one array entry per probability.

    A group may be any share of the table: beyond ``one_buffer_rows`` rows its values are
    ranked in buckets and only the two rows around each quantile are kept.
    """
    array = F.array(*[F.lit(float(p)) for p in probs])
    if df.agg(F.count(value)).first()[0] <= one_buffer_rows:
        return df.groupBy(*groups).agg(F.percentile(value, array).alias("quantiles"))
    ranks = rank_values(df, value, groups, rows_per_bucket=rows_per_bucket)
    sizes = ranks.groupBy(*groups).agg(F.sum("ties").alias("_n"))
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    near = (ranks.join(sizes, groups)
            .withColumn("_mark", F.explode(marks))
            .withColumn("_at", (F.col("_n") - 1) * F.col("_mark.p"))
            .where((F.col("below") <= F.ceil("_at")) & (F.floor("_at") < F.col("below") + F.col("ties"))))
    covers = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
    picked = near.groupBy(*groups, F.col("_mark.i").alias("_i"), "_at").agg(
        F.max(F.when(covers(F.floor("_at")), F.col(value))).alias("_v0"),
        F.max(F.when(covers(F.ceil("_at")), F.col(value))).alias("_v1"))
    exact = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_at") - F.floor("_at"))
    return (picked.groupBy(*groups)
            .agg(F.array_sort(F.collect_list(F.struct("_i", exact.alias("q")))).alias("_qs"))
            .select(*groups, F.transform("_qs", lambda s: s["q"]).alias("quantiles")))
