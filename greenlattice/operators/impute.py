"""Exact nearest-row imputation without comparing every pair of rows.

The distance between two rows is the Euclidean distance over the columns both have, scaled
up by (all columns / shared columns). What keeps it cheap and exact:

* rows that agree in every value are at the same distance, so at most ``k`` of them matter;
* some donors (up to ``BOUND_ROWS`` of the receiver's own cell, or a few of the whole table) are
  dealt into shares; the ``k``-th of the shares' least distances is an upper bound on the wanted one;
* columns are put in blocks of ``AXES``, complete and wide ones first. A receiver looks into
  the block of which it has most columns: those columns are its axes. The pattern (block and
  the columns had) names the index it uses; donors stand in the index of every pattern in use;
* a donor that has an axis stands in the cell of its value there, cut at quantiles; the
  distance is at least the gap in that axis, scaled by all columns / columns the receiver has,
  so only cells whose range meets the bound matter. A donor that lacks an axis stands in a cell
  of its own there, which every receiver looks into: no distance can be ruled out by it.

Cells that hold many donors are sliced by a salt of their own, and the first ``k`` donors of
a receiver are ranked map-side before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenlattice.operators.ranking import with_bucket
from greenlattice.operators.spatial_join import salted
from greenlattice.session import materialize

CELL_ROWS = 256
BOUND_ROWS = 4096
BOUND_SHARES = 4  # shares of the bound's donors, times k; their least distances give the bound
UNROLLED = 32  # columns up to which a distance is one expression
AXES = 3  # columns of a block
MAX_CUTS = 4096  # split points of a column (with three axes enough for 10^13 rows)
HOT_CELL_ROWS = 100_000
LACKING = -1  # cell of the donors without a value


def _scaled_square(size: int) -> Column:
    """Squared distance of the values _r0, _r1, ... and _d0, _d1, ...; NULL when they share no present column.

    One expression that is compiled into the join; array functions, some hundred times slower a pair,
    take over where its code would be too long for the JVM to compile.
    """
    if size > UNROLLED:
        gaps = F.zip_with(F.array(*_values("_r", size)), F.array(*_values("_d", size)), lambda a, b: (a - b) * (a - b))
        total = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + F.coalesce(g, F.lit(0.0)))
        return F.try_divide(total * F.lit(float(size)), F.size(F.array_compact(gaps)))
    gaps = [F.col(r) - F.col(d) for r, d in zip(_values("_r", size), _values("_d", size))]
    total = reduce(lambda x, y: x + y, [F.coalesce(g * g, F.lit(0.0)) for g in gaps])
    return F.try_divide(total * F.lit(float(size)), reduce(lambda x, y: x + y, [g.isNotNull().cast("int") for g in gaps]))


def _values(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(size)]


class _Index:
    """Blocks of columns, their cells, and the patterns by which receivers use them.

    ``number`` of a pattern is block * 2**AXES + the bits of the block's columns that a receiver has.
    """

    def __init__(self, columns: list[str], facts, cell_rows: int, table: DataFrame) -> None:
        rows = facts["_n"]
        varied = [c for c in columns if facts[f"s_{c}"] > 0] or columns[:1]
        order = sorted(varied, key=lambda c: (facts[f"n_{c}"] < rows, -facts[f"s_{c}"]))
        self.blocks = [order[i:i + AXES] for i in range(0, len(order), AXES)]
        self.columns = columns
        cuts = {c: int(min(MAX_CUTS, max(1, round((rows / cell_rows) ** (1 / len(b)))))) for b in self.blocks for c in b}
        asked = {c: [i / n for i in range(1, n)] for c, n in cuts.items() if n > 1}
        found = table.agg(*[F.percentile_approx(c, p).alias(c) for c, p in asked.items()]).first() if asked else {}
        self.splits = {c: sorted(set(found[c] or [])) if c in asked else [] for c in order}

    def bucketed(self, df: DataFrame, value: dict[str, Column], prefix: str) -> DataFrame:
        """``df`` with the bucket of each column's ``value``."""
        for c, v in value.items():
            df = with_bucket(df.withColumn("_v", F.coalesce(v, F.lit(0.0))), "_v", self.splits[c], f"{prefix}{c}").drop("_v")
        return df

    def number(self) -> Column:
        """Pattern of a row: the first of the blocks of which it has most columns; NULL if it has none."""
        have = [[F.col(c).isNotNull().cast("int") for c in block] for block in self.blocks]
        counts = [reduce(lambda x, y: x + y, h) for h in have]
        bits = [reduce(lambda x, y: x + y, [h * (1 << i) for i, h in enumerate(hs)]) + F.lit(b << AXES) for b, hs in enumerate(have)]
        most = F.greatest(*counts) if len(counts) > 1 else counts[0]
        chosen = F.lit(None)
        for count, number in reversed(list(zip(counts, bits))):
            chosen = F.when((count == most) & (count > 0), number).otherwise(chosen)
        return chosen.cast("int")

    def axes(self, number: int) -> list[str | None]:
        """Columns of a pattern by cell place."""
        block = self.blocks[number >> AXES]
        return [block[i] if i < len(block) and number >> i & 1 else None for i in range(AXES)]

    def place(self, number: int, cell) -> list[Column]:
        return [F.lit(0) if c is None else cell(c) for c in self.axes(number)]


CELL = [f"_b{i}" for i in range(AXES)]


def impute_nearest_rows(df: DataFrame, columns: list[str], row_id: str, k: int = 5,
                        cell_rows: int = CELL_ROWS, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Fill missing values of ``columns`` with the mean over the ``k`` nearest rows that have them."""
    table = df.withColumns({c: F.col(c).cast("double") for c in columns})
    facts = table.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n_{c}") for c in columns],
                      *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}") for c in columns],
                      *[F.avg(c).alias(f"m_{c}") for c in columns]).first()
    gappy = [c for c in columns if facts[f"n_{c}"] < facts["_n"]]
    if not gappy:
        return df
    index = _Index(columns, facts, cell_rows, table)
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in gappy])
    axes = {c: F.col(c) for block in index.blocks for c in block}

    # Receivers: one row per distinct incomplete row and missing column, with the pattern it looks through.
    distinct = table.where(incomplete).groupBy(*columns).agg(F.min(row_id).alias("_rid")).withColumn("_pattern", index.number())
    wants = F.array(*[F.when(F.col(c).isNull(), F.lit(columns.index(c))) for c in gappy])
    receivers = index.bucketed(distinct.where("_pattern is not null"), axes, "_own_")
    size = len(columns)
    rv, dv = _values("_r", size), _values("_d", size)
    receivers = materialize(receivers.select("*", *[F.col(c).alias(r) for c, r in zip(columns, rv)], F.explode(F.array_compact(wants)).alias("_gap")))
    patterns = sorted(r[0] for r in receivers.select("_pattern").distinct().collect())  # 2**AXES a block at most

    def by_pattern(cell) -> list[Column]:
        """The cell places of a row by its pattern."""
        places = {n: index.place(n, cell) for n in patterns}
        out = []
        for i in range(AXES):
            chosen = F.lit(0)
            for n in patterns:
                chosen = F.when(F.col("_pattern") == n, places[n][i]).otherwise(chosen)
            out.append(chosen)
        return out

    receivers = receivers.select("_rid", "_gap", "_pattern", *rv, *[c.alias(n) for c, n in zip(by_pattern(lambda c: F.col(f"_own_{c}")), CELL)])

    # Donors: at most k rows of any group of identical rows, in the index of every pattern in use.
    same = W.partitionBy(*columns).orderBy(row_id)
    donors = (table.select(row_id, *columns).withColumn("_copy", F.row_number().over(same))
              .where(F.col("_copy") <= k).drop("_copy"))
    donors = index.bucketed(donors, axes, "_own_")
    stands = F.array(*[F.struct(F.lit(n).alias("_pattern"), *[c.cast("int").alias(b) for c, b in zip(
        index.place(n, lambda c: F.when(F.col(c).isNull(), F.lit(LACKING)).otherwise(F.col(f"_own_{c}"))), CELL)]) for n in patterns])
    donors = materialize(donors.select(F.col(row_id).alias("_id"), *[F.col(c).alias(v) for c, v in zip(columns, dv)], F.explode(stands).alias("_s"))
                         .select("_id", *dv, "_s.*")) if patterns else None
    if donors is None:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(facts[f"m_{c}"])) for c in gappy})
    keys = ["_pattern", *CELL]
    value = F.coalesce(*[F.when(F.col("_gap") == i, F.col(dv[i])) for i in map(columns.index, gappy)])
    has_gap = value.isNotNull()

    # Upper bound from some donors of the own cell, or a few donors of the whole table.
    few = W.partitionBy(*keys).orderBy("_id")
    local = donors.withColumn("_i", F.row_number().over(few)).where(F.col("_i") <= max(k, BOUND_ROWS)).drop("_i")
    # the least ids that have a column come from a combined top-k, not from one task's sort
    anywhere = reduce(DataFrame.unionByName, [
        donors.where((F.col("_pattern") == patterns[0]) & F.col(dv[columns.index(c)]).isNotNull())
        .select(F.lit(columns.index(c)).alias("_gap"), "_id", *dv).orderBy("_id").limit(2 * k) for c in gappy])
    square = _scaled_square(size)

    def kth_distance(candidates: DataFrame, name: str) -> DataFrame:
        """No less than the k-th distance: the k-th of the least distances of disjoint shares of the donors. No pair is sorted."""
        share = F.pmod(F.xxhash64("_id"), F.lit(BOUND_SHARES * k))
        least = (candidates.select("_rid", "_gap", share.alias("_share"), square.alias("_d2"))
                 .groupBy("_rid", "_gap", "_share").agg(F.min("_d2").alias("_d2")))
        return least.groupBy("_rid", "_gap").agg(F.get(F.array_sort(F.collect_list("_d2")), F.lit(k - 1)).alias(name))

    near_bound = kth_distance(receivers.join(local, keys).where(has_gap), "_near")
    far_bound = kth_distance(receivers.join(F.broadcast(anywhere), "_gap"), "_far")  # 2 k rows a column
    bounded = (receivers.drop(*CELL).join(near_bound, ["_rid", "_gap"], "left").join(far_bound, ["_rid", "_gap"], "left")
               .withColumn("_limit", F.coalesce(F.least("_near", "_far"), F.lit(float("inf"))) * (1 + 1e-12)).drop("_near", "_far"))

    # Cells whose range meets the bound in every axis, and those of donors without it.
    present = reduce(lambda x, y: x + y, [F.col(r).isNotNull().cast("int") for r in rv])
    reach = F.sqrt(F.col("_limit") * present / F.lit(float(len(columns)))) * (1 + 1e-9)
    own = {c: F.col(rv[columns.index(c)]) for c in axes}
    ranged = index.bucketed(index.bucketed(bounded, {c: v - reach for c, v in own.items()}, "_lo_"), {c: v + reach for c, v in own.items()}, "_hi_")
    lows, highs = by_pattern(lambda c: F.col(f"_lo_{c}")), by_pattern(lambda c: F.col(f"_hi_{c}"))
    searched = ranged.select("_rid", "_gap", "_pattern", *rv, "_limit", *[low.alias(f"_l{i}") for i, low in enumerate(lows)],
                             *[high.alias(f"_h{i}") for i, high in enumerate(highs)])
    searched = materialize(searched)
    lacking = {r[0]: set(r[1]) for r in donors.groupBy("_pattern").agg(F.array_compact(F.array(*[
        F.max(F.when(F.col(b) == LACKING, F.lit(i))) for i, b in enumerate(CELL)]))).collect()}  # a row per pattern
    for i, b in enumerate(CELL):
        cells = F.sequence(F.col(f"_l{i}"), F.col(f"_h{i}"))
        also = [n for n in patterns if i in lacking.get(n, ())]
        if also:
            cells = F.when(F.col("_pattern").isin(also), F.concat(cells, F.array(F.lit(LACKING)))).otherwise(cells)
        searched = searched.withColumn(b, F.explode(cells)).drop(f"_l{i}", f"_h{i}")
    donors, searched, salted_keys = salted(donors, searched, keys, hot_rows)
    pairs = (searched.join(donors, salted_keys).where(has_gap)
             .select("_rid", "_gap", "_id", value.alias("_value"), "_limit", square.alias("_d2")).where(F.col("_d2") <= F.col("_limit")))
    nearest = W.partitionBy("_rid", "_gap").orderBy("_d2", "_id")
    filled = (pairs.select("_rid", "_gap", "_id", "_d2", "_value").withColumn("_i", F.row_number().over(nearest))
              .where(F.col("_i") <= k).groupBy("_rid", "_gap").agg(F.avg("_value").alias("_fill")))
    # One row per distinct incomplete row, its fills as columns, joined back on the values.
    wide = filled.groupBy("_rid").agg(*[
        F.max(F.when(F.col("_gap") == columns.index(c), F.col("_fill"))).alias(f"_fill_{c}") for c in gappy])
    keyed = (table.where(incomplete).groupBy(*columns).agg(F.min(row_id).alias("_rid"))
             .join(wide, "_rid", "left").drop("_rid"))
    keyed = keyed.select(*[F.col(c).alias(f"_k_{c}") for c in columns], *[f"_fill_{c}" for c in gappy])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns])
    holes = table.where(incomplete).join(keyed, match, "left").withColumns({
        c: F.coalesce(F.col(c), F.col(f"_fill_{c}"), F.lit(facts[f"m_{c}"])) for c in gappy})
    return table.where(~incomplete).select(*df.columns).unionByName(holes.select(*df.columns))
