"""Radius, containment, nearest and overlap joins as bucketed equi-joins.

None of these compares all pairs: both sides get integer cell keys so Catalyst plans a
hash or sort-merge join, and the exact geometric test runs on the matches. No side is
hinted as broadcast; AQE switches when it has seen a side's real size. A cell that holds a
large part of a table is cut into salted slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.functions.geo import SphereCells, haversine_km
from greenlattice.functions.numeric import rounded
from greenlattice.operators import ring_edges
from greenlattice.session import materialize

HOT_CELL_ROWS = 1_000_000
HOT_CELL_PAIRS = 100_000_000
PLACE_ROWS = 1_000  # rows of one place that travel together
RING_CORNERS = 64  # corners up to which a ring goes along with its cells
COMPILED_CORNERS = 9  # corners up to which the test of rings is a compiled expression
PACK_ROWS = 65_536  # polygons in a row among which equal rings are put together
PAIRS_PER_POINT = 32  # pairs a point has on average from which the work is dealt out by cells


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """(keys, _slices) of the keys with more than ``hot_rows`` rows, stored: rows / hot_rows entries at most."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counts.where(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_slices")))


def salted(dense: DataFrame, sparse: DataFrame, keys: list[str],
            hot_rows: int, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Slice the hot keys of the dense side by a row hash and repeat their sparse rows once per slice.

    The slices of a key follow its own row count, or are those of ``hot``; all other keys stay as they are.
    """
    hot = hot_keys(dense, keys, hot_rows) if hot is None else hot
    slice_of = F.when(F.col("_slices").isNotNull(), F.pmod(F.xxhash64(*dense.columns), F.col("_slices"))).otherwise(0).cast("int")
    dense = dense.join(hot, keys, "left").withColumn("_salt", slice_of).drop("_slices")
    last = F.coalesce(F.col("_slices") - 1, F.lit(0))
    sparse = sparse.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_slices")
    return dense, sparse, [*keys, "_salt"]


def _parts(df: DataFrame) -> int:
    """Number of parts for work that takes cores rather than bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def with_row(df: DataFrame) -> DataFrame:
    """``df`` stored with a row number ``_row``, so that an outer form finds its rows again."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()))


def packed_places(points: DataFrame, place_rows: int = PLACE_ROWS) -> DataFrame:
    """latitude, longitude, _points: the rows of a place as arrays of some ``place_rows``."""
    place = ["latitude", "longitude"]
    points = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    hot = hot_keys(points, place, place_rows)
    part = F.when(F.col("_slices").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_slices"))).otherwise(0)
    rows = points.select(*place, F.struct(*points.columns).alias("_point")).join(hot, place, "left")
    return (rows.select(*place, "_point", part.alias("_part")).groupBy(*place, "_part")
            .agg(F.collect_list("_point").alias("_points")).drop("_part"))


def radius_join(points: DataFrame, targets: DataFrame, radius_km: float, how: str = "inner",
                hot_rows: int = HOT_CELL_ROWS, digits: int | None = None) -> DataFrame:
    """Points with every target at most ``radius_km`` away (great circle), plus distance_km.

    Points at one place travel together: a target is held against the place once, and
    distance_km, rounded to ``digits`` if given, is worked out before the rows are listed.

    ``points`` and ``targets`` both carry latitude/longitude; the target's columns that
    clash get the prefix ``t_``. Each point looks into the cells that touch its own, each
    target sits in one cell. ``how='left'`` keeps points without a match.
    """
    if how == "left":
        keyed = with_row(points)
        matched = radius_join(keyed, targets, radius_km, hot_rows=hot_rows, digits=digits)
        extra = [c for c in matched.columns if c not in keyed.columns]
        return keyed.join(matched.select("_row", *extra), "_row", "left").select(*points.columns, *extra)
    if how != "inner":
        raise ValueError(f"unsupported join type {how}")
    cells = SphereCells(radius_km)
    renamed = {c: f"t_{c}" for c in targets.columns if c in points.columns}
    right = targets.withColumnsRenamed(renamed)
    tlat, tlon = renamed.get("latitude", "latitude"), renamed.get("longitude", "longitude")
    right = (right.where(F.col(tlat).isNotNull() & F.col(tlon).isNotNull())
             .withColumn("_band", cells.band(F.col(tlat)))
             .withColumn("_cell", cells.cell(F.col(tlon), F.col("_band"))))
    found = [c for c in right.columns if c not in ("_band", "_cell")]
    own = cells.band(F.col("_lat"))
    left = (packed_places(points).toDF("_lat", "_lon", "_points").withColumn("_band", F.explode(F.sequence(own - 1, own + 1)))
            .withColumn("_cell", F.explode(cells.neighbour_cells(F.col("_lon"), F.col("_band")))))
    right, left, keys = salted(right, left, ["_band", "_cell"], hot_rows)
    distance = haversine_km(F.col("_lat"), F.col("_lon"), F.col(tlat), F.col(tlon))
    near = left.join(right, keys).withColumn("distance_km", distance).where(F.col("distance_km") <= F.lit(float(radius_km)))
    if digits is not None:
        near = near.withColumn("distance_km", rounded(F.col("distance_km"), digits))
    return (near.select(F.explode("_points").alias("_point"), *found, "distance_km")
            .select("_point.*", *found, "distance_km"))


def planar_radius_join(points: DataFrame, targets: DataFrame, radius_deg: float,
                       hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """As ``radius_join`` with the Euclidean distance in degrees (distance_deg)."""
    size = F.lit(float(radius_deg))
    renamed = {c: f"t_{c}" for c in targets.columns if c in points.columns}
    right = targets.withColumnsRenamed(renamed)
    tlat, tlon = F.col(renamed.get("latitude", "latitude")), F.col(renamed.get("longitude", "longitude"))
    right = (right.withColumn("_cy", F.floor(tlat / size).cast("bigint"))
             .withColumn("_cx", F.floor(tlon / size).cast("bigint")))
    cy, cx = F.floor(F.col("latitude") / size).cast("bigint"), F.floor(F.col("longitude") / size).cast("bigint")
    left = (points.withColumn("_cy", F.explode(F.sequence(cy - 1, cy + 1)))
            .withColumn("_cx", F.explode(F.sequence(cx - 1, cx + 1))))
    right, left, keys = salted(right, left, ["_cy", "_cx"], hot_rows)
    dlat, dlon = F.col("latitude") - tlat, F.col("longitude") - tlon
    return (left.join(right, keys).withColumn("distance_deg", F.sqrt(dlat * dlat + dlon * dlon))
            .where(F.col("distance_deg") <= size).drop("_cy", "_cx", "_salt"))


def buffer_analysis(points: DataFrame, point_id: str, targets: DataFrame, value: str,
                    radius_deg: float, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Per point the count, mean and sum of target values inside its buffer.

    A point without targets has count 0, a NULL mean and sum 0. Targets at one place are
    summed first, so a crowded place joins as one row.
    """
    placed = targets.groupBy("latitude", "longitude").agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"))
    near = planar_radius_join(points.select(point_id, "latitude", "longitude"), placed, radius_deg, hot_rows)
    stats = near.groupBy(point_id).agg(F.sum("_n").alias("count"), F.sum("_s").alias("sum"))
    return (points.join(stats, point_id, "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint"))
            .withColumn("mean", F.try_divide(F.col("sum"), F.col("count")))
            .withColumn("sum", F.coalesce(F.col("sum"), F.lit(0.0))))


def inside_ring(x: Column, y: Column, points: Column) -> Column:
    """Half-open ray cast: a ring owns its lower and left edges, so tilings do not overlap.

    ``points`` is a closed ring ARRAY<STRUCT<x, y>>.
    """
    edges = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1),
                       F.slice(points, F.lit(2), F.size(points) - 1),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay <= y) != (by <= y)
        return spans & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_area(points: Column) -> Column:
    """Unsigned shoelace area of a closed ring."""
    twice = F.aggregate(
        F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1),
                   lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]),
        F.lit(0.0), lambda acc, v: acc + v)
    return F.abs(twice) / 2.0


def close_ring(points: Column) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(first == last, points).otherwise(F.concat(points, F.array(first)))


def valid_polygons(polygons: DataFrame, ring_column: str = "ring") -> DataFrame:
    """Close rings; drop missing ones, those under three distinct corners and those of no area."""
    closed = polygons.where(F.size(ring_column) > 0).withColumn(ring_column, close_ring(F.col(ring_column)))
    return closed.where((F.size(F.array_distinct(ring_column)) >= 3) & (ring_area(F.col(ring_column)) > 0))


LEVEL_FACTOR = 4.0


def polygon_cells(polygons: DataFrame, size: float, ring_column: str = "ring") -> DataFrame:
    """Polygons with their bounding box, repeated for every cell it touches (_lvl, _px, _py).

    Cells of level n are ``size * 4**n`` degrees wide and a polygon uses the first level whose
    cells are at least a quarter of its longer side, so even a very large one covers few cells.
    """
    xs, ys = F.transform(ring_column, lambda p: p["x"]), F.transform(ring_column, lambda p: p["y"])
    boxed = polygons.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    level = F.ceil(F.log(LEVEL_FACTOR, F.greatest(side / F.lit(LEVEL_FACTOR * size), F.lit(1.0)))).cast("int")
    return (boxed.withColumn("_lvl", level)
            .withColumn("_px", F.explode(F.sequence(_cell("_x0", size), _cell("_x1", size))))
            .withColumn("_py", F.explode(F.sequence(_cell("_y0", size), _cell("_y1", size)))))


def _cell(value: str, size: float) -> Column:
    return F.floor(F.col(value) / (F.lit(size) * F.pow(F.lit(LEVEL_FACTOR), F.col("_lvl")))).cast("bigint")


def typical_cell(polygons: DataFrame, ring_column: str = "ring") -> float:
    """A cell size near the middle bounding-box side, so most polygons cover a handful of cells."""
    xs, ys = F.transform(ring_column, lambda p: p["x"]), F.transform(ring_column, lambda p: p["y"])
    side = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return float(polygons.agg(F.percentile_approx(side, 0.5)).first()[0] or 1.0)


def packed_rings(polygons: DataFrame, ring_column: str = "ring") -> DataFrame:
    """ring, _members: polygons of equal rings as one row, their other columns as an array of ``PACK_ROWS`` at most."""
    others = [c for c in polygons.columns if c != ring_column]
    member = F.struct(*others) if others else F.struct(F.lit(True).alias("_alone"))
    block = F.floor(F.monotonically_increasing_id() / F.lit(PACK_ROWS))
    return (polygons.select(F.col(ring_column).alias("_ring"), F.col(ring_column), member.alias("_member"), block.alias("_block"))
            .groupBy("_ring", "_block").agg(F.first(ring_column).alias(ring_column), F.collect_list("_member").alias("_members"))
            .drop("_ring", "_block"))


def with_corners(polygons: DataFrame, corners: int, ring_column: str = "ring") -> DataFrame:
    """``polygons`` with the first corners as columns ``_cx0``, ``_cy0`` and so on; a shorter ring repeats its last one."""
    corner = [F.get(ring_column, F.least(F.lit(i), F.size(ring_column) - 1)) for i in range(corners)]
    return polygons.withColumns({f"_c{n}{i}": c[n] for i, c in enumerate(corner) for n in ("x", "y")})


def inside_corners(x: Column, y: Column, corners: int) -> Column:
    """As ``inside_ring`` for rows ``with_corners`` of rings of no more corners: one compiled expression."""
    odd = F.lit(False)
    for i in range(corners - 1):
        ax, ay, bx, by = (F.col(f"_c{n}{k}") for k in (i, i + 1) for n in ("x", "y"))
        spans = (ay <= y) != (by <= y)
        odd = odd != F.coalesce(spans & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay)), F.lit(False))
    return odd


def points_in_polygons(points: DataFrame, polygons: DataFrame, how: str = "inner",
                       ring_column: str = "ring", cell_deg: float | None = None,
                       hot_rows: int = HOT_CELL_ROWS, ring_corners: int = RING_CORNERS,
                       hot_pairs: int = HOT_CELL_PAIRS) -> DataFrame:
    """Spatial join: points within polygons; ``how`` is inner, left or right.

    Clashing polygon columns get the prefix ``g_``. Rings of up to ``ring_corners`` corners travel
    with their cells, equal ones as one, and their polygons are listed after the test; longer ones
    are edges in latitude bands, and a point counts its crossings. Where all cells are of one size,
    a left join lists the pairs once and never moves them.
    """
    if how == "right":
        kept = with_row(polygons)
        matched = points_in_polygons(points, kept, "inner", ring_column, cell_deg, hot_rows, ring_corners, hot_pairs)
        named = {c: c if c not in points.columns else f"g_{c}" for c in kept.columns if c != "_row"}
        other = [c for c in matched.columns if c not in named.values() and c != "_row"]
        found = kept.withColumnsRenamed(named).join(matched.select("_row", *other), "_row", "left").drop("_row")
        return found.select(*[c for c in matched.columns if c != "_row"])
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how}")
    renamed = {c: f"g_{c}" for c in polygons.columns if c in points.columns}
    shapes = polygons.withColumnsRenamed(renamed)
    ring_name = renamed.get(ring_column, ring_column)
    columns = [*points.columns, *shapes.columns]
    size = cell_deg or typical_cell(shapes, ring_name)
    many = F.size(ring_name) > F.lit(ring_corners)
    short, long = shapes.where(~many), shapes.where(many)
    corners = shapes.agg(F.max(F.size(ring_name))).first()[0] or 0
    some_long = corners > ring_corners
    levels = _levels(polygon_cells(short, size, ring_name))
    if how == "left":
        points = with_row(points)

    def listed(matches: DataFrame, outer: bool = False) -> DataFrame:
        return matches.select(*points.columns, ring_name, (F.inline_outer if outer else F.inline)("_members")).select(
            *points.columns, *shapes.columns)

    once = how == "left" and not some_long and len(levels) < 2
    placed = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    matches = _short_ring_matches(points.where(placed), short, ring_name, size, levels, min(corners, ring_corners),
                                  hot_rows, hot_pairs, "left" if once else "inner")
    found = listed(matches, once)
    if some_long:
        crossed = _points_in_long_rings(points, long, ring_name, size, hot_rows, hot_pairs)
        found = found.unionByName(crossed)
    if how == "left":
        alone = points.where(~placed)  # put aside, as keys without a value would meet in one task
        if not once:
            met = matches.select("_row").unionByName(crossed.select("_row")) if some_long else matches.select("_row")
            alone = points.join(met.distinct(), "_row", "left_anti")
        found = found.unionByName(alone, allowMissingColumns=True)
    return found.select(*columns)


def _levels(tiled: DataFrame) -> list[int]:
    return sorted(r[0] for r in tiled.select("_lvl").where(F.col("_lvl").isNotNull()).distinct().collect())  # a few levels


def _in_cells(points: DataFrame, tiled: DataFrame, size: float, levels: list[int], hot_rows: int, hot_pairs: int,
              packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points with their cell of each level, the polygons of ``polygon_cells`` and the keys on which they meet.

    Cells are sliced by rows and by pairs; where a point has many pairs, points are dealt out by cells, as pairs are
    work for cores. ``packed`` goes along in place of ``tiled``, which then only tells the pairs.
    """
    keys = ["_lvl", "_px", "_py"]
    located = points.withColumn("_lvl", F.explode(F.array(*[F.lit(n) for n in levels])) if len(levels) > 1 else F.lit((levels or [0])[0]))
    located = located.withColumns({"_px": _cell("longitude", size), "_py": _cell("latitude", size)})
    if len(levels) < 2:  # a key that is one value everywhere would be left out of the join, which then moved the points again
        keys, located = keys[1:], located.drop("_lvl")
    sizes = located.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(
        tiled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys, "left")
    n, pairs = F.col("_n"), F.col("_n") * F.coalesce(F.col("_m"), F.lit(0)).cast("double")
    slices = F.least(n, F.ceil(F.greatest(n / F.lit(hot_rows), pairs / F.lit(hot_pairs)))).cast("int")
    most, rows, work = sizes.agg(F.max(slices), F.sum(n), F.sum(pairs)).first() if levels else (0, 0, 0)
    if packed is not None:
        tiled = packed
    if (most or 0) > 1:
        hot = materialize(sizes.select(*keys, slices.alias("_slices")).where("_slices > 1"))
        located, tiled, keys = salted(located, tiled, keys, hot_rows, hot)
    if (work or 0) > PAIRS_PER_POINT * (rows or 0):
        located, tiled = located.repartition(4 * _parts(points), *keys), tiled.hint("merge")
    return located, tiled, keys


def _in_box() -> Column:
    x, y = F.col("longitude"), F.col("latitude")
    return (x >= F.col("_x0")) & (x < F.col("_x1")) & (y >= F.col("_y0")) & (y < F.col("_y1"))


def _short_ring_matches(points: DataFrame, shapes: DataFrame, ring_name: str, size: float, levels: list[int], corners: int,
                        hot_rows: int, hot_pairs: int, how: str) -> DataFrame:
    """Points with ``packed_rings`` that hold them; the exact test is part of the join, which so keeps whole rows of points."""
    packed = polygon_cells(packed_rings(shapes, ring_name), size, ring_name)
    x, y, inside = F.col("longitude"), F.col("latitude"), None
    if corners <= COMPILED_CORNERS:
        packed, inside = with_corners(packed, corners, ring_name), inside_corners(x, y, corners)
    located, tiled, keys = _in_cells(points, polygon_cells(shapes, size, ring_name), size, levels, hot_rows, hot_pairs, packed)
    meets = _in_box() & (inside_ring(x, y, F.col(ring_name)) if inside is None else inside)
    for k in keys:
        meets = (F.col(k) == F.col(f"_at{k}")) & meets
    return located.join(tiled.withColumnsRenamed({k: f"_at{k}" for k in keys}), meets, how)


def _points_in_long_rings(points: DataFrame, shapes: DataFrame, ring_name: str, size: float, hot_rows: int,
                          hot_pairs: int) -> DataFrame:
    """As ``points_in_polygons`` for rings of many corners: only boxes and single edges meet the points."""
    shapes = materialize(shapes.withColumn("_ring_row", F.monotonically_increasing_id()))
    boxed = polygon_cells(shapes.select("_ring_row", ring_name), size, ring_name).withColumn("_h", ring_edges.band_height(ring_name))
    boxes = boxed.drop(ring_name)
    once = boxed.select("_ring_row", ring_name, "_y0", "_h").dropDuplicates(["_ring_row"])
    edges = materialize(ring_edges.banded_edges(once, "_ring_row", ring_name))
    levels = edges.groupBy("_ring_row").agg(F.collect_set("_level").alias("_levels"))  # a few levels a ring
    located, boxes, keys = _in_cells(points, boxes, size, _levels(boxes), hot_rows, hot_pairs)
    pairs = materialize(located.join(boxes, keys).where(_in_box()).select(*points.columns, "_ring_row", "_y0", "_h").withColumn(
        "_pair", F.monotonically_increasing_id()))
    asked = ring_edges.looking(pairs.select("_pair", "_ring_row", F.col("longitude").alias("_x"), F.col("latitude").alias("_y"), "_y0", "_h"), levels, "_ring_row")
    asked, edges, keys = salted(asked, edges, ["_ring_row", "_level", "_band"], hot_rows)
    odd = ring_edges.odd_crossings(asked.join(edges, keys))
    inside = pairs.join(odd, "_pair").drop("_pair", "_y0", "_h")
    return inside.join(shapes, "_ring_row").drop("_ring_row")


# ---------------------------------------------------------------- nearest site

BROADCAST_CELLS = 65_536  # cells a level can have at most for its table to go to every task


def nearest_site(points: DataFrame, point_id: str, sites: DataFrame, site_id: str,
                 leaf_rows: int = 16, stride: int = 2, max_depth: int = 40) -> DataFrame:
    """(point_id, site_id, distance_deg): the nearest site of every point, lowest id on a tie.

    Points are dealt into cells a step finer than the sites' leaves, and the box of a cell's points
    stands for them: a quadtree over the sites is walked top-down for all boxes at once. A step joins
    each box's open cells with their children and keeps those whose nearest edge is no farther than
    the best distance guaranteed to the whole box, so a box keeps a handful of cells however
    unevenly the sites lie. Every point is then held against the sites left to its box only; sites
    at one place count as one, and so do points of one id.
    """
    placed = sites.groupBy(F.col("longitude").alias("_sx"), F.col("latitude").alias("_sy")).agg(
        F.min(site_id).alias(site_id))
    placed = materialize(placed)  # read once per level below
    box = placed.agg(F.min("_sx"), F.min("_sy"), F.max("_sx"), F.max("_sy"), F.count(F.lit(1))).first()
    if not box[4]:
        return points.select(point_id, F.lit(None).cast(sites.schema[site_id].dataType).alias(site_id),
                             F.lit(None).cast("double").alias("distance_deg"))
    side = max(box[2] - box[0], box[3] - box[1]) * (1 + 1e-9) or 1.0

    def at_depth(df: DataFrame, depth: int) -> DataFrame:
        scale = F.lit((2 ** depth) / side)
        return df.withColumns({
            "_cx": F.floor((F.col("_sx") - F.lit(box[0])) * scale).cast("bigint"),
            "_cy": F.floor((F.col("_sy") - F.lit(box[1])) * scale).cast("bigint")})

    # Counts of the finest cells give those of every depth, so one job finds the leaves' depth.
    finest = at_depth(placed, max_depth).groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    depths = list(range(stride, max_depth + 1, stride))
    shifted = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("_cx", max_depth - d).alias("x"), F.shiftright("_cy", max_depth - d).alias("y"))
                                  for d in depths])).alias("c")
    hottest = (finest.select("_n", shifted).groupBy("c").agg(F.sum("_n").alias("_n")).groupBy("c.d").agg(F.max("_n").alias("_n")).collect())  # a row per depth
    depth = min([r["d"] for r in hottest if r["_n"] <= leaf_rows], default=depths[-1])
    leaves = materialize(at_depth(placed, depth))
    # Every level's cells with the tight box of their sites, built from the leaves' boxes and stored once.
    boxes = [F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1")]
    tight = leaves.groupBy("_cx", "_cy").agg(F.min("_sx").alias("_x0"), F.max("_sx").alias("_x1"), F.min("_sy").alias("_y0"), F.max("_sy").alias("_y1"))
    steps = [F.struct(F.lit(d).alias("_d"), F.shiftright("_cx", depth - d).alias("_cx"), F.shiftright("_cy", depth - d).alias("_cy"))
             for d in range(stride, depth + 1, stride)]
    levels = materialize(tight.select("_x0", "_x1", "_y0", "_y1", F.explode(F.array(*steps)).alias("_s")).groupBy("_s").agg(*boxes).select("_s.*", "_x0", "_x1", "_y0", "_y1"))

    def level(d: int) -> DataFrame:
        """Non-empty cells of depth d with the tight box of their sites and their parent."""
        return levels.where(F.col("_d") == d).drop("_d").withColumns({"_ox": F.shiftright("_cx", stride), "_oy": F.shiftright("_cy", stride)})

    # The top level has at most 4**stride cells: a literal array on every point. A point's
    # open cells are an array that is filtered against its own minimum, so a level is one
    # join and one aggregate. Levels of few possible cells go to every task.
    fields = ["_cx", "_cy", "_x0", "_x1", "_y0", "_y1"]
    cell = F.struct(*fields)
    top = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in level(stride).collect()])
    # The walk is work for cores, not bytes, so the number of parts is named and not left to be merged by size.
    scale = F.lit((2 ** (depth + stride)) / side)
    dealt = points.select(F.col(point_id).alias("_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()).withColumns({
            "_gx": F.floor((F.col("_x") - F.lit(box[0])) * scale).cast("bigint"), "_gy": F.floor((F.col("_y") - F.lit(box[1])) * scale).cast("bigint")})
    edges = ["_w", "_e", "_s", "_n"]
    packed = dealt.groupBy("_gx", "_gy").agg(F.min("_x").alias("_w"), F.max("_x").alias("_e"), F.min("_y").alias("_s"), F.max("_y").alias("_n"))
    packed = packed.repartition(_parts(points), "_gx", "_gy").withColumn("_cells", top)

    def reach(c: Column, near: bool) -> Column:
        """Square of the least distance between the boxes, or of the greatest."""
        def along(low: Column, high: Column, begin: str, end: str) -> Column:
            first, last = F.col(begin), F.col(end)
            return F.greatest(low - last, first - high, F.lit(0.0)) if near else F.greatest(last - low, high - first)
        x, y = along(c["_x0"], c["_x1"], "_w", "_e"), along(c["_y0"], c["_y1"], "_s", "_n")
        return x * x + y * y

    group = ["_gx", "_gy", *edges]
    for step, d in enumerate(range(stride, depth + 1, stride)):
        if d > stride:
            found = level(d)
            children = open_cells.join(F.broadcast(found) if 4 ** d <= BROADCAST_CELLS else found, ["_ox", "_oy"])
            packed = children.groupBy("_gx", "_gy").agg(*[F.first(c).alias(c) for c in edges], F.collect_list(cell).alias("_cells"))
        best = F.array_min(F.transform("_cells", lambda c: reach(c, False)))
        kept = F.filter("_cells", lambda c: reach(c, True) <= F.col("_best") * (1 + 1e-12))
        open_cells = packed.withColumn("_best", best).select(*group, F.explode(kept).alias("_c")).select(
            *group, F.col("_c._cx").alias("_ox"), F.col("_c._cy").alias("_oy"))
        if step % 3 == 2 and d < depth:
            open_cells = materialize(open_cells)
    final = leaves.select(F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("_sx").alias("_x0"), F.col("_sx").alias("_x1"),
                          F.col("_sy").alias("_y0"), F.col("_sy").alias("_y1"), site_id)
    sites_left = open_cells.join(final, ["_ox", "_oy"]).groupBy("_gx", "_gy").agg(
        *[F.first(c).alias(c) for c in edges], F.collect_list(F.struct("_x0", "_x1", "_y0", "_y1", F.col(site_id).alias("id"))).alias("_cells"))
    kept = F.filter("_cells", lambda c: reach(c, True) <= F.col("_best") * (1 + 1e-12))
    sites_left = sites_left.withColumn("_best", best).select("_gx", "_gy", kept.alias("_sites"))

    def away(c: Column) -> Column:
        dx, dy = F.col("_x") - c["_x0"], F.col("_y") - c["_y0"]
        return F.struct((dx * dx + dy * dy).alias("d2"), c["id"].alias("id"))

    found = (dealt.join(sites_left, ["_gx", "_gy"]).select("_pid", F.array_min(F.transform("_sites", away)).alias("_b"))
             .groupBy("_pid").agg(F.min("_b").alias("_b")))
    return found.select(F.col("_pid").alias(point_id), F.col("_b.id").alias(site_id),
                        F.sqrt("_b.d2").alias("distance_deg"))


# ---------------------------------------------------------------- area overlap

def landuse_overlap(points: DataFrame, polygons: DataFrame, types: list[str], radius_deg: float = 0.01,
                    type_column: str = "landuse_type", cell_deg: float | None = None) -> DataFrame:
    """Share of each point's disc covered by each land-use type, capped at 1, 0 without any.

    The shared area is exact for simple closed rings (``ring_edges.disc_overlap``). A point's
    square meets a polygon once, in the first cell that both touch.
    """
    nodes = points.select("latitude", "longitude").distinct()
    shapes = polygons.select("ring", type_column).where(F.col(type_column).isin(types))
    size = cell_deg or typical_cell(shapes)
    # Rings are dealt out first: overlaps are work for cores, and a compact table is read by a few tasks only.
    tiled = polygon_cells(shapes.repartition(_parts(shapes)), size)
    levels = sorted(r[0] for r in tiled.select("_lvl").where(F.col("_lvl").isNotNull()).distinct().collect())  # a few levels
    square = nodes.select(F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"), *[
        (F.col(c) + F.lit(side * radius_deg)).alias(n) for n, c, side in (
            ("_w", "longitude", -1), ("_e", "longitude", 1), ("_s", "latitude", -1), ("_n", "latitude", 1))])
    square = square.withColumn("_lvl", F.explode(F.array(*[F.lit(n) for n in levels])) if levels else F.lit(0))
    square = square.withColumns({"_px": F.explode(F.sequence(_cell("_w", size), _cell("_e", size)))}).withColumn(
        "_py", F.explode(F.sequence(_cell("_s", size), _cell("_n", size))))
    first_met = ((F.col("_px") == F.greatest(_cell("_w", size), _cell("_x0", size)))
                 & (F.col("_py") == F.greatest(_cell("_s", size), _cell("_y0", size))))
    square, tiled, keys = salted(square, tiled, ["_lvl", "_px", "_py"], HOT_CELL_ROWS)
    touch = (F.col("_w") < F.col("_x1")) & (F.col("_e") >= F.col("_x0")) & (F.col("_s") < F.col("_y1")) & (F.col("_n") >= F.col("_y0"))
    shared = ring_edges.disc_overlap(F.col("ring"), F.col("_plon"), F.col("_plat"), radius_deg)
    met = square.join(tiled, keys).where(first_met & touch).select("_plat", "_plon", type_column, shared.alias("_area"))
    whole = F.lit(ring_edges.disc_area(radius_deg))
    shares = met.groupBy("_plat", "_plon").agg(*[
        F.least(F.sum(F.when(F.col(type_column) == t, F.col("_area")).otherwise(0.0)) / whole, F.lit(1.0)).alias(t) for t in types])
    joined = nodes.join(shares, (nodes["latitude"] == shares["_plat"]) & (nodes["longitude"] == shares["_plon"]), "left")
    return joined.select("latitude", "longitude", *[F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in types])
