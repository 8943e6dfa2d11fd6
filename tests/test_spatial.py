import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenlattice.functions.geo import haversine_km, valid_coordinates
from greenlattice.operators import grid, raster, ring_edges, spatial_join, species, zones


def brute_km(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.minimum(np.sqrt(h), 1))


def pairs_of(df, a, b):
    return {(r[a], r[b]) for r in df.select(a, b).collect()}


def test_haversine_one_degree(spark):
    got = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert got == pytest.approx(2 * math.pi * 6371 / 360, abs=1e-9)


@pytest.mark.parametrize("radius", [5.0, 150.0, 2500.0])
@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_radius_join_is_brute_force(spark, radius, hot_rows):
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(88, 90, 30), rng.normal(19, 0.05, 120)])
    lon = np.concatenate([rng.uniform(-180, 180, 150), rng.uniform(-180, 180, 30), rng.normal(75, 0.05, 120)])
    lon[:20] = np.where(rng.random(20) < 0.5, 179.99, -179.99)
    lat[:20] = rng.uniform(10, 10.1, 20)
    frame = pd.DataFrame({"id": np.arange(300), "latitude": lat, "longitude": lon})
    points = spark.createDataFrame(frame.iloc[::3].rename(columns={"id": "pid"}))
    targets = spark.createDataFrame(frame.rename(columns={"id": "tid"}))
    got = pairs_of(spatial_join.radius_join(points, targets, radius, hot_rows=hot_rows), "pid", "tid")
    d = brute_km(lat[::3, None], lon[::3, None], lat[None], lon[None])
    want = {(int(i * 3), int(j)) for i, j in zip(*np.where(d <= radius))}
    assert got == want


def test_radius_join_keeps_lonely_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "pid int, latitude double, longitude double")
    targets = spark.createDataFrame([(7, 0.0, 0.001)], "tid int, latitude double, longitude double")
    assert pairs_of(spatial_join.radius_join(points, targets, 5.0, how="left"), "pid", "tid") == {(1, 7), (2, None)}


@pytest.mark.parametrize("hot_rows", [10**6, 25])
def test_buffer_analysis(spark, hot_rows):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"pid": np.arange(40), "latitude": rng.uniform(0, 3, 40), "longitude": rng.uniform(-1, 2, 40)})
    t = pd.DataFrame({"latitude": rng.uniform(0, 3, 300), "longitude": rng.uniform(-1, 2, 300), "v": rng.normal(size=300)})
    t.loc[:99, ["latitude", "longitude"]] = [1.5, 0.5]
    t.loc[::9, "v"] = np.nan
    targets = spark.createDataFrame(t).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = spatial_join.buffer_analysis(spark.createDataFrame(p), "pid", targets, "v", 0.4, hot_rows).toPandas().set_index("pid")
    for _, row in p.iterrows():
        near = t[np.hypot(t.latitude - row.latitude, t.longitude - row.longitude) <= 0.4]["v"]
        assert got.loc[row.pid, "count"] == near.count()
        assert got.loc[row.pid, "sum"] == pytest.approx(near.sum())
        if near.count():
            assert got.loc[row.pid, "mean"] == pytest.approx(near.mean())


def ring_rows(spark, rings):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in rings.items()],
                                 "gid int, ring array<struct<x:double,y:double>>")


def test_points_in_polygons_of_any_shape(spark):
    star = [(0, 0), (4, 0), (2, 1), (4, 4), (2, 2), (0, 4), (1, 2), (0, 0)]
    box = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"pid": np.arange(400), "longitude": rng.uniform(-1, 5, 400), "latitude": rng.uniform(-1, 5, 400)})

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
        return hit

    want = {(int(r.pid), g) for r in frame.itertuples() for g, s in ((1, star), (2, box)) if inside(r.longitude, r.latitude, s)}
    points, shapes = spark.createDataFrame(frame), ring_rows(spark, {1: star, 2: box})
    for cell, hot, corners in ((None, 10**6, 64), (0.5, 10**6, 64), (7.0, 30, 64), (None, 10**6, 5), (0.7, 30, 0)):
        got = pairs_of(spatial_join.points_in_polygons(points, shapes, cell_deg=cell, hot_rows=hot, ring_corners=corners), "pid", "gid")
        assert got == want
    left = pairs_of(spatial_join.points_in_polygons(points, shapes, how="left"), "pid", "gid")
    assert {p for p, _ in left} == set(range(400)) and {x for x in left if x[1] is not None} == want


def test_polygons_of_very_different_size(spark):
    rng = np.random.default_rng(11)
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    corners = [(float(x), float(y), 0.01) for x, y in rng.uniform(0, 90, (40, 2))] + [(-170.0, -80.0, 160.0), (10.0, 10.0, 30.0)]
    rings = {i: box(*c) for i, c in enumerate(corners)}
    frame = pd.DataFrame({"pid": np.arange(300), "longitude": rng.uniform(-20, 90, 300), "latitude": rng.uniform(-20, 90, 300)})
    frame.loc[:39, "longitude"] = [c[0] + 0.005 for c in corners[:40]]
    frame.loc[:39, "latitude"] = [c[1] + 0.005 for c in corners[:40]]
    want = {(int(r.pid), g) for r in frame.itertuples() for g, (x, y, w) in enumerate(corners)
            if x <= r.longitude < x + w and y <= r.latitude < y + w}
    shapes = ring_rows(spark, rings)
    assert pairs_of(spatial_join.points_in_polygons(spark.createDataFrame(frame), shapes), "pid", "gid") == want
    assert spatial_join.polygon_cells(shapes, 0.01).count() < 42 * 40


def test_tiling_boxes_own_each_point_once(spark):
    boxes = {i: [(i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0)] for i in range(3)}
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate([(0, 0), (1, 0), (2, .5), (1, .999)])],
                                   "pid int, longitude double, latitude double")
    assert pairs_of(spatial_join.points_in_polygons(points, ring_rows(spark, boxes)), "pid", "gid") == {(0, 0), (1, 1), (2, 2), (3, 1)}


def test_valid_polygons_drop_degenerate(spark):
    shapes = ring_rows(spark, {1: [(0, 0), (1, 0), (1, 1)], 2: [(0, 0), (1, 0)], 3: [(0, 0), (1, 1), (2, 2), (0, 0)], 4: []})
    kept = spatial_join.valid_polygons(shapes).select("gid", F.size("ring").alias("n")).collect()
    assert [(r["gid"], r["n"]) for r in kept] == [(1, 4)]


@pytest.mark.parametrize("leaf_rows", [1, 4, 64])
def test_nearest_site_is_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(8)
    sites = np.concatenate([rng.normal([3, 3], 0.01, (150, 2)), rng.uniform(0, 50, (60, 2)), np.repeat([[9.0, 9.0]], 80, 0)])
    points = np.concatenate([rng.uniform(-5, 60, (120, 2)), rng.normal([3, 3], 0.02, (60, 2))])
    s = spark.createDataFrame(pd.DataFrame({"sid": np.arange(len(sites)), "longitude": sites[:, 0], "latitude": sites[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(points)), "longitude": points[:, 0], "latitude": points[:, 1]}))
    got = {r["pid"]: (r["sid"], r["distance_deg"]) for r in spatial_join.nearest_site(p, "pid", s, "sid", leaf_rows=leaf_rows).collect()}
    d2 = ((points[:, None] - sites[None]) ** 2).sum(-1)
    assert len(got) == len(points)
    for i in range(len(points)):
        assert got[i][0] == int(np.argmin(d2[i]))
        assert got[i][1] == pytest.approx(math.sqrt(d2[i].min()))


def test_nearest_site_one_place_and_none(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "pid int, longitude double, latitude double")
    one = spark.createDataFrame([(5, 3.0, 4.0), (4, 3.0, 4.0)], "sid int, longitude double, latitude double")
    assert tuple(spatial_join.nearest_site(p, "pid", one, "sid").first()) == (1, 4, 5.0)
    assert spatial_join.nearest_site(p, "pid", one.limit(0), "sid").first()["sid"] is None


def test_overlap_exact_for_half_plane(spark):
    points = spark.createDataFrame([(0.0, 0.0)], "latitude double, longitude double")
    half = ring_rows(spark, {1: [(0, -1), (1, -1), (1, 1), (0, 1), (0, -1)]}).withColumn("landuse_type", F.lit("forest"))
    row = spatial_join.landuse_overlap(points, half, ["forest", "urban"], radius_deg=0.01).first()
    assert row["forest"] == pytest.approx(0.5, abs=1e-12) and row["urban"] == 0


def ray_casts(x, y, ring):
    """Inside or not for many points, a plain ray cast against every edge."""
    inside = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if ay != by:
            spans = (ay <= y) != (by <= y)
            inside ^= spans & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return inside


def test_points_in_rings_of_many_corners(spark):
    rng = np.random.default_rng(12)
    angle = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    reach = 2 + 0.3 * np.sin(40 * angle) + rng.normal(0, 0.01, len(angle))
    round_ring = list(zip(reach * np.cos(angle), reach * np.sin(angle)))
    up = np.linspace(-3, 3, 400)  # every edge spans the whole height
    comb = [(x, -1.0 if i % 2 else 1.0) for i, x in enumerate(up)] + [(3.5, 2.0), (-3.5, 2.0)]
    rings = {1: round_ring + round_ring[:1], 2: comb + comb[:1], 3: [(0, 0), (1, 0), (1, 1), (0, 0)]}
    frame = pd.DataFrame({"pid": np.arange(1500), "longitude": rng.uniform(-4, 4, 1500), "latitude": rng.uniform(-3, 3, 1500)})
    frame.loc[:99, ["longitude", "latitude"]] = [0.25, 0.125]  # a crowded place
    want = {(int(p), g) for g, r in rings.items() for p in np.flatnonzero(ray_casts(frame.longitude.to_numpy(), frame.latitude.to_numpy(), r))}
    points, shapes = spark.createDataFrame(frame), ring_rows(spark, rings)
    for hot in (10**6, 50):
        assert pairs_of(spatial_join.points_in_polygons(points, shapes, hot_rows=hot), "pid", "gid") == want
    outer = pairs_of(spatial_join.points_in_polygons(points, shapes, how="left"), "pid", "gid")
    assert {x for x in outer if x[1] is not None} == want and {p for p, _ in outer} == set(range(1500))
    most = ring_edges.banded_edges(spatial_join.polygon_cells(shapes.where("gid = 1"), 100.0).dropDuplicates(["gid"]).withColumn("_h", ring_edges.band_height("ring")), "gid", "ring").groupBy(
        "gid", "_level", "_band").count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] < 4000 and most[1] < 500_000  # of 100,000 edges a point meets few, and an edge few bands


def test_scan_lines_fill_as_ray_casts_do(spark):
    rng = np.random.default_rng(13)
    rings = {}
    for i in range(12):
        n = int(rng.integers(3, 30))
        angle, reach, (cx, cy) = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.2, 4, n), rng.uniform(-1, 11, 2)
        ring = list(zip(cx + reach * np.cos(angle), cy + reach * np.sin(angle)))
        rings[i] = ring + ring[:1]
    rings[20] = [(2.5, 2.5), (7.5, 2.5), (7.5, 7.5), (2.5, 7.5), (2.5, 2.5)]  # borders through centres
    rings[21] = [(4, 4), (6, 4), (4, 4)]  # no area
    shapes = ring_rows(spark, rings).withColumn("v", F.col("gid") + 1.0).withColumns({c: F.lit(None).cast("double") for c in ("longitude", "latitude")})
    spot = spark.createDataFrame([(30, None, 99.0, 0.2, 0.3), (31, None, 98.0, 50.0, 0.3)], shapes.schema)
    got = {(r["row"], r["col"]): r["value"] for r in raster.rasterize_shapes(shapes.unionByName(spot), "v", "gid", (0.0, 0.0, 10.0, 10.0), 0.5).collect()}
    xs, ys = np.meshgrid((np.arange(20) + 0.5) * 0.5, 10 - (np.arange(20) + 0.5) * 0.5)
    want = np.zeros((20, 20))
    for g, ring in sorted(rings.items()):
        want[ray_casts(xs.ravel(), ys.ravel(), ring).reshape(20, 20)] = g + 1
    want[19, 0] = 99
    assert len(got) == 400 and all(got[r, c] == want[r, c] for r in range(20) for c in range(20))


def test_disc_overlap_agrees_with_a_fine_lattice(spark):
    rng = np.random.default_rng(14)
    k = 1200
    at = (np.arange(k) + 0.5) / k * 2 - 1
    lx, ly = (v.ravel() for v in np.meshgrid(at, at))
    disc = lx * lx + ly * ly <= 1
    rings = {0: [(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], 1: [(9, 9), (10, 9), (10, 10), (9, 9)], 2: [(-.2, -.2), (.3, -.1), (0, .4), (-.2, -.2)],
             3: [(0, 0), (2, 0), (2, 2), (0, 0)], 4: [(-3, 0), (3, 0), (3, 0.5), (-3, 0.5), (-3, 0)], 5: [(0, 0), (0, 0), (1, 0), (0, 1), (0, 0)]}
    for i in range(6, 12):
        n = int(rng.integers(3, 12))
        angle, reach, middle = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.2, 2, n), rng.uniform(-1, 1, 2)
        ring = list(zip(middle[0] + reach * np.cos(angle), middle[1] + reach * np.sin(angle)))
        rings[i] = (ring + ring[:1])[::-1 if i % 2 else 1]
    area = ring_edges.disc_overlap(F.col("ring"), F.lit(0.0), F.lit(0.0), 1.0)
    got = {r["gid"]: r["a"] for r in ring_rows(spark, rings).select("gid", area.alias("a")).collect()}
    for g, ring in rings.items():
        assert got[g] == pytest.approx((ray_casts(lx, ly, ring) & disc).sum() * (2 / k) ** 2, abs=4e-3)
    assert got[0] == pytest.approx(math.pi) and got[1] == pytest.approx(0) and got[2] == pytest.approx(0.14)
    assert got[5] == pytest.approx(0.5)


def test_grid_counts_and_values(spark):
    assert grid.node_count(72, 80, 0.1) == 81 and grid.node_count(15, 22, 0.1) == 72
    assert grid.node_count(15, 22, 0.1, inclusive=False) == 70
    got = grid.create_grid(spark, (15.0, 15.0, 22.0, 22.0), 0.1).where("iy = 0").orderBy("ix").toPandas()["longitude"].to_numpy()
    np.testing.assert_array_equal(got, np.arange(15.0, 22.0 + 0.1, 0.1))


def test_shannon_and_threat(spark):
    occ = spark.createDataFrame([("a", 0.0, 0.0, "LC", False), ("a", 0.0, 0.0, "EX", True), ("b", 0.0, 0.001, "VU", False), ("b", 0.0, 0.001, "VU", False)],
                                "species_name string, latitude double, longitude double, conservation_status string, is_endemic boolean")
    sites = spark.createDataFrame([(0.0, 0.0), (40.0, 40.0)], "latitude double, longitude double")
    near, far = species.species_metrics(occ, sites, 5.0).orderBy("latitude").collect()
    assert near["species_count"] == 2 and near["endemic_species"] == 1 and near["threatened_species"] == 1
    assert near["species_diversity"] == pytest.approx(math.log(2)) and near["threat_index"] == pytest.approx((0 + 6 + 2 + 2) / 4 / 6)
    assert far["species_count"] == 0 and far["species_diversity"] == 0.0


def test_species_metrics_brute_force_with_a_hot_place(spark):
    rng = np.random.default_rng(9)
    n = 600
    frame = pd.DataFrame({"species_name": rng.choice([f"s{i}" for i in range(12)], n), "latitude": rng.uniform(10, 11, n),
                          "longitude": rng.uniform(20, 21, n), "conservation_status": rng.choice(["LC", "VU", "EN", "EX"], n),
                          "is_endemic": rng.random(n) < 0.2})
    frame.loc[:199, ["latitude", "longitude"]] = [10.5, 20.5]
    sites = pd.DataFrame({"latitude": rng.uniform(10, 11, 25), "longitude": rng.uniform(20, 21, 25)})
    got = species.species_metrics(spark.createDataFrame(frame), spark.createDataFrame(sites), 25.0, hot_rows=20).toPandas()
    assert len(got) == 25
    score = {"LC": 0, "VU": 2, "EN": 3, "EX": 6}
    for r in got.itertuples():
        near = frame[brute_km(r.latitude, r.longitude, frame.latitude, frame.longitude) <= 25]
        assert r.species_count == near.species_name.nunique()
        assert r.endemic_species == near[near.is_endemic].species_name.nunique()
        assert r.threatened_species == near[near.conservation_status.isin(["VU", "EN"])].species_name.nunique()
        p = near.species_name.value_counts(normalize=True)
        assert r.species_diversity == pytest.approx(-(p * np.log(p)).sum(), abs=1e-9)
        assert r.threat_index == pytest.approx(near.conservation_status.map(score).mean() / 6)


def test_rasterize_last_wins_and_fill(spark):
    pts = spark.createDataFrame([(1, 0.5, 1.5, 0.2), (2, 0.6, 1.6, 0.9), (3, 9.0, 9.0, 0.5)],
                                "oid int, longitude double, latitude double, v double")
    cells = {(r["row"], r["col"]): r["value"] for r in raster.rasterize(pts, "v", "oid", (0.0, 0.0, 2.0, 2.0), 1.0).collect()}
    assert len(cells) == 4 and cells[(0, 0)] == pytest.approx(0.9) and cells[(1, 1)] == 0


def test_zone_feature_is_geojson(spark):
    import json
    req = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.5)], "min_lon double, min_lat double, max_lon double, max_lat double, resolution double")
    z = zones.closed_form_zones(req)
    assert z.count() == 4
    text = z.select(zones.zone_feature(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), risk_level=F.col("risk_level"))).first()[0]
    feature = json.loads(text)
    assert feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"][0]) == 5


def test_valid_coordinates(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (91.0, 0.0), (0.0, 181.0), (None, 0.0), (float("nan"), 0.0)], "a double, o double")
    assert [r[0] for r in rows.select(valid_coordinates(F.col("a"), F.col("o"))).collect()] == [True, False, False, False, False]


def test_nearest_site_walks_boxes_not_points(spark):
    """The walk meets a row per box of points however many points there are; ids that repeat stay one row."""
    rng = np.random.default_rng(5)
    sites = pd.DataFrame({"sid": range(60), "longitude": rng.uniform(0, 4, 60), "latitude": rng.uniform(0, 4, 60)})
    points = pd.DataFrame({"pid": [i % 2000 for i in range(4000)], "longitude": np.tile(rng.uniform(-1, 5, 2000), 2), "latitude": np.tile(rng.uniform(-1, 5, 2000), 2)})
    points.loc[7, "longitude"] = None
    points.loc[2007, "longitude"] = None
    found = spatial_join.nearest_site(spark.createDataFrame(points).replace(float("nan"), None), "pid", spark.createDataFrame(sites), "sid", leaf_rows=16)
    lists = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert lists and not any("_pid" in line for line in lists)
    got = {r["pid"]: r for r in found.collect()}
    assert len(got) == 1999 and 7 not in got
    for i in range(0, 2000, 13):
        if i != 7:
            d = np.hypot(sites.longitude - points.longitude[i], sites.latitude - points.latitude[i])
            assert got[i]["sid"] == int(d.argmin()) and got[i]["distance_deg"] == pytest.approx(d.min())


def test_disc_overlap_of_missing_and_short_rings(spark):
    rows = [(0, None), (1, []), (2, [(0.0, 0.0)]), (3, [(-1.0, -1.0), (0.0, -1.0), (0.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]), (4, [(0.0, None), (1.0, 1.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "i int, ring array<struct<x: double, y: double>>").coalesce(1)
    got = {r["i"]: r["a"] for r in df.select("i", ring_edges.disc_overlap(F.col("ring"), F.lit(0.0), F.lit(0.0), 0.5).alias("a")).collect()}
    assert got[0] is None and got[1] == got[2] == 0.0 and got[4] is None
    assert got[3] == pytest.approx(math.pi / 8)
    plan = df.select(ring_edges.disc_overlap(F.col("ring"), F.lit(0.0), F.lit(0.0), 0.5))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan  # batches, not an expression per ring


def test_radius_join_lists_rows_of_a_crowded_place_once(spark, monkeypatch):
    monkeypatch.setattr(spatial_join.packed_places, "__defaults__", (7,))
    points = spark.createDataFrame([(i % 40, 19.0, 75.0, None) for i in range(60)] + [(99, None, 75.0, "x")], "pid int, latitude double, longitude double, note string")
    targets = spark.createDataFrame([(1, 19.001, 75.0), (1, 19.001, 75.0), (2, 25.0, 75.0)], "tid int, latitude double, longitude double")
    assert max(len(r["_points"]) for r in spatial_join.packed_places(points).collect()) <= 14
    got = spatial_join.radius_join(points, targets, 5.0, digits=6)
    assert got.columns == ["pid", "latitude", "longitude", "note", "tid", "t_latitude", "t_longitude", "distance_km"]
    rows = got.collect()
    assert sorted(r.pid for r in rows) == sorted(2 * [i % 40 for i in range(60)])
    assert {r.distance_km for r in rows} == {round(brute_km(19.0, 75.0, 19.001, 75.0), 6)}
    outer = spatial_join.radius_join(points, targets, 5.0, how="left").collect()
    assert len(outer) == 121 and [r.tid for r in outer if r.pid == 99] == [None]


def triangles_at(spark, places):
    """Right triangles of side 0.5, number i at places[i]; a place may come twice."""
    return spark.createDataFrame([(i, [(x, y), (x + 0.5, y), (x, y + 0.5), (x, y)]) for i, (x, y) in enumerate(places)],
                                 "gid int, ring array<struct<x:double,y:double>>")


def test_left_join_lists_each_pair_once_and_never_moves_it(spark):
    """Equal rings meet a point as one row, and the unmatched points come from the same join, not from one over all pairs."""
    places = [(float(x), 0.0) for x in range(4)] * 50
    points = spark.createDataFrame([(i, 0.1 + i % 5, 0.1) for i in range(40)], "pid int, longitude double, latitude double")
    shapes = triangles_at(spark, places)
    assert spatial_join.packed_rings(shapes.coalesce(1)).count() == 4
    left = spatial_join.points_in_polygons(points, shapes, how="left").select("pid", "gid")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Join Inner" not in plan and "LeftAnti" not in plan
    joined = plan[plan.index("Join LeftOuter"):].splitlines()[0]
    assert "lambda" not in joined and "gid" not in joined  # a compiled test, before polygons are listed
    got = [tuple(r) for r in left.collect()]
    want = [(i, g) for i in range(40) for g in ([g for g in range(200) if g % 4 == i % 5] or [None])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packed_rings_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "PACK_ROWS", 7)
    shapes = triangles_at(spark, [(0.0, 0.0), (-0.0, 0.0), (1.0, 0.0)] * 20).coalesce(1)
    packed = spatial_join.packed_rings(shapes).collect()
    assert max(len(r["_members"]) for r in packed) <= 7
    assert sorted(m["gid"] for r in packed for m in r["_members"]) == list(range(60))
    alone = spatial_join.packed_rings(shapes.select("ring")).collect()
    assert sum(len(r["_members"]) for r in alone) == 60
    points = spark.createDataFrame([(1, 0.1, 0.1)], "pid int, longitude double, latitude double")
    assert spatial_join.points_in_polygons(points, shapes.select("ring"), how="left").count() == 40


def test_left_join_of_crowded_cells_keeps_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(21)
    places = [(float(x), float(y)) for x, y in rng.uniform(0, 2, (30, 2))] * 2 + [(0.5, 0.5)] * 40
    at = [(float(x), float(y)) for x, y in rng.uniform(-1, 3, (300, 2))] + [(0.6, 0.6)] * 60 + [(None, 0.6), (0.6, None), (None, None)] * 5
    ids = [i % 200 for i in range(len(at))]  # ids repeat
    points = spark.createDataFrame([(i, *p) for i, p in zip(ids, at)], "pid int, longitude double, latitude double")
    many = [(4 + math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * np.pi, 30)]  # not compiled
    long = [(-2 + 1.5 * math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * np.pi, 90)]
    wide = [(-30.0, -30.0), (30.0, -30.0), (0.0, 30.0), (-30.0, -30.0)]  # cells of another size

    def holds(ring, p):
        return None not in p and bool(ray_casts(np.array([p[0]]), np.array([p[1]]), ring)[0])

    cases = (([], 10**6, 10**8, 32), ([], 10**6, 50, 0), ([many + many[:1]], 10**6, 50, 0), ([wide, long + long[:1], many + many[:1]], 20, 10**8, 10**9))
    for more, hot_rows, hot_pairs, share in cases:
        monkeypatch.setattr(spatial_join, "PAIRS_PER_POINT", share)
        rings = [[(x, y), (x + 0.5, y), (x, y + 0.5), (x, y)] for x, y in places] + more
        shapes = ring_rows(spark, dict(enumerate(rings))).withColumn("longitude", F.lit("clash"))
        shapes = shapes.unionByName(spark.createDataFrame([(900, None, "none"), (901, [], "none"), (902, [(None, 1.0), (2.0, 2.0)], "none")], shapes.schema))
        want = sorted(((i, g) for i, p in zip(ids, at) for g in ([g for g, r in enumerate(rings) if holds(r, p)] or [None])), key=str)
        found = spatial_join.points_in_polygons(points, shapes, how="left", hot_rows=hot_rows, hot_pairs=hot_pairs)
        assert found.columns == ["pid", "longitude", "latitude", "gid", "ring", "g_longitude"]
        rows = found.collect()
        assert sorted(((r.pid, r.gid) for r in rows), key=str) == want
        assert all((r.gid is None) == (r.ring is None) == (r.g_longitude is None) for r in rows)
    none = spatial_join.points_in_polygons(points, shapes.limit(0), how="left").collect()
    assert sorted((r.pid for r in none)) == sorted(ids) and all(r.gid is None for r in none)
