"""Operators against pandas, numpy or known values, with missing values, ties and empty tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topolidar.functions import crs, geo, geometry, meta, rules
from topolidar.functions.aggregates import Recipe
from topolidar.operators import clusters, edges, labels, offset, ordered, profile, reshape, segments, spatial
from topolidar.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_segments_with_nulls_ties_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 0.0, 1, 5.0), ("a", 3.0, 1, 5.0), ("a", 9.0, 2, None), ("a", 12.0, 1, 7.0), ("a", 13.0, 1, 3.0), ("b", 100.0, 2, 4.0)], "gt string, alongtrack double, c int, h double")
    recipes = [Recipe("h", "median", "c", 1, "m"), Recipe("h", "get_len", "c", 2, "n"), Recipe("h", "get_mode", "c", 1, "mode"), Recipe("h", "count", "c", 2, "k"), Recipe("gone", "mean")]
    got = segments.aggregate_by_segment(df, recipes, 10, ["gt"])
    assert rows(got.select("gt", "key_id", "alongtrack", "m", "n", "mode", "k")) == [("a", 0, 5.0, 5.0, 1, 5.0, 0), ("a", 1, 15.0, 5.0, None, 3.0, None), ("b", 0, 105.0, None, 1, None, 1)]
    assert segments.aggregate_by_segment(df.limit(0), recipes, 10, ["gt"]).count() == 0
    with pytest.raises(ValueError):
        segments.aggregate_by_segment(df, [Recipe("h", "nothing")], 10, ["gt"])


def test_asof_nearest_like_pandas(spark):
    rnd = random.Random(2)
    left = pd.DataFrame({"id": range(60), "at": sorted(float(rnd.randint(0, 40)) for _ in range(60))})
    right = pd.DataFrame({"at": sorted(float(rnd.randint(0, 40)) for _ in range(15)), "v": [float(i) for i in range(15)]})
    want = pd.merge_asof(left, right, on="at", direction="nearest")
    got = ordered.asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), "at", ["v"], order="v").toPandas().sort_values("id")
    # pandas takes the first of equal keys ahead and the last behind.
    assert got["v"].tolist() == want.sort_values("id")["v"].tolist()
    assert ordered.asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right).limit(0), "at", ["v"]).where("v is not null").count() == 0


def test_heights_over_interpolated_ground(spark):
    df = spark.createDataFrame([(float(x), 10.0 + x if c == 1 else 12.0 + x, c) for x, c in ((0, 2), (2, 1), (5, 2), (8, 1), (11, 2))], "alongtrack double, h double, c int")
    got = ordered.normalize_heights(df, "h", "c", [1], 1.0)
    assert [r["h_norm"] for r in got.orderBy("alongtrack").collect()] == [0.0, 0.0, 2.0, 0.0, 5.0]
    assert got.sparkSession is not None and ordered.normalize_heights(df.where("c = 2"), "h", "c", [1], 1.0).where("h_norm is not null").count() == 0


def test_range_sum_like_a_join(spark):
    rnd = random.Random(5)
    right = [(rnd.randint(0, 50), rnd.random()) for _ in range(40)]
    left = [(i, rnd.randint(-5, 55), rnd.randint(-5, 55)) for i in range(60)]
    got = ordered.range_sum(spark.createDataFrame(left, "i int, lo int, hi int"), spark.createDataFrame(right, "k int, v double"), "lo", "hi", "k", "v")
    for r in got.collect():
        assert r["total"] == pytest.approx(sum(v for k, v in right if r["lo"] <= k <= r["hi"]))


def test_scans_by_ranges_equal_windows(spark):
    rnd = random.Random(21)
    left = [(i, g, float(rnd.randint(0, 300)) if rnd.random() > 0.02 else None) for i in range(400) for g in ("a",)] + [(i, "b", float(rnd.randint(0, 30))) for i in range(400, 420)]
    right = [(g, float(rnd.randint(0, 300)), float(i)) for i, g in enumerate("a" * 90 + "b" * 5)]
    ldf, rdf = spark.createDataFrame(left, "id int, g string, at double").repartition(5), spark.createDataFrame(right, "g string, at double, v double")
    for by in ([], ["g"]):
        make = [
            lambda wide: ordered.asof_nearest(ldf, rdf, "at", ["v"], by, wide=wide),
            lambda wide: ordered.sample_line(ldf, rdf.withColumnsRenamed({"at": "lx", "v": "ly"}), "at", "lx", "ly", by, wide=wide),
            lambda wide: ordered.range_sum(ldf.withColumn("hi", F.col("at") + 20), rdf.withColumnRenamed("at", "k"), "at", "hi", "k", "v", by, wide=wide),
        ]
        for f in make:
            assert rows(f(True).where("at is not null")) == rows(f(False).where("at is not null"))


@pytest.mark.parametrize("kind", ordered.KINDS)
def test_kinds_of_interpolation(spark, kind):
    line = [(0.0, 1.0), (2.0, 5.0), (4.0, 4.0), (4.0, 6.0), (10.0, -1.0)]
    asked = [-3.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 7.0, 9.0, 10.0, 12.0]
    x, y = np.array([0, 2, 4, 10.0]), np.array([1, 5, 5, -1.0])
    df, ldf = spark.createDataFrame([(a,) for a in asked], "x double"), spark.createDataFrame(line, "lx double, ly double")
    got = {r["x"]: r["y"] for r in ordered.sample_line(df, ldf, "x", "lx", "ly", kind=kind, beyond="null").collect()}
    for a in asked:
        i, j = np.searchsorted(x, a, "right") - 1, np.searchsorted(x, a)
        want = None
        if 0 <= a <= 10:
            want = {"linear": np.interp(a, x, y), "nearest": y[i] if a - x[i] <= x[j] - a else y[j], "nearest-up": y[j] if x[j] - a <= a - x[i] else y[i], "next": y[j]}.get(kind, y[i])
        assert got[a] == (None if want is None else pytest.approx(want))
    held = {r["x"]: r["y"] for r in ordered.sample_line(df, ldf, "x", "lx", "ly", kind=kind).collect()}
    assert (held[-3.0], held[12.0]) == (1.0, -1.0)
    if kind == "linear":
        on = {r["x"]: r["y"] for r in ordered.sample_line(df, ldf, "x", "lx", "ly", beyond="extend").collect()}
        assert (on[-3.0], on[12.0], on[7.0]) == (pytest.approx(-5.0), pytest.approx(-3.0), pytest.approx(2.0))


def test_labels_scatter_and_expand(spark):
    photons = spark.range(8).withColumnRenamed("id", "ph_index")
    seg = spark.createDataFrame([(1, 1, 3, 5.0), (2, 0, 2, 9.0), (3, 4, 0, 9.0), (4, 6, 2, 7.0)], "segment_id long, ph_index_beg long, ph_count int, v double")
    got = labels.segment_to_photon(photons, seg, ["v"]).orderBy("ph_index")
    assert [r["v"] for r in got.collect()] == [5, 5, 5, 0, 0, 7, 7, 0]
    signal = spark.createDataFrame([(1, 2, 1), (4, 1, 2), (2, 1, 3), (9, 1, 3)], "ph_segment_id long, classed_pc_indx int, c int")
    at = labels.label_index(signal, seg)
    assert rows(at.select("ph_index", "c")) == [(1, 1), (5, 2)]
    assert [r["c"] for r in labels.scatter(photons, at, ["c"]).orderBy("ph_index").collect()] == [0, 1, 0, 0, 0, 2, 0, 0]


def test_class_rules(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 40), (2, 1), (3, 0), (0, 41)], "a int, b int")
    got = df.select(rules.combine_classes(F.col("a"), F.col("b")), rules.contested(F.col("a"), F.col("b"))).collect()
    assert list(map(tuple, got)) == [(0, 0), (1, 2), (40, 3), (2, 3), (3, 1), (41, 2)]


def test_vegetation_only_where_there_is_none(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 5), ("z", 1)], "g string, c int")
    assert rows(rules.reclassify_vegetation(df, "c", ["g"]).select("g", "c")) == [("x", 2), ("x", 3), ("y", 1), ("y", 3), ("z", 1)]


def test_right_closed_bins_on_their_edges(spark):
    values = [-10.0, -9.5, -9.49, 10.0, 10.1]
    got = spark.createDataFrame([(v,) for v in values], "d double").select(rules.right_closed_bin(F.col("d"), -10, 0.5, 10)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 39, None]
    spread = edges.edge_spread(spark.createDataFrame([(0.1, "roof"), (0.2, "ground"), (0.3, "noise")], "d double, c string"), "d", "c")
    assert spread.count() == 40 and spread.where("ground = 1 and building = 1 and ratio = 0.5").count() == 1


def test_datum_shift_and_back_within_a_centimetre(spark):
    df = spark.createDataFrame([(-122.3, 47.6, 50.0), (-80.0, 35.0, 200.0)], "lon double, lat double, h double")
    there = geo.helmert(df, "lon", "lat", "h").select(F.col("lon_out").alias("lon"), F.col("lat_out").alias("lat"), F.col("h_out").alias("h"))
    for a, b in zip(df.collect(), geo.helmert(there, "lon", "lat", "h", inverse=True).collect(), strict=True):
        assert abs(a["lon"] - b["lon_out"]) * 1e5 < 0.01 and abs(a["lat"] - b["lat_out"]) * 1e5 < 0.01 and abs(a["h"] - b["h_out"]) < 0.01


def test_vincenty_known_distance():
    # One degree of longitude on the equator, and a quarter meridian.
    got = geo.vincenty_metres([0, 0, 5], [0, 0, 5], [0, 90, 5], [1, 0, 5])
    assert got == pytest.approx([111319.491, 10001965.729, 0.0], abs=1e-3)


def test_utm_of_the_central_meridian(spark):
    x, y = geo.utm_project(F.lit(45.0), F.lit(-123.0), 10)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000, abs=1e-3) and r["y"] == pytest.approx(4982950.400, abs=1e-2)


def test_clock_and_dates(spark):
    r = spark.range(1).select(meta.clock(F.lit(90061.5)), *meta.month_and_day(F.lit(2020), F.lit(60))).first()
    assert tuple(r) == ("01:01:01.500000", 2, 29)


def test_wide_families(spark):
    df = spark.createDataFrame([(1, *range(5))], "id int, h_0 int, h_1 int, h_2 int, h_3 int, h_4 int")
    assert rows(reshape.expand_families(df, ["h", "gone"])) == [(1, i, i) for i in range(5)]
    assert reshape.expand_families(df, ["gone"]).count() == 0


def brute_clusters(p, eps, least):
    """Labels of DBSCAN, -1 for noise; clusters by their smallest core cell, to which points that two of them reach go."""
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    cell = np.floor(p / clusters.CELL).astype(int)
    labels, order = np.full(len(p), -1), sorted(np.flatnonzero(core), key=lambda i: tuple(cell[i]))
    for n, i in enumerate(order):
        if labels[i] >= 0:
            continue
        labels[i], todo = n, [i]
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & core & (labels < 0)):
                labels[k] = n
                todo.append(k)
    for i in np.flatnonzero(~core):
        found = labels[near[i] & core]
        labels[i] = found.min() if len(found) else -1
    return labels


@pytest.mark.parametrize("seed", range(2))
def test_clusters_like_brute_force(spark, seed):
    # Dense blobs that are all heavy cells, some of them just under or over EPS apart, among sparse points and repeated ones.
    rng, rows = np.random.default_rng(seed), []
    centres = [(b, 0.0, 0.0) for b in range(6)]
    for b, *_ in centres:
        blobs = [rng.uniform(-9, 9, 2) + rng.uniform(0, (0.4, 1.5, 4)[k], (int(rng.integers(12, 60)), 2)) for k in rng.integers(0, 3, 4)]
        left = rng.uniform(0, 0.5, (40, 2)) - [6.0, 0]
        right = rng.uniform(0, 0.5, (40, 2)) + [left[:, 0].max() + 3.0 + (0.02 if b % 2 else -0.02) - 0.25, 0]
        cloud = np.vstack((*blobs, rng.uniform(-10, 10, (int(rng.integers(0, 120)), 2)), left, right))
        rows += [(b, *p) for p in np.vstack((cloud, cloud[:5], cloud[:5])).tolist()]
    df = spark.createDataFrame(rows, "b int, x double, y double").withColumn("d2", F.col("x") ** 2 + F.col("y") ** 2)
    parts = clusters.roof_parts(df, ["b"]).toPandas()
    assert (parts["kind"] == 1).any() and (parts["kind"] == 2).any()
    for b, *_ in centres:
        p = np.array([r[1:] for r in rows if r[0] == b])
        labels = brute_clusters(p, clusters.EPS, clusters.LEAST)
        d2 = np.where(labels < 0, np.inf, (p**2).sum(axis=1))
        chosen = p[labels == labels[d2.argmin()]]
        got = clusters.nearest_cluster(parts[parts["b"] == b])
        assert np.where(got["kind"] == 0, 1, got["n"]).sum() == len(chosen)
        assert (got["x0"].min(), got["x1"].max(), got["y0"].min(), got["y1"].max()) == (*chosen[:, 0].min(keepdims=True), *chosen[:, 0].max(keepdims=True), *chosen[:, 1].min(keepdims=True), *chosen[:, 1].max(keepdims=True))
        assert (edges.roof_ends(got, 6)[0] == edges.roof_ends(pd.DataFrame({"x0": chosen[:, 0], "x1": chosen[:, 0], "y0": chosen[:, 1], "y1": chosen[:, 1]}), 6)[0]).all()


def test_planted_edge_is_found(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-6, 6, 3000), rng.uniform(0, 20, 3000)
    points = spark.createDataFrame(pd.DataFrame({"building_id": 1, "crosstrack": x, "alongtrack": y + 100 + 0.2 * x, "classification": 6}))
    centre = spark.createDataFrame([(1, 0.0, 110.0), (2, 0.0, 0.0)], "building_id long, x0 double, y0 double")
    got = {r["building_id"]: r for r in edges.building_edges(points, centre).collect()}
    assert got[1]["entry"]["valid"] and got[1]["entry"]["slope"] == pytest.approx(0.2, abs=0.05) and got[1]["entry"]["intercept"] == pytest.approx(100, abs=0.5)
    assert got[1]["exit"]["intercept"] == pytest.approx(120, abs=0.5) and got[2]["entry"] is None


def test_shift_is_recovered(spark):
    rng = np.random.default_rng(3)
    truth = lambda x, y: np.sin(x / 3) + np.cos(y / 4)
    gx, gy = rng.uniform(-25, 25, 60_000), rng.uniform(0, 700, 60_000)
    ground = spark.createDataFrame(pd.DataFrame({"gt": "a", "crosstrack": gx, "alongtrack": gy, "z": truth(gx, gy)}))
    px, py = rng.uniform(-5, 5, 3000), rng.uniform(15, 685, 3000)
    photons = spark.createDataFrame(pd.DataFrame({"gt": "a", "crosstrack": px - 2.13, "alongtrack": py + 1.57, "h_ph": truth(px, py)}))
    surface = offset.surface(ground, 1.0, ["gt"])
    assert surface.count() == 3
    costs = offset.shift_costs(photons, surface, 4.0, 0.5, ["gt"])
    assert costs.count() == 256 and costs.where("n = 3000").count() == 256
    best = offset.find_shift(photons, surface, ["gt"], reach=4.0, tolerance=0.05)
    got = best.first()
    assert got["dx"] == pytest.approx(2.13, abs=0.15) and got["dy"] == pytest.approx(-1.57, abs=0.15) and got["mae"] <= costs.agg(F.min("mae")).first()[0]
    assert offset.z_shift(photons.withColumn("h_ph", F.col("h_ph") + 0.25), surface, best, ["gt"]).first()["z_shift"] == pytest.approx(0.25, abs=0.02)
    assert offset.find_shift(photons.limit(0), surface, ["gt"], tolerance=1).count() == 0 and offset.find_shift(photons, offset.surface(ground.limit(0), 1.0, ["gt"]), ["gt"], tolerance=1).count() == 0


def test_surface_is_the_grid_without_holes(spark):
    # Cells of a track of several parts, some of them empty, against nearest cells and costs over the whole grid at once.
    rng = np.random.default_rng(8)
    x, y = rng.uniform(-6, 6, 300), np.concatenate((rng.uniform(0, 200, 200), rng.uniform(1200, 1500, 100)))
    z = x + y / 50
    df = spark.createDataFrame(pd.DataFrame({"crosstrack": x, "alongtrack": y, "z": z}))
    parts = offset.surface(df, 1.0).toPandas().sort_values("part")
    head = parts.iloc[0]
    grid = np.concatenate([np.frombuffer(d, "<f8").reshape(-1, head["nx"]) for d in parts["data"]])
    ix = np.minimum(((x - x.min()) * head["nx"] / np.ptp(x)).astype(int), head["nx"] - 1)
    iy = np.minimum(((y - y.min()) * head["ny"] / np.ptp(y)).astype(int), head["ny"] - 1)
    known = pd.DataFrame({"ix": ix, "iy": iy, "z": z}).groupby(["iy", "ix"])["z"].mean()
    at, values = np.array(known.index.tolist()), known.to_numpy()
    assert grid.shape == (head["ny"], head["nx"])
    for i, j in zip(rng.integers(0, head["ny"], 2000), rng.integers(0, head["nx"], 2000), strict=True):
        d = ((at - [i, j]) ** 2).sum(axis=1)
        assert np.isclose(values[d == d.min()], grid[i, j]).any()
    photons = pd.DataFrame({"crosstrack": rng.uniform(-8, 8, 200), "alongtrack": rng.uniform(-20, 1520, 200), "h_ph": 0.0})
    for r in offset.shift_costs(spark.createDataFrame(photons), offset.surface(df, 1.0), 2.0, 1.0).collect():
        over = offset.bilinear(grid.T, head["x0"], head["y0"], (head["rx"], head["ry"]), photons["crosstrack"] + r["dx"], photons["alongtrack"] + r["dy"])
        assert r["n"] == (~np.isnan(over)).sum() and r["mae"] == pytest.approx(np.nanmean(np.abs(over)))


def test_polygons_and_tracks(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))))
    line = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")) for a, x, y in ((0.0, -5.0, 1.0), (20.0, 15.0, 1.0))))
    r = spark.range(1).select(geometry.area(ring), geometry.within(F.lit(4.5), F.lit(1.0), ring, 1.0), geometry.within(F.lit(5.0), F.lit(1.0), ring, 1.0), geometry.crossings(ring, line), geometry.signed_crosstrack(F.lit(0.0), F.lit(3.0), line), geometry.projected_alongtrack(F.lit(0.0), F.lit(3.0), line)).first()
    assert tuple(r) == (12.0, True, False, 2, 2.0, 5.0)


def test_tiles_touching_at_the_buffer(spark):
    tiles = spark.createDataFrame([("in", 0.0, 0.0, 10.0, 10.0), ("touch", 0.0, 15.0, 10.0, 25.0), ("out", 0.0, 15.1, 10.0, 25.0)], "file_name string, x_min double, y_min double, x_max double, y_max double")
    track = spark.createDataFrame([(0.0, -50.0, 5.0), (100.0, 50.0, 5.0)], "at double, x double, y double")
    assert rows(spatial.tiles_near_track(tiles, track, 10.0, 20.0)) == [("in",), ("touch",)]


def test_every_figure_has_panels(spark):
    photons = spark.createDataFrame([(0, 1.0, 2.0, 2.0, 1, 1, 1, 0, 1.0, 1.0)], "i long, alongtrack double, h_ph double, ortho_h double, combined_class int, atl08_class int, atl24_class int, contested_class int, h_norm double, h_te_norm double")
    als = spark.createDataFrame([(1.0, 2.0, 2.0, 2, 3.0, 4.0, 5.0, 1.0, 1.0)], "alongtrack double, ortho_h double, ellip_h double, classification int, y double, latitude double, longitude double, h_norm double, h_topobathy_norm double")
    assert len(profile.FIGURES) == 20
    for name in profile.FIGURES:
        assert profile.figure(name, {"photons": photons, "als": als}).count() > 0


def test_radius_join_of_projected_points_copies_no_formulas_into_filters(spark):
    system = crs.parse_crs("EPSG:32610")
    at = spark.range(5).select("id", (500_000.0 + F.col("id")).alias("px"), (F.col("id") * 2 + 4e6).alias("py"))
    lon, lat = crs.unproject(system, F.col("px"), F.col("py"))
    x, y = crs.project(system, F.col("lon"), F.col("lat"))
    targets = at.select(F.col("id").alias("target"), lon.alias("lon"), lat.alias("lat")).select("target", x.alias("x"), y.alias("y"))
    met = spatial.within_radius(targets, at, 2.5)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 2000
    assert met.columns == ["target", "x", "y", "id", "px", "py", "distance"]
    assert rows(met.select("target", "id")) == [(a, b) for a in range(5) for b in range(5) if abs(a - b) < 2]


def test_utm_and_back_within_nanometres(spark):
    system = crs.parse_crs("EPSG:32610")
    df = spark.createDataFrame([(x, y) for x in (200_000.0, 500_012.3, 800_000.0) for y in (1e6, 2.5e6, 4e6, 8.5e6)], "x double, y double")
    lon, lat = crs.unproject(system, F.col("x"), F.col("y"))
    x, y = crs.project(system, F.col("lon"), F.col("lat"))
    for r in df.select("x", "y", lon.alias("lon"), lat.alias("lat")).select("x", "y", x.alias("u"), y.alias("v")).collect():
        assert abs(r["x"] - r["u"]) < 1e-8 and abs(r["y"] - r["v"]) < 1e-8


def test_longitudes_beyond_a_cone_s_cut_come_back(spark):
    conic = crs.parse_crs("EPSG:8716")
    at = [-180.0, -150.0, -120.5, 0.0, 59.0, 60.0, 150.0, 173.51, 179.99, 180.0]
    df = spark.createDataFrame([(v, 40.0) for v in at], "lon double, lat double")
    x, y = crs.project(conic, F.col("lon"), F.col("lat"))
    u, v = crs.project(conic, F.col("lon") - 360, F.col("lat"))
    flat = df.select("lon", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    lon, lat = crs.unproject(conic, F.col("x"), F.col("y"))
    for r in flat.select("*", lon.alias("back"), lat.alias("lat")).collect():
        assert abs((r["lon"] - r["back"] + 180) % 360 - 180) < 1e-9 and abs(r["back"]) <= 180 + 1e-9 and abs(r["lat"] - 40) < 1e-9
        assert abs(r["x"] - r["u"]) < 1e-4 and abs(r["y"] - r["v"]) < 1e-4
    lon, _ = crs.unproject(crs.parse_crs("EPSG:32660"), F.lit(900_000.0), F.lit(4e6))
    assert -180 < spark.range(1).select(lon.alias("lon")).first()["lon"] < -178


def test_reprojection_at_the_antimeridian_equals_its_table(spark, tmp_path):
    keys = [1519, 1541, 36000, 72000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    want = [(k, k * 7919 % 16000 / 100 - 80, k * 104729 % 36000 / 100 - 180, float(k % 500)) for k in keys]
    got = rows(registry.queries()["reproject_there_and_back"](spark, str(tmp_path)))
    assert [tuple(round(v, 6) for v in r) for r in want] == got
