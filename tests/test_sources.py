"""Formats written and read again, settings, streams and pipelines on tiny tables."""

import struct

import pytest
from pyspark.sql import functions as F

from topolidar.plans import pipelines
from topolidar.sources import binary, config, granules, tables
from topolidar.streaming import windows


def las_file(points, wkt=b"EPSG:32610\0"):
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HHHIIBHI", head, 90, 32, 2021, 227, 227 + len(vlr), 1, 0, 20, len(points))
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 1000.0, 2000.0, 0.0)
    xs, ys, zs = zip(*[p[:3] for p in points], strict=True)
    struct.pack_into("<6d", head, 179, max(xs), min(xs), max(ys), min(ys), max(zs), min(zs))
    body = b"".join(struct.pack("<iiiHBBbBH", round((x - 1000) * 100), round((y - 2000) * 100), round(z * 100), 0, 0, c, 0, 0, 0) for x, y, z, c in points)
    return bytes(head) + vlr + body


def test_las_headers_and_points(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_file([(1000 + i, 2000 + 2 * i, 5.5, i % 3) for i in range(25)]))
    (tmp_path / "bad.las").write_bytes(b"no")
    heads = {r["file_name"].rsplit("/", 1)[1]: r for r in binary.read_las_headers(spark, str(tmp_path)).collect()}
    assert heads["bad.las"]["error"] and heads["a.las"]["crs"] == "EPSG:32610" and heads["a.las"]["x_max"] == 1024 and str(heads["a.las"]["creation_date"]) == "2021-02-01"
    got = binary.read_las_points(spark, str(tmp_path)).orderBy("pt_index").collect()
    assert [(r["pt_index"], round(r["x"], 2), r["classification"]) for r in got] == [(0, 1000.0, 0), (10, 1010.0, 1), (20, 1020.0, 2)]
    packed = bytearray(las_file([(1000, 2000, 5.5, 1)]))
    packed[104] |= 0x80
    (tmp_path / "packed.las").write_bytes(packed)
    (tmp_path / "short.las").write_bytes(las_file([(1000, 2000, 5.5, 1)] * 9)[:-5])
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in binary.unreadable_las(spark, str(tmp_path)).collect()} == {"bad.las": "not a LAS file", "packed.las": "packed", "short.las": "cut short"}
    for name in ("packed.las", "short.las"):
        (tmp_path / name).unlink()
    zoned = binary.read_las_headers(spark, str(tmp_path)).withColumn("zone", F.lit(10))
    assert pipelines.tile_catalogue(zoned).count() == 1


def test_gtx_grid(spark, tmp_path):
    (tmp_path / "g.gtx").write_bytes(struct.pack(">4d2i", 10.0, 20.0, 1.0, 1.0, 2, 3) + struct.pack(">6f", 1, 2, 3, 4, 5, 6))
    grid, origin, step, right = binary.read_gtx(spark, str(tmp_path / "g.gtx"))
    from topolidar.functions.geo import geoid_height

    at = spark.createDataFrame([(20.0, 10.0), (22.0, 11.0), (30.0, 10.0)], "lon double, lat double")
    assert [r["geoid"] for r in geoid_height(at, grid, "lon", "lat", origin, step, right).orderBy("lon").collect()] == [1.0, 6.0, None]


def test_tiff_extent():
    tags = [(256, 3, 1, struct.pack("<HH", 10, 0)), (257, 3, 1, struct.pack("<HH", 20, 0))]
    data = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 4)
    place = 8 + 2 + 4 * 12 + 4
    for tag, kind, n, value in tags:
        data += struct.pack("<HHI", tag, kind, n) + value
    data += struct.pack("<HHII", 33550, 12, 3, place) + struct.pack("<HHII", 33922, 12, 6, place + 24) + struct.pack("<I", 0)
    data += struct.pack("<3d", 2.0, 2.0, 0.0) + struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0)
    got = binary.tiff_extent(data)
    assert (got["x_min"], got["x_max"], got["y_min"], got["y_max"]) == (100.0, 120.0, 160.0, 200.0)


def test_geopackage_and_wkb(spark, tmp_path):
    df = spark.range(1).select(F.lit("b1").alias("name"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0)))).alias("ring"))
    tables.write_gpkg(df, str(tmp_path / "a.gpkg"), "buildings", 32610)
    got = tables.read_gpkg(spark, str(tmp_path / "a.gpkg")).first()
    assert got["name"] == "b1" and got["srid"] == 32610 and [tuple(p) for p in got["ring"]] == [(0, 0), (2, 0), (2, 1), (0, 0)]
    assert tables.polygon_rings(bytes(df.select(tables.ring_wkb(F.col("ring"))).first()[0])) == [[(0, 0), (2, 0), (2, 1), (0, 0)]]


def test_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3).withColumn("key_id", F.lit(1))

    for _ in range(2):
        assert tables.get_or_create(spark, str(tmp_path / "t"), make).columns == ["id"]
    assert len(calls) == 1


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("res: 30\nals: a\n")
    got = config.load(str(tmp_path / "c.yaml"), ["--als", "b"])
    assert (got.res, got.als, got.compat) == (30, "b", "observed")
    (tmp_path / "d.yaml").write_text("what: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.yaml"))


def test_pairs_and_attributes(spark):
    names = spark.createDataFrame([("ATL03_20200101000000_00010101_006_01.h5",), ("ATL03_20200102000000_00020101_006_01.h5",)], "name string")
    others = spark.createDataFrame([("d/ATL08_20200101000000_00010101_006_02.h5",), ("d/ATL08_20200101000000_00010101_006_01.h5",)], "path string")
    assert [r["path"] for r in granules.pair_granules(names, others).orderBy("name").collect()] == ["d/ATL08_20200101000000_00010101_006_01.h5", None]
    assert granules.unpaired(names, others).count() == 1


def test_stream_of_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0)]


def test_topobathy_pipeline(spark):
    n = 60
    photons = spark.createDataFrame([("g", "gt1l", i, i * 0.5, 10.0 + (3 if i % 3 == 0 else 0), 2 if i % 3 == 0 else 1, 1.0, 2.0, float(i)) for i in range(n)], "granule string, gt string, ph_index long, alongtrack double, h_ph double, combined_class int, longitude double, latitude double, delta_time double")
    ready = pipelines.photon_heights(photons)
    swath = spark.createDataFrame([("g", "gt1l", i * 0.5, 9.0, 2) for i in range(n)], "granule string, gt string, alongtrack double, z double, classification int").withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    lidar = pipelines.lidar_heights(swath).withColumn("ortho_h", F.col("z"))
    got = pipelines.topobathy(ready, lidar, res=10.0).orderBy("key_id").collect()
    assert len(got) == 3 and got[0]["h_canopy"] == pytest.approx(3.0) and got[0]["als_h_te_median"] == 9.0 and got[0]["n_terrain"] == 13


def test_swath_around_a_track(spark):
    track = spark.createDataFrame([("g", "a", float(i), float(i), 0.0) for i in range(0, 3001, 50)], "granule string, gt string, alongtrack double, x double, y double")
    tiles = spark.createDataFrame([("t1", 0.0, -100.0, 1000.0, 100.0), ("t2", 0.0, 5000.0, 1000.0, 6000.0)], "file_name string, x_min double, y_min double, x_max double, y_max double")
    points = spark.createDataFrame([("t1", 0, 510.0, 10.0, 1.0, 2), ("t1", 10, 510.0, -20.0, 1.0, 2), ("t1", 20, 510.0, 30.0, 1.0, 2), ("t1", 5, 510.0, 1.0, 1.0, 2), ("t2", 0, 500.0, 5500.0, 1.0, 2)], "file string, pt_index long, x double, y double, z double, classification int")
    got = pipelines.lidar_swath(points, tiles, track).orderBy("pt_index").collect()
    assert [(r["pt_index"], r["crosstrack"], r["alongtrack"], r["gt"]) for r in got] == [(0, 10.0, 510.0, "a"), (10, -20.0, 510.0, "a")]
