"""Sources, sinks, figures and whole chains over the driver's tables."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from topolidar.functions import crs, geo
from topolidar.operators import labels, ordered, profile, reshape, spatial
from topolidar.plans import pipelines
from topolidar.plans.inputs import C_SQL, E_SQL, V_SQL, events, places, points, r, table
from topolidar.plans.registry import query
from topolidar.plans.space_queries import _PH, _SEG, _TILES, _tiles
from topolidar.sources import binary, scratch, tables


def _fresh(spark, name):
    return f"{scratch.folder(spark)}/topolidar/{name}-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT p_partkey, p_name, p_size, round(p_retailprice, 6) + 0.0 AS price FROM part")
def csv_scan(spark, sf_dir):
    path = _fresh(spark, "csv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double").select("p_partkey", "p_name", "p_size", r("p_retailprice").alias("price"))


@query("segments_by_track", "SELECT CAST(user_id % 3 AS INTEGER) AS granule, 'gt' || user_id % 2 AS gt, count(*) AS n, round(sum(value), 3) + 0.0 AS total, true AS named FROM events GROUP BY ALL")
def segments_by_track(spark, sf_dir):
    path = _fresh(spark, "segments")
    e = table(spark, sf_dir, "events").withColumns({"granule": (F.col("user_id") % 3).cast("int"), "gt": F.concat(F.lit("gt"), (F.col("user_id") % 2).cast("string"))})
    tables.write_segments(e.select("granule", "gt", "event_id", "value"), path)
    back = tables.read_parquet(spark, path, file_name=True)
    return back.groupBy("granule", "gt").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"), F.min(F.col("file_name").endswith(".parquet")).alias("named"))


@query("made_once", "SELECT o_orderkey, round(o_totalprice * 2, 2) + 0.0 AS twice FROM orders")
def made_once(spark, sf_dir):
    path = _fresh(spark, "once")
    made = table(spark, sf_dir, "orders").select("o_orderkey", r(F.col("o_totalprice") * 2, 2).alias("twice"), F.lit(1).alias("key_id"))
    tables.get_or_create(spark, path, lambda: made)
    return tables.get_or_create(spark, path, lambda: made.limit(0))  # not made again


@query("edges_as_json", f"WITH {C_SQL} SELECT custkey, round(lat, 6) + 0.0 AS slope, round(lon, 6) + 0.0 AS intercept, lat > 0 AS valid, CASE WHEN custkey % 2 = 0 THEN round(lon, 6) + 0.0 END AS leaving FROM c")
def edges_as_json(spark, sf_dir):
    path = _fresh(spark, "edges")
    edge = F.struct(F.col("lat").alias("slope"), F.col("lon").alias("intercept"), (F.col("lat") > 0).alias("valid"))
    tables.edges_json(places(spark, sf_dir).select("custkey", edge.alias("entry"), F.when(F.col("custkey") % 2 == 0, edge).alias("exit")), path, ["custkey"])
    kind = "struct<slope:double,intercept:double,valid:boolean>"
    back = spark.read.schema(f"custkey long, entry {kind}, exit {kind}").json(path)
    return back.select("custkey", r("entry.slope").alias("slope"), r("entry.intercept").alias("intercept"), F.col("entry.valid").alias("valid"), r("exit.intercept").alias("leaving"))


def _las_files(spark, sf_dir):
    """(path, content): the point cloud as LAS files, one for each thousand points and label."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("vec_id")
        n, wkt = len(p), b"EPSG:32610\0"
        xyz = np.round(p[["x", "y", "z"]].to_numpy() * 100).astype("<i4")
        record = np.zeros(n, np.dtype({"names": ["p", "c"], "formats": ["(3,)<i4", "u1"], "offsets": [0, 15], "itemsize": 20}))
        record["p"], record["c"] = xyz, p["label"].to_numpy()
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", bytes([1, 2])
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt
        struct.pack_into("<HHHIIBHI", head, 90, 32, 2021, 227, 227 + len(vlr), 1, 0, 20, n)
        struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 0.0, 0.0, 0.0)
        struct.pack_into("<6d", head, 179, *(v / 100 for c in range(3) for v in (xyz[:, c].max(), xyz[:, c].min())))
        return pd.DataFrame({"path": [f"{p['part'].iloc[0]}_{p['label'].iloc[0]}.las"], "content": [bytes(head) + vlr + record.tobytes()]})

    rows = points(spark, sf_dir).withColumn("part", F.floor(F.col("vec_id") / 1000))
    return rows.groupBy("part", "label").applyInPandas(packed, "path string, content binary")


_LAS_SQL = f"WITH {V_SQL}, f AS (SELECT vec_id, CAST(floor(vec_id / 1000) AS BIGINT) || '_' || label || '.las' AS file, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y, round(z, 2) + 0.0 AS z, label AS classification, row_number() OVER (PARTITION BY floor(vec_id / 1000), label ORDER BY vec_id) - 1 AS pt_index FROM v)"


@query("las_points", f"{_LAS_SQL} SELECT file, pt_index, x, y, z, classification FROM f WHERE pt_index % 10 = 0")
def las_points(spark, sf_dir):
    out = binary.las_points(_las_files(spark, sf_dir), step=10)
    return out.select("file", "pt_index", r("x", 2).alias("x"), r("y", 2).alias("y"), r("z", 2).alias("z"), "classification")


@query("las_headers", f"{_LAS_SQL} SELECT file AS file_name, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, CAST('2021-02-01' AS DATE) AS creation_date, count(*) AS n_points, 'EPSG:32610' AS crs FROM f GROUP BY file")
def las_headers(spark, sf_dir):
    files = _las_files(spark, sf_dir).select("path", F.substring("content", 1, 1 << 16).alias("head"))
    out = binary.las_headers(files).where("error is null")
    return out.select("file_name", *(r(c, 2).alias(c) for c in ("x_min", "x_max", "y_min", "y_max", "z_min", "z_max")), "creation_date", "n_points", "crs")


@query("gpkg_round_trip", "SELECT n_name, CAST(n_nationkey AS VARCHAR) AS nation, CAST(4326 AS INTEGER) AS srid, CAST(5 AS INTEGER) AS vertices, round(CAST(n_nationkey AS DOUBLE), 6) + 0.0 AS x, round(n_regionkey + 0.5::DOUBLE, 6) + 0.0 AS y FROM nation")
def gpkg_round_trip(spark, sf_dir):
    path = _fresh(spark, "layer") + ".gpkg"
    n = table(spark, sf_dir, "nation")
    x, y = F.col("n_nationkey").cast("double"), F.col("n_regionkey") + 0.5
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    tables.write_gpkg(n.select("n_name", F.col("n_nationkey").alias("nation"), ring.alias("ring")), path, "nations", 4326)
    back = tables.read_gpkg(spark, path)
    return back.select("n_name", "nation", "srid", F.size("ring").alias("vertices"), r(F.col("ring")[0]["x"]).alias("x"), r(F.col("ring")[0]["y"]).alias("y"))


@query("rings_as_wkb", f"WITH {C_SQL} SELECT custkey, CAST(93 AS INTEGER) AS bytes, '01030000000100000005000000' AS head FROM c")
def rings_as_wkb(spark, sf_dir):
    ring = F.array(*(F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    wkb = places(spark, sf_dir).select("custkey", tables.ring_wkb(ring).alias("w"))
    return wkb.select("custkey", F.length("w").alias("bytes"), F.substring(F.lower(F.hex("w")), 1, 26).alias("head"))


@query("gtx_geoid", f"WITH {C_SQL}, g AS (SELECT CAST(floor((lat - 85.25) / -0.5) AS INTEGER) AS i, CAST(floor((CASE WHEN lon < 0 THEN lon + 360 ELSE lon END + 0.25) / 0.5) AS INTEGER) AS j, custkey FROM c) SELECT custkey, CASE WHEN i BETWEEN 0 AND 339 AND j BETWEEN 0 AND 719 THEN round(CAST((339 - i) * 7 % 50 + j % 30 AS DOUBLE) / 4, 6) + 0.0 END AS geoid FROM g")
def gtx_geoid(spark, sf_dir):
    path = _fresh(spark, "geoid") + ".gtx"
    i, j = np.mgrid[0:340, 0:720]
    tables.put(spark, path, struct.pack(">4d2i", -84.5, 0.0, 0.5, 0.5, 340, 720) + ((i * 7 % 50 + j % 30) / 4).astype(">f4").tobytes())
    grid, origin, step, right = binary.read_gtx(spark, path)
    return geo.geoid_height(places(spark, sf_dir), grid, "lon", "lat", origin, step, right).select("custkey", r("geoid").alias("geoid"))


@query("stacked", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance, NULL AS name FROM customer UNION ALL SELECT 's', s_suppkey, NULL, s_name FROM supplier")
def stacked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return reshape.stacked([c, table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("array_columns", f"SELECT vec_id, {', '.join(f'round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS e_{i}' for i in range(5))}, CAST(NULL AS DOUBLE) AS e_64 FROM embeddings")
def array_columns(spark, sf_dir):
    wide = reshape.exploded_columns(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), {"e": 65})
    return wide.select("vec_id", *(r(f"e_{i}").alias(f"e_{i}") for i in range(5)), "e_64")


# Figures.

_PHOTON_SQL = "photons AS (SELECT event_id, pos AS alongtrack, value AS h_ph, value - 5 AS ortho_h, value - 10 AS h_norm, value - 7 AS h_te_norm, user_id % 5 AS atl08_class, CASE user_id % 4 WHEN 1 THEN 40 WHEN 2 THEN 41 ELSE user_id % 4 END AS atl24_class, CASE WHEN user_id % 6 > 3 THEN 36 + user_id % 6 ELSE user_id % 6 END AS combined_class, user_id % 5 AS contested_class FROM e)"
_ALS_SQL = "als AS (SELECT y AS alongtrack, x AS y, z AS ortho_h, z + 1 AS ellip_h, z - 2 AS h_norm, z - 3 AS h_topobathy_norm, x / 100 AS latitude, y / 100 AS longitude, CASE WHEN label > 7 THEN 32 + label ELSE label END AS classification FROM v)"
_ALS_COLUMNS = {"alongtrack", "y", "ortho_h", "ellip_h", "h_norm", "h_topobathy_norm", "latitude", "longitude"}


def _figures_sql() -> str:
    parts = []
    for name, panels in profile.FIGURES.items():
        for panel, layers in enumerate(panels):
            for source, x, y, cls, series in layers:
                if source == "als" and not {x, y} <= _ALS_COLUMNS:
                    continue
                case = " ".join(f"WHEN {cls} IN ({', '.join(map(str, ids))}) THEN '{label}'" for label, ids in series.items())
                thin = f"AND ({cls} NOT IN (SELECT unnest([{', '.join(map(str, series.get('unclassified', (-1,))))}])) OR event_id % 2 = 0)" if source == "photons" and "unclassified" in series else ""
                parts.append(f"SELECT '{name}' AS figure, {panel} AS panel, CASE {case} END AS series, {x} AS px, {y} AS py FROM {source} WHERE CASE {case} END IS NOT NULL {thin}")
    return f"WITH {E_SQL}, {V_SQL}, {_PHOTON_SQL}, {_ALS_SQL}, rows_ AS ({' UNION ALL '.join(parts)}) SELECT figure, panel, series, count(*) AS n, round(avg(px - 1.5e9 * CAST(abs(px) > 1e8 AS INTEGER)), 4) + 0.0 AS x, round(avg(py), 6) + 0.0 AS y FROM rows_ GROUP BY ALL"


@query("figures", _figures_sql())
def figures(spark, sf_dir):
    """Every figure's panels and series: their rows' number and means."""
    u, v = F.col("user_id"), F.col("value")
    sea, both = F.when(u % 4 == 1, 40).when(u % 4 == 2, 41).otherwise(u % 4), F.when(u % 6 > 3, 36 + u % 6).otherwise(u % 6)
    photons = events(spark, sf_dir).select("event_id", F.col("pos").alias("alongtrack"), v.alias("h_ph"), (v - 5).alias("ortho_h"), (v - 10).alias("h_norm"), (v - 7).alias("h_te_norm"), (u % 5).alias("atl08_class"), sea.alias("atl24_class"), both.alias("combined_class"), (u % 5).alias("contested_class"))
    z, label = F.col("z"), F.col("label")
    als = points(spark, sf_dir).select(F.col("y").alias("alongtrack"), F.col("x").alias("y"), z.alias("ortho_h"), (z + 1).alias("ellip_h"), (z - 2).alias("h_norm"), (z - 3).alias("h_topobathy_norm"), (F.col("x") / 100).alias("latitude"), (F.col("y") / 100).alias("longitude"), F.when(label > 7, 32 + label).otherwise(label).alias("classification"))
    parts = [profile.figure(name, {"photons": photons, "als": als}, thin="event_id").select(F.lit(name).alias("figure"), "panel", "series", "x", "y") for name in profile.FIGURES]
    x = F.col("x") - 1.5e9 * (F.abs("x") > 1e8).cast("int")
    return reshape.stacked(parts).groupBy("figure", "panel", "series").agg(F.count(F.lit(1)).alias("n"), r(F.avg(x), 4).alias("x"), r(F.avg("y"), 6).alias("y"))


# Chains.


@query(
    "labelled_photons",
    f"""WITH {_SEG}, {_PH}, d AS (SELECT event_id AS ph_index, value, user_id FROM events),
    g AS (SELECT beg + l_linenumber - 2 AS ph_index, max(struct_pack(c := CAST(l_linenumber % 4 AS INTEGER), h := l_quantity)) AS m FROM lineitem JOIN s ON l_orderkey = o_orderkey WHERE beg <> 0 GROUP BY 1),
    q AS (SELECT event_id * 2 AS ph_index, CAST(CASE user_id % 4 WHEN 1 THEN 40 WHEN 2 THEN 41 ELSE user_id % 4 END AS INTEGER) AS c, value AS o FROM events),
    a AS (SELECT d.ph_index, coalesce(s.o_orderkey * 20.0::DOUBLE, 0) + value AS alongtrack, coalesce(CAST(v AS DOUBLE), 0) AS solar, coalesce(m.c, 0) AS land, coalesce(m.h, 0) AS h_norm, coalesce(q.c, 0) AS sea, coalesce(q.o, 0) AS ortho
          FROM d LEFT JOIN s ON beg > 0 AND d.ph_index BETWEEN beg - 1 AND beg + cnt - 2 LEFT JOIN g ON g.ph_index = d.ph_index LEFT JOIN q ON q.ph_index = d.ph_index)
    SELECT ph_index, round(alongtrack, 6) + 0.0 AS alongtrack, solar, land, round(h_norm, 6) + 0.0 AS h_norm, sea, round(ortho, 6) + 0.0 AS ortho_h, CASE WHEN sea IN (40, 41) THEN sea WHEN land = 0 AND sea <> 0 THEN sea ELSE land END AS combined,
    CAST(CASE WHEN land > 0 AND sea > 0 THEN 3 WHEN sea > 0 THEN 2 WHEN land > 0 THEN 1 ELSE 0 END AS INTEGER) AS contested FROM a""",
)
def labelled_photons(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("user_id")
    photons = table(spark, sf_dir, "events").select(F.col("event_id").alias("ph_index"), F.col("value").alias("dist_ph_along"))
    segments = table(spark, sf_dir, "orders").select(k.alias("segment_id"), F.when(k % 7 == 0, 0).otherwise(k * 4 - 3).alias("ph_index_beg"), (k % 4).alias("segment_ph_cnt"), (k * 20.0).alias("segment_dist_x"), F.col("o_custkey").cast("double").alias("solar_elevation"))
    land = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ph_segment_id"), F.col("l_linenumber").alias("classed_pc_indx"), (F.col("l_linenumber") % 4).cast("int").alias("classed_pc_flag"), F.col("l_quantity").cast("double").alias("ph_h"))
    sea = table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("index_ph"), F.when(u % 4 == 1, 40).when(u % 4 == 2, 41).otherwise(u % 4).cast("int").alias("class_ph"), F.col("value").alias("ortho_h"))
    out = labels.read_labelled(photons, segments, land, sea, by=[])
    return out.select("ph_index", r("alongtrack").alias("alongtrack"), F.col("solar_elevation").alias("solar"), F.col("atl08_class").alias("land"), r("h_norm").alias("h_norm"), F.col("atl24_class").alias("sea"), r("ortho_h").alias("ortho_h"), F.col("combined_class").alias("combined"), F.col("contested_class").alias("contested"))


def _over_ground(name: str, source: str, ids: str, height: str) -> str:
    """CTEs that end in ``name`` (id, h): heights over the medians of classes ``ids`` in bins of one metre, by track."""
    return f"""{name}k AS (SELECT *, CAST(floor(place - min(place) OVER (PARTITION BY track)) AS BIGINT) AS b FROM {source}),
    {name}m AS (SELECT track, b, median({height}) FILTER (WHERE cls IN ({ids})) AS g FROM {name}k GROUP BY ALL), {name}g AS (SELECT * FROM {name}m WHERE g IS NOT NULL),
    {name}s AS (SELECT m.track, m.b, lo.b AS b0, lo.g AS g0, hi.b AS b1, hi.g AS g1 FROM {name}m AS m ASOF LEFT JOIN {name}g AS lo ON m.track = lo.track AND m.b >= lo.b ASOF LEFT JOIN {name}g AS hi ON m.track = hi.track AND m.b <= hi.b),
    {name} AS (SELECT id, round({height} - CASE WHEN b0 = b1 THEN g0 WHEN b0 IS NULL THEN g1 WHEN b1 IS NULL THEN g0 ELSE g0 + (g1 - g0) * (b - b0) / (b1 - b0) END, 6) + 0.0 AS h FROM {name}k JOIN {name}s USING (track, b))"""


@query(
    "photon_heights",
    f"""WITH p AS (SELECT event_id AS id, user_id % 3 AS track, event_id / 4 AS place, value AS h, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 41 WHEN 'purchase' THEN 40 ELSE 0 END AS cls FROM events),
    f AS (SELECT * FROM p WHERE (id % 360) - 180 BETWEEN -120 AND 150 AND (id % 170) - 85 BETWEEN -60 AND 70), {_over_ground("one", "f", "1, 41", "h")}, {_over_ground("two", "f", "1, 40", "h")}
    SELECT one.id AS event_id, one.h AS h_te_norm, two.h AS h_norm FROM one JOIN two ON one.id = two.id""",
)
def photon_heights(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    cls = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 41).when(kind == "purchase", 40).otherwise(0)
    photons = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("gt"), (i / 4).alias("alongtrack"), F.col("value").alias("h_ph"), cls.alias("combined_class"), (i % 360 - 180).alias("longitude"), (i % 170 - 85).alias("latitude"))
    out = pipelines.photon_heights(photons, ["gt"], box=(-120, -60, 150, 70))
    return out.select("event_id", r("h_te_norm").alias("h_te_norm"), r("h_norm").alias("h_norm"))


@query(
    "lidar_heights",
    f"""WITH {V_SQL}, p AS (SELECT vec_id AS id, label % 3 AS track, y AS place, z * 0.3048 AS h, CASE WHEN label % 3 = 2 THEN [2, 1][1 + vec_id % 2] ELSE [2, 40, 41, 3, 5, 1][1 + vec_id % 6] END AS cls FROM v WHERE label % 3 < 3),
    q AS (SELECT id, track, place, h, CASE WHEN track = 1 AND cls = 40 THEN 4 ELSE cls END AS cls FROM p), {_over_ground("one", "q", "2, 40", "h")}, {_over_ground("two", "q", "2, 41", "h")},
    t AS (SELECT track, bool_or(cls = 40) AS sea, bool_or(cls = 2) AS ground, bool_or(cls IN (3, 4, 5)) AS veg FROM q GROUP BY track)
    SELECT q.id AS vec_id, CASE WHEN sea THEN one.h END AS h_topobathy_norm, two.h AS h_norm, round(q.h, 6) + 0.0 AS ellip_h, CAST(CASE WHEN ground AND NOT veg AND cls = 1 THEN 3 WHEN cls IN (4, 5) THEN 3 ELSE cls END AS INTEGER) AS classification FROM q JOIN t USING (track) JOIN one ON one.id = q.id JOIN two ON two.id = q.id""",
)
def lidar_heights(spark, sf_dir):
    i, track = F.col("vec_id"), F.col("label") % 3
    cls = F.when(track == 2, F.element_at(F.array(F.lit(2), F.lit(1)), (1 + i % 2).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, (2, 40, 41, 3, 5, 1))), (1 + i % 6).cast("int")))
    swath = points(spark, sf_dir).select("vec_id", track.alias("gt"), F.col("y").alias("alongtrack"), "x", "y", "z", F.when((track == 1) & (cls == 40), 4).otherwise(cls).alias("classification"))
    out = pipelines.lidar_heights(swath, ["gt"], feet=True)
    return out.select("vec_id", r("h_topobathy_norm").alias("h_topobathy_norm"), r("h_norm").alias("h_norm"), r("ellip_h").alias("ellip_h"), F.col("classification").cast("int").alias("classification"))


@query("lidar_swath", f"WITH {V_SQL} SELECT vec_id, round((y - x) / sqrt(2), 6) + 0.0 AS crosstrack, round((x + y) / sqrt(2) + 60 * sqrt(2), 6) + 0.0 AS alongtrack FROM v WHERE x >= -40 AND x < 40 AND y >= -40 AND y < 40 AND abs(y - x) / sqrt(2) < 4")
def lidar_swath(spark, sf_dir):
    """Points of the tiles near a diagonal track, in its coordinates."""
    at = F.col("id").cast("double")
    track = spark.range(-60, 61).select(F.lit("g").alias("granule"), F.lit("gt").alias("gt"), ((at + 60) * 2**0.5).alias("alongtrack"), at.alias("x"), at.alias("y"))
    v = points(spark, sf_dir).where((F.col("x") >= -40) & (F.col("x") < 40) & (F.col("y") >= -40) & (F.col("y") < 40))
    tile = F.format_string("t%d_%d", F.floor(F.col("x") / 10), F.floor(F.col("y") / 10))
    cloud = v.select("vec_id", tile.alias("file"), F.col("vec_id").alias("pt_index"), "x", "y", "z", F.col("label").alias("classification"))
    out = pipelines.lidar_swath(cloud, _tiles(spark), track, buffer=5.0, limit=4.0, res=10.0, step=1)
    return out.select("vec_id", r("crosstrack").alias("crosstrack"), r("alongtrack").alias("alongtrack"))


@query(
    "hit_buildings",
    f"""WITH {V_SQL}, b AS (SELECT vec_id, x, y, 8.0::DOUBLE + label AS s FROM v) SELECT vec_id, round((y - x) / sqrt(2) - s * sqrt(2), 6) + 0.0 AS low, round((y - x) / sqrt(2) + s * sqrt(2), 6) + 0.0 AS high, round((x + y) / sqrt(2) + 300 * sqrt(2) - s * sqrt(2), 6) + 0.0 AS first FROM b
    WHERE 4 * s * s > 100 AND greatest(abs(y - x) - 2 * s, 0) / sqrt(2) <= 5 AND (y - x) / sqrt(2) - s * sqrt(2) < -7 AND (y - x) / sqrt(2) + s * sqrt(2) > 7""",
)
def hit_buildings(spark, sf_dir):
    """Square buildings around points that a diagonal track hits, in its coordinates."""
    at = F.col("id").cast("double")
    track = spark.range(-300, 301, 20).select(F.lit("g").alias("granule"), F.lit("gt").alias("gt"), ((at + 300) * 2**0.5).alias("alongtrack"), at.alias("x"), at.alias("y"))
    s = F.lit(8.0) + F.col("label")
    ring = F.array(*(F.struct((F.col("x") + a * s).alias("x"), (F.col("y") + b * s).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    out = pipelines.footprint_buildings(points(spark, sf_dir).select(F.lit("g").alias("granule"), F.lit("gt").alias("gt"), F.col("vec_id").alias("building_id"), ring.alias("ring")), track)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return out.select(F.col("building_id").alias("vec_id"), r(F.array_min(xs)).alias("low"), r(F.array_max(xs)).alias("high"), r(F.array_min(ys)).alias("first"))


@query(
    "interp_kinds",
    f"""WITH {E_SQL}, k AS (SELECT pos AS x, avg(value) AS y FROM e WHERE event_type = 'purchase' GROUP BY pos), q AS (SELECT event_id, pos FROM e WHERE event_type = 'error'),
    j AS (SELECT event_id, pos, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM q ASOF LEFT JOIN k AS a ON pos >= a.x ASOF LEFT JOIN k AS b ON pos <= b.x)
    SELECT event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN pos - x0 <= x1 - pos THEN y0 ELSE y1 END, 6) + 0.0 AS nearest, round(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN y0 END, 6) + 0.0 AS previous, round(coalesce(y1, y0), 6) + 0.0 AS next_ FROM j""",
)
def interp_kinds(spark, sf_dir):
    e = events(spark, sf_dir)
    line = e.where("event_type = 'purchase'").select(F.col("pos").alias("lx"), F.col("value").alias("ly"))
    out = e.where("event_type = 'error'").select("event_id", "pos")
    for kind, beyond, name in (("nearest", "hold", "nearest"), ("previous", "null", "previous"), ("next", "hold", "next_")):
        out = ordered.sample_line(out, line, "pos", "lx", "ly", kind=kind, beyond=beyond, out=name)
    return out.select("event_id", r("nearest").alias("nearest"), r("previous").alias("previous"), r("next_").alias("next_"))


@query(
    "land_alongtrack",
    f"""WITH {C_SQL}, t AS (SELECT custkey, custkey % 8 AS track, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM c WINDOW w AS (PARTITION BY custkey % 8 ORDER BY custkey)),
    h AS (SELECT custkey, track, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM t)
    SELECT custkey, round(sum(coalesce(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0)) OVER (PARTITION BY track ORDER BY custkey), 2) + 0.0 AS alongtrack FROM h""",
)
def land_alongtrack(spark, sf_dir):
    """Land segments without geolocation segments: distances between centroids, added up."""
    land = places(spark, sf_dir).select((F.col("custkey") % 8).alias("gt"), F.col("custkey").alias("segment_id_beg"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return pipelines.land_alongtrack(land, None, ["gt"], metres=geo.haversine).select(F.col("segment_id_beg").alias("custkey"), r("alongtrack", 2).alias("alongtrack"))


@query("track_line", f"WITH {_TILES}, {V_SQL}, f AS (SELECT label, floor(y / 10) AS b, min(struct_pack(a := y, x := x)) AS m FROM v GROUP BY ALL) SELECT label, count(*) AS vertices, round(min(m.a), 6) + 0.0 AS first, round(sum(m.x), 6) + 0.0 AS xs FROM f GROUP BY label")
def track_line(spark, sf_dir):
    line = spatial.track_line(points(spark, sf_dir).select("label", F.col("y").alias("alongtrack"), "x", F.col("z").alias("y")), ["label"], res=10.0)
    total = F.aggregate(F.transform("line", lambda p: p["x"]), F.lit(0.0), lambda s, v: s + v)
    return line.select("label", F.size("line").cast("long").alias("vertices"), r(F.element_at("line", 1)["at"]).alias("first"), r(total).alias("xs"))


# Coordinate systems.


def _conic_sql(code: int) -> str:
    """Easting and northing in US feet from lon and lat, by the formulas of a conic projection with two parallels."""
    system = crs.parse_crs(f"EPSG:{code}")
    e2 = geo.FLATTENING_NAD * (2 - geo.FLATTENING_NAD)
    e = f"sqrt({e2!r})"
    m = lambda p: f"(cos(radians({p})) / sqrt(1 - {e2!r} * pow(sin(radians({p})), 2)))"
    t = lambda p: f"(tan(pi() / 4 - radians({p}) / 2) / pow((1 - {e} * sin(radians({p}))) / (1 + {e} * sin(radians({p}))), {e} / 2))"
    a, b = (repr(p) for p in system.parallels)
    n = f"((ln{m(a)} - ln{m(b)}) / (ln{t(a)} - ln{t(b)}))"
    scale = f"({geo.A_NAD!r}::DOUBLE * {m(a)} / ({n} * pow({t(a)}, {n})))"
    rho = lambda p: f"({scale} * pow({t(p)}, {n}))"
    theta = f"({n} * radians(lon - ({system.origin[0]!r})))"
    return f"round(({system.false[0]!r}::DOUBLE + {rho('lat')} * sin({theta})) * 3937 / 1200, 2) + 0.0 AS x, round(({system.false[1]!r}::DOUBLE + {rho(repr(system.origin[1]))} - {rho('lat')} * cos({theta})) * 3937 / 1200, 2) + 0.0 AS y"


@query("conic_project", f"WITH {C_SQL} SELECT custkey, {_conic_sql(8716)} FROM c WHERE lat > -60")
def conic_project(spark, sf_dir):
    x, y = crs.project(crs.parse_crs("EPSG:8716"), F.col("lon"), F.col("lat"), over=True)
    return places(spark, sf_dir).where("lat > -60").select("custkey", r(x, 2).alias("x"), r(y, 2).alias("y"))


@query("mercator_project", f"WITH {C_SQL} SELECT custkey, round(6378137.0::DOUBLE * radians(lon), 3) + 0.0 AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 AS y FROM c")
def mercator_project(spark, sf_dir):
    out = crs.reproject(places(spark, sf_dir), "EPSG:4326", "EPSG:3857", "lon", "lat")
    return out.select("custkey", r("lon", 3).alias("x"), r("lat", 3).alias("y"))


@query("reproject_there_and_back", f"WITH {C_SQL} SELECT custkey, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(CAST(custkey % 500 AS DOUBLE), 4) + 0.0 AS h FROM c WHERE lat BETWEEN 0 AND 70")
def reproject_there_and_back(spark, sf_dir):
    """Degrees on NAD83 to a conic system in feet, to Web Mercator and back to NAD83, with heights over a sloping geoid."""
    i, j = F.col("i"), F.col("j")
    grid = spark.range(181).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(361).select(F.col("id").cast("int").alias("j"))).select(i.alias("row"), j.alias("col"), ((i + j) / 10.0).alias("value"))
    geoid = (grid, (-180.5037, 90.5037), (1.0, -1.0), 180.4963)  # no point lies on a cell's side
    at = places(spark, sf_dir).where("lat between 0 and 70").withColumn("h", (F.col("custkey") % 500).cast("double"))
    conic = crs.reproject(at, "EPSG:4269", "EPSG:8716", "lon", "lat", "h", target_geoid=geoid)
    flat = crs.reproject(conic.withColumn("h", F.col("h") / crs.US_FOOT), "EPSG:8716", "EPSG:3857", "lon", "lat", "h", z_unit=crs.US_FOOT, source_geoid=geoid)
    back = crs.reproject(flat, "EPSG:3857", "EPSG:4269", "lon", "lat", "h")
    # The shift back is one with negated parameters: good to some tenths of a millimetre, which the rounding hides but for heights.
    # 180 and -180 are one meridian, of which the table has -180.
    lon = F.when(r("lon") == 180, -180.0).otherwise(r("lon"))
    return back.select("custkey", r("lat").alias("lat"), lon.alias("lon"), (F.round("h", 1) + 0.0).alias("h"))


@query("region_points", f"WITH {V_SQL}, {_TILES}, t AS (SELECT vec_id AS target_id, x AS tx, y AS ty FROM v WHERE vec_id % 50 = 0) SELECT target_id, count(*) AS n, round(avg(z * 1200 / 3937), 6) + 0.0 AS z FROM t JOIN v ON sqrt(pow(tx - x, 2) + pow(ty - y, 2)) < 2 GROUP BY target_id")
def region_points(spark, sf_dir):
    """Points of a cloud in UTM within two metres of targets in degrees; heights in feet."""
    system = crs.parse_crs("EPSG:32610")
    x, y = F.col("x") + 500_000, F.col("y") + 4_000_000
    v = points(spark, sf_dir)
    lon, lat = crs.unproject(system, x, y)
    targets = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("target_id"), lon.alias("lon"), lat.alias("lat"))
    cloud = v.select(x.alias("px"), y.alias("py"), "z", F.col("label").alias("classification"))
    found = pipelines.region_points(targets, cloud, "EPSG:32610", "EPSG:4326", radius=2.0, z_unit=crs.US_FOOT)
    return found.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("z"))
