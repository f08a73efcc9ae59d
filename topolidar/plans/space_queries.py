"""Label joins, geodesy, grids, edges and spatial joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from topolidar.functions import geo, geometry, meta, rules
from topolidar.operators import edges, labels, offset, spatial
from topolidar.plans.inputs import C_SQL, E_SQL, V_SQL, events, places, points, r, table
from topolidar.plans.registry import query

#: Every seventh segment is empty: it begins at 0.
_SEG = "s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey * 4 - 3 END AS beg, o_orderkey % 4 AS cnt, o_custkey AS v FROM orders)"
_PH = "p AS (SELECT event_id AS ph_index FROM events)"


def _order_segments(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("segment_id"), F.when(k % 7 == 0, 0).otherwise(k * 4 - 3).alias("ph_index_beg"), (k % 4).alias("ph_count"), F.col("o_custkey").alias("v"))


def _event_photons(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ph_index"))


@query("segment_to_photon", f"WITH {_SEG}, {_PH} SELECT ph_index, coalesce(v, 0) AS v FROM p LEFT JOIN s ON beg > 0 AND ph_index BETWEEN beg - 1 AND beg + cnt - 2")
def segment_to_photon(spark, sf_dir):
    return labels.segment_to_photon(_event_photons(spark, sf_dir), _order_segments(spark, sf_dir), ["v"])


_SIGNAL = "g AS (SELECT l_orderkey AS seg, 1 + l_linenumber % 4 AS i, CAST(l_linenumber % 4 AS INTEGER) AS cls, l_quantity AS h FROM lineitem), x AS (SELECT beg + i - 2 AS ph_index, max(struct_pack(o := h, c := cls)) AS m FROM g JOIN s ON seg = o_orderkey WHERE beg <> 0 GROUP BY 1)"


def _signal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    signal = rows.select(F.col("l_orderkey").alias("ph_segment_id"), (1 + F.col("l_linenumber") % 4).alias("classed_pc_indx"), F.pmod("l_linenumber", F.lit(4)).cast("int").alias("cls"), F.col("l_quantity").alias("h"))
    return labels.label_index(signal, _order_segments(spark, sf_dir))


@query("scatter_labels", f"WITH {_SEG}, {_PH}, {_SIGNAL} SELECT ph_index, coalesce(m.c, 0) AS cls, coalesce(m.o, 0) AS h FROM p LEFT JOIN x USING (ph_index)")
def scatter_labels(spark, sf_dir):
    return labels.scatter(_event_photons(spark, sf_dir), _signal(spark, sf_dir), ["cls", "h"], order="h").select("ph_index", "cls", F.col("h").cast("double").alias("h"))


@query("labels_out_of_range", f"WITH {_SEG}, {_PH}, {_SIGNAL} SELECT ph_index, count(*) AS n FROM (SELECT beg + i - 2 AS ph_index FROM g JOIN s ON seg = o_orderkey WHERE beg <> 0) WHERE ph_index NOT IN (SELECT ph_index FROM p) GROUP BY 1")
def labels_out_of_range(spark, sf_dir):
    return labels.out_of_range(_event_photons(spark, sf_dir), _signal(spark, sf_dir)).groupBy("ph_index").agg(F.count(F.lit(1)).alias("n"))


@query("ismember", "SELECT c_custkey, coalesce(i, -1) AS first_index FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS i FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def ismember(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    out = labels.is_member(rows, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), ["k"], "o_orderkey")
    return out.select(F.col("k").alias("c_custkey"), F.coalesce("first_index", F.lit(-1)).alias("first_index"))


@query("ismember_rows", "SELECT s_suppkey, coalesce(i, -1) AS first_index FROM supplier LEFT JOIN (SELECT l_suppkey, l_linenumber, min(l_orderkey) AS i FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey AND l_linenumber = 1 + s_suppkey % 9")
def ismember_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("a"), (1 + F.col("s_suppkey") % 9).cast("int").alias("b"))
    reference = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("int").alias("b"), "l_orderkey")
    return labels.is_member(rows, reference, ["a", "b"], "l_orderkey").select("s_suppkey", F.coalesce("first_index", F.lit(-1)).alias("first_index"))


#: Granules of all orders; the files of the other product are of another day for every other one.
_NAME = "printf('%s_2020%04d010203_%08d_006_01.h5', '{0}', (o_orderkey + {1}) % 1231, o_orderkey)"
_NAMES_SQL = f"a AS (SELECT {_NAME.format('ATL03', '0')} AS name FROM orders), b AS (SELECT {_NAME.format('ATL08', 'o_orderkey % 2')} AS path FROM orders)"


def _names(spark, sf_dir, product, moved, out):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.format_string(f"{product}_2020%04d010203_%08d_006_01.h5", (k + (k % 2 if moved else 0)) % 1231, k).alias(out))


@query("granule_pairing", f"WITH {_NAMES_SQL} SELECT name, path FROM a JOIN b ON substr(name, 6) = substr(path, 6)")
def granule_pairing(spark, sf_dir):
    from topolidar.sources.granules import pair_granules

    return pair_granules(_names(spark, sf_dir, "ATL03", False, "name"), _names(spark, sf_dir, "ATL08", True, "path")).where("path is not null").select("name", "path")


@query("missing_pairs_anti", f"WITH {_NAMES_SQL} SELECT name FROM a WHERE substr(name, 6) NOT IN (SELECT substr(path, 6) FROM b)")
def missing_pairs_anti(spark, sf_dir):
    from topolidar.sources.granules import unpaired

    return unpaired(_names(spark, sf_dir, "ATL03", False, "name"), _names(spark, sf_dir, "ATL08", True, "path"))


@query("meta_parse", f"WITH {_NAMES_SQL} SELECT name, substr(name, 1, 5) AS product, substr(name, 7, 8) AS date, substr(name, 15, 6) AS time, substr(name, 22, 4) AS track, substr(name, 26, 4) AS cycle, substr(name, 31, 3) AS release, substr(name, 35, 2) AS version, 'final' AS kind FROM a")
def meta_parse(spark, sf_dir):
    names = _names(spark, sf_dir, "ATL03", False, "name")
    return names.select("name", *(c.alias(k) for k, c in meta.granule_fields(F.col("name")).items()))


@query("doy_t2t", "SELECT o_orderkey, lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') AS doy, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, printf('%02d:%02d:%02d.000000', o_orderkey * 7 % 86400 // 3600, o_orderkey * 7 % 86400 % 3600 // 60, o_orderkey * 7 % 60) AS clock FROM orders")
def doy_t2t(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("doy", meta.day_of_year(F.col("o_orderdate")))
    month, day = meta.month_and_day(F.year("o_orderdate"), F.col("doy"))
    return o.select("o_orderkey", "doy", month.alias("m"), day.alias("d"), meta.clock(F.col("o_orderkey") * 7).alias("clock"))


@query("haversine", f"WITH {C_SQL}, h AS (SELECT custkey, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2) AS h FROM c) SELECT custkey, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) + 0.0 AS metres FROM h")
def haversine(spark, sf_dir):
    return places(spark, sf_dir).select("custkey", r(geo.haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 3).alias("metres"))


def _vincenty_sql() -> str:
    """The iteration as a recursive query: rounds until the step in longitude is under the tolerance."""
    f, a = repr(geo.FLATTENING), repr(geo.A)
    b = repr((1 - geo.FLATTENING) * geo.A)
    return f"""WITH RECURSIVE {C_SQL},
    p AS (SELECT custkey, atan((1 - {f}) * tan(radians(lat))) AS u1, atan((1 - {f}) * tan(radians(10.0::DOUBLE))) AS u2, radians(20.0::DOUBLE) - radians(lon) AS apart, lat = 10 AND lon = 20 AS here FROM c),
    it AS (SELECT custkey, u1, u2, apart, here, apart AS lam, 1.0::DOUBLE AS step, 0 AS n FROM p UNION ALL
      SELECT custkey, u1, u2, apart, here, fresh, abs(fresh - lam), n + 1 FROM (SELECT *, apart + (1 - cc) * {f} * sa * (sigma + cc * ss * (mid + cc * cs * (2 * mid * mid - 1))) AS fresh FROM
        (SELECT *, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS cc, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS mid FROM
          (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM
            (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE step >= 1e-12 AND n < 200))))),
    e AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY n DESC) = 1),
    g AS (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM e),
    h AS (SELECT *, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS mid, (1 - sa * sa) * (pow({a}::DOUBLE, 2) - pow({b}::DOUBLE, 2)) / pow({b}::DOUBLE, 2) AS u FROM g),
    k AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM h)
    SELECT custkey, CASE WHEN here THEN 0 WHEN step < 1e-12 THEN round({b}::DOUBLE * big * (sigma - small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))), 3) + 0.0 END AS metres FROM k"""


@query("vincenty", _vincenty_sql())
def vincenty(spark, sf_dir):
    return places(spark, sf_dir).select("custkey", F.nanvl(r(geo.vincenty(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 3), F.lit(None).cast("double")).alias("metres"))


_ZONE = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 ELSE CAST(floor((lon + 180) / 6) AS INTEGER) + 1 END"


@query("utm_zone", f"WITH {C_SQL} SELECT custkey, CAST({_ZONE} AS INTEGER) AS zone, CASE WHEN lat >= 84 THEN 'X' WHEN lat < -80 THEN 'C' ELSE substr('CDEFGHIJKLMNOPQRSTUVWX', CAST(floor((lat + 80) / 8) AS INTEGER) + 1, 1) END AS letter FROM c")
def utm_zone(spark, sf_dir):
    zone, letter = geo.utm_zone(F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).select("custkey", zone.alias("zone"), letter.alias("letter"))


@query("utm_epsg", f"WITH {C_SQL} SELECT custkey, CAST(CASE WHEN lat >= 84 THEN 32661 WHEN lat < -80 THEN 32761 WHEN lat > 0 THEN 32600 + {_ZONE} ELSE 32700 + {_ZONE} END AS INTEGER) AS epsg FROM c")
def utm_epsg(spark, sf_dir):
    return places(spark, sf_dir).select("custkey", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def _utm_sql() -> str:
    radius, alpha, _ = geo._krueger()
    e = (geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5
    xs = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    ys = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""WITH {C_SQL}, z AS (SELECT custkey, lat, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, sin(radians(lat)) AS s, lon FROM c),
    t AS (SELECT custkey, lat, sinh(0.5 * ln((1 + s) / (1 - s)) - {e!r} * 0.5 * ln((1 + {e!r} * s) / (1 - {e!r} * s))) AS t, radians(lon - (zone * 6 - 183)) AS lam FROM z),
    u AS (SELECT custkey, lat, atan2(t, cos(lam)) AS xi, sin(lam) / sqrt(1 + t * t) AS q FROM t), w AS (SELECT custkey, lat, xi, 0.5 * ln((1 + q) / (1 - q)) AS eta FROM u)
    SELECT custkey, round(500000 + 0.9996::DOUBLE * {radius!r}::DOUBLE * (eta + {xs}), 3) + 0.0 AS x, round(CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + 0.9996::DOUBLE * {radius!r}::DOUBLE * (xi + {ys}), 3) + 0.0 AS y FROM w"""


@query("utm_project", _utm_sql())
def utm_project(spark, sf_dir):
    zone = F.floor((F.col("lon") + 180) / 6).cast("int") + 1
    x, y = geo.utm_project(F.col("lat"), F.col("lon"), zone, F.col("lat") < 0)
    return places(spark, sf_dir).select("custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("utm_round_trip", f"WITH {C_SQL} SELECT custkey, round(lat, 7) + 0.0 AS lat, round(lon, 7) + 0.0 AS lon FROM c")
def utm_round_trip(spark, sf_dir):
    zone = F.floor((F.col("lon") + 180) / 6).cast("int") + 1
    x, y = geo.utm_project(F.col("lat"), F.col("lon"), zone, F.col("lat") < 0)
    at = places(spark, sf_dir).select("custkey", zone.alias("zone"), (F.col("lat") < 0).alias("south"), x.alias("x"), y.alias("y"))
    lat, lon = geo.utm_unproject(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return at.select("custkey", r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


def _helmert_sql(inverse: bool) -> str:
    import math

    p = {k: (-v if inverse else v) for k, v in geo.HELMERT.items()}
    nad, wgs = (geo.A_NAD, geo.FLATTENING_NAD), (geo.A, geo.FLATTENING)
    (a1, f1), (a2, f2) = (wgs, nad) if inverse else (nad, wgs)
    e1, e2 = f1 * (2 - f1), f2 * (2 - f2)
    rx, ry, rz = (repr(math.radians(p[k] / 3600)) for k in ("rx", "ry", "rz"))
    m = repr(1 + p["s"] * 1e-9)
    rounds = ", ".join(f"f{i} AS (SELECT custkey, u, v, w, r, atan2(w + {e2!r} * ({a2!r} / sqrt(1 - {e2!r} * pow(sin(f), 2))) * sin(f), r) AS f FROM f{i - 1})" for i in range(1, 6))
    return f"""WITH {C_SQL}, g AS (SELECT custkey, radians(lat) AS p, radians(lon) AS l, CAST(custkey % 500 AS DOUBLE) AS h, {a1!r} / sqrt(1 - {e1!r} * pow(sin(radians(lat)), 2)) AS n FROM c),
    q AS (SELECT custkey, (n + h) * cos(p) * cos(l) AS x, (n + h) * cos(p) * sin(l) AS y, (n * (1 - {e1!r}) + h) * sin(p) AS z FROM g),
    t AS (SELECT custkey, ({p["tx"]!r}) + {m} * (x - ({rz}) * y + ({ry}) * z) AS u, ({p["ty"]!r}) + {m} * (({rz}) * x + y - ({rx}) * z) AS v, ({p["tz"]!r}) + {m} * (({rx}) * y - ({ry}) * x + z) AS w FROM q),
    f0 AS (SELECT custkey, u, v, w, sqrt(u * u + v * v) AS r, atan2(w, sqrt(u * u + v * v) * (1 - {e2!r})) AS f FROM t), {rounds}
    SELECT custkey, round(degrees(atan2(v, u)), 8) + 0.0 AS lon, round(degrees(f), 8) + 0.0 AS lat, round(r / cos(f) - {a2!r} / sqrt(1 - {e2!r} * pow(sin(f), 2)), 4) + 0.0 AS h FROM f5"""


def _helmert(inverse):
    def run(spark, sf_dir):
        at = places(spark, sf_dir).withColumn("h", (F.col("custkey") % 500).cast("double"))
        return geo.helmert(at, "lon", "lat", "h", inverse).select("custkey", r("lon_out", 8).alias("lon"), r("lat_out", 8).alias("lat"), r("h_out", 4).alias("h"))

    return run


query("helmert_fwd", _helmert_sql(False))(_helmert(False))
query("helmert_inv", _helmert_sql(True))(_helmert(True))

_GRID = "grid AS (SELECT CAST(a AS INTEGER) AS row, CAST(b AS INTEGER) AS col, (a * 7 + b * 3) % 101 / 10.0::DOUBLE AS value FROM range(0, 34) t(a), range(0, 72) s(b))"


@query("geoid_lookup", f"WITH {C_SQL}, {_GRID} SELECT custkey, round(value, 6) + 0.0 AS geoid FROM c LEFT JOIN grid ON row = CAST(floor((lat - 85) / -5) AS INTEGER) AND col = CAST(floor(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END / 5) AS INTEGER)")
def geoid_lookup(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    grid = spark.range(34).select(F.col("id").alias("a")).crossJoin(spark.range(72).select(F.col("id").alias("b"))).select(a.cast("int").alias("row"), b.cast("int").alias("col"), ((a * 7 + b * 3) % 101 / 10.0).alias("value"))
    return geo.geoid_height(places(spark, sf_dir), grid, "lon", "lat", (0.0, 85.0), (5.0, -5.0), 360.0).select("custkey", r("geoid").alias("geoid"))


@query(
    "grid_mean",
    f"""WITH {V_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v), n AS (SELECT *, greatest(ceil((x1 - x0) / 5), 1) AS nx, greatest(ceil((y1 - y0) / 5), 1) AS ny FROM b)
    SELECT CAST(least(floor((x - x0) * nx / (x1 - x0)), nx - 1) AS INTEGER) AS ix, CAST(least(floor((y - y0) * ny / (y1 - y0)), ny - 1) AS INTEGER) AS iy, round(avg(z), 6) + 0.0 AS z, count(*) AS n FROM v, n GROUP BY ALL""",
)
def grid_mean(spark, sf_dir):
    return offset.grid_mean(points(spark, sf_dir), "x", "y", "z", 5.0).select("ix", "iy", r("z").alias("z"), "n")


_CLS = "d AS (SELECT vec_id, round(x, 3) AS dist, CASE WHEN abs(z - 8) <= 5 THEN 'roof' WHEN abs(z) <= 5 THEN 'ground' ELSE 'noise' END AS cls, vec_id % 10 AS file FROM v)"


def _classed(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", F.round("x", 3).alias("dist"), rules.photon_class(F.col("z"), F.lit(8.0), 5.0).alias("cls"), (F.col("vec_id") % 10).alias("file"), "x", "y", "z", "label")


@query("photon_class", f"WITH {V_SQL}, {_CLS} SELECT vec_id, cls FROM d")
def photon_class(spark, sf_dir):
    return _classed(spark, sf_dir).select("vec_id", "cls")


@query(
    "esf_histogram",
    f"""WITH {V_SQL}, {_CLS}, k AS (SELECT CAST(greatest(ceil((dist + 10) / 0.5) - 1, 0) AS INTEGER) AS bin, cls FROM d WHERE dist BETWEEN -10 AND 10 AND cls <> 'noise'),
    n AS (SELECT bin, count(*) FILTER (WHERE cls = 'ground') AS g, count(*) FILTER (WHERE cls = 'roof') AS b FROM k GROUP BY bin), a AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 40) t(i))
    SELECT bin, round(-10 + (bin + 0.5::DOUBLE) * 0.5, 6) + 0.0 AS centre, coalesce(g, 0) AS ground, coalesce(b, 0) AS building, round(CAST(b AS DOUBLE) / nullif(g + b, 0), 6) + 0.0 AS ratio FROM a LEFT JOIN n USING (bin)""",
)
def esf_histogram(spark, sf_dir):
    out = edges.edge_spread(_classed(spark, sf_dir), "dist", "cls")
    return out.select("bin", r("centre").alias("centre"), "ground", "building", r("ratio").alias("ratio"))


@query("orthogonal_distance", f"WITH {V_SQL} SELECT vec_id, round(-((y - (0.1::DOUBLE * x + 3)) / sqrt(0.1::DOUBLE * 0.1::DOUBLE + 1)), 6) + 0.0 AS d FROM v WHERE abs((y - (0.1::DOUBLE * x + 3)) / sqrt(0.1::DOUBLE * 0.1::DOUBLE + 1)) <= 10")
def orthogonal_distance(spark, sf_dir):
    d = rules.line_distance(F.col("x"), F.col("y"), F.lit(0.1), F.lit(3.0), leaving=True)
    return points(spark, sf_dir).withColumn("d", d).where(F.abs("d") <= 10).select("vec_id", r("d").alias("d"))


@query("quality_gate", f"WITH {V_SQL}, {_CLS}, q AS (SELECT file FROM d GROUP BY file HAVING count(*) FILTER (WHERE cls = 'ground') > 3 AND count(*) FILTER (WHERE cls = 'roof') > 3 AND max(dist) FILTER (WHERE cls = 'ground') < 26 AND min(dist) FILTER (WHERE cls = 'roof') > -26) SELECT vec_id, file FROM d WHERE file IN (SELECT file FROM q)")
def quality_gate(spark, sf_dir):
    return edges.quality_gate(_classed(spark, sf_dir), ["file"], "dist", "cls", reach=26.0).select("vec_id", "file")


@query("edge_bins", f"WITH {V_SQL} SELECT label, CAST(greatest(0, least(floor((x + 6) / 1) + 1, 13)) AS INTEGER) AS bin, round(min(x), 6) + 0.0 AS exy, round(min(y), 6) + 0.0 AS ey, round(max(x), 6) + 0.0 AS oxy, round(max(y), 6) + 0.0 AS oy FROM v GROUP BY ALL")
def edge_bins(spark, sf_dir):
    out = edges.edge_points(points(spark, sf_dir), "x", "y", ["label"])
    return out.select("label", "bin", r("entry_xt").alias("exy"), r("entry_at").alias("ey"), r("exit_xt").alias("oxy"), r("exit_at").alias("oy"))


@query(
    "local_edge_reason",
    f"""WITH {V_SQL}, p AS (SELECT vec_id % 12 AS b, x / 10 AS d, z / 4 + 6 AS h, CASE WHEN label < 6 THEN 6 ELSE 2 END AS cls FROM v),
    s AS (SELECT b, count(*) FILTER (WHERE cls = 6 AND d BETWEEN 0 AND 3) AS n, quantile_cont(h, [0.25, 0.5, 0.75]) FILTER (WHERE cls = 6 AND d BETWEEN 0 AND 3) AS q FROM p GROUP BY b),
    c AS (SELECT b, count(*) FILTER (WHERE h > q[1] - 1 AND h < q[3] + 1) AS blocked FROM p JOIN s USING (b) WHERE -d BETWEEN 1 AND 8 GROUP BY b)
    SELECT b, n, round(q[2], 6) + 0.0 AS med, round(q[3] - q[1], 6) + 0.0 AS iqr, CASE WHEN n < 10 THEN 'few roof points' WHEN q[3] - q[1] > 2.5 THEN 'uneven roof' WHEN coalesce(blocked, 0) > 0 THEN 'no clearance' WHEN q[2] < 3 THEN 'low roof' ELSE 'ok' END AS reason FROM s LEFT JOIN c USING (b)""",
)
def local_edge_reason(spark, sf_dir):
    p = points(spark, sf_dir).select((F.col("vec_id") % 12).alias("b"), (F.col("x") / 10).alias("distance"), (F.col("z") / 4 + 6).alias("h_norm"), F.when(F.col("label") < 6, 6).otherwise(2).alias("classification"))
    out = edges.local_edge_conditions(p, ["b"], most_iqr=2.5)
    return out.select("b", F.col("n_roof").alias("n"), r("roof_median_h").alias("med"), r("roof_iqr").alias("iqr"), "reason")


_SURFACE = "su AS (SELECT CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, avg(z) AS surface FROM v WHERE label < 5 GROUP BY ALL), ph AS (SELECT x, y, z FROM v WHERE label >= 5)"


def _surface(spark, sf_dir):
    v = points(spark, sf_dir)
    cells = v.where("label < 5").groupBy(F.floor(F.col("x") / 5).cast("long").alias("cx"), F.floor(F.col("y") / 5).cast("long").alias("cy")).agg(F.avg("z").alias("surface"))
    return v.where("label >= 5"), cells


@query("mae_shift_search", f"WITH {V_SQL}, {_SURFACE}, i AS (SELECT i * 0.5::DOUBLE - 10 AS d FROM range(0, 40) t(i)) SELECT a.d AS dx, b.d AS dy, round(avg(abs(z - surface)), 6) + 0.0 AS mae, count(*) AS n FROM ph, i AS a, i AS b JOIN su ON cx = CAST(floor((x + a.d) / 5) AS BIGINT) AND cy = CAST(floor((y + b.d) / 5) AS BIGINT) GROUP BY ALL")
def mae_shift_search(spark, sf_dir):
    v, cells = _surface(spark, sf_dir)
    out = offset.cell_costs(v, cells, 5.0)
    return out.select(F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), r("mae").alias("mae"), "n")


@query("z_shift", f"WITH {V_SQL}, {_SURFACE} SELECT round(coalesce(median(z - surface), 0), 6) + 0.0 AS z_shift FROM ph LEFT JOIN su ON cx = CAST(floor(x / 5) AS BIGINT) AND cy = CAST(floor(y / 5) AS BIGINT)")
def z_shift(spark, sf_dir):
    v, cells = _surface(spark, sf_dir)
    return offset.cell_median(v, cells, 5.0).select(r("z_shift").alias("z_shift"))


_TILES = "tiles AS (SELECT 't' || i || '_' || j AS file_name, CAST(i * 10 AS DOUBLE) AS x_min, CAST(j * 10 AS DOUBLE) AS y_min, CAST(i * 10 + 10 AS DOUBLE) AS x_max, CAST(j * 10 + 10 AS DOUBLE) AS y_max FROM range(-4, 4) a(i), range(-4, 4) b(j))"


def _tiles(spark):
    i, j = F.col("i"), F.col("j")
    grid = spark.range(-4, 4).select(F.col("id").alias("i")).crossJoin(spark.range(-4, 4).select(F.col("id").alias("j")))
    side = lambda c: c.cast("double")
    return grid.select(F.concat(F.lit("t"), i.cast("string"), F.lit("_"), j.cast("string")).alias("file_name"), side(i * 10).alias("x_min"), side(j * 10).alias("y_min"), side(i * 10 + 10).alias("x_max"), side(j * 10 + 10).alias("y_max"))


@query("spatial_inner_join", f"WITH {V_SQL}, {_TILES} SELECT vec_id, file_name FROM v JOIN tiles ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max")
def spatial_inner_join(spark, sf_dir):
    return spatial.points_in_boxes(points(spark, sf_dir), _tiles(spark), 10.0).select("vec_id", "file_name")


@query("tile_semi_join", f"WITH {_TILES}, n AS (SELECT *, greatest(x_min, least(x_max, (x_min + y_min) / 2)) AS q FROM tiles) SELECT file_name FROM n WHERE greatest(x_min - y_max, y_min - x_max, 0) / sqrt(2) <= 4")
def tile_semi_join(spark, sf_dir):
    track = spark.range(-50, 51, 5).select(F.col("id").cast("double").alias("at"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    return spatial.tiles_near_track(_tiles(spark), track, 4.0, 10.0)


_RING = [(-15.0, -15.0), (12.0, -18.0), (20.0, 5.0), (0.5, 21.0), (-18.0, 9.0)]


def _ring():
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))


def _ring_sql() -> str:
    hits = []
    for (ax, ay), (bx, by) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        hits.append(f"CAST((({ay} > y) <> ({by} > y)) AND x < {ax} + (y - ({ay})) * (({bx}) - ({ax})) / (({by}) - ({ay}))  AS INTEGER)")
    return f"WITH {V_SQL} SELECT vec_id FROM v WHERE ({' + '.join(hits)}) % 2 = 1"


@query("point_in_polygon", _ring_sql())
def point_in_polygon(spark, sf_dir):
    return points(spark, sf_dir).where(geometry.inside(F.col("x"), F.col("y"), _ring())).select("vec_id")


@query("polygon_area", "SELECT s_suppkey, round(abs((0 * (s_suppkey % 17 + 1.0::DOUBLE) - s_suppkey * 0) + (s_suppkey * (s_suppkey % 17 + 1.0::DOUBLE) - s_suppkey * 0.0::DOUBLE) + 0) / 2, 6) + 0.0 AS area FROM supplier")
def polygon_area(spark, sf_dir):
    k = F.col("s_suppkey").cast("double")
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (k, F.lit(0.0)), (k, F.pmod(k, F.lit(17.0)) + 1))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r(geometry.area(ring)).alias("area"))


_VERTICES = [(0.0, -30.0, -20.0), (30.0, -5.0, 2.0), (60.0, 25.0, 8.0), (90.0, 50.0, 30.0)]


def _line():
    return F.array(*(F.struct(F.lit(a).alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")) for a, x, y in _VERTICES))


def _line_sql() -> str:
    legs = []
    for (t0, ax, ay), (t1, bx, by) in zip(_VERTICES, _VERTICES[1:], strict=False):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0.0, least(1.0, ((x - ({ax})) * {dx} + (y - ({ay})) * {dy}) / {dx * dx + dy * dy}))"
        legs.append(f"struct_pack(d := sqrt(pow(x - ({ax}) - {t} * {dx}, 2) + pow(y - ({ay}) - {t} * {dy}, 2)), a := {t0} + {t} * {t1 - t0})")
    (_, ax, ay), (_, bx, by) = _VERTICES[0], _VERTICES[-1]
    cross = f"{bx - ax} * (y - ({ay})) - {by - ay} * (x - ({ax}))"
    return f"WITH {V_SQL}, n AS (SELECT vec_id, least({', '.join(legs)}) AS m, {cross} AS s FROM v) SELECT vec_id, round(m.d * CASE WHEN s < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS crosstrack, round(m.a, 6) + 0.0 AS alongtrack FROM n WHERE m.d < 25"


@query("track_coordinates", _line_sql())
def track_coordinates(spark, sf_dir):
    lines = spark.range(1).select(_line().alias("line"))
    out = spatial.to_track(points(spark, sf_dir), lines, [])
    return out.select("vec_id", r("crosstrack").alias("crosstrack"), r("alongtrack").alias("alongtrack"))


@query("radius_p98", f"WITH {V_SQL}, t AS (SELECT vec_id AS id, x AS tx, y AS ty FROM v WHERE vec_id % 50 = 0), j AS (SELECT id, z, label % 6 AS c FROM t JOIN v ON sqrt(pow(tx - x, 2) + pow(ty - y, 2)) < 6) , a AS (SELECT id, count(*) AS n, quantile_cont(z, 0.98) FILTER (WHERE c IN (0, 1, 3, 4, 5)) - median(z) FILTER (WHERE c = 2) AS h FROM j GROUP BY id) SELECT t.id, coalesce(n, 0) AS n_points, round(CASE WHEN n >= 5 THEN h END, 6) + 0.0 AS als_98 FROM t LEFT JOIN a USING (id)")
def radius_p98(spark, sf_dir):
    v = points(spark, sf_dir)
    targets = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "x", "y")
    cloud = v.select(F.col("x").alias("px"), F.col("y").alias("py"), "z", (F.col("label") % 6).alias("classification"))
    return spatial.heights_around(targets, cloud, "id", 6.0).select("id", "n_points", r("als_98").alias("als_98"))


def _clip_sql() -> str:
    away = []
    for (ax, ay), (bx, by) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0.0, least(1.0, ((x - ({ax})) * ({dx}) + (y - ({ay})) * ({dy})) / {dx * dx + dy * dy}))"
        away.append(f"sqrt(pow(x - ({ax}) - {t} * ({dx}), 2) + pow(y - ({ay}) - {t} * ({dy}), 2))")
    inside = _ring_sql()
    return f"{inside[: inside.index(' SELECT vec_id FROM v WHERE')]} SELECT vec_id, 1 AS building_id FROM v WHERE {inside.split(' FROM v WHERE ')[1]} OR least({', '.join(away)}) < 2"


@query("clip_buildings", _clip_sql())
def clip_buildings(spark, sf_dir):
    ring = spark.range(1).select(F.lit(1).alias("building_id"), _ring().alias("ring"))
    return spatial.clip(points(spark, sf_dir), ring, 2.0, x="x", y="y").select("vec_id", "building_id")


@query("building_edges")
def building_edges(spark, sf_dir):
    v = points(spark, sf_dir).select(F.lit(1).alias("building_id"), (F.col("x") / 6).alias("crosstrack"), (F.col("y") / 6).alias("alongtrack"), F.lit(6).alias("classification"))
    centre = spark.range(1).select(F.lit(1).alias("building_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    return edges.building_edges(v, centre).select("building_id", F.to_json("entry").alias("entry"), F.to_json("exit").alias("exit"))


def _unproject_sql(x: str, y: str) -> tuple[str, str, str]:
    """CTEs from ``corner`` to ``geo`` (its columns, lat and lon): the inverse of the projection's series in zone 10."""
    radius, _, beta = geo._krueger()
    e, scale = repr((geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5), repr(0.9996 * radius)
    xs = " + ".join(f"{v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(beta, 1))
    ys = " + ".join(f"{v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(beta, 1))
    rounds = ", ".join(f"f{i} AS (SELECT * REPLACE (atan(sinh(q + {e} * atanh({e} * sin(f)))) AS f) FROM f{i - 1})" for i in range(1, 5))
    return f"""xe AS (SELECT *, {y} / {scale}::DOUBLE AS xi, ({x} - 500000) / {scale}::DOUBLE AS eta FROM corner),
    x1 AS (SELECT *, xi - ({xs}) AS xi1, eta - ({ys}) AS eta1 FROM xe),
    f0 AS (SELECT *, asinh(sin(xi1) / sqrt(pow(sinh(eta1), 2) + pow(cos(xi1), 2))) AS q, atan(sin(xi1) / sqrt(pow(sinh(eta1), 2) + pow(cos(xi1), 2))) AS f FROM x1), {rounds},
    geo AS (SELECT *, degrees(f) AS lat, degrees(atan2(sinh(eta1), cos(xi1))) - 123 AS lon FROM f4)"""


_CORNERS = "corner AS (SELECT file_name, x_min * 100 + 500000 AS x0, CASE WHEN i IN (1, 2) THEN x_max ELSE x_min END * 100 + 500000 AS cx, CASE WHEN i IN (2, 3) THEN y_max ELSE y_min END * 100 + 4000000 AS cy FROM tiles, range(0, 4) t(i))"


@query("tile_catalogue", f"WITH {_TILES}, {_CORNERS}, {_unproject_sql('cx', 'cy')} SELECT file_name, round(min(x0), 3) + 0.0 AS x_min, round(min(lon), 8) + 0.0 AS lon_min, round(max(lon), 8) + 0.0 AS lon_max, round(min(lat), 8) + 0.0 AS lat_min, round(max(lat), 8) + 0.0 AS lat_max FROM geo GROUP BY file_name")
def tile_catalogue(spark, sf_dir):
    from topolidar.plans import pipelines

    at = lambda c, base: (F.col(c) * 100 + base).alias(c)
    heads = _tiles(spark).select("file_name", at("x_min", 500_000), at("x_max", 500_000), at("y_min", 4_000_000), at("y_max", 4_000_000), F.lit(10).alias("zone"), F.lit("EPSG:32610").alias("crs"), F.lit(None).cast("string").alias("error"))
    return pipelines.tile_catalogue(heads).select("file_name", r("x_min", 3).alias("x_min"), *(r(c, 8).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")))


def _footprint_inputs(spark, sf_dir):
    """A made-up swath and its photons: tracks by the labels' parity, one flat roof of 6 m over uneven ground for each."""
    v = points(spark, sf_dir).withColumn("granule", F.lit("g")).withColumn("gt", F.concat(F.lit("gt"), (F.col("label") % 2).cast("string")))
    x, y = F.col("x") / 4, F.col("y") / 4
    roof = (F.abs(x) < 6.5) & (F.abs(y) < 2.5)
    ground = F.sin(x) + F.cos(y / 2)
    rows = v.select("granule", "gt", "vec_id", x.alias("crosstrack"), y.alias("alongtrack"), roof.alias("roof"), ground.alias("ground"), (F.col("z") / 100).alias("noise"))
    swath = rows.select("granule", "gt", "crosstrack", "alongtrack", (F.col("ground") + F.when(F.col("roof"), 6.0).otherwise(0.0)).alias("z"), F.when(F.col("roof"), 6).otherwise(2).alias("classification"), F.when(F.col("roof"), 6.0).otherwise(0.0).alias("h_norm"))
    along = F.col("alongtrack")
    photons = rows.select("granule", "gt", "vec_id", along, (1.0 * F.cos(along / 2) + F.col("noise")).alias("h_ph"), F.when(F.abs(along) < 2.5, 2).otherwise(1).alias("atl08_class"), F.when(F.abs(along) < 2.5, 6.0).otherwise(0.0).alias("h_norm"))
    ring = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((-8.0, -2.5), (8.0, -2.5), (8.0, 2.5), (-8.0, 2.5))))
    buildings = v.select("granule", "gt").distinct().withColumn("building_id", F.lit(1)).withColumn("ring", ring)
    return photons, swath, spatial.not_grazing(buildings)


@query("footprint_photons")
def footprint_photons(spark, sf_dir):
    """The footprint pipeline over the made-up swath, its photons counted by wall and class."""
    from topolidar.plans import pipelines

    out = pipelines.footprints(*_footprint_inputs(spark, sf_dir), cell=1.0)
    return out.groupBy("granule", "gt", "building_id", "direction", "photon_class").agg(F.count(F.lit(1)).alias("n"))


@query("shift_search")
def shift_search(spark, sf_dir):
    """The shift of each track of the made-up swath, over its ground without holes, and what photons then lie above it."""
    photons, swath, _ = _footprint_inputs(spark, sf_dir)
    terrain = photons.where("atl08_class = 1").withColumn("crosstrack", F.lit(0.0))
    ground = offset.surface(swath.where("classification = 2"), 1.0, ["granule", "gt"])
    best = offset.find_shift(terrain, ground, ["granule", "gt"])
    above = offset.z_shift(terrain, ground, best, ["granule", "gt"])
    return best.join(above, ["granule", "gt"]).select("granule", "gt", *(r(c).alias(c) for c in ("dx", "dy", "mae", "z_shift")))
