"""Segment aggregation, row rules and ordered operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.functions import rules
from topolidar.functions.aggregates import RELATIVE_HEIGHTS, Recipe
from topolidar.functions.geo import haversine
from topolidar.operators import ordered, profile, reshape
from topolidar.operators.segments import aggregate_by_segment, join_segments
from topolidar.plans.inputs import C_SQL, E_SQL, events, places, r, table
from topolidar.plans.registry import query

_K = f"WITH {E_SQL}, k AS (SELECT *, CAST(floor((pos - min(pos) OVER ()) / 3600) AS BIGINT) AS key_id, min(pos) OVER () AS p0 FROM e)"
_CLICK, _SEEN = "event_type", ("click", "view")


def _segments(spark, sf_dir, recipes, **more):
    return aggregate_by_segment(events(spark, sf_dir), recipes, 3600, position="pos", **more)


def _one(name: str, operation: str, sql: str, classes=("click", "view")):
    listed = ", ".join(f"'{c}'" for c in classes)

    @query(name, f"{_K} SELECT key_id, {sql.format(f=f'FILTER (WHERE event_type IN ({listed}))')} AS metric FROM k GROUP BY key_id")
    def run(spark, sf_dir):
        metric = F.col("metric")
        out = _segments(spark, sf_dir, [Recipe("value", operation, _CLICK, classes, "metric")])
        return out.select("key_id", r(metric).alias("metric") if "round" in sql else F.coalesce(metric, F.lit(-1)).alias("metric"))

    return run


_one("seg_agg_median", "median", "round(median(value) {f}, 6) + 0.0", ("click",))
_one("seg_agg_max98", "get_max98", "round(quantile_cont(value, 0.98) {f}, 6) + 0.0")
_one("seg_agg_len", "get_len", "coalesce(nullif(count(*) {f}, 0), -1)", ("purchase",))
_one("seg_agg_len_unique", "get_len_unique", "coalesce(nullif(count(*) {f}, 0), -1)", ("error",))
_one("seg_agg_skew", "get_skew", "round(skewness(value) {f}, 6) + 0.0")
_one("seg_agg_std", "std", "round(stddev_samp(value) {f}, 6) + 0.0", ("view",))
_one("seg_agg_nunique", "nunique", "coalesce(nullif(count(DISTINCT value) {f}, 0), -1)", ("signup",))


@query("seg_agg_len_unique_intended", f"{_K} SELECT key_id, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS metric FROM k GROUP BY key_id")
def seg_agg_len_unique_intended(spark, sf_dir):
    return _segments(spark, sf_dir, [Recipe("user_id", "get_len_unique", _CLICK, "click", "metric")], compat="intended").select("key_id", "metric")


@query("seg_agg_mode", f"{_K}, m AS (SELECT key_id, floor(value) AS v, count(*) AS n FROM k WHERE event_type = 'view' GROUP BY ALL), d AS (SELECT DISTINCT key_id FROM k) SELECT key_id, coalesce(CAST(v AS BIGINT), -1) AS metric FROM d LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY n DESC, v) = 1) USING (key_id)")
def seg_agg_mode(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.floor("value"))
    return aggregate_by_segment(e, [Recipe("value", "get_mode", _CLICK, "view", "metric")], 3600, position="pos").select("key_id", F.coalesce("metric", F.lit(-1)).alias("metric"))


@query("seg_agg_rh18", f"{_K}, q AS (SELECT key_id, quantile_cont(value, {RELATIVE_HEIGHTS}) FILTER (WHERE event_type IN ('click', 'view')) AS l FROM k GROUP BY key_id) SELECT key_id, CAST(i AS INTEGER) AS i, round(l[i], 6) + 0.0 AS height FROM (SELECT key_id, l, unnest(range(1, 19)) AS i FROM q WHERE l IS NOT NULL)")
def seg_agg_rh18(spark, sf_dir):
    out = _segments(spark, sf_dir, [Recipe("value", "percentile_rh", _CLICK, _SEEN, "rh")])
    return out.select("key_id", F.posexplode("rh").alias("i", "height")).select("key_id", (F.col("i") + 1).alias("i"), r("height").alias("height"))


@query(
    "seg_agg_full_recipe",
    f"""{_K} SELECT key_id, round(key_id * 3600 + min(p0) + 1800, 6) + 0.0 AS pos, round(median(value) FILTER (WHERE event_type = 'click'), 6) + 0.0 AS h_te,
    round(quantile_cont(value, 0.98) FILTER (WHERE event_type IN ('click', 'view')), 6) + 0.0 AS h_canopy, coalesce(nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), -1) AS n_te,
    coalesce(nullif(count(*) FILTER (WHERE event_type = 'error'), 0), -1) AS n_shots, round(max(value) FILTER (WHERE event_type = 'signup'), 6) + 0.0 AS h_max FROM k GROUP BY key_id""",
)
def seg_agg_full_recipe(spark, sf_dir):
    recipes = [Recipe("value", "median", _CLICK, "click", "h_te"), Recipe("value", "get_max98", _CLICK, _SEEN, "h_canopy"), Recipe("value", "get_len", _CLICK, "purchase", "n_te"), Recipe("user_id", "get_len_unique", _CLICK, "error", "n_shots"), Recipe("value", "max", _CLICK, "signup", "h_max"), Recipe("absent", "mean", _CLICK, "view", "skipped")]
    out = _segments(spark, sf_dir, recipes)
    return out.select("key_id", r("pos").alias("pos"), r("h_te").alias("h_te"), r("h_canopy").alias("h_canopy"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_te", "n_shots")), r("h_max").alias("h_max"))


@query(
    "seg_agg_passthrough",
    f"""WITH {E_SQL}, k AS (SELECT *, CAST(floor((pos - min(pos) OVER (PARTITION BY event_type)) / 7200) AS BIGINT) AS key_id FROM e)
    SELECT event_type, key_id, round(avg(value), 6) + 0.0 AS a, round(stddev_samp(value), 6) + 0.0 AS v, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi, round(sum(value), 4) + 0.0 AS s, count(value) AS n,
    round(arg_min(value, event_id), 6) + 0.0 AS f, round(arg_max(value, event_id), 6) + 0.0 AS l FROM k GROUP BY ALL""",
)
def seg_agg_passthrough(spark, sf_dir):
    recipes = [Recipe("value", op, outfield=out) for op, out in (("mean", "a"), ("std", "v"), ("min", "lo"), ("max", "hi"), ("sum", "s"), ("count", "n"), ("first", "f"), ("last", "l"))]
    out = aggregate_by_segment(events(spark, sf_dir), recipes, 7200, by=["event_type"], position="pos", order="event_id")
    return out.select("event_type", "key_id", *(r(c, 4 if c == "s" else 6).alias(c) for c in ("a", "v", "lo", "hi", "s", "f", "l")), "n")


@query("segment_join", f"{_K}, a AS (SELECT key_id, count(*) AS n, min(p0) AS p0 FROM k WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT key_id, count(*) AS m FROM k WHERE event_type = 'purchase' GROUP BY ALL) SELECT key_id, n, coalesce(m, -1) AS m, round(p0 + key_id * 3600 + 1800, 6) + 0.0 AS pos_x FROM a LEFT JOIN b USING (key_id)")
def segment_join(spark, sf_dir):
    e = events(spark, sf_dir)
    start = e.agg(F.min("pos")).first()[0]  # one shared origin for both sensors
    sides = [aggregate_by_segment(e.where(F.col("event_type") == t), [Recipe("value", "get_len", outfield=o)], 3600, position="pos", start=start) for t, o in (("view", "n"), ("purchase", "m"))]
    return join_segments(*sides, position="pos").select("key_id", "n", F.coalesce("m", F.lit(-1)).alias("m"), r("pos_x").alias("pos_x"))


@query("bbox_filter", f"WITH {C_SQL} SELECT custkey, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM c WHERE lon BETWEEN -50 AND 60 AND lat BETWEEN -30 AND 45")
def bbox_filter(spark, sf_dir):
    return places(spark, sf_dir).where(rules.within_box(F.col("lon"), F.col("lat"), (-50, -30, 60, 45))).select("custkey", r("lat").alias("lat"), r("lon").alias("lon"))


@query("class_isin_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def class_isin_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(rules.ids(["click", "error"]))).select("event_id", "event_type")


_CLASSES = "cl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber % 4 AS INTEGER) AS land, CAST(CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 41 ELSE 1 END AS INTEGER) AS sea FROM lineitem)"


def _classes(spark, sf_dir):
    s = F.pmod("l_suppkey", F.lit(4))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pmod("l_linenumber", F.lit(4)).cast("int").alias("land"), F.when(s == 0, 0).when(s == 1, 40).when(s == 2, 41).otherwise(1).alias("sea"))


@query("combine_classes", f"WITH {_CLASSES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN sea IN (40, 41) THEN sea WHEN land = 0 AND sea <> 0 THEN sea ELSE land END AS cls FROM cl")
def combine_classes(spark, sf_dir):
    return _classes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", rules.combine_classes(F.col("land"), F.col("sea")).alias("cls"))


@query("contested_classes", f"WITH {_CLASSES} SELECT land, sea, CAST(CASE WHEN land > 0 AND sea > 0 THEN 3 WHEN sea > 0 THEN 2 WHEN land > 0 THEN 1 ELSE 0 END AS INTEGER) AS contested, count(*) AS n FROM cl GROUP BY ALL")
def contested_classes(spark, sf_dir):
    return _classes(spark, sf_dir).withColumn("contested", rules.contested(F.col("land"), F.col("sea"))).groupBy("land", "sea", "contested").agg(F.count(F.lit(1)).alias("n"))


@query("measurement_type", "WITH m AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value END AS a, CASE WHEN user_id % 3 = 0 THEN value END AS b FROM events) SELECT event_id, coalesce(nullif(concat_ws('-', CASE WHEN a IS NOT NULL THEN 'a' END, CASE WHEN b IS NOT NULL THEN 'b' END), ''), 'none') AS kind FROM m")
def measurement_type(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("b"))
    return m.select("event_id", rules.measurement_type(["a", "b"]).alias("kind"))


@query("reclassify_veg", "WITH g AS (SELECT vec_id, vec_id % 20 AS track, CASE WHEN vec_id % 20 < 5 THEN vec_id % 3 ELSE label % 6 END AS cls FROM embeddings), f AS (SELECT track, bool_or(cls = 2) AS ground, bool_or(cls IN (3, 4, 5)) AS veg FROM g GROUP BY track) SELECT vec_id, CAST(CASE WHEN ground AND NOT veg AND cls = 1 THEN 3 WHEN cls IN (4, 5) THEN 3 ELSE cls END AS BIGINT) AS cls FROM g JOIN f USING (track)")
def reclassify_veg(spark, sf_dir):
    v = F.col("vec_id")
    g = table(spark, sf_dir, "embeddings").select("vec_id", (v % 20).alias("track"), F.when(v % 20 < 5, v % 3).otherwise(F.col("label") % 6).alias("cls"))
    return rules.reclassify_vegetation(g, "cls", ["track"]).select("vec_id", F.col("cls").cast("long").alias("cls"))


@query("reclassify_als", "SELECT vec_id, CASE WHEN label = 1 THEN 3 ELSE label END AS cls FROM embeddings")
def reclassify_als(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rules.reclassify_unclassified(F.col("label")).alias("cls"))


@query("confidence_rule", f"WITH {_CLASSES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN sea = 40 AND (l_partkey % 100) / 100.0::DOUBLE > 0.6 THEN 0 ELSE sea END AS sea FROM cl")
def confidence_rule(spark, sf_dir):
    return _classes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", rules.confident_class(F.col("sea"), (F.col("l_partkey") % 100) / 100.0).alias("sea"))


@query("photon_rate", "SELECT user_id, round(CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) + 0.0 AS rate FROM events GROUP BY user_id")
def photon_rate(spark, sf_dir):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("a"), n("view").alias("b")).select("user_id", r(rules.photon_rate(F.col("a"), F.col("b"))).alias("rate"))


@query("unit_conversion", "SELECT p_partkey, round(p_retailprice * 0.3048, 6) + 0.0 AS metres FROM part")
def unit_conversion(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(rules.to_metres(F.col("p_retailprice"))).alias("metres"))


@query("decimate", "SELECT event_id FROM events WHERE event_id % 10 = 0")
def decimate(spark, sf_dir):
    return table(spark, sf_dir, "events").where(rules.decimated(F.col("event_id"), 10)).select("event_id")


@query(
    "ground_normalize",
    f"""{_K}, b AS (SELECT key_id AS b, median(value) FILTER (WHERE event_type = 'purchase') AS g FROM k GROUP BY key_id), g AS (SELECT b, g FROM b WHERE g IS NOT NULL),
    s AS (SELECT b.b, lo.b AS b0, lo.g AS g0, hi.b AS b1, hi.g AS g1 FROM b ASOF LEFT JOIN g AS lo ON b.b >= lo.b ASOF LEFT JOIN g AS hi ON b.b <= hi.b)
    SELECT event_id, round(value - CASE WHEN b0 = b1 THEN g0 WHEN b0 IS NULL THEN g1 WHEN b1 IS NULL THEN g0 ELSE g0 + (g1 - g0) * (b - b0) / (b1 - b0) END, 6) + 0.0 AS h_norm FROM k JOIN s ON key_id = b""",
)
def ground_normalize(spark, sf_dir):
    out = ordered.normalize_heights(events(spark, sf_dir), "value", "event_type", ["purchase"], 3600, position="pos")
    return out.select("event_id", r("h_norm").alias("h_norm"))


@query(
    "asof_nearest",
    f"""WITH {E_SQL}, l AS (SELECT event_id, user_id, pos FROM e WHERE event_type = 'error'), a AS (SELECT user_id, pos, max(value) AS v FROM e WHERE event_type = 'purchase' GROUP BY ALL),
    j AS (SELECT l.event_id, l.pos, p.pos AS p0, p.v AS v0, n.pos AS p1, n.v AS v1 FROM l ASOF LEFT JOIN a AS p ON l.user_id = p.user_id AND l.pos >= p.pos ASOF LEFT JOIN a AS n ON l.user_id = n.user_id AND l.pos <= n.pos)
    SELECT event_id, round(CASE WHEN p1 IS NULL OR pos - p0 <= p1 - pos THEN p0 ELSE p1 END, 6) + 0.0 AS near_pos, round(CASE WHEN p1 IS NULL OR pos - p0 <= p1 - pos THEN v0 ELSE v1 END, 6) + 0.0 AS v FROM j""",
)
def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "pos")
    right = e.where("event_type = 'purchase'").select("user_id", "pos", F.col("value").alias("v"))
    return ordered.asof_nearest(left, right, "pos", ["v"], ["user_id"]).select("event_id", r("right_key").alias("near_pos"), r("v").alias("v"))


@query("range_sum", "WITH s AS (SELECT s_suppkey, s_suppkey * 11 % 1500 AS lo, s_suppkey * 11 % 1500 + s_suppkey % 40 - 3 AS hi FROM supplier) SELECT s_suppkey, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM s LEFT JOIN part ON p_partkey BETWEEN lo AND hi GROUP BY s_suppkey")
def range_sum(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, (k * 11 % 1500).alias("lo"), (k * 11 % 1500 + k % 40 - 3).alias("hi"))
    return ordered.range_sum(s, table(spark, sf_dir, "part"), "lo", "hi", "p_partkey", "p_size").select("s_suppkey", F.col("total").cast("long").alias("total"))


@query(
    "lag_cumsum",
    f"""WITH {C_SQL}, t AS (SELECT custkey, custkey % 8 AS track, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM c WINDOW w AS (PARTITION BY custkey % 8 ORDER BY custkey)),
    h AS (SELECT custkey, track, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM t)
    SELECT custkey, round(sum(coalesce(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0)) OVER (PARTITION BY track ORDER BY custkey), 2) + 0.0 AS alongtrack FROM h""",
)
def lag_cumsum(spark, sf_dir):
    t = places(spark, sf_dir).withColumn("track", F.col("custkey") % 8)
    w = Window.partitionBy("track").orderBy("custkey")
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return ordered.running_distance(t.withColumn("d", step), F.col("d"), "custkey", ["track"]).select("custkey", r("alongtrack", 2).alias("alongtrack"))


@query("first_per_bin", f"WITH {E_SQL} SELECT user_id, CAST(floor(pos / 86400) AS BIGINT) AS day, min(event_id) AS event_id FROM e GROUP BY ALL")
def first_per_bin(spark, sf_dir):
    out = ordered.first_per_bin(events(spark, sf_dir), "pos", 86400, "event_id", ["user_id"])
    return out.select("user_id", F.floor(F.col("pos") / 86400).cast("long").alias("day"), "event_id")


@query("wide_to_long", "SELECT p_partkey, CAST(i AS INTEGER) AS part, round(p_retailprice + i, 4) + 0.0 AS h, p_size * i AS f FROM (SELECT *, unnest(range(0, 5)) AS i FROM part)")
def wide_to_long(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wide = p.select("p_partkey", *((F.col("p_retailprice") + i).alias(f"h_{i}") for i in range(5)), *((F.col("p_size").cast("long") * i).alias(f"f_{i}") for i in range(5)))
    return reshape.expand_families(wide, ["h", "f", "absent"], index="part").select("p_partkey", "part", r("h", 4).alias("h"), "f")


@query(
    "interp_linear",
    f"""WITH {E_SQL}, k AS (SELECT pos AS x, avg(value) AS y FROM e WHERE event_type = 'purchase' GROUP BY pos), q AS (SELECT event_id, pos FROM e WHERE event_type = 'error'),
    j AS (SELECT event_id, pos, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM q ASOF LEFT JOIN k AS a ON pos >= a.x ASOF LEFT JOIN k AS b ON pos <= b.x)
    SELECT event_id, round(CASE WHEN x0 = x1 THEN y0 WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (pos - x0) / (x1 - x0) END, 5) + 0.0 AS y FROM j""",
)
def interp_linear(spark, sf_dir):
    e = events(spark, sf_dir)
    line = e.where("event_type = 'purchase'").select(F.col("pos").alias("lx"), F.col("value").alias("ly"))
    return ordered.sample_line(e.where("event_type = 'error'").select("event_id", "pos"), line, "pos", "lx", "ly").select("event_id", r("y", 5).alias("y"))


@query("thirds", "WITH n AS (SELECT l_orderkey, l_quantity, ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS part FROM lineitem) SELECT l_orderkey, CAST(part AS INTEGER) AS part, round(avg(l_quantity), 6) + 0.0 AS m FROM n GROUP BY ALL")
def thirds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return ordered.in_thirds(rows, "at", "l_quantity", ["l_orderkey"]).select("l_orderkey", "part", r("mean").alias("m"))


@query("profile_series", f"WITH {E_SQL} SELECT 0 AS panel, CASE WHEN user_id % 7 = 0 THEN 'unclassified' WHEN user_id % 7 = 1 THEN 'ground' WHEN user_id % 7 = 2 THEN 'canopy' ELSE 'top of canopy' END AS series, count(*) AS n, round(sum(value), 3) + 0.0 AS y FROM e WHERE user_id % 7 < 4 AND (user_id % 7 > 0 OR event_id % 2 = 0) GROUP BY ALL")
def profile_series(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("pos").alias("alongtrack"), F.col("value").alias("h_ph"), (F.col("user_id") % 7).alias("combined_class"))
    out = profile.figure("alongtrack", {"photons": e}, thin="event_id")
    return out.groupBy("panel", "series").agg(F.count(F.lit(1)).alias("n"), r(F.sum("y"), 3).alias("y"))


@query("sub_segment_offset", "SELECT p_partkey, CASE WHEN p_size % 5 > 3 THEN 50.0::DOUBLE WHEN p_size % 7 > 4 THEN 30 WHEN p_size % 3 > 1 THEN 10 WHEN p_size % 2 > 0 THEN -10 WHEN p_size % 11 > 5 THEN -30 ELSE 0 END AS centre FROM part")
def sub_segment_offset(spark, sf_dir):
    flag = lambda m, over: F.when(F.col("p_size") % m > over, 1).otherwise(-127 if m == 7 else -1)
    return table(spark, sf_dir, "part").select("p_partkey", rules.sub_segment_offset([flag(5, 3), flag(7, 4), flag(3, 1), flag(2, 0), flag(11, 5)]).alias("centre"))


_MERGE = """WITH p AS (SELECT user_id % 3 AS granule, event_id AS pos, value AS h, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 40 ELSE 0 END AS c FROM events),
k AS (SELECT *, CAST(floor((pos - min(pos) OVER (PARTITION BY granule)) / 50) AS BIGINT) AS key_id, min(pos) OVER (PARTITION BY granule) AS p0 FROM p),
a AS (SELECT granule, key_id, key_id * 50 + min(p0) + 25.0::DOUBLE AS x, median(h) FILTER (WHERE c = 1) AS te, quantile_cont(h - 10, 0.98) FILTER (WHERE c IN (2, 3)) AS ca, count(*) FILTER (WHERE c = 1) AS n FROM k GROUP BY granule, key_id),
l AS (SELECT l_orderkey % 3 AS granule, l_orderkey AS pos, l_quantity AS h, l_linenumber AS c FROM lineitem),
m AS (SELECT *, CAST(floor((pos - min(pos) OVER (PARTITION BY granule)) / 50) AS BIGINT) AS key_id FROM l),
b AS (SELECT granule, key_id, median(h) FILTER (WHERE c = 2) AS als, count(*) FILTER (WHERE c IN (3, 4, 5)) AS nc FROM m GROUP BY granule, key_id)
SELECT granule, key_id, round(x, 6) + 0.0 AS alongtrack_x, round(te, 6) + 0.0 AS h_te_median, round(ca, 6) + 0.0 AS h_canopy, coalesce(nullif(n, 0), -1) AS n_terrain,
round(als, 6) + 0.0 AS als_h_te_median, coalesce(nullif(nc, 0), -1) AS als_n_canopy FROM a LEFT JOIN b USING (granule, key_id)"""


def _merge(spark, sf_dir, lineitem):
    from topolidar.plans import pipelines

    kind = F.col("event_type")
    cls = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 3).when(kind == "purchase", 40).otherwise(0)
    photons = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("granule"), F.col("event_id").alias("alongtrack"), F.col("value").alias("h_ph"), (F.col("value") - 10).alias("h_norm"), cls.alias("combined_class"))
    lidar = lineitem.select((F.col("l_orderkey") % 3).alias("granule"), F.col("l_orderkey").alias("alongtrack"), F.col("l_quantity").alias("ortho_h"), F.col("l_linenumber").alias("classification"))
    out = pipelines.topobathy(photons, lidar, 50.0, ["granule"])
    return out.select("granule", "key_id", r("alongtrack_x").alias("alongtrack_x"), *(r(c).alias(c) for c in ("h_te_median", "h_canopy", "als_h_te_median")), *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_terrain", "als_n_canopy")))


@query("topobathy_merge", _MERGE)
def topobathy_merge(spark, sf_dir):
    return _merge(spark, sf_dir, table(spark, sf_dir, "lineitem"))
