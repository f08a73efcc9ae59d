"""Composite pipelines over all granules and beams at once: one lazy plan each, keyed by granule and gt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.functions import crs, geo, geometry, rules
from topolidar.operators import edges, labels, offset, ordered, reshape, segments, spatial
from topolidar.sources import scratch

BY = ("granule", "gt")


def photon_heights(photons: DataFrame, by: Sequence[str] = BY, box: Sequence[float] | None = None, geoid: tuple | None = None) -> DataFrame:
    """Labelled photons within a box, with heights over the geoid (h_ph - geoid) and over land ground and sea floor."""
    if "atl24_conf" in photons.columns:
        photons = photons.withColumn("atl24_class", rules.confident_class(F.col("atl24_class"), F.col("atl24_conf")))
    if box is not None:
        photons = photons.where(rules.within_box(F.col("longitude"), F.col("latitude"), box))
    if geoid is not None:
        photons = geo.geoid_height(photons, geoid[0], "longitude", "latitude", *geoid[1:]).withColumn("ortho_h", F.col("h_ph") - F.col("geoid")).drop("geoid")
    land = ordered.normalize_heights(photons, "h_ph", "combined_class", [1, 41], 1.0, by, out="h_te_norm")
    return ordered.normalize_heights(land, "h_ph", "combined_class", [1, 40], 1.0, by, out="h_norm")


def lidar_heights(swath: DataFrame, by: Sequence[str] = BY, feet: bool = False, zone: int | None = None, south: bool = False, source_geoid: tuple | None = None, target_geoid: tuple | None = None, nad83: bool = False) -> DataFrame:
    """A swath (x, y, z, classification, alongtrack) with units, heights over floor and ground, degrees, datum and geoid, and
    merged vegetation, in this order. Heights over the sea floor are NULL for a track without class 40."""
    z = rules.to_metres(F.col("z")) if feet else F.col("z")
    out = swath.withColumn("z", z)
    sea = out.groupBy(*by).agg(F.max((F.col("classification") == 40).cast("int")).alias("_sea"))
    out = ordered.normalize_heights(out, "z", "classification", [2, 40], 1.0, by, out="h_topobathy_norm").join(sea, list(by))
    out = out.withColumn("h_topobathy_norm", F.when(F.col("_sea") == 1, F.col("h_topobathy_norm"))).drop("_sea")
    out = ordered.normalize_heights(out, "z", "classification", [2, 41], 1.0, by, out="h_norm")
    if zone is not None:
        lat, lon = geo.utm_unproject(F.col("x"), F.col("y"), zone, south)
        out = out.withColumns({"latitude": lat, "longitude": lon})
    out = out.withColumn("ellip_h", F.col("z"))
    if source_geoid is not None:
        out = geo.geoid_height(out, source_geoid[0], "longitude", "latitude", *source_geoid[1:]).withColumn("ellip_h", F.col("z") + F.col("geoid")).drop("geoid")
    if nad83:
        out = geo.helmert(out, "longitude", "latitude", "ellip_h").drop("longitude", "latitude", "ellip_h").withColumnsRenamed({"lon_out": "longitude", "lat_out": "latitude", "h_out": "ellip_h"})
    if target_geoid is not None:
        out = geo.geoid_height(out, target_geoid[0], "longitude", "latitude", *target_geoid[1:]).withColumn("ortho_h", F.col("ellip_h") - F.col("geoid")).drop("geoid")
    return rules.reclassify_vegetation(out, "classification", by)


def lidar_swath(points: DataFrame, tiles: DataFrame, track: DataFrame, by: Sequence[str] = BY, buffer: float = 100.0, limit: float = 25.0, res: float = 100.0, step: int = 10) -> DataFrame:
    """Points (file, pt_index, x, y, z, classification) of the tiles near each track, every ``step``-th, in track coordinates,
    those within ``limit`` of it. ``track``: by, alongtrack, x, y. A tile's points see only the part of the track's line
    around the tile, so that their work doesn't grow with the track."""
    lines = spatial.track_line(track, by, res=res)
    vertices = lines.select(*by, F.explode("line").alias("v")).select(*by, "v.*")
    near = spatial.tiles_near_track(tiles, vertices, buffer, 1000.0, by=by)
    margin = max(buffer, res) + 50
    boxed = near.join(tiles.select("file_name", "x_min", "y_min", "x_max", "y_max"), "file_name").join(lines, list(by))
    around = F.filter("line", lambda v: v["x"].between(F.col("x_min") - margin, F.col("x_max") + margin) & v["y"].between(F.col("y_min") - margin, F.col("y_max") + margin))
    parts = boxed.select(*by, F.col("file_name").alias("file"), around.alias("line"))
    return spatial.to_track(points.where(rules.decimated(F.col("pt_index"), step)), parts, ["file"], limit=limit)


def topobathy(photons: DataFrame, swath: DataFrame | None = None, res: float = 20.0, by: Sequence[str] = BY, compat: str = "observed", attributes: DataFrame | None = None) -> DataFrame:
    """Segments of labelled photons with heights, joined to those of the swath. As observed, each sensor counts its segments
    from its own start; as intended both from the photons'."""
    own = segments.aggregate_by_segment(photons, segments.PHOTON_RECIPES, res, by, compat=compat)
    if swath is not None:
        if compat == "intended":
            start = photons.groupBy(*by).agg(F.min("alongtrack").alias("_first"))
            lidar = segments.aggregate_by_segment(swath.join(start, list(by)), segments.LIDAR_RECIPES, res, by, start=F.col("_first"), compat=compat)
        else:
            lidar = segments.aggregate_by_segment(swath, segments.LIDAR_RECIPES, res, by, compat=compat)
        own = segments.join_segments(own, lidar, by)
    if attributes is not None:
        from topolidar.sources.granules import with_attributes

        own = with_attributes(own, attributes, by)
    return own


def region_points(targets: DataFrame, cloud: DataFrame, source: str, target: str, radius: float = 6.0, z_unit: float = 1.0, geoid: tuple | None = None) -> DataFrame:
    """(target_id, px, py, z, classification): the points of a cloud (px, py, z in the ``source`` system) within ``radius``
    metres of each target (target_id, lon, lat), in the ``target`` system; heights over the ellipsoid if a geoid is given."""
    system = crs.parse_crs(source)
    x, y = crs.project(system, F.col("lon"), F.col("lat"))
    met = spatial.within_radius(targets.select("target_id", x.alias("x"), y.alias("y")), cloud, radius / system.unit)
    return crs.reproject(met.select("target_id", "px", "py", "z", "classification"), source, target, "px", "py", "z", z_unit, source_geoid=geoid)


def swath_and_heights(points: DataFrame, tiles: DataFrame, track: DataFrame, by: Sequence[str] = BY, buffer: float = 100.0, limit: float = 25.0, res: float = 100.0, step: int = 10, **heights) -> DataFrame:
    """The swath of each track with its heights: lidar_swath, then lidar_heights with what is given for it."""
    return lidar_heights(lidar_swath(points, tiles, track, by, buffer, limit, res, step), by, **heights)


def land_alongtrack(land: DataFrame, geosegments: DataFrame | None, by: Sequence[str] = BY, metres=geo.vincenty) -> DataFrame:
    """``land`` with alongtrack: the start of the first geolocation segment and half the length of all of them; without such
    segments the running sum of ``metres`` between neighbouring centroids, which falls short of the orbit's path."""
    if geosegments is None:
        w = Window.partitionBy(*by).orderBy("segment_id_beg")
        stepped = land.withColumns({"_lat": F.lag("latitude").over(w), "_lon": F.lag("longitude").over(w)})
        stepped = stepped.withColumn("_metres", metres(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")))
        return ordered.running_distance(stepped, F.col("_metres"), "segment_id_beg", by).drop("_lat", "_lon", "_metres")
    lengths = ordered.range_sum(land, geosegments, "segment_id_beg", "segment_id_end", "segment_id", "segment_length", by, out="total")
    starts = geosegments.select(*by, F.col("segment_id").alias("segment_id_beg"), "segment_dist_x")
    return lengths.join(starts, [*by, "segment_id_beg"], "left").withColumn("alongtrack", F.col("segment_dist_x") + F.col("total") / 2).drop("segment_dist_x", "total")


def land_segments(photons: DataFrame, land: DataFrame, geosegments: DataFrame | None, by: Sequence[str] = BY, res: float = 30.0) -> DataFrame:
    """30 m segments of photons with what the nearest land segment says, and photon rates for a shot."""
    at = land_alongtrack(land, geosegments, by)
    Recipe, cls = segments.Recipe, "atl08_class"
    recipes = [Recipe("h_ph", "get_len", cls, 1, "n_te_photons"), Recipe("h_ph", "get_len", cls, 2, "n_ca_photons"), Recipe("h_ph", "get_len", cls, 3, "n_toc_photons"), Recipe("h_ph", "get_len_unique", cls, (0, 1, 2, 3), "n_shots")]
    own = segments.aggregate_by_segment(photons, recipes, res, by)
    values = [c for c in at.columns if c not in (*by, "alongtrack")]
    near = ordered.asof_nearest(own, at, "alongtrack", values, by, order="segment_id_beg")
    canopy = F.coalesce("n_ca_photons", F.lit(0)) + F.coalesce("n_toc_photons", F.lit(0))
    return near.withColumn("canopy_rate", rules.photon_rate(canopy, F.col("n_shots"))).withColumn("terrain_rate", rules.photon_rate(F.coalesce("n_te_photons", F.lit(0)), F.col("n_shots")))


def land_segments_20m(land: DataFrame) -> DataFrame:
    return reshape.expand_families(land)


def footprint_buildings(buildings: DataFrame, track: DataFrame, by: Sequence[str] = BY, simple: bool = False) -> DataFrame:
    """Buildings (building_id, ring) that a track's photons (by, alongtrack, x, y) hit, with rings in track coordinates:
    within 5 m of its line, over 100 square metres, and reaching beyond the footprint on both sides. ``simple``: only those
    that the line enters and leaves once."""
    lines = spatial.track_line(track, by, res=10.0)
    met = spatial.corridor_buildings(buildings, lines, by, buffer=5.0, least_area=100.0)
    return spatial.not_grazing(spatial.rings_to_track(spatial.simple_crossings(met) if simple else met)).select(*by, "building_id", "ring")


def footprints(photons: DataFrame, swath: DataFrame, buildings: DataFrame, by: Sequence[str] = BY, tolerance: float = 1.0, cell: float = 1.0, shifts: DataFrame | None = None) -> DataFrame:
    """Photons around the walls of buildings (by, building_id, ring in track coordinates): the swath moved by the shift that
    fits terrain photons best over its ground, walls from its roofs, and each photon's distance to a wall that passed all
    checks, at most 10 m, and class by the roof at the wall. Buildings without such walls, and tracks without ground, give
    no rows. ``shifts`` (by, dx, dy): of offset.find_shift, if they are at hand."""
    photons = photons.drop("crosstrack").withColumn("crosstrack", F.lit(0.0))
    if shifts is None:
        shifts = offset.find_shift(photons.where("atl08_class = 1"), offset.surface(swath.where("classification = 2"), cell, by), by)
    key = [*by, "building_id"]
    around = scratch.written(spatial.clip(offset.shifted(swath, shifts, by), buildings, 21.0, by).where(F.abs("crosstrack") < 7), "around")
    centre = geometry.centroid(F.col("ring"))
    walls = scratch.written(edges.checked_edges(edges.building_edges(around, buildings.select(*key, centre["x"].alias("x0"), centre["y"].alias("y0")), key), around, key), "walls")
    # Photons meet the walls within 50 m of them by cells of 100 m along the track.
    reach = walls.where("valid").withColumn("_cell", F.explode(F.sequence(F.floor((F.col("intercept") - 50) / 100), F.floor((F.col("intercept") + 50) / 100))))
    near = photons.withColumn("_cell", F.floor(F.col("alongtrack") / 100)).join(reach, [*by, "_cell"]).drop("_cell")
    near = edges.band(near, "alongtrack", F.col("intercept"))
    d = rules.line_distance(F.col("crosstrack"), F.col("alongtrack"), F.col("slope"), F.col("intercept"), F.col("direction") == "exit")
    near = near.withColumn("distance", d).where(F.abs("distance") <= 10)
    return near.withColumn("photon_class", rules.photon_class(F.col("h_norm"), F.col("roof_median_h"), tolerance))


def tile_catalogue(headers: DataFrame, zone_of: str = "zone", south: bool = False) -> DataFrame:
    """Headers with a readable coordinate system, their corners in degrees, and their ring: lon and lat bounds of the UTM box."""
    good = headers.where("crs is not null and error is null")
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))))
    rows = good.select("*", F.posexplode(corners).alias("_i", "_c"))
    lat, lon = geo.utm_unproject(F.col("_c.x"), F.col("_c.y"), F.col(zone_of), south)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_lon", "_lat"))), lambda c: F.struct(c["_lon"].alias("x"), c["_lat"].alias("y")))
    found = rows.withColumn("_lat", lat).withColumn("_lon", lon).groupBy("file_name").agg(F.min("_lon").alias("lon_min"), F.max("_lon").alias("lon_max"), F.min("_lat").alias("lat_min"), F.max("_lat").alias("lat_max"), ring.alias("ring"))
    return good.join(found, "file_name")
