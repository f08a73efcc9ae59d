"""Tables in and out: Parquet, CSV, JSON edges, results that are made once, and vector layers in GeoPackages."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def read_parquet(spark: SparkSession, path: str | Sequence[str], file_name: bool = False) -> DataFrame:
    """Parquet files, with the name of each row's file if asked for."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select("*", F.col("_metadata.file_name").alias("file_name")) if file_name else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_segments(df: DataFrame, path: str, by: Sequence[str] = ("granule", "gt"), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def get_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame], drop: Sequence[str] = ("key_id",)) -> DataFrame:
    """The table at ``path``, made and written first if its last write did not complete; columns in ``drop`` are left out."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    return df.drop(*[c for c in drop if c in df.columns])


def edges_json(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Edges as lines of valid JSON: missing numbers are left out, never NaN."""
    df.select(*by, "entry", "exit").write.mode(mode).json(path)


def ring_wkb(ring: Column) -> Column:
    """A ring as the bytes of a polygon in well-known binary, closed if it is open; NULL for a null or empty one."""

    @F.arrow_udf("binary")
    def run(rings: pa.Array) -> pa.Array:
        flat = rings.flatten()
        xy = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype("<f8")
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(rings), 0).to_pylist()]).tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            points = xy[a:b] if a == b or (xy[a] == xy[b - 1]).all() else np.vstack((xy[a:b], xy[a]))
            out.append(struct.pack("<BIII", 1, 3, 1, len(points)) + points.tobytes() if len(points) else None)
        return pa.array(out, pa.binary())

    return run(ring)


def polygon_rings(wkb: bytes) -> list[list[tuple[float, float]]]:
    """Exterior rings of a polygon or multi-polygon in well-known binary, of two or more dimensions."""
    out: list[list[tuple[float, float]]] = []

    def geometry(at: int) -> int:
        order = "<" if wkb[at] == 1 else ">"
        (kind,) = struct.unpack_from(f"{order}I", wkb, at + 1)
        extra = (kind & 0x80000000 != 0) + (kind & 0x40000000 != 0) + {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000]
        at += 5 + 4 * (kind & 0x20000000 != 0)
        (n,) = struct.unpack_from(f"{order}I", wkb, at)
        at += 4
        if (kind & 0xFFFF) % 1000 == 6:
            for _ in range(n):
                at = geometry(at)
            return at
        if (kind & 0xFFFF) % 1000 != 3:
            raise ValueError(f"no polygon: {kind}")
        for i in range(n):
            (m,) = struct.unpack_from(f"{order}I", wkb, at)
            at += 4
            values = struct.unpack_from(f"{order}{m * (2 + extra)}d", wkb, at)
            at += 8 * m * (2 + extra)
            if i == 0:
                out.append([(values[j], values[j + 1]) for j in range(0, len(values), 2 + extra)])
        return at

    geometry(0)
    return out


def _wkb_of(blob: bytes) -> bytes:
    """A GeoPackage geometry without its header."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]


def _database(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, most: int = 10_000) -> DataFrame:
    """A vector layer of the GeoPackage at ``path``: its columns as text, ring and srid; a row for each polygon. An executor
    reads the file, in batches of ``most`` rows; the driver learns the names of the columns only."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def described(content: bytes):
        db = _database(content)
        name = layer or db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name").fetchone()[0]
        geom, srid = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()
        found = db.execute(f'SELECT * FROM "{name}"')
        return found, [c[0] for c in found.description], geom, srid

    def head(found):
        for pdf in found:
            yield pd.DataFrame([(names, geom) for _, names, geom, _ in map(described, pdf["content"])], columns=["names", "geom"])

    def run(found):
        for pdf in found:
            for content in pdf["content"]:
                cursor, names, geom, srid = described(content)
                while part := cursor.fetchmany(most):
                    rows = []
                    for values in part:
                        row = dict(zip(names, values, strict=True))
                        blob = row.pop(geom)
                        kept = json.dumps({k: v for k, v in row.items() if not isinstance(v, bytes)})
                        rows += [(kept, [{"x": x, "y": y} for x, y in ring], srid) for ring in (polygon_rings(_wkb_of(blob)) if blob else [])]
                    yield pd.DataFrame(rows, columns=["properties", "ring", "srid"])

    names, geom = files.mapInPandas(head, "names array<string>, geom string").first()
    df = files.mapInPandas(run, f"properties string, ring {RING}, srid int")
    return df.select(*(F.get_json_object("properties", f"$['{n}']").alias(n) for n in names if n != geom), "ring", "srid")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write bytes to a path of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_gpkg(df: DataFrame, path: str, layer: str, srid: int, most: int = 1_000_000) -> None:
    """A table with ring to a GeoPackage of one layer, for exchange. A GeoPackage is one database made by one writer; tables of
    more than ``most`` rows belong in Parquet, with ring_wkb, and raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write Parquet instead")
    names = [c for c in df.columns if c != "ring"]
    with sqlite3.connect(":memory:") as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{"".join(f", {chr(34)}{n}{chr(34)}" for n in names)})')
        for row in rows:
            ring = [(p["x"], p["y"]) for p in row["ring"]]
            ring = [*ring, ring[0]] if ring[0] != ring[-1] else ring
            blob = b"GP\x00\x01" + struct.pack("<i", srid) + struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
            db.execute(f'INSERT INTO "{layer}" (geom{"".join(f", {chr(34)}{n}{chr(34)}" for n in names)}) VALUES ({", ".join("?" * (len(names) + 1))})', [blob, *(row[n] for n in names)])
        db.commit()
        put(df.sparkSession, path, db.serialize())
