"""Binary formats by their public layouts: LAS headers and points, GTX geoid grids, GeoTIFF extents; HDF5 if h5py is there.

Files are read with Spark's binaryFile source, one file by one task. A file that can't be read becomes a row with an error,
which a run can set aside; it doesn't stop the others.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAS_HEADER = "file_name string, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, creation_date date, n_points long, crs string, error string"
LAS_POINTS = "file string, pt_index long, x double, y double, z double, classification int"


def las_header(data: bytes) -> dict:
    """Bounds, counts, scales and the coordinate system of a LAS file of version 1.0 to 1.4, from its first bytes."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    day, year, size, offset, n_vlr, form, length, n = struct.unpack_from("<HHHIIBHI", data, 90)
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    if minor >= 4 and size >= 375:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    out = {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "z_min": z0, "z_max": z1, "n_points": n, "offset": offset, "format": form & 0x3F, "packed": bool(form & 0x80), "length": length, "scale": scale, "shift": shift, "crs": None}
    out["creation_date"] = date(year, 1, 1) + timedelta(days=day - 1) if year and day else None
    at = size
    for _ in range(n_vlr):  # variable length records: well-known text, or a GeoTIFF key of a projected or geographic system
        user, record, after = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
        body = data[at + 54 : at + 54 + after]
        if user == b"LASF_Projection" and record == 2112:
            out["crs"] = body.rstrip(b"\0").decode("utf-8", "replace")
        elif user == b"LASF_Projection" and record == 34735 and out["crs"] is None:
            keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)[1:]
            codes = {int(k[0]): int(k[3]) for k in keys}
            code = codes.get(3072) or codes.get(2048)
            out["crs"] = f"EPSG:{code}" if code else None
        at += 54 + after
    return out


def read_las_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row of LAS_HEADER for each .las file under ``path``; of each file only its beginning goes to Python."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(path)
    return las_headers(files.select("path", F.substring("content", 1, 1 << 16).alias("head")))


def las_headers(files: DataFrame) -> DataFrame:
    """A row of LAS_HEADER for each of ``files`` (path, head: its first bytes); one that is broken has an error."""

    def run(found):
        for pdf in found:
            rows = []
            for name, head in zip(pdf["path"], pdf["head"], strict=True):
                try:
                    h = las_header(bytes(head))
                    rows.append({"file_name": name, **{k: h[k] for k in ("x_min", "x_max", "y_min", "y_max", "z_min", "z_max", "creation_date", "n_points", "crs")}, "error": None})
                except Exception as e:  # noqa: BLE001  any broken file is a row, not a failure
                    rows.append({"file_name": name, "error": str(e)})
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in LAS_HEADER.split(", ")])
            yield out.astype({c: object for c in ("creation_date", "crs", "error")}).where(out.notna(), None)

    return files.select("path", "head").mapInPandas(run, LAS_HEADER)


def read_las_points(spark: SparkSession, path: str, step: int = 10, most: int = 1 << 20) -> DataFrame:
    """Every ``step``-th point of the uncompressed .las files under ``path``; see las_points."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(path)
    return las_points(files.select("path", "content"), step, most)


def unreadable_las(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of the .las files under ``path`` that las_points gives no points of: packed or broken ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(path)

    def run(found):
        for pdf in found:
            faults = []
            for name, head, size in zip(pdf["path"], pdf["head"], pdf["length"], strict=True):
                try:
                    h = las_header(bytes(head))
                    fault = "packed" if h["packed"] else "cut short" if h["offset"] + h["n_points"] * h["length"] > size else None
                except Exception as e:  # noqa: BLE001
                    fault = str(e) or type(e).__name__
                faults += [(name, fault)] if fault else []
            yield pd.DataFrame(faults, columns=["file", "error"])

    return files.select("path", F.substring("content", 1, 1 << 16).alias("head"), "length").mapInPandas(run, "file string, error string")


def las_points(files: DataFrame, step: int = 10, most: int = 1 << 20) -> DataFrame:
    """Every ``step``-th point of ``files`` (path, content), in batches of ``most``; packed and broken files give none, and are
    told by unreadable_las."""

    def run(found):
        for pdf in found:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = las_header(bytes(content[: 1 << 16]))
                    if h["packed"]:
                        continue
                    kind = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 16 if h["format"] >= 6 else 15], "itemsize": h["length"]})
                    points = np.frombuffer(content, kind, count=h["n_points"], offset=h["offset"])[::step]
                except Exception:  # noqa: BLE001
                    continue
                for at in range(0, len(points), most):
                    p = points[at : at + most]
                    mask = 0xFF if h["format"] >= 6 else 0x1F
                    yield pd.DataFrame({"file": name, "pt_index": (np.arange(len(p)) + at) * step, **{k: p[k] * h["scale"][i] + h["shift"][i] for i, k in enumerate("xyz")}, "classification": (p["c"] & mask).astype(np.int32)})

    return files.select("path", "content").mapInPandas(run, LAS_POINTS)


def read_gtx(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[float, float], tuple[float, float], float]:
    """(grid of row, col, value from the north; origin; step; right side) of a GTX geoid grid. The driver reads its 40 first
    bytes, an executor the values, a few rows of the grid at a time."""
    files = spark.read.format("binaryFile").load(path)
    south, west, dy, dx, rows, cols = struct.unpack(">4d2i", files.select(F.substring("content", 1, 40)).first()[0])

    def run(found):
        for pdf in found:
            for content in pdf["content"]:
                values = np.frombuffer(content, ">f4", count=rows * cols, offset=40).reshape(rows, cols)[::-1]
                for at in range(0, rows, max(1, (1 << 18) // cols)):
                    part = values[at : at + max(1, (1 << 18) // cols)].astype(float)
                    row, col = np.divmod(np.arange(part.size), cols)
                    yield pd.DataFrame({"row": (row + at).astype(np.int32), "col": col.astype(np.int32), "value": part.ravel()})

    grid = files.select("content").mapInPandas(run, "row int, col int, value double").where("value > -88.88")  # the format's mark for no value
    return grid, (west - dx / 2, south + (rows - 0.5) * dy), (dx, -dy), west + (cols - 0.5) * dx


def tiff_extent(data: bytes) -> dict:
    """Bounds and EPSG code of a GeoTIFF with a scale and a tie point, from its first bytes."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    tags = {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        form = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}.get(kind)
        if form and n and form != "s":
            size = struct.calcsize(form) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
            if place + size <= len(data):
                tags[tag] = struct.unpack_from(f"{order}{n}{form}", data, place)
    width, height, scale, tie = tags[256][0], tags[257][0], tags[33550], tags[33922]
    x0, y1 = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    keys = np.array(tags.get(34735, (0, 0, 0, 0))).reshape(-1, 4)[1:]
    codes = {int(k[0]): int(k[3]) for k in keys}
    return {"x_min": x0, "x_max": x0 + width * scale[0], "y_min": y1 - height * scale[1], "y_max": y1, "crs": f"EPSG:{code}" if (code := codes.get(3072) or codes.get(2048)) else None}


def read_tiff_extents(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bounds, crs, error) of the .tif files in ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    columns = ["file_name", "x_min", "x_max", "y_min", "y_max", "crs", "error"]

    def run(found):
        for pdf in found:
            rows = []
            for name, head in zip(pdf["path"], pdf["head"], strict=True):
                try:
                    rows.append({"file_name": name, **tiff_extent(bytes(head)), "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"file_name": name, "error": str(e)})
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: object for c in ("crs", "error")}).where(out.notna(), None)

    return files.select("path", F.substring("content", 1, 1 << 20).alias("head")).mapInPandas(run, "file_name string, x_min double, x_max double, y_min double, y_max double, crs string, error string")


def read_h5(spark: SparkSession, paths: Sequence[str], datasets: dict[str, str], beams: Sequence[str], most: int = 1 << 18) -> DataFrame:
    """Datasets of HDF5 files as a photon table (granule, gt, ph_index and a double for each name in ``datasets``), a task for
    each file and beam. A dataset that is absent is NULL, of one of two dimensions the first column counts. Needs h5py."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; Parquet is the canonical input") from e
    names = list(datasets)
    parts = [(p, b) for p in paths for b in beams]
    jobs = spark.createDataFrame(parts, "granule string, gt string").repartition(len(parts), "granule", "gt")

    def run(found):
        import h5py

        for pdf in found:
            for path, beam in pdf.itertuples(index=False):
                with h5py.File(path, "r") as file:
                    there = {k: file[f"{beam}/{v}"] for k, v in datasets.items() if f"{beam}/{v}" in file}
                    n = max((len(d) for d in there.values()), default=0)
                    for at in range(0, n, most):
                        rows = np.arange(at, min(at + most, n))
                        part = {k: np.asarray(d[at : at + most], float).reshape(len(rows), -1)[:, 0] for k, d in there.items() if len(d) == n}
                        yield pd.DataFrame({"granule": path, "gt": beam, "ph_index": rows, **{k: pd.Series(part.get(k, [None] * len(rows)), dtype="float64") for k in names}})

    return jobs.mapInPandas(run, f"granule string, gt string, ph_index long, {', '.join(f'{k} double' for k in names)}").replace(float("nan"), None)


def h5_keys(path: str, group: str = "/") -> list[tuple[str, str, int]]:
    """(name, type or Group, length) of all that is under a group of an HDF5 file on the driver's disk."""
    import h5py

    out: list[tuple[str, str, int]] = []
    with h5py.File(path, "r") as file:
        file[group].visititems(lambda name, x: out.append((name, str(x.dtype), len(x) if x.shape else 1) if isinstance(x, h5py.Dataset) else (name, "Group", len(x))))
    return out
