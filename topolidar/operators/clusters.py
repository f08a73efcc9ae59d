"""Density clusters (DBSCAN) of points that may lie dense: exact, with tasks bounded by area and not by points.

Points fall into cells so small that any two of one cell are neighbours. A heavy cell, of ``LEAST`` points or more, is all
core: of it a task needs its number of points and its extent. The points of light cells are kept. What the offset of two
cells leaves open is settled by joins before: how many points of a heavy cell are near a light point, and whether two heavy
cells that nothing else links hold a pair of neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.sources import scratch

#: Neighbours are at most EPS apart; a core point has LEAST of them, itself included. Bins of one metre are whole cells.
EPS, LEAST, CELL = 3.0, 10, 0.5
_R = round(EPS / CELL)
_STEPS = [(a, b) for a in range(-_R - 1, _R + 2) for b in range(-_R - 1, _R + 2)]
#: Offsets of cells all of whose points are neighbours, and of those of which some may be.
SURE = [(a, b) for a, b in _STEPS if math.hypot(abs(a) + 1, abs(b) + 1) <= _R]
OPEN = [(a, b) for a, b in _STEPS if math.hypot(abs(a) + 1, abs(b) + 1) > _R and math.hypot(max(abs(a) - 1, 0), max(abs(b) - 1, 0)) <= _R]
_KINDS = {"kind": "int", "i": "long", "j": "long", "n": "long", "x0": "double", "x1": "double", "y0": "double", "y1": "double", "d2": "double", "k": "long", "l": "long"}


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that links (a, b) reach from each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _offset_pairs(i: np.ndarray, j: np.ndarray, k: np.ndarray, l: np.ndarray, offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Places (a, b) where cell (k, l)[b] is at one of ``offsets`` from cell (i, j)[a]; cells (k, l) are distinct."""
    if not len(i) or not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, wide = min(j.min(), l.min()) - _R - 2, max(j.max(), l.max()) - min(j.min(), l.min()) + 2 * _R + 5
    code = lambda u, v: u * wide + (v - low)
    order = np.argsort(code(k, l))
    known = code(k, l)[order]
    found = []
    for a, b in offsets:
        want = code(i + a, j + b)
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = np.flatnonzero(known[at] == want)
        found.append((hit, order[at[hit]]))
    return tuple(np.concatenate([f[s] for f in found]) for s in (0, 1))


def open_pairs(cells: pd.DataFrame) -> pd.DataFrame:
    """Pairs (i, j, k, l) of heavy cells that may hold neighbours and that sure neighbours don't link."""
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    root = forest(len(i), *_offset_pairs(i, j, i, j, SURE))
    a, b = _offset_pairs(i, j, i, j, OPEN)
    some = (a < b) & (root[a] != root[b])
    return pd.DataFrame({"i": i[a[some]], "j": j[a[some]], "k": i[b[some]], "l": j[b[some]]})


def _near_rows(x: np.ndarray, y: np.ndarray):
    """(p, q, near) for blocks of points: places p against the places q around them, and which are neighbours."""
    u, v = np.floor(x / EPS).astype(np.int64), np.floor(y / EPS).astype(np.int64)
    order = np.lexsort((v, u))
    blocks = pd.DataFrame({"u": u[order], "v": v[order]}).groupby(["u", "v"]).indices
    blocks = {key: order[at] for key, at in blocks.items()}
    for (a, b), p in blocks.items():
        q = np.concatenate([blocks[c, d] for c in (a - 1, a, a + 1) for d in (b - 1, b, b + 1) if (c, d) in blocks])
        for s in range(0, len(p), 256):
            some = p[s : s + 256]
            yield some, q, (x[some, None] - x[q]) ** 2 + (y[some, None] - y[q]) ** 2 <= EPS * EPS


def nearest_cluster(parts: pd.DataFrame) -> pd.DataFrame | None:
    """Of a building's ``parts`` (see roof_parts) those of the cluster that holds the point nearest to its centre; None
    without a cluster. A point that two clusters reach and that is no core belongs to the one with the smallest cell."""
    light, heavy, met, links = (parts[parts["kind"] == k].reset_index(drop=True) for k in range(4))
    x, y, m = light["x0"].to_numpy(), light["y0"].to_numpy(), len(light)
    li, lj, hi, hj = light["i"].to_numpy(), light["j"].to_numpy(), heavy["i"].to_numpy(), heavy["j"].to_numpy()
    sure = _offset_pairs(li, lj, hi, hj, SURE)
    place = {p: n for n, p in enumerate(zip(hi.tolist(), hj.tolist(), strict=True))}
    alike = light.groupby(["x0", "y0"]).indices if len(met) else {}
    of = [(p, place[r.i, r.j], r.n) for r in met.itertuples() for p in alike[r.x0, r.y0].tolist()]
    some = tuple(np.array([o[s] for o in of], np.int64) for s in range(3))
    count = np.bincount(sure[0], heavy["n"].to_numpy()[sure[1]], m) + np.bincount(some[0], some[2], m)
    for p, q, near in _near_rows(x, y):
        count[p] += near.sum(axis=1)
    core = count >= LEAST
    # Core points of one cell are linked: cells are what is joined, light ones with a core point and all heavy ones.
    cells, unit = np.unique(np.column_stack((np.append(li, hi), np.append(lj, hj))), axis=0, return_inverse=True)
    unit = unit.ravel()
    at, own = unit[m:], unit[:m]
    near_heavy = (np.append(sure[0], some[0]), at[np.append(sure[1], some[1])])
    ends = [at[e] for e in _offset_pairs(hi, hj, hi, hj, SURE)], [own[near_heavy[0]][core[near_heavy[0]]], near_heavy[1][core[near_heavy[0]]]]
    told = [np.array([at[place[p]] for p in zip(links[a].tolist(), links[b].tolist(), strict=True)], np.int64) for a, b in (("i", "j"), ("k", "l"))]
    pairs, reached = [np.unique(np.column_stack(e), axis=0) for e in (*ends, told)], [np.column_stack(near_heavy)]
    for p, q, near in _near_rows(x, y):
        a, b = np.nonzero(near & core[q])
        a, b = p[a], own[q[b]]
        pairs.append(np.unique(np.column_stack((own[a[core[a]]], b[core[a]])), axis=0))
        reached.append(np.unique(np.column_stack((a[~core[a]], b[~core[a]])), axis=0))
    joined = np.concatenate(pairs).astype(np.int64)
    root = forest(len(cells), joined[:, 0], joined[:, 1])
    label = np.full(m, len(cells))
    touched = np.concatenate(reached).astype(np.int64)
    np.minimum.at(label, touched[:, 0], root[touched[:, 1]])
    label = np.append(np.where(core, root[own], label), root[at])
    both = pd.concat((light.assign(x1=light["x0"], y1=light["y0"]), heavy), ignore_index=True)
    members = np.flatnonzero(label < len(cells))
    if not len(members):
        return None
    d2 = both["d2"].to_numpy()[members]
    chosen = label[members[d2 == d2.min()]].min()
    return both[label == chosen]


def _gap(a: str, b: str) -> Column:
    """The least square distance of two boxes of points."""
    side = lambda lo, hi: F.pow(F.greatest(F.col(f"{a}{lo}") - F.col(f"{b}{hi}"), F.col(f"{b}{lo}") - F.col(f"{a}{hi}"), F.lit(0.0)), F.lit(2))
    return side("x0", "x1") + side("y0", "y1")


def _heavy_links(rows: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Those of ``pairs`` (by, i, j, k, l) of cells that hold two neighbours. Points meet only where the boxes of their
    sixty-fourths of a cell leave it open."""
    key, fine = [*by, "i", "j", "k", "l"], CELL / 8
    part = [F.floor(F.col(c) / fine).alias(f) for c, f in (("x", "u"), ("y", "v"))]
    one, two = (pairs.join(rows.select(*by, F.col("i").alias(a), F.col("j").alias(b), "x", "y", *part), [*by, a, b]) for a, b in (("i", "j"), ("k", "l")))
    box = [f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in enumerate((F.min, F.max))]
    boxes = [side.groupBy(*key, "u", "v").agg(*box).withColumnsRenamed({c: f"{p}_{c}" for c in ("u", "v", "x0", "x1", "y0", "y1")}) for side, p in ((one, "a"), (two, "b"))]
    met = boxes[0].join(boxes[1], key).where(_gap("a_", "b_") <= EPS * EPS)
    far = lambda c: F.pow(F.greatest(F.abs(F.col(f"a_{c}1") - F.col(f"b_{c}0")), F.abs(F.col(f"b_{c}1") - F.col(f"a_{c}0"))), F.lit(2))
    met = met.withColumn("sure", far("x") + far("y") <= EPS * EPS)
    sure = met.where("sure").select(*key).distinct()
    rest = met.select(*key, "a_u", "a_v", "b_u", "b_v").join(sure, key, "left_anti")
    rest = rest.join(one.select(*key, F.col("u").alias("a_u"), F.col("v").alias("a_v"), F.col("x").alias("a_x"), F.col("y").alias("a_y")), [*key, "a_u", "a_v"])
    rest = rest.join(two.select(*key, F.col("u").alias("b_u"), F.col("v").alias("b_v"), F.col("x").alias("b_x"), F.col("y").alias("b_y")), [*key, "b_u", "b_v"])
    near = F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)) <= EPS * EPS
    return sure.union(rest.where(near).select(*key)).distinct()


def roof_parts(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """What clustering needs of ``points`` (by, x, y, d2), as rows of one table: kind 0, the points of light cells; 1, heavy
    cells with their number of points, extent and least d2; 2, how many points of a heavy cell are near a light point where
    the cells leave it open; 3, links of heavy cells. d2 is the square distance to what a cluster is chosen by."""
    by = list(by)
    # Both are read several times below.
    rows = scratch.written(points.where("x is not null and y is not null").withColumns({"i": F.floor(F.col("x") / CELL), "j": F.floor(F.col("y") / CELL)}), "roofs")
    cells = rows.groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("d2").alias("d2"))
    cells = scratch.written(cells, "cells")
    heavy = cells.where(F.col("n") >= LEAST)
    light = rows.join(cells.where(F.col("n") < LEAST).select(*by, "i", "j"), [*by, "i", "j"], "left_semi")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in OPEN)))
    around = heavy.select(*by, F.col("i").alias("k"), F.col("j").alias("l"), steps.alias("s")).select(*by, "k", "l", (F.col("k") + F.col("s.a")).alias("i"), (F.col("l") + F.col("s.b")).alias("j"))
    asks = light.join(around, [*by, "i", "j"]).select(*by, F.col("k").alias("i"), F.col("l").alias("j"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    near = F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2)) <= EPS * EPS
    met = rows.join(asks, [*by, "i", "j"]).where(near).groupBy(*by, "i", "j", "px", "py").agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    head = ", ".join(f"{c} {kinds[c]}" for c in by)

    def of_building(pdf: pd.DataFrame) -> pd.DataFrame:
        out = open_pairs(pdf)
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    pairs = heavy.select(*by, "i", "j").groupBy(*by).applyInPandas(of_building, f"{head}, i long, j long, k long, l long")
    pairs = scratch.written(pairs, "pairs")
    links = _heavy_links(rows, pairs, by) if not pairs.isEmpty() else pairs

    def as_kind(df: DataFrame, kind: int, **named: str) -> DataFrame:
        have = {"kind": F.lit(kind), **{c: F.col(c) for c in df.columns}, **{k: F.col(v) for k, v in named.items()}}
        return df.select(*by, *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()))

    return as_kind(light, 0, x0="x", y0="y").union(as_kind(heavy, 1)).union(as_kind(met, 2, x0="px", y0="py")).union(as_kind(links, 3))
