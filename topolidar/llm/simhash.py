"""SimHash near-duplicates: fingerprints of word shingles, compared tile by tile with exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.llm import shared
from topolidar.llm.batches import map_texts, texts
from topolidar.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints of a tile that goes between machines, and of one that is compared at a time.
TILE = 1024
INNER = 256
#: Texts of a group that a round judges among themselves, and those that a task holds against what stays of them.
FIRST, PART = 128, 2_000
#: Groups of bits that fingerprints must share to meet. With a radius of four these are 70 ways to share 32 bits.
TOGETHER = 4
#: Rows under masks that a task lays out, some 50 MB of them in its aggregate.
LAID_OUT = 500_000


def fingerprint(text: bytes, words: int) -> int:
    """64 bits, each set if it is set in over half the XXH64 hashes of the text's shingles, repeats included."""
    found = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) of each row of ``df``, fp a signed long of the 64 bits; 0 for a null or empty text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, words) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_texts(df, "doc_id long, fp long", step, id_col, text_col)


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints at most ``radius`` bits apart: left against right, or left against itself.

    Both sides are sorted by population count and cut into tiles; two tiles whose counts differ by more than the radius
    hold no such pair and are skipped.
    """
    own = right is None
    sides = []
    for side in (left,) if own else (left, right):
        ones = np.bitwise_count(side)
        order = np.argsort(ones, kind="stable")
        sides.append((order, side[order], ones[order].astype(np.int64)))
    (order_a, a, ones_a), (order_b, b, ones_b) = sides[0], sides[-1]
    found_i, found_j = [], []
    for i in range(0, len(a), INNER):
        for j in range(i if own else 0, len(b), INNER):
            if ones_b[j] - ones_a[min(i + INNER, len(a)) - 1] > radius:
                break
            if ones_a[i] - ones_b[min(j + INNER, len(b)) - 1] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[i : i + INNER, None] ^ b[None, j : j + INNER]) <= radius)
            found_i.append(order_a[x + i])
            found_j.append(order_b[y + j])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that links (i, j) reach from each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(radius: int):
    """Of sorted rows (cell, side, fp): for each cell, links that connect what its near pairs connect, as a star each, so
    that a group of g near fingerprints gives g - 1 links and not all pairs."""

    def of_cell(fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side.any():
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side)
            i, j = near_pairs(fps[left], fps[right], radius)
            i, j = left[i], right[j]
        else:
            i, j = near_pairs(fps, None, radius)
        root = forest(len(fps), i, j) if len(i) else np.arange(len(fps))
        at = np.flatnonzero(root != np.arange(len(fps)))
        return fps[at], fps[root[at]]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1)).tolist()
            pairs = [of_cell(fp[a:b].view(np.uint64), side[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in found:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "side", "fp")]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            last = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last cell may go on
            if last:
                yield emit(*(x[:last] for x in rest))
                rest = [x[last:] for x in rest]
        if rest is not None and len(rest[0]):
            yield emit(*rest)

    return run


def bit_masks(radius: int, together: int) -> list[int]:
    """Masks of 64 bits: the bits fall into radius + together groups, and a mask is a choice of ``together`` of them. Two
    fingerprints at most ``radius`` bits apart differ in at most as many groups, so they agree under a mask at least."""
    n = radius + together
    edges = [BITS * k // n for k in range(n + 1)]
    groups = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(groups, together)]


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at most ``radius`` bits apart.

    Only fingerprints that agree under one of ``bit_masks`` meet in a tile: with the masks' many bits few do that aren't
    near, however many there are in all. Where more than ``tile`` agree, they are dealt by population count and a salt into
    tiles, and each pair of tiles whose counts are within the radius is a cell of its own: no task holds more than two tiles
    of a value, and no pair is lost. Fingerprints, few bytes in few tasks, are dealt out by their number first, as each gives a
    row for every mask; rows that meet are written at once.
    """
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    some = bit_masks(radius, together)
    masks = F.array(*(F.lit(signed(m)).cast("long") for m in some))
    parts = max(1, math.ceil(fps.count() * len(some) / LAID_OUT))
    keyed = fps.repartition(parts, "fp").select("fp", F.posexplode(masks).alias("block", "mask")).select("fp", F.xxhash64("block", F.col("fp").bitwiseAND(F.col("mask"))).alias("value"))
    # Values that one fingerprint has alone, as most are, make no pair and go no further: only what is left is sized up for
    # tiles. Never a broadcast: a table's size says nothing of what its rows are laid out to.
    several = keyed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = shared.written(keyed.join(several.hint("merge"), "value"), "meeting")
    cells = met.where(F.col("n") <= tile).select(F.col("value").alias("cell"), F.lit(0).alias("side"), "fp")
    hot = met.where(F.col("n") > tile).select("value", "fp", F.bit_count("fp").alias("ones"))
    if not hot.isEmpty():
        sizes = hot.groupBy("value", "ones").count()
        salts = sizes.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile).cast("int").alias("salts")))).alias("salts"))
        salt = F.pmod(F.xxhash64("fp"), F.col("salts")[F.col("ones")]).cast("int")
        mine = F.struct(F.col("ones").alias("o"), salt.alias("s"))
        near = F.filter(F.map_entries("salts"), lambda e: F.abs(e["key"] - F.col("ones")) <= radius)
        tiles = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda s: F.struct(e["key"].alias("o"), s.alias("s")))))
        dealt = hot.join(salts.hint("merge"), "value").select("value", "fp", mine.alias("mine"), F.explode(tiles).alias("other"))
        cell = F.xxhash64("value", F.least("mine", "other"), F.greatest("mine", "other"))
        cells = cells.union(dealt.select(cell.alias("cell"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "a long, b long").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for each row of ``df``: the fingerprint in hexadecimal, the smallest doc_id
    that links of at most ``radius`` bits reach, and how many rows have this fingerprint.

    Texts without words, null ones too, have fingerprint 0 and link like others. Rows that repeat an id are rows of their
    own; a null id never is the smallest unless a component has no other. An empty table gives no rows; further columns
    are not read. Copies meet in an aggregate that combines before its shuffle; only distinct fingerprints are compared.
    """
    docs = shared.written(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = shared.written(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")), "distinct")
    rooted = shared.written(_rooted(distinct, radius), "roots")
    # Components of one fingerprint, which most are, need no more; the others are reduced before their shuffle.
    least = rooted.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, (F.col("linked")) & (rooted["root"] == least["root"]), "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n_same")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def _rooted(distinct: DataFrame, radius: int, together: int = TOGETHER) -> DataFrame:
    """``distinct`` (fp, ...) with root, the smallest fingerprint that links reach, and linked: whether there is a link."""
    roots = components(near_links(distinct.select("fp"), radius, together=together)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, sorted."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    some = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), np.uint64))


def _shared_counts(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``rows`` shares with each of ``others``, sets of distinct numbers."""
    values, owner = np.concatenate(others), np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.zeros((len(rows), len(others)), np.int64)
    for i, x in enumerate(rows):
        first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        sizes = last - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[i] = np.bincount(owner[at], minlength=len(others))
    return out


def alike(rows: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``rows`` have a Jaccard similarity of ``similarity`` or more with any of ``others``."""
    if not rows or not others:
        return np.zeros(len(rows), bool)
    both = _shared_counts(rows, others)
    union = np.array([len(x) for x in rows])[:, None] + np.array([len(x) for x in others])[None] - both
    return ((both > 0) & (both >= similarity * union)).any(axis=1)


def in_turn(rows: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``rows`` stay: in their order, each that resembles none that stays."""
    stay = np.zeros(len(rows), bool)
    for i, x in enumerate(rows):
        stay[i] = not alike([x], [rows[j] for j in np.flatnonzero(stay[:i])], similarity)[0]
    return stay


def near_duplicates(df: DataFrame, words: int = 5, radius: int = 6, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(doc_id, mark, stays): which rows of ``df`` repeat another one and go, by doc_id and ``mark``, a hash of the text;
    ``stays``: of several rows with this id and text one stays.

    Candidates are what links of fingerprints at most ``radius`` bits apart connect. In each such group texts are judged by
    id (a null id comes last; those of one id by mark): one goes if its shingle set has a Jaccard similarity of
    ``similarity`` or more with one that stays. A round judges the first of each group among themselves, and holds the
    others, in salted parts, against those that stay; what neither stays nor goes is left for the next. Rounds grow with the
    texts of one group that stay, by FIRST of them for each. Equal texts count as one, of the smallest id; a null text
    counts as empty. Texts without words are similar to none. An empty table gives no rows.
    """
    last = F.lit(2**63 - 1)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, words) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], names=["id", "fp"])

    docs = shared.written(map_texts(rows, "id long, fp long", step, "id", "text", ["mark"]), "fingerprints")
    # Rows of equal texts are one: the first id stays for all of them.
    one = docs.groupBy("fp", "mark").agg(F.min("id").alias("id"))
    distinct = shared.written(one.select("fp").distinct(), "distinct")
    rooted = _rooted(distinct, radius, together).where("linked").select("fp", "root")
    single = one.groupBy("fp").count().where("count > 1").select("fp", F.col("fp").alias("own"))
    groups = one.join(rooted, "fp", "left").join(single, "fp", "left").withColumn("root", F.coalesce("root", "own")).where("root is not null")
    groups = shared.written(groups.select("root", "id", "mark"), "groups")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in texts(batch.column("text"))]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["id", "shingles"])

    some = rows.join(groups.select("id", "mark"), ["id", "mark"], "left_semi")
    hashed = map_texts(some, "id long, shingles array<long>", sets, "id", "text", ["mark"]).dropDuplicates(["id", "mark"])
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / PART).alias("n"))
    left = hashed.join(groups, ["id", "mark"]).join(sizes, "root").withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.col("n")))
    left = shared.written(left.select("root", "salt", "n", "id", "mark", "shingles"), "shingles")
    gone: list[DataFrame] = []

    def first_ones(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "mark"])
        return pdf[["root", "id", "mark"]].assign(stays=in_turn(list(pdf["shingles"]), similarity))

    def others(rest: pd.DataFrame, stay: pd.DataFrame) -> pd.DataFrame:
        return rest[["id", "mark"]].assign(same=alike(list(rest["shingles"]), list(stay["shingles"]), similarity))

    while not left.isEmpty():
        in_part, in_group = (Window.partitionBy(*by).orderBy("id", "mark") for by in (("root", "salt"), ("root",)))
        heads = left.select("root", "salt", "id", "mark").withColumn("k", F.row_number().over(in_part)).where(F.col("k") <= FIRST)
        heads = shared.written(heads.withColumn("k", F.row_number().over(in_group)).where(F.col("k") <= FIRST).select("root", "id", "mark"), "heads")
        judged = left.join(heads, ["root", "id", "mark"]).groupBy("root").applyInPandas(first_ones, "root long, id long, mark long, stays boolean")
        judged = shared.written(judged, "judged")
        gone.append(judged.where("not stays").select("id", "mark"))
        rest = left.join(heads, ["root", "id", "mark"], "left_anti")
        following = left.limit(0)
        if not rest.select("id").isEmpty():
            stay = left.join(judged.where("stays").select("root", "id", "mark"), ["root", "id", "mark"])
            # Written, as both sides come from one table; a copy for each part.
            stay = shared.written(stay.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), "shingles"), "stay")
            found = rest.groupBy("root", "salt").cogroup(stay.groupBy("root", "salt")).applyInPandas(others, "id long, mark long, same boolean")
            found = shared.written(found, "judged")
            gone.append(found.where("same").select("id", "mark"))
            following = shared.written(left.join(found.where("not same").select("id", "mark"), ["id", "mark"], "left_semi"), "shingles")
            shared.drop(left.sparkSession, left)
        left = following
    # Of equal texts the rows of the first id stay, or one of them; none does if the text goes.
    counted = docs.groupBy("fp", "mark", "id").agg(F.count(F.lit(1)).alias("rows"))
    firsts = counted.groupBy("fp", "mark").agg(F.min("id").alias("first"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    repeated = counted.join(firsts, ["fp", "mark"]).where("id <> first or rows > 1").withColumn("stays", F.col("id") == F.col("first"))
    if gone:
        whole = reduce(DataFrame.union, gone).join(one, ["id", "mark"]).select("fp", "mark")
        repeated = repeated.join(whole, ["fp", "mark"], "left_anti").select("id", "mark", "stays").union(counted.join(whole, ["fp", "mark"], "left_semi").select("id", "mark", F.lit(False)))
    return repeated.select(F.nullif("id", last).alias("doc_id"), "mark", "stays")
