"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from topolidar.llm.batches import buffers, slices

SPACES = b"\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Chunking:
    """A cut falls before one word in ``words`` on average, wherever the last ``window`` bits of the gear hash, which depend
    on as many bytes, are small enough: a text that is moved has the same cuts from ``window`` bytes on. In words of over
    ``long_word`` bytes (scripts without spaces) any character can be cut at. ``most`` bytes force a cut, before the character that holds the byte. Repeated chunks
    in a row are removed if they have ``least`` bytes or more together; what is shorter may repeat by chance."""

    words: int = 5
    window: int = 12
    long_word: int = 64
    most: int = 4096
    least: int = 120


def gear_table() -> np.ndarray:
    """A pseudo-random number for each byte, from a mixing function."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def cut(data: np.ndarray, offsets: np.ndarray, rule: Chunking) -> np.ndarray:
    """Where chunks of some texts begin, texts' own beginnings among them; a chunk ends where the next one begins.

    The gear hash h <- 2h + G[byte] is needed only before possible cuts; its lowest bits there are a sum over the bytes
    before, shifted by their distance, which is taken for all of them at once.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    blank = space[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts[begins] = ~blank[begins]
    words = np.flatnonzero(starts)
    lasting = np.diff(words, append=len(data))
    if (lasting > rule.long_word).any():
        place = np.arange(len(data)) - np.maximum.accumulate(np.where(starts, np.arange(len(data)), 0))
        starts |= (place > rule.long_word) & ~blank & ((data & 0xC0) != 0x80)
    starts[begins] = False
    at = np.flatnonzero(starts)
    first = begins[np.searchsorted(begins, at, side="right") - 1]
    gears, total = gear_table(), np.zeros(len(at), np.uint32)
    for k in range(rule.window):
        byte = at - 1 - k
        total += np.where(byte >= first, gears[data[np.maximum(byte, 0)]], np.uint32(0)) << np.uint32(k)
    at = at[(total & np.uint32((1 << rule.window) - 1)) < (1 << rule.window) // rule.words]
    cuts = np.union1d(begins, at)
    sizes = np.diff(cuts, append=len(data))
    long = np.flatnonzero(sizes > rule.most)
    if not len(long):
        return cuts
    forced = np.concatenate([np.arange(cuts[i] + rule.most, cuts[i] + sizes[i], rule.most) for i in long.tolist()])
    for _ in range(3):  # a character has at most three bytes after its first
        forced -= (data[forced] & 0xC0) == 0x80
    return np.union1d(cuts, forced)


def digests(whole: bytes, cuts: np.ndarray) -> np.ndarray:
    edges = [*cuts.tolist(), len(whole)]
    return np.fromiter((xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(edges, edges[1:], strict=False)), np.uint64, len(cuts))


def _mark(text: Column) -> Column:
    """Tells rows apart that share an id and not their text."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF))


def chunk_table(df: DataFrame, rule: Chunking) -> DataFrame:
    """(digest, doc_id, place) for each chunk of ``df`` (doc_id, mark, text); place is the mark and the chunk's number."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in slices(batch, "text"):
                offsets, data = buffers(piece.column("text"))
                cuts = cut(data, offsets, rule)
                owner = np.searchsorted(offsets, cuts, side="right") - 1
                number = np.arange(len(cuts)) - np.searchsorted(owner, owner)
                mark = piece.column("mark").to_numpy(zero_copy_only=False)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(digests(data.tobytes(), cuts).view(np.int64)), piece.column("doc_id").take(pa.array(owner)), pa.array((mark << 32) | number)], names=["digest", "doc_id", "place"])

    return df.select("doc_id", "mark", "text").mapInArrow(run, "digest long, doc_id long, place long")


def _runs(repeated: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of repeated chunks with ``least`` bytes or more."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if sizes[i:j].sum() >= least:
            yield i, j


def dedup_substrings(df: DataFrame, keep: list[str] = (), rule: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``df``: doc_id, the columns in ``keep``, text without what repeats, n_chunks, removed (spans of bytes
    of the old text) and removed_bytes.

    A chunk repeats if a document with a smaller id has it, or an earlier place of its own; the first one stays. Rows that
    share an id count as one document; a null id comes after all others. A null text stays null and an empty one empty;
    both have no chunks. An empty table gives no rows; columns outside ``keep`` are not read. A chunk that many documents
    share is added up before its shuffle, and is met again in a join that adaptive execution splits; what a task holds
    together are the chunks of one document.
    """
    last = F.lit(2**63 - 1)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep))).withColumn("mark", _mark(F.col("text")))
    chunks = chunk_table(docs, rule)
    first = chunks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    found = chunks.join(first, "digest").select("doc_id", F.shiftright("place", 32).alias("mark"), (F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 + (F.col("first") == F.col("doc_id")).cast("int")).cast("int").alias("x"))
    lists = found.groupBy("doc_id", "mark").agg(F.collect_set("x").alias("found"))
    met = docs.join(lists, ["doc_id", "mark"], "left").drop("mark")
    schema = StructType([f for f in met.schema.fields if f.name != "found"] + [StructField("n_chunks", LongType()), StructField("removed", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))), StructField("removed_bytes", LongType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, counts, spans = [], [], []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            if not text.is_valid:
                new.append(None), counts.append(0), spans.append([])
                continue
            whole = text.as_buffer().to_pybytes()
            data = np.frombuffer(whole, np.uint8)
            cuts = cut(data, np.array([0, len(data)]), rule)
            counts.append(len(cuts))
            gone: list[tuple[int, int]] = []
            if found.is_valid:
                x = found.values.to_numpy(zero_copy_only=False)
                repeated, own = np.zeros(len(cuts), bool), np.sort(x[x % 2 == 1] // 2)
                repeated[x[x % 2 == 0] // 2] = True
                seen: set[bytes] = set()
                edges = [*cuts.tolist(), len(whole)]
                for i in own.tolist():  # chunks that are first here: only those that come again later in this text go
                    piece = whole[edges[i] : edges[i + 1]]
                    repeated[i] = piece in seen
                    seen.add(piece)
                gone = [(edges[i], edges[j]) for i, j in _runs(repeated, np.diff(edges), rule.least)]
            spans.append([{"start": a, "stop": b} for a, b in gone])
            edges = [0, *(x for span in gone for x in span), len(whole)]
            new.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else whole)
        own = {"text": pa.array(new, pa.binary()).cast(pa.string()), "n_chunks": pa.array(counts, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "removed_bytes": pa.array([sum(s["stop"] - s["start"] for s in x) for x in spans], pa.int64())}
        return pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names=names)

    names = schema.names

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in slices(batch, "text"):
                yield step(piece)

    out = met.mapInArrow(run, schema).withColumn("doc_id", F.nullif("doc_id", last))
    return out.select("doc_id", *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)), "text", "n_chunks", "removed", "removed_bytes")
