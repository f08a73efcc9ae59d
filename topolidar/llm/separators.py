"""Token counts from flat token files: a separator scan by blocks, stitched by a prefix scan over block summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.llm import shared

#: Tokens of a block, and blocks of the upper level of the prefix scan.
BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 1 << 10


def read_token_files(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files of little-endian ids under ``path``. A file is read by one task, so token
    files should be kept to a few hundred MB each; Spark refuses any of 2 GB or more. An empty file gives no block."""
    size = token_bytes * block_tokens
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)
    return whole.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("block")).select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("data"))


def pack(encoded: DataFrame, separator: int, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat token files, one for each partition of ``encoded`` (doc_id, ids): the ids of its documents in a row, each closed
    by the separator, cut into blocks without regard to documents. Returns (file, block, data) and, for those who need to
    know which document is which, (file, ordinal, doc_id). Written once to the shared folder. Null ids count as none; repeated
    and null doc_ids are documents of their own. An id that ``token_bytes`` don't hold, or that is the separator, raises."""
    kind = np.dtype(f"<u{token_bytes}")
    if not 0 <= separator < 1 << 8 * token_bytes:
        raise ValueError(f"separator {separator} does not fit in {token_bytes} bytes")
    names = ["file", "block", "data", "doc_ids"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, order, rest = f"part-{TaskContext.get().partitionId():06d}", 0, 0, np.zeros(0, kind)
        for batch in found:
            ids = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= 1 << 8 * token_bytes or (flat == separator).any()):
                raise ValueError(f"ids must be from 0 to {(1 << 8 * token_bytes) - 1} and other than the separator {separator}")
            flat = np.insert(flat.astype(kind), np.cumsum(lengths), separator)
            rest = np.concatenate((rest, flat))
            for at in range(0, len(rest) - block_tokens + 1, block_tokens):
                yield row(file, block, rest[at : at + block_tokens].tobytes(), None)
                block += 1
            rest = rest[len(rest) // block_tokens * block_tokens :]
            yield row(file, order, None, batch.column("doc_id").to_pylist())
            order += batch.num_rows
        if len(rest):
            yield row(file, block, rest.tobytes(), None)

    both = shared.written(encoded.select("doc_id", "ids").mapInArrow(run, "file string, block long, data binary, doc_ids array<long>"), "tokens")
    order = both.where("doc_ids is not null").select("file", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
    return both.where("data is not null").select("file", "block", "data"), order.select("file", (F.col("block") + F.col("at")).alias("ordinal"), "doc_id")


def scan_blocks(blocks: DataFrame, separator: int, token_bytes: int = 2) -> DataFrame:
    """(file, block, n_tokens, ends): the tokens of each block and, by a vectorised search, where its separators are. A null
    block counts as empty."""
    kind = np.dtype(f"<u{token_bytes}")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                data = batch.column("data")[i]
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype=kind)
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in ("file", "block")), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))], names=["file", "block", "n_tokens", "ends"])

    return blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(run, "file string, block long, n_tokens long, ends array<int>")


def document_counts(blocks: DataFrame, separator: int, token_bytes: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of each document of the flat files in ``blocks`` (file, block, data).

    What a block can't know is how many separators and how many unclosed tokens come before it. Both are prefix scans over
    the summaries, in two levels (``GROUP_BLOCKS`` blocks, then such groups), so that no task holds all blocks of a file.
    ``start`` is the document's first token in its file. Separators in a row enclose documents of no tokens; tokens after
    the last separator are a last document with ``closed`` false. No blocks give no rows.
    """
    summary = shared.written(scan_blocks(blocks, separator, token_bytes), "blocks")
    n = F.size("ends").cast("long")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside, upper = before.partitionBy("file", "part"), Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(column: str, window) -> F.Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # Within a part: tokens and separators before a block, and where the last document before it closed.
    local = summary.select("file", "block", F.floor(F.col("block") / GROUP_BLOCKS).alias("part"), "n_tokens", "ends", n.alias("n_ends"))
    local = local.select("*", ahead("n_tokens", inside).alias("t"), ahead("n_ends", inside).alias("s")).withColumn("closed", F.when(F.col("n_ends") > 0, F.col("t") + F.element_at("ends", -1) + 1))
    local = local.withColumn("closed_before", F.max("closed").over(inside))
    # The same over parts, whose rows are small.
    parts = local.groupBy("file", "part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_ends").alias("n_ends"), F.max("closed").alias("closed"), F.max("block").alias("last"))
    parts = parts.select("*", ahead("n_tokens", upper).alias("part_t"), ahead("n_ends", upper).alias("part_s")).withColumn("closed", F.col("part_t") + F.col("closed"))
    parts = parts.select("file", "part", "part_t", "part_s", F.max("closed").over(upper).alias("part_closed"), F.when(F.lead("part").over(Window.partitionBy("file").orderBy("part")).isNull(), F.col("last")).alias("last"))
    at = local.join(parts, ["file", "part"]).withColumn("start", F.col("part_t") + F.col("t"))
    at = at.withColumn("open", F.col("start") - F.coalesce(F.col("part_t") + F.col("closed_before"), F.col("part_closed"), F.lit(0)))
    # The first document that closes in a block begins with the tokens that earlier blocks left open; what follows the last
    # separator of a file, if anything does, is a document as well.
    begins = F.concat(F.array(-F.col("open")), F.transform("ends", lambda e: e.cast("long") + 1))
    stops = F.concat(F.col("ends").cast("array<long>"), F.when((F.col("block") == F.col("last")) & (F.element_at("begins", -1) < F.col("n_tokens")), F.array("n_tokens")).otherwise(F.array().cast("array<long>")))
    found = at.withColumn("begins", begins).withColumn("stops", stops)
    found = found.select("file", "start", (F.col("part_s") + F.col("s")).alias("ordinal"), "n_ends", "begins", F.posexplode("stops").alias("i", "stop"))
    begin = F.element_at("begins", F.col("i") + 1)
    return found.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("start") + begin).alias("start"), (F.col("stop") - begin).alias("n_tokens"), (F.col("i") < F.col("n_ends")).alias("closed"))
