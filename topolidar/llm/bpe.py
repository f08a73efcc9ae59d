"""Byte-level BPE with the tokenizers library: encoding with offsets, and decoding by the reversed byte table."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
import types
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from topolidar.llm.batches import buffers, map_texts

#: Pretokens that a worker remembers; the memory this needs doesn't grow with the table.
REMEMBERED = 120_000

ENCODED = "doc_id long, ids array<int>, char_starts array<int>, char_stops array<int>"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is a visible Latin-1 character, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``: what is left of its bytes once all pairs of lower rank are merged."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= own:
            raise ValueError(f"no merges make {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(path: str) -> str:
    """The rank file at ``path``, as a tokenizer of the tokenizers library that takes one pretoken at a time."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_characters()
    spell = lambda token: "".join(map(table.__getitem__, token))
    merges = [tuple(map(spell, merge_of(token, ranks))) for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1]
    made = Tokenizer(models.BPE(vocab={spell(k): v for k, v in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made.to_str()


class Splitter:
    """Splits text into pretokens by the pattern of the rank files.

    Over common Latin characters the standard library's classes mean the same as \\p{L} and \\p{N} and are faster; any
    other text goes through the regex library.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        fast = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast = re.compile(fast) if r"\p" not in fast else None
        self.other = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ‐-‧€]")

    def __call__(self, text: str) -> list[str]:
        return self.full.findall(text) if self.fast is None or self.other.search(text) else self.fast.findall(text)


class BytePairs:
    """Encoder and decoder of a worker. Encodes each distinct pretoken once and remembers a bounded number of them."""

    def __init__(self, json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_str(json), Splitter(pattern)
        self.bytes_of = byte_strings(self.tokenizer.get_vocab())
        self.length_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end)."""
        pieces = [self.split(t) for t in texts]
        distinct = set().union(*pieces)
        new = [p for p in distinct if p not in self.number]
        if len(self.number) + len(new) > REMEMBERED:
            self._forget()
            new = list(distinct)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.number[piece] = len(self.starts) - 1
                self.ids.extend(coded.ids)
                self.starts.append(len(self.ids))
        number = self.number.__getitem__
        at = np.fromiter((i for p in pieces for i in map(number, p)), np.int64, sum(map(len, pieces)))
        starts, ids = np.array(self.starts, np.int64), np.array(self.ids, np.int32)
        lengths = (starts[1:] - starts[:-1])[at]
        stops = np.cumsum(lengths)
        flat = ids[np.repeat(starts[at] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        ends = np.concatenate(([0], stops))[np.cumsum([len(p) for p in pieces], dtype=np.int64)] if pieces else np.zeros(0, np.int64)
        return flat, ends


def join_bytes(bytes_of: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes of some ids; characters whose bytes are split over ids come out whole."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist()))


def byte_strings(tokens: dict[str, int]) -> list[bytes]:
    """The bytes of each id, by the reversed byte table; an id without a token has none."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    spelled = {i: t for t, i in tokens.items()}
    return [bytes(map(byte_of.__getitem__, spelled.get(i, ""))) for i in range(max(spelled) + 1)]


def worker_state() -> types.ModuleType:
    """What a Python worker keeps from task to task; a module, so that it isn't pickled with functions."""
    return sys.modules.setdefault("_topolidar_worker", types.ModuleType("_topolidar_worker"))


def byte_pairs(json: str, pattern: str) -> BytePairs:
    kept = worker_state().__dict__.setdefault("byte_pairs", {})
    key = hashlib.sha256((json + pattern).encode()).digest()
    if key not in kept:
        kept.clear()
        kept[key] = BytePairs(json, pattern)
    return kept[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), round_trip: bool = False) -> DataFrame:
    """(doc_id, ids, char_starts, char_stops) and the columns in ``keep`` for each row of ``df``: the ids of its whole text, without special tokens, and
    for each id the characters of the text that its bytes belong to (a character split over ids belongs to each).

    A null or empty text has no ids. Repeated rows and null ids are rows like others; an empty table gives no rows; columns
    outside ``keep`` are not read. The text is cut into pretokens by ``pattern`` and each pretoken is encoded on its own, as the
    rank files ask for. With ``round_trip`` the ids are decoded in the same pass, as ``decoded``: a second Python operator on
    top would need a worker of its own for each task. One pass, no shuffle; the vocabulary (a few MB, whatever the table) goes to the workers by broadcast.
    """
    json = df.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path))
    schema = ENCODED + ", decoded binary" if round_trip else ENCODED

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = byte_pairs(json.value, pattern)
        offsets, data = buffers(batch.column("text"))
        flat, ends = coder.encode(x or "" for x in batch.column("text").to_pylist())
        stops = np.cumsum(coder.length_of[flat])
        lengths = coder.length_of[flat]
        character = np.concatenate((np.cumsum((data & 0xC0) != 0x80), [0])) - 1  # of each byte; the last isn't one
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
        first = np.concatenate((character[offsets[:-1]], [0]))[owner] if len(data) else owner
        chars = [character[stops - lengths] - first, character[stops - 1] - first + 1] if len(data) else [flat, flat]
        at = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (flat, *chars)]
        columns, names = [batch.column("doc_id").cast(pa.int64()), *lists], ["doc_id", "ids", "char_starts", "char_stops"]
        if round_trip:
            columns.append(pa.array([join_bytes(coder.bytes_of, flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)], pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(df, schema, step, id_col, text_col, keep, 1 << 20)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ids, decoded) and the columns in ``keep`` for each row of ``df``: the bytes that its ids stand for, in which
    characters whose bytes are split over ids are whole again. A null list counts as empty; an id outside the vocabulary
    fails the job, as it can't come from ``encode``."""
    table = byte_characters()
    strings = byte_strings({"".join(map(table.__getitem__, token)): i for token, i in read_ranks(ranks_path).items()})
    sent = df.sparkSession.sparkContext.broadcast(strings)

    def run(found):
        bytes_of = sent.value
        for batch in found:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [join_bytes(bytes_of, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)))
    made = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
    return made.select("doc_id", "ids", "decoded", *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)))
