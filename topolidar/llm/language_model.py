"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

An n-gram of count c has the level 1 + floor(log_b(c)) and is inserted once for each level up to its own; probing level after
level until one is missing gives the level back, and with it the least count of that level. All n-grams of two and three
tokens of the training texts are held, those that occur once too, so the filter grows with the corpus: it is made in shards
by the keys' highest bits, and what is to be probed comes to the shards. Counts of single tokens go the same way and stay
exact. Texts are tokenised once, into pieces whose tokens are numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.llm import shared
from topolidar.llm.batches import slices, text_table, texts

#: No word holds a space, so this can stand for a text's end.
END = b"\n"
BASE, HASHES, BITS_PER_INSERT = 1.5, 6, 14
#: What a context's count is held against when the estimates of an n-gram and of the shorter one are mixed. For each training
#: text the one counts that makes it likeliest, each token left out in its turn; the middle of these is taken.
STRENGTHS = (25.0, 125.0, 625.0, 3125.0)
#: Keys that a shard gets on average at most, and bytes of text in a piece, unless a single text is longer. Of an n-gram's key
#: 32 bits are sent beside the shard's number: of a shard's 2^20 keys one in 4,096 meets another by chance. Keys of words are
#: sent whole.
SHARD_KEYS, PIECE = 1 << 20, 2 << 20
#: Keys of a shard, in their order, that have a segment of the filter to themselves: one that stays in a processor's cache.
SEGMENT_KEYS = 1 << 15

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def join_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first n - 1 words and of their last word."""
    with np.errstate(over="ignore"):
        return _mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def least_counts() -> np.ndarray:
    """The least count of each level; 0 at level 0."""
    return np.concatenate(([0.0], np.ceil(BASE ** np.arange(255) - 1e-9)))


@dataclass
class LogBloom:
    """A segment of the filter; its size is a power of two, so that places are taken by a mask."""

    mask: np.uint64
    flags: np.ndarray

    @staticmethod
    def _walk(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of keys begin, and how far they step."""
        return keys ^ (keys >> np.uint64(33)), _mix(keys) | np.uint64(1)

    def _place(self, begin: np.ndarray, step: np.ndarray, level: int, j: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (begin + np.uint64(level * HASHES + j) * step) & self.mask

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> LogBloom:
        """The filter of some keys, each inserted for all levels up to its own."""
        bits = 1 << max(6, int(levels.sum() * BITS_PER_INSERT - 1).bit_length())
        out = cls(np.uint64(bits - 1), np.zeros(bits, bool))
        level = 1
        while len(keys):
            begin, step = cls._walk(keys)
            for j in range(HASHES):
                out.flags[out._place(begin, step, level, j)] = True
            more = levels > level
            keys, levels, level = keys[more], levels[more], level + 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key by repeated probes; 0 for one that isn't in the filter."""
        out, at, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        begin, step = self._walk(keys)
        while len(at) and level < 255:
            out[at] = level
            level += 1
            for j in range(HASHES):
                there = self.flags[self._place(begin, step, level, j)]
                if not there.all():
                    at, begin, step = at[there], begin[there], step[there]
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens_of(found: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct tokens, the number of each text's tokens in a row, how many each text has): lower-cased words, then END."""
    numbers = _Numbers({END: 0})
    number = numbers.__getitem__
    lists = [[*map(number, t.lower().split()), 0] for t in found]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return list(numbers), np.fromiter((x for w in lists for x in w), np.uint32, int(sizes.sum())), sizes


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ngram_keys(hashes: np.ndarray, flat: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys, ends): keys of all n-grams of 2, 3, ... ``order`` tokens; ends: for each of these lengths the tokens that its
    n-grams end at. No n-gram goes over a text's end."""
    place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    before = word = hashes[flat]
    keys, ends = [np.zeros(0, np.uint64)], []
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        longer = np.zeros(len(flat), np.uint64)
        longer[at] = join_keys(before[at - 1], word[at])
        keys.append(longer[at])
        ends.append(at)
        before = longer
    return np.concatenate(keys), ends


def _pressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _opened_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned numbers, compressed byte plane by byte plane; of ``rising`` ones the differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return _pressed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(_opened_bytes(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def _cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where the shards of sorted ``keys``, by their highest ``bits``, begin and end."""
    shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    return [*np.searchsorted(shard, np.arange(1 << bits, dtype=np.uint64)).tolist(), len(keys)]


def _pieces(rows: DataFrame) -> DataFrame:
    """(piece, trains, n_tokens, n_distinct, doc_ids, scored, sizes, flat, words): ``rows`` (doc_id, text, trains, scored) in
    numbered pieces of at most PIECE bytes of text, those that train and others apart, in the shared folder. flat are the
    tokens' numbers, words the distinct tokens but END, which has number 0."""
    names = ["trains", "n_tokens", "n_distinct", "doc_ids", "scored", "sizes", "flat", "words"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for both in slices(batch, "text", PIECE):
                flags = np.array(both.column("trains").to_pylist(), bool)
                for trains in (True, False):
                    piece = both.filter(pa.array(flags == trains))
                    if piece.num_rows:
                        distinct, flat, sizes = tokens_of(texts(piece.column("text")))
                        values = trains, len(flat), len(distinct), piece.column("doc_id").to_pylist(), piece.column("scored").to_pylist(), sizes.tolist(), packed(flat.astype("<u4")), _pressed(b"\n".join(distinct[1:]))
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    schema = "trains boolean, n_tokens long, n_distinct long, doc_ids array<long>, scored array<boolean>, sizes array<long>, flat binary, words binary"
    return shared.written(rows.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("piece"), "*"), "pieces")


def _opened(flat: bytes, words: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, flat, starts)."""
    sizes, words = np.array(sizes, np.int64), _opened_bytes(words)
    return hash_words([END, *words.split(b"\n")] if words else [END]), unpacked(flat, "<u4").astype(np.int64), np.cumsum(sizes) - sizes


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one by one, as they are large."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _by_shard(messages: DataFrame, shards: int) -> DataFrame:
    return messages.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def _fold(found: Iterator[pa.RecordBatch], fold) -> Iterator[pa.RecordBatch]:
    """``fold(shard, rows)`` for the rows (piece, ...) of each shard of sorted batches."""
    held, rows = None, []
    for batch in found:
        for shard, *row in _rows(batch):
            if held is not None and shard != held:
                yield fold(held, rows)
                rows = []
            held = shard
            rows.append(row)
    if rows:
        yield fold(held, rows)


def _word_counts(pieces: DataFrame, bits: int) -> DataFrame:
    """(piece, shard, counts, n, v, n1, n2): how often the training texts have the distinct tokens of each piece, by shards;
    and of each shard, in a row without a piece, its tokens, its distinct ones and those that occur once and twice. Written
    to the shared folder."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece, trains, sizes, flat, words in _rows(batch):
                hashes, flat, _ = _opened(flat, words, sizes)
                order = np.argsort(hashes)
                keys, counts, cuts = hashes[order].astype("<u8"), np.bincount(flat if trains else [], minlength=len(hashes))[order].astype("<u8"), _cuts(hashes[order], bits)
                some = [s for s in range(1 << bits) if cuts[s + 1] > cuts[s]]
                body = [[packed(keys[cuts[s] : cuts[s + 1]], rising=True) for s in some], [packed(counts[cuts[s] : cuts[s + 1]]) for s in some]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([piece] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in body)], names=["shard", "piece", "keys", "counts"])

    def fold(shard: int, rows: list) -> pa.RecordBatch:
        found = [unpacked(r[1], "<u8", rising=True) for r in rows]
        keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate([unpacked(r[2], "<u8") for r in rows]).astype(np.int64))
        back, ends = total[inverse].astype("<u8"), np.cumsum([0, *map(len, found)]).tolist()
        own = [[None] * len(rows) + [int(x)] for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
        return pa.RecordBatch.from_arrays([pa.array([*(r[0] for r in rows), None], pa.int64()), pa.array([shard] * (len(rows) + 1), pa.int32()), pa.array([*(packed(back[a:b]) for a, b in zip(ends, ends[1:], strict=False)), None], pa.binary()), *(pa.array(x, pa.int64()) for x in own)], names=["piece", "shard", "counts", "n", "v", "n1", "n2"])

    sent = pieces.select("piece", "trains", "sizes", "flat", "words").mapInArrow(send, "shard int, piece long, keys binary, counts binary")
    return shared.written(_by_shard(sent, 1 << bits).mapInArrow(lambda found: _fold(found, fold), "piece long, shard int, counts binary, n long, v long, n1 long, n2 long"), "words")


def _probed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The levels that a segment of the filter, made of the keys that are counted, gives for all of ``keys``."""
    keys, seen = _mix(keys.astype(np.uint64)), counts > 0
    return LogBloom.of(keys[seen], level_of(counts[seen])).levels(keys).astype(np.uint8)


def _levels(pieces: DataFrame, order: int, bits: int) -> DataFrame:
    """(piece, shard, levels): each shard adds up the n-grams of training pieces, makes its segment of the filter and probes
    it for the n-grams of all pieces, a byte for each."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece, trains, sizes, flat, words in _rows(batch):
                keys, _ = ngram_keys(*_opened(flat, words, sizes), order)
                keys, times = np.unique(keys, return_counts=True)
                cuts, times = _cuts(keys, bits), (times if trains else np.zeros(len(keys))).astype("<u4")
                keys = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                some = [s for s in range(1 << bits) if cuts[s + 1] > cuts[s]]
                body = [[packed(keys[cuts[s] : cuts[s + 1]], rising=True) for s in some], [packed(times[cuts[s] : cuts[s + 1]]) for s in some]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([piece] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in body)], names=["shard", "piece", "keys", "times"])

    def fold(shard: int, rows: list) -> pa.RecordBatch:
        found = [unpacked(r[1], "<u4", rising=True) for r in rows]
        keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpacked(r[2], "<u4") for r in rows]), len(keys))
        level = np.concatenate([_probed(keys[a : a + SEGMENT_KEYS], counts[a : a + SEGMENT_KEYS]) for a in range(0, len(keys), SEGMENT_KEYS)])[inverse]
        ends = np.cumsum([0, *map(len, found)]).tolist()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array([_pressed(level[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["piece", "shard", "levels"])

    sent = pieces.select("piece", "trains", "sizes", "flat", "words").mapInArrow(send, "shard int, piece long, keys binary, times binary")
    return _by_shard(sent, 1 << bits).mapInArrow(lambda found: _fold(found, fold), "piece long, shard int, levels binary")


def mixed(one: np.ndarray, longer: list[np.ndarray], counts: np.ndarray, starts: np.ndarray, n: int, v: int, d: float, strength: float) -> np.ndarray:
    """The probability of each token: ``counts`` of the tokens, discounted by ``d``, what that leaves going to all words and
    one unknown word alike; then for each length the n-gram's count, with ``strength`` times the shorter estimate, over its
    context's count. ``one`` and ``longer`` are counts of contexts and n-grams by the token they end at."""
    p = np.maximum(counts - d, 0) / max(n, 1) + (d * v / n if n else 1.0) / (v + 1)
    context = one
    for k, found in enumerate(longer):
        before = np.concatenate(([0.0], context[:-1]))
        before[starts] = 0
        p = np.where(before > 0, (np.minimum(found, before) + strength * p) / (before + strength), p)
        context = found
    return p


@dataclass
class Model:
    """The training texts, whose tokens are counted where they are looked up, and the longest n-gram."""

    source: DataFrame
    order: int


def train(df: DataFrame, order: int = 3, text_col: str = "text") -> Model:
    """A model of all texts of ``df``; a null text is an empty one."""
    return Model(df.select(F.col(text_col).cast("string").alias("text")), order)


def _middle(votes: list[int]) -> int:
    """The strength that the middle text of all would have: copies, of which a part of the texts are and which are best
    told by the weakest, don't decide."""
    seen = np.cumsum(votes)
    return int(np.searchsorted(seen, (seen[-1] + 1) / 2)) if seen[-1] else 0


def _bits(keys: int) -> int:
    return max(0, (max(keys - 1, 0) // SHARD_KEYS).bit_length())


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", trained: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``df``; log10 probabilities of its whole
    text and end.

    ``trained``: of which rows of ``df`` the model is, if it is of rows of ``df``; these are then read once for both. Counts
    of n-grams are the least of their levels, so that the shares of one context add up to no more than one, but for
    absent n-grams that the filter seems to have: one in five hundred at most, and only if their parts are there. A null or empty text is its end alone. Repeated rows and
    null ids are rows of their own; with no training text every token is unknown and has probability 1; an empty table gives
    no rows; further columns are not read.
    """
    order, no = model.order, F.lit(False)
    rows = text_table(df, id_col, text_col, (no if trained is None else F.coalesce(trained, no)).alias("trains"), F.lit(True).alias("scored")).withColumn("doc_id", F.col("doc_id").cast("long"))
    if trained is None:
        rows = rows.unionByName(model.source.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("trains"), no.alias("scored")))
    pieces = _pieces(rows)
    tokens, distinct = pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    word_bits, bits = _bits(distinct), _bits((order - 1) * tokens)
    words = _word_counts(pieces, word_bits)
    n, v, n1, n2 = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2"))).first()
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)

    def step(doc_ids, scored, sizes, flat, words, trains, counts: list[bytes], levels: list[bytes]) -> pa.RecordBatch:
        hashes, flat, starts = _opened(flat, words, sizes)
        exact = np.zeros(len(hashes), np.int64)
        exact[np.argsort(hashes)] = np.concatenate([unpacked(x, "<u8") for x in counts]).astype(np.int64)
        keys, ends = ngram_keys(hashes, flat, starts, order)
        told = np.frombuffer(b"".join(map(_opened_bytes, levels)), np.uint8)
        level = told[np.unique(keys, return_inverse=True)[1]] if len(keys) else told
        c = exact[flat].astype(float)
        least, longer, at = least_counts(), [c], 0
        for end in ends:
            # One that is there has its first and last n - 1 tokens there too.
            found = np.zeros(len(flat))
            found[end] = np.where((longer[-1][end] > 0) & (longer[-1][end - 1] > 0), least[level[at : at + len(end)]], 0)
            longer.append(found)
            at += len(end)
        longer = longer[1:]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        out = [add(np.log10(mixed(c, longer, c, starts, n, v, d, s))) for s in STRENGTHS]
        # Each training token left out of what is known of it; what comes before it stays.
        fit = np.zeros(len(STRENGTHS), np.int64)
        if trains:
            less = [np.maximum(x - 1, 0) for x in longer]
            own = [add(np.log10(mixed(np.maximum(c - 1, 0), less, c - 1, starts, n - 1, v, d, s))) for s in STRENGTHS]
            fit = np.bincount(np.argmax(own, axis=0), minlength=len(STRENGTHS))
        base = np.log10((exact + 1) / (n + v + 1))
        m = len(doc_ids)
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(add((c > 0).astype(np.int64))), pa.array(add(base[flat])),
            pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * len(STRENGTHS)), pa.array(np.column_stack(out).ravel())), pa.array([fit.tolist()] + [None] * (m - 1), pa.list_(pa.int64())), pa.array(scored, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "scores", "fit", "scored"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, levels = None, [], []
        for batch in found:
            for kind, count, level, *more in _rows(batch):
                if kind == 0:
                    if own is not None:
                        yield step(*own, counts, levels)
                    own, counts, levels = more, [], []
                elif kind == 1:
                    counts.append(count)
                else:
                    levels.append(level)
        if own is not None:
            yield step(*own, counts, levels)

    # A piece's own row comes before its counts and levels, these by shard: in the order of its keys.
    parts = [
        pieces.select("piece", F.lit(0).alias("kind"), F.lit(-1).alias("shard"), "doc_ids", "scored", "sizes", "flat", "words", "trains"),
        words.where("piece is not null").select("piece", F.lit(1).alias("kind"), "shard", F.col("counts").alias("count")),
        _levels(pieces, order, bits).select("piece", F.lit(2).alias("kind"), "shard", F.col("levels").alias("level")),
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).repartition("piece").sortWithinPartitions("piece", "kind", "shard")
    schema = "doc_id long, n_tokens long, n_known long, base_score double, scores array<double>, fit array<long>, scored boolean"
    done = shared.written(both.select("kind", "count", "level", "doc_ids", "scored", "sizes", "flat", "words", "trains").mapInArrow(run, schema), "scored")
    votes = done.agg(*(F.coalesce(F.sum(F.col("fit")[i]), F.lit(0)) for i in range(len(STRENGTHS)))).first()
    best = _middle(votes)
    return done.where("scored").select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))
