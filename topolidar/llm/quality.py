"""Quality rules: word and line counts, and repetition found with suffix arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topolidar.llm.batches import buffers, map_texts

SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\x0b\x0c\r "

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, repeats array<struct<start:long,stop:long>>, kept boolean"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits. A repeat is a maximal substring, in words, that a text holds twice or more (overlaps count) and that has
    ``repeat_words`` words or more. A text fails when repeats cover more than ``max_covered`` of its words, or when its
    longest repeat is over ``max_longest`` of them."""

    min_words: int = 50
    max_repeat_percent: int = 50
    repeat_words: int = 10
    max_covered: float = 0.4
    max_longest: float = 0.25


class _Numbers(dict):
    """Numbers for words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of many sequences at once, by prefix doubling that sorts again only what is still tied.

    ``symbols`` are such that sequences share none; ``ends[i]`` is where i's sequence stops. Returns the positions in
    suffix order, and the ranks by the first 2 symbols (ties share the rank of the first of them). With ``depth``, ties
    by that many symbols may stay.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    new = np.ones(n, bool)
    new[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    kept: dict[int, np.ndarray] = {}
    slots = _tied(new)
    k = 1
    while len(slots) and (depth is None or k < depth):
        at = order[slots]
        follow = at + k
        second = np.where(follow < ends[at], rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        if k == 1:
            kept[2] = rank.copy()
        slots = slots[_tied(fresh)]
        k *= 2
    kept.setdefault(2, rank)
    return order, kept


def _tied(new: np.ndarray) -> np.ndarray:
    """Where a sorted run has more than one member; ``new`` marks the first of each run."""
    last = np.ones(len(new), bool)
    last[:-1] = new[1:]
    return np.flatnonzero(~(new & last))


def longest_common(symbols: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of pairs of suffixes of a sequence each, by binary search over prefix hashes."""
    if not len(a):
        return np.zeros(0, np.int64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        mixed = symbols.astype(np.uint64) + np.uint64(1)
        for shift in (30, 27, 31):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        power = np.cumprod(np.full(len(symbols), factor, np.uint64), dtype=np.uint64)
        hashes = np.zeros(len(symbols) + 1, np.uint64)
        hashes[1:] = np.cumsum(mixed * power, dtype=np.uint64)
        first, second = np.minimum(a, b), np.maximum(a, b)
        lift = np.concatenate(([np.uint64(1)], power))[second - first]
        low, high = np.zeros(len(a), np.int64), ends[second] - second
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (hashes[first + mid] - hashes[first]) * lift == hashes[second + mid] - hashes[second]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def repeat_reach(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each position, the words of the longest substring that starts there and occurs elsewhere in its sequence; 0 below ``least``.

    In suffix order, an LCP interval of depth d holds the occurrences of a maximal repeat of d words; the deepest one that
    holds a suffix has the larger of its two neighbouring LCP values.
    """
    reach = np.zeros(len(symbols), np.int64)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((symbols[a] == symbols[b]) & (ends[a] - a >= least) & (ends[b] - b >= least))
    for k in (1, least - 1):
        near = near[symbols[a[near] + k] == symbols[b[near] + k]] if least > k else near
    common = longest_common(symbols, ends, a[near], b[near])
    near, common = near[common >= least], common[common >= least]
    np.maximum.at(reach, a[near], common)
    np.maximum.at(reach, b[near], common)
    return reach


def _spans(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the union of [i, i + reach[i])."""
    at = np.flatnonzero(reach)
    if not len(at):
        return at, at
    furthest = np.maximum.accumulate(at + reach[at])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] >= furthest[:-1]  # spans that only touch may be of two texts
    heads = np.flatnonzero(new)
    return at[heads], furthest[np.append(heads[1:], len(at)) - 1]


def measure(found: list[bytes], rules: QualityRules) -> dict[str, np.ndarray | list]:
    """The columns of SCHEMA after doc_id for some texts."""
    numbers = _Numbers()
    number = numbers.__getitem__
    words = [list(map(number, t.split())) for t in found]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.concatenate(([0], np.cumsum(n_words)))
    flat = np.fromiter((w for x in words for w in x), np.int64, int(edges[-1]))
    owner = np.repeat(np.arange(len(words)), n_words)
    ends = np.repeat(edges[1:], n_words)
    symbols = owner * max(len(numbers), 1) + flat

    order, kept = suffix_ranks(symbols, ends)
    in_repeat = np.zeros(len(flat) + 1, np.int64)
    at = np.flatnonzero(np.arange(len(flat)) + 2 < ends)
    if len(at):
        by_two = kept[2]
        pairs = by_two[at]
        shared = np.bincount(pairs, minlength=len(flat) + 1)[pairs] > 1  # a triple that repeats starts with a pair that does
        at = at[shared]
        _, which, times = np.unique(by_two[at] * max(len(numbers), 1) + flat[at + 2], return_inverse=True, return_counts=True)
        at = at[times[which] > 1]
        np.add.at(in_repeat, at, 1)
        np.add.at(in_repeat, at + 3, -1)
    in_repeat = np.cumsum(in_repeat)[:-1] > 0
    reach = repeat_reach(symbols, ends, order, rules.repeat_words)
    starts, stops = _spans(reach)
    covered, longest, n_repeat = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    np.add.at(covered, owner[starts], stops - starts)
    np.maximum.at(longest, owner, reach)
    np.add.at(n_repeat, owner[in_repeat], 1)

    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    repetitive = (covered > rules.max_covered * n_words) | (longest > rules.max_longest * n_words)
    spans: list[list[dict]] = [[] for _ in words]
    for a, b, doc in zip(starts.tolist(), stops.tolist(), owner[starts].tolist(), strict=True):
        spans[doc].append({"start": a - int(edges[doc]), "stop": b - int(edges[doc])})
    return {"n_words": n_words, "n_repeat_words": n_repeat, "base_failed": base_failed, "covered_words": covered, "longest_repeat": longest, "repeats": spans, "kept": ~base_failed & ~repetitive}


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules(), keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``df`` with the counts, the spans of repeats (in words), the verdict ``kept`` and columns to keep.

    Words are runs of bytes other than the six ASCII spaces. A null or empty text has no words and fails; so does any text
    under ``min_words``. Rows with equal or null ids are judged each for itself. Ties don't arise: all counts are exact.
    An empty table gives no rows; columns of ``df`` outside ``keep`` are not read. One pass without a shuffle; a task holds a few
    MB of text, or one text if that is longer.
    """
    symbol, space = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    space[list(SPACES)] = True

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, data = buffers(batch.column("text"))
        whole, edges = data.tobytes(), offsets.tolist()
        found = [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        columns = measure(found, rules) | {
            "doc_id": batch.column("doc_id"),
            "word_chars": _per_text(((data & 0xC0) != 0x80) & ~space[data], offsets),
            "n_symbols": _per_text(symbol[data], offsets),
            "n_dup_lines": np.fromiter(map(_dup_lines, found), np.int64, len(found)),
        }
        spans = pa.array(columns["repeats"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([spans if k == "repeats" else pa.array(columns[k]) if k != "doc_id" else columns[k].cast(pa.int64()) for k in names], names=names)

    return map_texts(df, SCHEMA, step, id_col, text_col, keep)
