"""Toxicity scores from class-conditional Kneser-Ney models of characters.

Each class has counts of ORDER-character pieces of words; both back off to one model of shorter pieces, counted over both
classes. The log-likelihood ratio of a piece that a class has not seen is then the ratio of two backoff weights, and rare
expressions cancel out. A text is judged by length-normalised ratios: of the whole text, for a character, and of its one,
two, four and eight most toxic words, for a character and for a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolidar.llm import shared
from topolidar.llm.batches import map_texts

ORDER, DISCOUNT = 8, 0.75
#: Pieces found less often in both classes together are left to the backoff.
LEAST = 2
#: Numbers of strongest words that a text is judged by.
TOPS = (1, 2, 4, 8)
#: The fit takes that many labelled rows at most, by hashed ids, and of texts up to that many bytes. ORDER, LEAST, TOPS and
#: FOLDS were chosen by folds of the rows that one may learn from.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 1 << 16
FOLDS, FEATURES = 4, 1 + 2 * len(TOPS)

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(word: str) -> list[str]:
    """The ORDER-character pieces of a word that is led by a mark and closed by another; no word has either."""
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


class Ratios:
    """Log-likelihood ratios of pieces, class 1 against class 0."""

    def __init__(self, counts: tuple[Counter, Counter]):
        """``counts``: of words, by class."""
        own = tuple(Counter() for _ in counts)
        for words, into in zip(counts, own, strict=True):
            for word, n in words.items():
                for piece in pieces(word):
                    into[piece] += n
        rare = [p for p in own[0].keys() | own[1].keys() if own[0][p] + own[1][p] < LEAST]
        for found in own:
            for piece in rare:
                found.pop(piece, None)
        lower = {ORDER - 1: Counter(p[1:] for p in own[0].keys() | own[1].keys())}  # distinct characters before a piece
        for k in range(ORDER - 2, 0, -1):
            lower[k] = Counter(p[1:] for p in lower[k + 1])
        totals, kinds = ({k: Counter() for k in lower} for _ in range(2))
        for k, found in lower.items():
            for piece, n in found.items():
                totals[k][piece[:-1]] += n
                kinds[k][piece[:-1]] += 1
        shared: dict[str, float] = {"": 1 / (len(lower[1]) + 1)} if lower[1] else {}
        for k in range(1, ORDER):
            for piece, n in lower[k].items():
                total = totals[k][piece[:-1]]
                shared[piece] = max(n - DISCOUNT, 0) / total + DISCOUNT * kinds[k][piece[:-1]] / total * shared[piece[1:] if k > 1 else ""]
        sizes, types = (tuple(Counter() for _ in own) for _ in range(2))
        for c, found in enumerate(own):
            for piece, n in found.items():
                sizes[c][piece[:-1]] += n
                types[c][piece[:-1]] += 1

        def weight(c: int, context: str) -> float:
            return DISCOUNT * types[c][context] / sizes[c][context] if context in sizes[c] else 1.0

        def chance(c: int, piece: str) -> float:
            seen = max(own[c].get(piece, 0) - DISCOUNT, 0) / sizes[c][piece[:-1]] if piece[:-1] in sizes[c] else 0.0
            return seen + weight(c, piece[:-1]) * shared[piece[1:]]

        self.seen = {p: math.log(chance(1, p) / chance(0, p)) for p in own[0].keys() | own[1].keys()}
        self.unseen = {h: math.log(weight(1, h) / weight(0, h)) for h in sizes[0].keys() | sizes[1].keys()}


def word_ratio(word: str, seen: dict[str, float], unseen: dict[str, float]) -> float:
    return sum(seen[p] if p in seen else unseen.get(p[:-1], 0.0) for p in pieces(word))


def features(texts: list[str], seen: dict[str, float], unseen: dict[str, float]) -> np.ndarray:
    """For each text: the ratio for a character of the whole text; of its strongest 1, 2, 4 and 8 different words, or as many
    as it has, the ratio for a character and for a word (of so many)."""
    known: dict[str, float] = {}
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        found = Counter(words(text))
        if not found:
            continue
        for word in found:
            if word not in known:
                known[word] = word_ratio(word, seen, unseen)
        ratios = np.fromiter(map(known.__getitem__, found), float, len(found))
        lengths, times = np.fromiter(map(len, found), float, len(found)) + 1, np.fromiter(found.values(), float, len(found))
        out[i, 0] = (ratios * times).sum() / (lengths * times).sum()
        top = np.lexsort((lengths, -ratios))[: TOPS[-1]]
        for j, k in enumerate(TOPS):
            total = ratios[top[:k]].sum()
            out[i, 1 + j], out[i, 1 + len(TOPS) + j] = total / lengths[top[:k]].sum(), total / k
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, of a logistic regression with a ridge penalty, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    seen: dict[str, float]
    unseen: dict[str, float]
    weights: list[float]


def _counted(sample: DataFrame) -> DataFrame:
    """(fit, label, word, n): the words of a sample (fold, label, text) for each fit; fit k leaves fold k out, fit FOLDS none."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            counts: dict[tuple[int, int], Counter] = {}
            for fold, label, text in zip(*(batch.column(c) for c in ("fold", "label", "text")), strict=True):
                counts.setdefault((fold.as_py(), label.as_py()), Counter()).update(words(text.as_py()))
            for (fold, label), some in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(some), pa.int32()), pa.array([label] * len(some), pa.int32()), pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], names=["fold", "label", "word", "n"])

    counted = sample.select("fold", "label", "text").mapInArrow(run, "fold int, label int, word string, n long")
    counted = counted.groupBy("fold", "label", "word").agg(F.sum("n").alias("n"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda k: k != F.col("fold"))
    return counted.select(F.explode(fits).alias("fit"), "label", "word", "n").groupBy("fit", "label", "word").agg(F.sum("n").alias("n"))


def _fitted(counted: DataFrame) -> DataFrame:
    """(fit, piece, ratio): the ratios of each fit, those of unseen continuations under a context's ORDER - 1 characters. A
    task makes one fit, which the sample bounds."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        by_class = tuple(Counter(dict(zip(some["word"], some["n"], strict=True))) for some in (pdf[pdf["label"] == c] for c in (0, 1)))
        number = pdf["fit"].iloc[0]
        if not all(by_class):
            return pd.DataFrame({"fit": [], "piece": [], "ratio": []})
        ratios = Ratios(by_class)
        return pd.DataFrame({"fit": number, "piece": [*ratios.seen, *ratios.unseen], "ratio": [*ratios.seen.values(), *ratios.unseen.values()]})

    return counted.groupBy("fit").applyInPandas(fit, "fit int, piece string, ratio double")


def _split(pieces: list[str], ratios: list[float]) -> tuple[dict[str, float], dict[str, float]]:
    both = list(zip(pieces, ratios, strict=True))
    return {p: r for p, r in both if len(p) == ORDER}, {p: r for p, r in both if len(p) < ORDER}


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits both models, and the weights of the features on texts that the ratios they are fitted on have not seen.

    Rows without a label or a text are left out. Takes at most SAMPLE_ROWS rows; with none, or none of a class, the score is
    the share of class 1 for all texts (a half with no rows). Executors count, fit and take the features; the driver gets a
    few numbers for each row of the sample, and the ratios, which it sends on.
    """
    labelled = labelled.where(F.col(label_col).isNotNull())
    # By their number, which needs no texts, rows are thinned to some more than the sample before any of them is sorted.
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(labelled.count(), 1))
    thin = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = thin.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.xxhash64(id_col).alias("by"), F.col(text_col).alias("text"), (F.col(label_col).cast("int") > 0).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("by", "text"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = shared.written(rows.orderBy("by", "text", "label").limit(SAMPLE_ROWS).select("text", "label", fold), "sample")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = (toxic + 0.5) / (n + 1)
        return ToxicityModel({}, {}, [0.0] * FEATURES + [math.log(share / (1 - share))])
    fitted = shared.written(_fitted(_counted(sample)), "ratios")

    def judged(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = features(left["text"].tolist(), *_split(right["piece"].tolist(), right["ratio"].tolist()))
        return pd.DataFrame({"label": left["label"], "x": list(x)})

    # Each text meets the fit that left its fold out.
    sides = sample.groupBy("fold").cogroup(fitted.where(F.col("fit") < FOLDS).withColumnRenamed("fit", "fold").groupBy("fold"))
    found = sides.applyInPandas(judged, "label int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, FEATURES)
    weights = logistic(x, found.column("label").to_numpy()).tolist()
    whole = fitted.where(F.col("fit") == FOLDS).select("piece", "ratio").toArrow()
    return ToxicityModel(*_split(whole.column("piece").to_pylist(), whole.column("ratio").to_pylist()), weights)


def toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, score, text_ratio, word_ratio) and the columns in ``keep`` for each row of ``df``; score is from 0 to 1.

    A null or empty text, or one without words, has ratios of 0 and the score that follows. Repeated rows and null ids are
    rows like others; an empty table gives no rows. One pass; the model's size is bounded by the sample of its fit.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.seen, model.unseen, model.weights))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, unseen, weights = sent.value
        x = features([t or "" for t in batch.column("text").to_pylist()], seen, unseen)
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "score", "text_ratio", "word_ratio"])

    return map_texts(df, "doc_id long, score double, text_ratio double, word_ratio double", step, id_col, text_col, keep)
