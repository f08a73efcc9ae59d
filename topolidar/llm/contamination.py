"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

The index holds postings (term, document, place) of every term that the benchmark has, in segments that are made where the
documents are read. A benchmark window is looked up from its rarest term on: the postings of
the rarest one give candidates, those of the second rarest at its offset leave few of them, and these are then intersected
with the postings of all other terms at their offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.llm import shared
from topolidar.llm.batches import text_table

#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which a table made from the benchmark is broadcast (some 100 MB at most), and up to which the numbers of
#: documents with candidates are (some 60 MB); beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_NUMBERS = 200_000, 2_000_000
#: In the index: the row that each document has, at place 0, whatever its words are.
DOCUMENT = -1


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATORS), "")


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table to join with: broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of the items that have words."""
    found = text_table(benchmark, id_col, text_col).select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("words"))
    return shared.written(found.where(F.size("words") > 0), "items")


def terms_of(items: DataFrame) -> DataFrame:
    """(term, t): the benchmark's terms with a number each; the empty term, which no text has, marks documents."""
    found = items.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("t"))
    return shared.written(found.union(items.sparkSession.range(1).select(F.lit(""), F.lit(DOCUMENT).cast("long"))), "terms")


def build_index(docs: DataFrame, terms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(t, row, pos, doc_id, n_words, keep): a posting for each place, from 1 on, of a document's word that is a term, and one
    DOCUMENT row for each document, which alone has the last columns. ``row`` tells rows with equal or null ids apart.
    Documents are read once, and each task writes a segment as it reads them."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"), *keep)
    found = found.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), *keep, F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term"))
    of_document = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    found = found.join(_small(terms), "term").select("t", "row", "pos", *(of_document(c) for c in ("doc_id", "n_words", *keep)))
    return shared.written(found, "index")


def windows_of(items: DataFrame, terms: DataFrame, index: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(window, n, t1, at1, t2, at2, ts) of each different window of ``width`` words of an item, or of all words of a shorter
    one, and (window, item_id): which items have it. t1 and t2 are its rarest and second rarest term by postings in the
    index, ties to the smaller number, with their places; ts are all terms in order. t2 is null if there is one term only.
    Windows with a term that no document has can't occur and are left out."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("start")
    some = items.select("item_id", "words", starts).select("item_id", F.slice("words", F.col("start") + 1, F.lit(width)).alias("w"))
    distinct = shared.written(some.select("w").distinct().select(F.monotonically_increasing_id().alias("window"), "w"), "windows")
    counts = index.where(F.col("t") >= 0).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    counted = shared.written(terms.join(counts, "t"), "counts")
    placed = distinct.select("window", F.size("w").alias("n"), F.posexplode("w").alias("at", "term")).join(_small(counted), "term")
    ranked = placed.groupBy("window").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "t", "at"))).alias("r")).where(F.size("r") == F.col("n"))
    other = F.get(F.filter("r", lambda x: x["t"] != F.col("r")[0]["t"]), F.lit(0))
    by_place = F.transform(F.array_sort(F.transform("r", lambda x: F.struct(x["at"].alias("at"), x["t"].alias("t")))), lambda x: x["t"])
    windows = ranked.select("window", "n", F.col("r")[0]["t"].alias("t1"), F.col("r")[0]["at"].alias("at1"), other["t"].alias("t2"), other["at"].alias("at2"), by_place.alias("ts"))
    return shared.written(windows, "ranked"), shared.written(some.join(distinct, "w").select("window", "item_id").distinct(), "members")


def _candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, window, start, n, t2, at2): where windows would begin, by the postings of their rarest term."""
    rare = _small(windows.select(F.col("t1").alias("t"), "window", "at1", "n", "t2", "at2"))
    found = index.join(rare, "t").withColumn("start", F.col("pos") - F.col("at1"))
    return found.select("row", "window", "start", "n", "t2", "at2")


def _postings(index: DataFrame, found: DataFrame) -> DataFrame:
    """(row, pos, t) of the documents that ``found`` has."""
    rows = shared.written(found.select("row").distinct(), "rows")
    return index.where(F.col("t") >= 0).select("row", "pos", "t").join(_small(rows, BROADCAST_NUMBERS), "row", "left_semi")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, window, start, n): places, from 1 on, where a document has all words of a window in their order."""
    second = _small(windows.where("t2 is not null").select(F.col("t2").alias("t")).distinct())
    beside = index.join(second, "t", "left_semi").select("row", (F.col("pos")).alias("_pos"), F.col("t").alias("t2"))
    ahead = _candidates(index, windows).where("start >= 1").withColumn("_pos", F.col("start") + F.col("at2"))
    left = shared.written(ahead.join(beside.withColumn("hit", F.lit(True)), ["row", "_pos", "t2"], "left").where("t2 is null or hit").select("row", "window", "start", "n"), "candidates")
    want = left.join(_small(windows.select("window", "ts")), "window").select("row", "window", "start", "n", F.posexplode("ts").alias("at", "t"))
    want = want.withColumn("pos", F.col("start") + F.col("at")).drop("at")
    met = want.join(_postings(index, left), ["row", "pos", "t"]).groupBy("row", "window", "start", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.where("met = n").drop("met")


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(row, window, start): places where all words of a window occur, in any order, within its words plus ``slop`` on either
    side, if it is laid with its rarest term on a posting of that term."""
    wide = (windows.agg(F.max("n")).first()[0] or 1) + 2 * slop
    found = shared.written(_candidates(index, windows).select("row", "window", "start", "n"), "candidates")
    want = found.join(_small(windows.select("window", F.array_distinct("ts").alias("ts"))), "window").select("row", "window", "start", "n", F.size("ts").alias("kinds"), F.explode("ts").alias("t"))
    low, high = F.col("start") - slop, F.col("start") + F.col("n") - 1 + slop
    want = want.withColumn("part", F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))))
    there = _postings(index, found).withColumn("part", F.floor(F.col("pos") / wide))
    met = want.join(there, ["row", "t", "part"]).where(F.col("pos").between(low, high)).select("row", "window", "start", "kinds", "t").distinct()
    return met.groupBy("row", "window", "start", "kinds").agg(F.count(F.lit(1)).alias("met")).where("met = kinds").select("row", "window", "start")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) and the columns in ``keep`` for each row of ``docs``: its words, how many of them
    are in an occurrence of a benchmark window, the sorted ids (as strings) of the items with such windows, and the word
    ranges that they cover.

    A null or empty text has no words and no hits; so has an item. Repeated rows and rows with a null id are judged each
    for itself; equal windows of several items count for all of them. An empty table of documents gives no rows, an empty
    benchmark no hits; further columns are not read. Of documents only the postings of benchmark terms are kept; a group
    holds what one document has.
    """
    docs = text_table(docs, id_col, text_col, *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)))
    kept = [f"keep_{i}" for i in range(len(keep))]
    items = items_of(benchmark, item_id, item_text)
    terms = terms_of(items)
    index = build_index(docs, terms, kept)
    windows, members = windows_of(items, terms, index, width)
    hits = shared.written(phrase_matches(index, windows), "hits")
    ids = hits.select("row", "window").distinct().join(_small(members), "window").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # Ranges that overlap or touch are one: a new one begins after the largest end before it.
    in_order = Window.partitionBy("row").orderBy("start")
    ranges = hits.groupBy("row", (F.col("start") - 1).alias("start")).agg((F.col("start") - 1 + F.max("n")).alias("stop"))
    ranges = ranges.withColumn("_before", F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("_run", F.sum(F.coalesce((F.col("_before") < F.col("start")).cast("int"), F.lit(1))).over(in_order))
    runs = ranges.groupBy("row", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    joined = index.where(F.col("t") == DOCUMENT).select("row", "doc_id", "n_words", *kept).join(ids.join(spans, "row"), "row", "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"), *(F.col(c).alias(k) for c, k in zip(kept, keep, strict=True)))
