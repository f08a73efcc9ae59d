"""Thin queries: the operators with production parameters over whole tables, in the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topolidar.llm import bpe, language_model, licenses, separators, tool_calls, toxicity
from topolidar.llm.chunks import dedup_substrings
from topolidar.llm.contamination import contamination
from topolidar.llm.quality import quality_rules
from topolidar.llm.simhash import simhash_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _multi_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@_query
def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _multi_bpe()
    separator = max(bpe.read_ranks(path).values()) + 1  # the first id that the ranks leave free
    width = 2 if separator < 1 << 16 else 4
    blocks, order = separators.pack(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), separator, width)
    return separators.document_counts(blocks, separator, width).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@_query
def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chunks", F.size("removed").cast("long").alias("n_removed"), "removed_bytes", (F.col("removed_bytes") > 0).alias("repeats"), "text", "removed")


def _sql_licenses() -> str:
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bare = f"regexp_replace({text}, '{licenses.LEADERS}', '\\1', 'g')"
    flowing = rf"regexp_replace({bare}, '([^.!?\n\x20\x09\x0D])[\x20\x09\x0D]*\n[\x20\x09\x0D]*([^\n\x20\x09\x0D])', '\1 \2', 'g')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in licenses.known_sentences().items()) + "}"

    def known(source: str) -> str:
        marked = f"regexp_replace(regexp_replace({source}, '{licenses.END}', '\\1' || chr(10), 'g'), '{licenses.OTHER}', ' ', 'g')"
        mapped = f"list_transform(string_split({marked}, chr(10)), lambda s: coalesce(({ids})[trim(s)], CASE WHEN regexp_matches(trim(s), '{licenses.COPYRIGHT}') THEN 'Copyright' END))"
        return f"list_filter({mapped}, lambda s: s IS NOT NULL)"

    steps, before = [], "start"
    for i, (_, sequence) in enumerate(licenses.RULES):
        mark = "".join(f"<{s}>" for s in sequence)
        steps.append(f"r{i} AS (SELECT *, contains(left{i}, '{mark}') AS m{i}, replace(left{i}, '{mark}', '#') AS left{i + 1} FROM {before})")
        before = f"r{i}"
    names = ", ".join(f"CASE WHEN m{i} THEN '{name}' END" for i, (name, _) in enumerate(licenses.RULES))
    first = "list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i)"
    return f"""
    WITH b AS (SELECT doc_id, {known(text)} AS lines, {known(flowing)} AS flowing FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(flowing) >= len(lines) THEN flowing ELSE lines END AS ids FROM b),
    start AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(list_filter(ids, lambda s: s <> 'Copyright'), lambda s: '<' || s || '>'), 'string_agg', ''), '') AS left0 FROM s),
    {", ".join(steps)},
    f AS (SELECT doc_id, ids, [{names}] AS l, left{len(licenses.RULES)} AS rest FROM {before})
    SELECT doc_id, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids, coalesce(list_aggregate({first}, 'string_agg', ','), '') AS licenses,
           CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched FROM f"""


SQL["op3_license_rules"] = _sql_licenses()


@_query
def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_unmatched")


@_query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = language_model.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs.select("doc_id", "text").join(labels.where(~held_out).select("doc_id", "toxic"), "doc_id"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A user's turn, as a call that the assistant answers.
ANSWER = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}

SQL["op7_tool_calls"] = """
WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id || ':' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.id AS call_id, CAST(c.depth AS INTEGER) AS depth, r.id IS NOT NULL AS linked, length(c.text) >= 1 AS valid,
       sha256('{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"depth":' || c.depth || ',"id":"' || c.id || '","name":"answer","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}') AS json_sha256
FROM c LEFT JOIN r USING (id)
"""


#: Turns of a conversation that one task orders.
TURNS = 4096


def _before(asked: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the turn of the same conversation before each; in two levels, of runs of turns and within
    them, as one conversation may have a third of all rows."""
    part = asked.where("turn is not null").select("conv_id", "turn").distinct().withColumn("part", F.floor(F.col("turn") / TURNS))
    inner, outer = Window.partitionBy("conv_id", "part").orderBy("turn"), Window.partitionBy("conv_id").orderBy("part")
    last = part.groupBy("conv_id", "part").agg(F.max("turn").alias("last")).select("conv_id", "part", F.lag("last").over(outer).alias("last"))
    return part.withColumn("before", F.lag("turn").over(inner)).join(last, ["conv_id", "part"]).select("conv_id", "turn", F.coalesce("before", "last").alias("before"))


@_query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as calls, each of which needs the one before; the assistant's next turn is the result."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    call = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col(turn) if isinstance(turn, str) else turn).cast("string"))
    asked = turns.where("role = 'user'")
    calls = asked.select(F.col("conv_id").alias("group_id"), call("turn").alias("call_id"), F.lit("answer").alias("name"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn")).alias("arguments"))
    results = turns.where("role = 'assistant'").select(call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    needs = _before(asked).where("before is not null").select(call("turn").alias("call_id"), call("before").alias("needed"))
    linked = tool_calls.link_calls(calls, results, needs, {"answer": ANSWER})
    return linked.select(F.col("group_id").alias("conv_id"), "call_id", "depth", "linked", "valid", F.sha2("json", 256).alias("json_sha256"))


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), words=4, radius=4)


#: DuckDB's words of op6, and its windows; lengths of items below ten make one window.
_OP6_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL["op6_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_OP6_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP6_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(_table(spark, sf_dir, "documents"), *_multi_bpe(), round_trip=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op9_log_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_model.held_out(F.col("doc_id"))
    model = language_model.train(docs.where(~out))
    scored = language_model.score(docs, model, trained=~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("repeats")
