"""The queries of this subpackage: thin uses of its operators, and SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsonde.llm import (
    decontamination, formatting, hard_negatives, jaccard_join, line_frequency, lm_scoring, pii, quality,
    repeat_dedup, sampled_encoding, spelling, substring_dedup, topk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- 1 ------------------------------------------------------------------------------------------

PROBE = "<|im_end|><|im_start|>assistant ok"


def turn_digests(rows: DataFrame) -> DataFrame:
    """Digests over turns in order. SHA-256 runs in sequence, so one task reads a conversation's
    turns as a sorted stream; it keeps two hash states, however long the conversation is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        state: list = []

        def done() -> pa.RecordBatch:
            n, whole, n_loss, loss, chars, valid = state
            return pa.RecordBatch.from_pylist([{
                "conv_id": current, "n_turns": n, "turns_sha256": whole.hexdigest(), "loss_chars": n_loss,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_valid": valid,
            }], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if current is run or r["conv_id"] != current:
                    if state:
                        yield done()
                    current, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{r['role']}\n{r['text']}\n".encode())
                state[2] += len(r["learned"])
                state[3].update(r["learned"].encode())
                state[4] += r["chars"]
                state[5] += r["valid"]
        if state:
            yield done()

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_valid long"
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_valid", pa.int64()),
    ])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").drop("block", "place", "turn").mapInArrow(run, ddl)


@query("op1_chat_formatting", """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
placed AS (
  SELECT *, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE coalesce(previous, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
              WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
            AND (following IS NOT NULL OR role IN ('user', 'assistant')) AS valid
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
      + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid
FROM judged GROUP BY conv_id
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return turn_digests(formatting.read_back(formatting.format_turns(conversations.unionByName(probe))))


# -- 3 ------------------------------------------------------------------------------------------

THRESHOLD = 0.3
FOLDS = 5


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def training_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.classify(docs, training_labels(spark, sf))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


# -- 7 ------------------------------------------------------------------------------------------


@query("op7_benchmark_decontamination", """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, windows.n, item_id FROM windows JOIN phrases USING (n, p)),
hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


# -- 8 ------------------------------------------------------------------------------------------

TOP = 20
QUERY_EVERY = 20


@query("op8_exact_topk", """
WITH whole AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vid") % QUERY_EVERY == 0, TOP)


# -- 10 -----------------------------------------------------------------------------------------

SURROGATE_KEY = "surrogates"


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SURROGATE_KEY)


# -- 4 ------------------------------------------------------------------------------------------


@query("op4_ngram_jaccard_join", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, 2) AS BIGINT))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) d LEFT JOIN sizes USING (doc_id)
""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


# -- 6 ------------------------------------------------------------------------------------------


@query("op6_substring_dedup", """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT p, min(doc_id) AS least FROM windows GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS word
  FROM windows JOIN firsts USING (p) WHERE least < doc_id),
every AS (SELECT doc_id, unnest(w) AS one, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS word FROM words),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(one, ' ' ORDER BY word) AS kept FROM every ANTI JOIN gone USING (doc_id, word) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)
""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = substring_dedup.duplicate_words(table(spark, sf, "documents").select("doc_id", "text"))
    return substring_dedup.without_spans(found).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# -- 9 ------------------------------------------------------------------------------------------


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = repeat_dedup.duplicate_bytes(table(spark, sf, "documents").select("doc_id", "text"))
    return repeat_dedup.without_spans(found).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# -- 2 ------------------------------------------------------------------------------------------

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sampled_encoding")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sampled_encoding.encode(docs, PIECES).drop("text")


# -- 5 ------------------------------------------------------------------------------------------


@query("op5_masked_lm_scoring")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.train(docs), lm_scoring.count_words(docs)).drop("text")


# -- 11 -----------------------------------------------------------------------------------------


@query("op11_line_frequency", """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_number() OVER () AS r, *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
grams AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM words WHERE len(w) >= 3)),
often AS (SELECT r, g FROM grams GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS word FROM grams JOIN often USING (r, g)) GROUP BY r),
raw AS (
  SELECT r, source, text, l, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM raw GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
frequent AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS k FROM raw GROUP BY ALL) JOIN hosts USING (source)
  WHERE k > 10 AND 100 * k > docs),
lost AS (
  SELECT r, sum(len(regexp_split_to_array(line, ' '))) AS n FROM raw JOIN frequent USING (source, line) GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
  FROM words LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * n_removed_words > 50 * n_words AS kept
FROM base
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_frequency.judge(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


# -- 12 -----------------------------------------------------------------------------------------


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


# -- 13 -----------------------------------------------------------------------------------------

ANCHOR_EVERY = 50


@query("op13_hard_negatives", """
WITH whole AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
  SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.id <> b.id WHERE a.id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vid") % ANCHOR_EVERY == 0, label)
