"""Queries on judged records, mentions and JSON-lines files."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsonde.functions import text as T
from capsonde.functions.scalars import top_list
from capsonde.operators import abilities as A
from capsonde.operators import judging as J
from capsonde.plans import refinement
from capsonde.session import scratch_path
from capsonde.sources import jsonl
from workload import inputs as I
from workload.registry import query, with_ctes

# Whitespace as the engine defines it, for RE2.
RE2_WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{RE2_WS}+', ' ', 'g'))"


def sql_compact(c: str, n: int) -> str:
    t = sql_squeeze(c)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - 3})) || '...' END"


def sql_norm(c: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '_', 'g'), '_'), ''),"
        " 'unnamed_ability')"
    )


JUDGED = """
judged AS (
  SELECT doc_id AS pos, doc_id % 8 AS shape, doc_id % 11 = 5 AS failed, lang, source, text, n_chars,
         CASE WHEN doc_id % 11 = 5 THEN 'request_error'
              WHEN doc_id % 8 IN (3, 4) THEN 'parse_error' ELSE 'parsed' END AS outcome,
         CASE WHEN doc_id % 8 = 6 THEN 'r' ELSE 'j' END || doc_id AS cluster_id,
         CASE WHEN doc_id % 8 = 6 THEN source ELSE lang END AS family,
         CASE WHEN doc_id % 8 <> 6 THEN ['keep', 'split', 'merge', 'drop'][doc_id % 4 + 1] END AS fit
  FROM documents)
"""
RAW = """
raw AS (
  SELECT pos, CAST(0 AS INTEGER) AS ability_index, cluster_id AS source_cluster_id, family AS source_family,
         fit AS cluster_fit, CAST(pos % 5 + 1 AS INTEGER) AS cluster_fit_score,
         source || CASE pos % 3 WHEN 0 THEN ' Skill' WHEN 1 THEN '-skill' ELSE '_SKILL!' END AS ability_name,
         CASE WHEN pos % 4 <> 1 THEN upper(source) END AS display_name,
         CASE WHEN pos % 2 = 0 THEN lang END AS representation_family,
         text AS definition, 'state ' || lang AS positive_state,
         CASE WHEN pos % 5 = 0 THEN 'narrow' WHEN pos % 5 <= 2 THEN 'cross_benchmark' END AS generality,
         CASE WHEN pos % 7 = 0 THEN 'no' ELSE 'yes' END AS contrast,
         [lang, 'b' || (pos % 10)] AS benchmarks
  FROM judged WHERE outcome = 'parsed' AND shape <> 5
  UNION ALL
  SELECT pos, 1, cluster_id, family, fit, CAST(pos % 5 + 1 AS INTEGER), lang || ' fluency', NULL, NULL,
         'fluency in ' || lang, NULL, 'family_specific', NULL, [source]
  FROM judged WHERE outcome = 'parsed' AND shape <> 5 AND pos % 3 = 0)
"""
USABLE = f"""
usable AS (
  SELECT *, {sql_norm('ability_name')} AS name FROM raw
  WHERE coalesce(contrast, '') <> 'no' AND coalesce(generality, '') <> 'narrow')
"""
# Names here are one letter run, digits, a blank and a word, so title case is plain.
FIELD_VALUES = """
field_values AS (
  SELECT name, 'display_name' AS field, 1 AS k, pos, ability_index, 0 AS item,
         coalesce(display_name, upper(name[1]) || replace(replace(name[2:], '_skill', ' Skill'), '_fluency', ' Fluency')) AS value
  FROM usable
  UNION ALL SELECT name, 'representation_family', 1, pos, ability_index, 0, coalesce(representation_family, source_family) FROM usable
  UNION ALL SELECT name, 'definition', 3, pos, ability_index, 0, definition FROM usable WHERE definition <> ''
  UNION ALL SELECT name, 'positive_state', 3, pos, ability_index, 0, positive_state FROM usable WHERE positive_state <> ''
  UNION ALL SELECT name, 'source_benchmark_examples', 12, pos, ability_index, i - 1, benchmarks[i]
            FROM usable, unnest(range(1, len(benchmarks) + 1)) r(i)
  UNION ALL SELECT name, 'generality', 1000000, pos, ability_index, 0, generality FROM usable
  UNION ALL SELECT name, 'contrast_pair_feasibility', 1000000, pos, ability_index, 0, contrast FROM usable
  UNION ALL SELECT name, 'behavioral_scorer_feasibility', 1000000, pos, ability_index, 0, NULL FROM usable),
ranked_values AS (
  SELECT name AS ability_name, field, value, n AS count,
         CAST(row_number() OVER (PARTITION BY name, field ORDER BY n DESC, first) AS INTEGER) AS rank, k
  FROM (SELECT name, field, k, value, count(*) AS n,
               min(pos * 1000 + ability_index * 100 + item) AS first
        FROM field_values GROUP BY ALL)
  QUALIFY rank <= k)
"""


@query("a1_jsonl_scan", """
SELECT event_id, user_id, event_type, value, props FROM events""")
def a1(spark, sf):
    path = scratch_path(spark, "events")
    events = I.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    jsonl.write_jsonl(events, path)
    return jsonl.read_jsonl(spark, path, events.schema)


@query("a2_jsonl_sink", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def a2(spark, sf):
    path = scratch_path(spark, "pages")
    pages = I.table(spark, sf, "pages")
    jsonl.write_jsonl(pages, path)
    return jsonl.read_jsonl(spark, path, pages.schema).select("page_id", "url", F.md5("html").alias("html_md5"))


@query("a3_tolerant_scan", """
SELECT cluster_id, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 4 <> 2 THEN event_type END AS cluster_id FROM events WHERE event_id % 7 <> 3)
WHERE cluster_id IS NOT NULL GROUP BY ALL""")
def a3(spark, sf):
    path = scratch_path(spark, "log")
    k = F.col("event_id")
    row = F.to_json(F.struct(F.when(k % 4 != 2, F.col("event_type")).alias("cluster_id"), "value"))
    line = F.when(k % 7 == 3, F.substring(row, 1, 9)).otherwise(row)
    I.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    rows = jsonl.read_jsonl_tolerant(spark, path, "cluster_id string, value double", "cluster_id")
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("a4_mentions_in_file_order", """
SELECT p_brand AS cluster_id, p_partkey AS pos, p_name AS benchmark_name,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS mention_no FROM part""")
def a4(spark, sf):
    return J.numbered_mentions(I.mentions(spark, sf)).select(
        "cluster_id", "pos", "benchmark_name", "mention_no"
    )


@query("a10_corpus_slice", f"""
SELECT doc_id, n_chars FROM documents
WHERE length(regexp_replace(regexp_replace(text, '^{RE2_WS}+', ''), '{RE2_WS}+$', '')) >= 600
ORDER BY doc_id LIMIT 40""")
def a10(spark, sf):
    docs = I.table(spark, sf, "documents").withColumn("pos", F.col("doc_id"))
    return jsonl.corpus_slice(docs, 40).select("doc_id", "n_chars")


@query("a11_resumed_log", """
SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'earlier' ELSE 'resumed' END AS run
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def a11(spark, sf):
    path = scratch_path(spark, "results")
    docs = I.table(spark, sf, "documents").select("doc_id")
    labelled = I.table(spark, sf, "labels").select("doc_id")
    jsonl.append_pending(labelled, path, "doc_id", lambda rows: rows.withColumn("run", F.lit("earlier")))
    return jsonl.append_pending(docs, path, "doc_id", lambda rows: rows.withColumn("run", F.lit("resumed")))


@query("c3_pending_rows", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c3(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "source")
    return jsonl.pending(docs, I.table(spark, sf, "labels"), "doc_id")


@query("e14_next_shard", "SELECT 1 + max(l_linenumber) AS next_shard FROM lineitem")
def e14(spark, sf):
    return jsonl.next_shard(I.table(spark, sf, "lineitem"), "l_linenumber")


@query("b1_compact_text", f"SELECT doc_id, {sql_compact('text', 450)} AS short FROM documents")
def b1(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.compact(F.col("text"), 450).alias("short"))


CLUSTER_SQL = """
brands AS (SELECT 'Brand#' || (n_nationkey + 5) AS cluster_id, n_nationkey AS pos, 'family_' || n_regionkey AS family FROM nation),
types AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
"""


@query("b2_top_list", with_ctes(CLUSTER_SQL, body="""
SELECT cluster_id, p_type AS name, n AS count FROM brands JOIN types ON cluster_id = p_brand
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, p_type) <= 3"""))
def b2(spark, sf):
    c = I.clusters(spark, sf)
    return c.select("cluster_id", F.inline(top_list(F.col("top_tasks"), 3)))


@query("b3_norm_name", f"""
SELECT doc_id, {sql_norm('text')} AS name FROM documents""")
def b3(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.norm_name(F.col("text")).alias("name"))


@query("b4_parse_json_text", with_ctes(JUDGED, body="""
SELECT pos, CASE WHEN failed OR shape IN (3, 4) THEN NULL ELSE pos % 5 + 1 END AS fit_score FROM judged"""))
def b4(spark, sf):
    reply = T.parse_json_text(F.col("response_text"))
    return I.judge_results(spark, sf).select(
        "pos", F.try_variant_get(reply, "$.fit_score", "bigint").alias("fit_score")
    )


@query("b22_usable_abilities", with_ctes(JUDGED, RAW, USABLE, body="""
SELECT pos, ability_index, ability_name FROM usable"""))
def b22(spark, sf):
    r = refinement.refine(I.judge_results(spark, sf))
    return A.usable(r.raw_abilities).select("pos", "ability_index", "ability_name")


@query("b23_default_fallbacks", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'missing' END AS label
FROM documents""")
def b23(spark, sf):
    k = F.col("doc_id") % 3
    first = F.when(k == 0, F.col("lang")).when(k == 1, "")
    second = F.when(k == 1, F.col("source"))
    return I.table(spark, sf, "documents").select(
        "doc_id", T.or_else(first, second, F.lit("missing")).alias("label")
    )


@query("b24_prompts")
def b24(spark, sf):
    return refinement.prompts(I.clusters(spark, sf), I.mentions(spark, sf)).select(
        "cluster_id", "family", "size", "prompt"
    )


EVIDENCE = (
    "cluster_id string, family string, size long, top_tasks array<struct<name: string, count: long>>, representative_mentions array<struct<"
    "paper_title: string, benchmark_name: string, task_name: string, capability_name: string, definition: string, "
    "agentic_dimensions: array<string>, domain_metadata: array<string>, confidence: string>>")


@query("b24_prompt_evidence", with_ctes(CLUSTER_SQL, f"""
tops AS (
  SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM types),
tasks AS (
  SELECT p_brand, string_agg(p_type || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 12) AS tasks, CAST(sum(n) AS BIGINT) AS size
  FROM tops GROUP BY p_brand),
shown AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS mention_no FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 10)""", body=f"""
SELECT cluster_id, family, coalesce(size, 0) AS size, coalesce(tasks, '') AS tasks, CAST(mention_no AS INTEGER) AS mention_no,
  'Paper ' || p_size AS paper_title, p_name AS capability_name, p_type AS task_name,
  CASE WHEN p_partkey IS NOT NULL THEN {sql_compact("repeat(p_name || '  of' || chr(9) || p_type || chr(10), 40)", 450)} END AS definition,
  CASE WHEN p_partkey IS NOT NULL THEN p_type || '/' END AS dimensions,
  CASE WHEN p_size > 25 THEN 'high' WHEN p_size IS NOT NULL THEN 'low' END AS confidence, true AS framed
FROM brands LEFT JOIN tasks ON tasks.p_brand = cluster_id LEFT JOIN shown ON shown.p_brand = cluster_id"""))
def b24_evidence(spark, sf):
    """The evidence read back from every prompt's text, one row per mention shown."""
    prompts = refinement.prompts(I.clusters(spark, sf), I.mentions(spark, sf))
    before = f"{J.GUIDANCE}\n\nOutput JSON schema:\n\n{J.REPLY_SHAPE}\n\nNow judge this cluster:\n\n"
    read = prompts.select(
        F.from_json(F.expr(f"substring(prompt, {len(before) + 1})"), EVIDENCE).alias("e"), F.startswith("prompt", F.lit(before)).alias("framed"))
    each = read.select("e.*", "framed", F.posexplode_outer("e.representative_mentions").alias("i", "m"))
    tasks = F.array_join(F.transform("top_tasks", lambda t: F.concat(t["name"], F.lit(":"), t["count"].cast("string"))), "|")
    return each.select(
        "cluster_id", "family", "size", tasks.alias("tasks"), (F.col("i") + 1).alias("mention_no"), "m.paper_title", "m.capability_name",
        "m.task_name", "m.definition",
        F.concat(F.array_join("m.agentic_dimensions", ","), F.lit("/"), F.array_join("m.domain_metadata", ",")).alias("dimensions"),
        "m.confidence", "framed")


@query("c2_clusters_with_mentions", with_ctes(CLUSTER_SQL, body="""
SELECT cluster_id, family, least(count(p_brand), 10) AS shown FROM brands LEFT JOIN part ON cluster_id = p_brand
GROUP BY ALL"""))
def c2(spark, sf):
    payloads = J.cluster_payloads(I.clusters(spark, sf), I.mentions(spark, sf))
    shown = F.size("cluster_payload.representative_mentions").cast("bigint")
    return payloads.select("cluster_id", "family", shown.alias("shown"))


@query("e1_representative_mentions", f"""
SELECT p_brand AS cluster_id,
       CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS mention_no,
       p_name AS capability_name,
       {sql_compact("repeat(p_name || '  of' || chr(9) || p_type || chr(10), 40)", 450)} AS definition
FROM part QUALIFY mention_no <= 10""")
def e1(spark, sf):
    return J.representative_mentions(I.mentions(spark, sf)).select(
        "cluster_id", "mention_no", "capability_name", "definition"
    )


@query("e2_most_common", """
SELECT p_brand, p_name, n AS count, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS INTEGER) AS rank
FROM (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL)
QUALIFY rank <= 3""")
def e2(spark, sf):
    return A.most_common(I.table(spark, sf, "part"), ["p_brand"], "p_name", F.col("p_partkey"), 3)


@query("j1_judgments", with_ctes(JUDGED, body="""
SELECT pos, cluster_id, family, fit AS representation_fit, CAST(pos % 5 + 1 AS INTEGER) AS fit_score,
       n_chars AS _source_size
FROM judged WHERE outcome = 'parsed'"""))
def j1(spark, sf):
    return refinement.refine(I.judge_results(spark, sf)).judgments.select(
        "pos", "cluster_id", "family", "representation_fit", "fit_score", "_source_size"
    )


@query("j1_rejects", with_ctes(JUDGED, body="""
SELECT pos, 'r' || pos AS cluster_id, outcome,
       CASE WHEN failed THEN 'timed out' ELSE 'not a JSON object' END AS error
FROM judged WHERE outcome <> 'parsed'"""))
def j1_rejects(spark, sf):
    return refinement.refine(I.judge_results(spark, sf)).rejects.drop("text")


@query("j2_exploded_abilities", with_ctes(JUDGED, RAW, body="""
SELECT pos, ability_index, source_cluster_id, source_family, cluster_fit, cluster_fit_score, ability_name,
       display_name, representation_family, md5(definition) AS definition_md5, generality,
       contrast AS contrast_pair_feasibility, array_to_string(benchmarks, ',') AS benchmarks FROM raw"""))
def j2(spark, sf):
    raw = refinement.refine(I.judge_results(spark, sf)).raw_abilities
    return raw.select(
        "pos", "ability_index", "source_cluster_id", "source_family", "cluster_fit",
        "cluster_fit_score", "ability_name", "display_name", "representation_family",
        F.md5("definition").alias("definition_md5"), "generality", "contrast_pair_feasibility",
        F.array_join("source_benchmark_examples", ",").alias("benchmarks"),
    )


@query("d5_summary_counts", with_ctes(JUDGED, RAW, body="""
SELECT 'results' AS metric, count(*) AS n FROM judged
UNION ALL SELECT 'request_errors', count(*) FROM judged WHERE outcome = 'request_error'
UNION ALL SELECT 'parse_errors', count(*) FROM judged WHERE outcome = 'parse_error'
UNION ALL SELECT 'parsed', count(*) FROM judged WHERE outcome = 'parsed'
UNION ALL SELECT 'fit:' || coalesce(fit, 'missing'), count(*) FROM judged WHERE outcome = 'parsed' GROUP BY 1
UNION ALL SELECT 'raw_abilities', count(*) FROM raw"""))
def d5(spark, sf):
    return refinement.refine(I.judge_results(spark, sf)).summary


@query("d3_ability_values", with_ctes(JUDGED, RAW, USABLE, FIELD_VALUES, body="""
SELECT ability_name, field, value, count, rank FROM ranked_values"""))
def d3(spark, sf):
    raw = refinement.refine(I.judge_results(spark, sf)).raw_abilities
    return A.ability_values(A.usable(raw))


@query("d3_ability_sources", with_ctes(JUDGED, RAW, USABLE, body="""
SELECT name AS ability_name, source_cluster_id, count(*) AS mention_count FROM usable GROUP BY ALL"""))
def d3_sources(spark, sf):
    raw = refinement.refine(I.judge_results(spark, sf)).raw_abilities
    return A.ability_sources(A.usable(raw))


@query("d4_source_cluster_counts", with_ctes(JUDGED, RAW, USABLE, body="""
SELECT name AS ability_name,
       count(DISTINCT source_cluster_id) + CAST(bool_or(source_cluster_id IS NULL) AS INTEGER) AS source_cluster_count,
       count(*) AS mention_count
FROM (SELECT name, CASE WHEN pos % 6 <> 1 THEN source_cluster_id END AS source_cluster_id FROM usable)
GROUP BY ALL"""))
def d4(spark, sf):
    raw = A.usable(refinement.refine(I.judge_results(spark, sf)).raw_abilities)
    some = F.when(F.col("pos") % 6 != 1, F.col("source_cluster_id"))
    return A.source_counts(raw.withColumn("source_cluster_id", some))


FINAL = with_ctes(JUDGED, RAW, USABLE, FIELD_VALUES, body="""
SELECT u.name AS ability_name,
       (SELECT value FROM ranked_values v WHERE v.ability_name = u.name AND field = 'display_name' AND rank = 1) AS display_name,
       (SELECT value FROM ranked_values v WHERE v.ability_name = u.name AND field = 'representation_family' AND rank = 1) AS representation_family,
       count(DISTINCT u.source_cluster_id) AS source_cluster_count, count(*) AS mention_count,
       (SELECT string_agg(value || '=' || count, ';' ORDER BY rank) FROM ranked_values v
        WHERE v.ability_name = u.name AND field = 'source_benchmark_examples') AS top_benchmarks,
       (SELECT string_agg(coalesce(value, 'None') || '=' || count, ';' ORDER BY rank) FROM ranked_values v
        WHERE v.ability_name = u.name AND field = 'generality') AS generalities,
       (SELECT string_agg(md5(value), ';' ORDER BY rank) FROM ranked_values v
        WHERE v.ability_name = u.name AND field = 'definition') AS definitions
FROM usable u GROUP BY u.name""")


def flat_final(final):
    def pairs(c):
        return F.array_join(
            F.transform(c, lambda e: F.concat(F.coalesce(e["value"], F.lit("None")), F.lit("="), e["count"].cast("string"))), ";"
        )

    return final.select(
        "ability_name", "display_name", "representation_family", "source_cluster_count", "mention_count",
        pairs("top_benchmark_examples").alias("top_benchmarks"),
        pairs("generalities").alias("generalities"),
        F.array_join(F.transform("definition_candidates", lambda e: F.md5(e["value"])), ";").alias("definitions"),
    )


@query("j3_final_abilities", FINAL)
def j3(spark, sf):
    return flat_final(refinement.refine(I.judge_results(spark, sf)).final_abilities)


@query("j4_refinement_flow", with_ctes(JUDGED, RAW, USABLE, body="""
SELECT (SELECT count(*) FROM judged WHERE outcome = 'parsed') AS judgments,
       (SELECT count(*) FROM judged WHERE outcome <> 'parsed') AS rejects,
       (SELECT count(*) FROM raw) AS raw_abilities,
       (SELECT count(DISTINCT name) FROM usable) AS final_abilities"""))
def j4(spark, sf):
    r = refinement.refine(I.judge_results(spark, sf), store=True)
    outputs = ["judgments", "rejects", "raw_abilities", "final_abilities"]
    sizes = None
    for o in outputs:
        one = getattr(r, o).select(F.lit(o).alias("output"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes.groupBy().pivot("output", outputs).agg(F.count(F.lit(1)))


@query("g1_final_order", with_ctes(JUDGED, RAW, USABLE, FIELD_VALUES, body="""
SELECT ability_name, representation_family, source_cluster_count,
       row_number() OVER (ORDER BY representation_family, source_cluster_count DESC, display_name, ability_name) AS position
FROM (SELECT u.name AS ability_name, count(DISTINCT source_cluster_id) AS source_cluster_count,
             (SELECT value FROM ranked_values v WHERE v.ability_name = u.name AND field = 'display_name' AND rank = 1) AS display_name,
             (SELECT value FROM ranked_values v WHERE v.ability_name = u.name AND field = 'representation_family' AND rank = 1) AS representation_family
      FROM usable u GROUP BY u.name)"""))
def g1(spark, sf):
    final = refinement.refine(I.judge_results(spark, sf)).final_abilities
    return A.numbered_final(final).select("ability_name", "representation_family", "source_cluster_count", "position")


@query("g4_pilot_limit", "SELECT n_nationkey AS pos, 'Brand#' || (n_nationkey + 5) AS cluster_id FROM nation ORDER BY n_nationkey LIMIT 5")
def g4(spark, sf):
    prompts = refinement.prompts(I.clusters(spark, sf), I.mentions(spark, sf), limit=5)
    keys = I.clusters(spark, sf).select("pos", "cluster_id")
    return prompts.select("cluster_id").join(keys, "cluster_id").select("pos", "cluster_id")
