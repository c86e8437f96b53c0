"""Queries which build probe texts, and those on the dataset catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsonde.functions import numbering as N
from capsonde.functions import text as T
from capsonde.functions.flatten import flatten_row
from capsonde.functions.scalars import depth_layers
from capsonde.operators import catalog as G
from capsonde.operators import corpus as P
from workload import inputs as I
from workload.judge_queries import RE2_WS
from workload.registry import query, with_ctes


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{RE2_WS}+', ''), '{RE2_WS}+$', '')"


NUMBERED = """
numbered AS (SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n FROM documents)
"""
# What the rules make of each shape of row, from the documents themselves.
ASSEMBLED = f"""
assembled AS (
  SELECT source AS dataset_id, doc_id AS row_idx, {sql_strip('''substr(CASE n % 4
    WHEN 1 THEN 'About ' || lang || ' in ' || source || CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END
    WHEN 2 THEN CASE WHEN s <> '' THEN s || chr(10) || chr(10) ELSE '' END || 'Options:' || chr(10) || lang || chr(10) || source
    ELSE s END, 1, 4000)''')} AS text
  FROM (SELECT *, {sql_strip('text')} AS s FROM numbered)),
premised AS (
  SELECT 'nli/' || source AS dataset_id, doc_id AS row_idx,
         'One premise for every row of ' || source || ' to be judged' AS text, {sql_strip('text')} AS s
  FROM documents),
thin AS (
  SELECT 'thin/' || lang AS dataset_id, doc_id AS row_idx,
         'Which language is this: ' || lang || '? Answer in full.' AS text
  FROM documents)
"""
TAGS = """
tags AS (
  SELECT dataset_id, list_sort(list(cluster_id)) AS clusters FROM (
    SELECT DISTINCT d.dataset_id, unnest(c) AS cluster_id
    FROM (SELECT unnest([source, 'nli/' || source]) AS dataset_id,
                 ['cap' || (n % 9), 'cap' || (9 + (n * 7) % 11)] AS c FROM numbered
          UNION ALL SELECT 'thin/' || lang, ['cap0'] FROM documents) d
    WHERE d.dataset_id NOT IN ('src19', 'src18'))
  GROUP BY dataset_id)
"""
# The whole corpus rule: dedupe, secondary field, sample, keep rule, numbering.
CORPUS = f"""
candidates AS (
  SELECT dataset_id, row_idx, text FROM assembled
  UNION ALL
  SELECT dataset_id, row_idx, {sql_strip("CASE WHEN s <> '' THEN text || chr(10) || chr(10) || substr(s, 1, 1500) ELSE text END")} FROM premised
  UNION ALL SELECT dataset_id, row_idx, text FROM thin),
firsts AS (
  SELECT dataset_id, min(row_idx) AS row_idx, text FROM candidates
  WHERE length(text) >= 30 AND dataset_id IN (SELECT dataset_id FROM tags)
  GROUP BY dataset_id, text),
sampled AS (
  SELECT * FROM firsts
  QUALIFY row_number() OVER (PARTITION BY dataset_id
                             ORDER BY md5('0:' || dataset_id || ':' || row_idx), row_idx) <= 150),
measured AS (
  SELECT dataset_id, count(*) AS n_texts,
         list_sort(list(length(text)))[count(*) // 2 + 1] AS median_chars
  FROM sampled GROUP BY dataset_id),
kept AS (
  SELECT dataset_id || '::' || (row_number() OVER (PARTITION BY dataset_id ORDER BY row_idx) - 1) AS uid,
         dataset_id, row_idx, text
  FROM sampled SEMI JOIN (SELECT dataset_id FROM measured WHERE n_texts >= 20 AND median_chars >= 40) m
  USING (dataset_id))
"""
WHOLE = (NUMBERED, ASSEMBLED, TAGS, CORPUS)


def corpus(spark, sf):
    rows = I.dataset_rows(spark, sf)
    return P.build_probe_texts(rows, P.dataset_clusters(I.experiment_clusters(spark, sf)))


@query("a6_dataset_clusters", with_ctes(NUMBERED, TAGS, body="""
SELECT dataset_id, array_to_string(clusters, ',') AS clusters FROM tags"""))
def a6(spark, sf):
    tags = P.dataset_clusters(I.experiment_clusters(spark, sf))
    return tags.withColumn("clusters", F.array_join("clusters", ","))


@query("a7_dataset_rows_load", with_ctes(NUMBERED, TAGS, ASSEMBLED, body="""
SELECT dataset_id, count(*) AS n_rows, min(row_idx) AS first_row FROM (
  SELECT dataset_id, row_idx FROM assembled UNION ALL SELECT dataset_id, row_idx FROM premised
  UNION ALL SELECT dataset_id, row_idx FROM thin) SEMI JOIN tags USING (dataset_id) GROUP BY ALL"""))
def a7(spark, sf):
    tags = P.dataset_clusters(I.experiment_clusters(spark, sf))
    return P.tagged_rows(I.dataset_rows(spark, sf), tags).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row")
    )


@query("a9_row_cap", """
SELECT source AS dataset_id, doc_id AS row_idx FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30""")
def a9(spark, sf):
    rows = I.table(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_idx")
    )
    return P.cap_rows(rows, 30)


@query("b5_flatten_chat", """
SELECT conv_id AS row_idx,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE turn_no <= 8) AS messages,
       'a: b: x' || chr(10) || 'e: y' AS meta
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)
GROUP BY conv_id""")
def b5(spark, sf):
    from capsonde.functions.flatten import field_text

    fields = I.chat_rows(spark, sf).select("row_idx", flatten_row("row_json").alias("f"))
    return fields.select(
        "row_idx", field_text(F.col("f"), F.lit("messages")).alias("messages"),
        field_text(F.col("f"), F.lit("meta")).alias("meta"),
    )


@query("b6_field_roles", with_ctes(NUMBERED, body="""
SELECT DISTINCT source AS dataset_id, ['Question', 'Text', 'prompt', 'body'][n % 4 + 1] AS prim,
       CASE WHEN n % 4 = 1 THEN 'context' END AS ctx, CASE WHEN n % 4 = 2 THEN 'options' END AS opt FROM numbered
UNION ALL SELECT DISTINCT 'nli/' || source, 'premise', NULL, NULL FROM documents
UNION ALL SELECT DISTINCT 'thin/' || lang, 'question', NULL, NULL FROM documents"""))
def b6(spark, sf):
    first = P.with_fields(P.first_rows(I.dataset_rows(spark, sf)))
    return P.field_roles(first).drop("first_keys")


@query("b7_longest_field", """
SELECT doc_id AS row_idx, CASE WHEN length(text) > length(lang) AND length(text) > length(source) THEN 'body'
       WHEN length(source) > length(lang) THEN 'tag' ELSE 'note' END AS longest
FROM documents""")
def b7(spark, sf):
    d = I.table(spark, sf, "documents")
    row = F.to_json(F.struct("doc_id", F.col("lang").alias("note"), F.col("text").alias("body"), F.col("source").alias("tag")))
    rows = d.select(F.col("doc_id").alias("row_idx"), F.lit("x").alias("dataset_id"), row.alias("row_json"))
    return P.with_fields(rows).select("row_idx", P._longest(F.col("fields")).alias("longest"))


@query("b8_assembled_texts", with_ctes(NUMBERED, ASSEMBLED, body="""
SELECT dataset_id, row_idx, text FROM assembled UNION ALL SELECT dataset_id, row_idx, text FROM premised
UNION ALL SELECT dataset_id, row_idx, text FROM thin"""))
def b8(spark, sf):
    rows = I.dataset_rows(spark, sf)
    roles = P.field_roles(P.with_fields(P.first_rows(rows))).withColumn("sec", F.lit(None).cast("string"))
    return P.assemble_rows(rows, roles)


@query("b9_long_enough", with_ctes(NUMBERED, ASSEMBLED, body="""
SELECT dataset_id, count(*) AS n
FROM (SELECT dataset_id, text FROM assembled UNION ALL SELECT dataset_id, text FROM premised UNION ALL SELECT dataset_id, text FROM thin)
WHERE length(text) >= 30 GROUP BY ALL"""))
def b9(spark, sf):
    return (
        b8(spark, sf).filter(F.char_length("text") >= P.MIN_CHARS)
        .groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    )


@query("b10_secondary_appended", with_ctes(NUMBERED, ASSEMBLED, body=f"""
SELECT dataset_id, row_idx, {sql_strip("CASE WHEN s <> '' THEN text || chr(10) || chr(10) || substr(s, 1, 1500) ELSE text END")} AS text
FROM premised"""))
def b10(spark, sf):
    rows = I.dataset_rows(spark, sf)
    roles = P.field_roles(P.with_fields(P.first_rows(rows)))
    second = P.secondary_fields(rows, roles)
    return P.assemble_rows(rows, roles.join(second, "dataset_id"))


@query("d8_secondary_field", """
SELECT DISTINCT 'nli/' || source AS dataset_id, 'hypothesis' AS sec FROM documents
UNION ALL SELECT dataset_id, sec FROM (
  SELECT 'two/' || lang AS dataset_id,
         CASE WHEN ln >= 15 AND nn >= nt OR lt < 15 THEN CASE WHEN ln >= 15 THEN 'name' END ELSE 'body' END AS sec
  FROM (SELECT lang, count(DISTINCT source || '/of the collection') AS nn, count(DISTINCT substr(text, 1, 500)) AS nt,
               list_sort(list(DISTINCT length(source || '/of the collection')))[1] AS ln,
               (SELECT list_sort(list(length(v)))[count(*) // 2 + 1]
                FROM (SELECT DISTINCT substr(text, 1, 500) AS v FROM documents i WHERE i.lang = o.lang)) AS lt
        FROM documents o GROUP BY lang)) WHERE sec IS NOT NULL""")
def d8(spark, sf):
    d = I.table(spark, sf, "documents")
    two = d.select(
        F.concat(F.lit("two/"), "lang").alias("dataset_id"), F.col("doc_id").alias("row_idx"),
        F.to_json(F.struct(
            F.lit("the same question again and again").alias("question"),
            F.concat("source", F.lit("/of the collection")).alias("name"), F.col("text").alias("body"),
        )).alias("row_json"),
    )
    rows = I.dataset_rows(spark, sf).unionByName(two)
    return P.secondary_fields(rows, P.field_roles(P.with_fields(P.first_rows(rows))))


@query("d7_mapping_log", with_ctes(*WHOLE, body="""
SELECT dataset_id,
       CASE WHEN dataset_id LIKE 'nli/%' THEN 'premise+hypothesis' WHEN dataset_id LIKE 'thin/%' THEN 'question'
            ELSE ['Question', 'context+Text', 'prompt+options', 'body'][CAST(dataset_id[4:] AS INTEGER) % 4 + 1] END AS fields,
       n_texts, CAST(median_chars AS INTEGER) AS median_chars,
       CASE WHEN n_texts >= 20 AND median_chars >= 40 THEN 'ok' ELSE 'dropped' END AS status
FROM measured"""))
def d7(spark, sf):
    return corpus(spark, sf).log


@query("e3_first_of_copies", """
SELECT source AS dataset_id, text_md5, CAST(length(any_value(text)) AS INTEGER) AS n_chars, min(doc_id) AS row_idx
FROM (SELECT *, md5(text) AS text_md5 FROM documents) WHERE length(text) >= 30 GROUP BY source, text_md5""")
def e3(spark, sf):
    return P.distinct_texts(I.table(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_idx"), "text"
    ))


@query("e4_sampled_rows", """
SELECT lang AS dataset_id, doc_id AS row_idx FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || lang || ':' || doc_id), doc_id) <= 150""")
def e4(spark, sf):
    keys = I.table(spark, sf, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("row_idx")
    )
    return P.sample_texts(keys)


@query("e5_probe_texts", with_ctes(*WHOLE, body="""
SELECT uid, dataset_id, array_to_string(clusters, ',') AS clusters, text FROM kept JOIN tags USING (dataset_id)"""))
def e5(spark, sf):
    return corpus(spark, sf).texts.withColumn("clusters", F.array_join("clusters", ","))


@query("d6_corpus_coverage", with_ctes(*WHOLE, body="""
SELECT unnest(clusters) AS cluster_id, count(*) AS n_texts, count(*) < 60 AS weak
FROM kept JOIN tags USING (dataset_id) GROUP BY 1"""))
def d6(spark, sf):
    return P.coverage(corpus(spark, sf).texts)


@query("b11_head_and_tail", f"""
SELECT doc_id, CASE WHEN len(w) > 984
  THEN array_to_string(w[1:492], ' ') || chr(10) || '...' || chr(10) || array_to_string(w[-492:], ' ') ELSE text END AS text
FROM (SELECT doc_id, text, regexp_split_to_array({sql_strip('text')}, '{RE2_WS}+') AS w FROM documents)""")
def b11(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.head_tail(F.col("text")).alias("text"))


@query("b12_shards", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS shard FROM labels""")
def b12(spark, sf):
    labels = I.table(spark, sf, "labels").select("doc_id")
    return N.shard_of(labels, "doc_id", 4)


@query("b13_depth_layers", """
SELECT n, array_to_string(list_sort(list_distinct([greatest(1, CAST(round_even(n * f, 0) AS INTEGER)) for f in [0.25, 0.5, 0.75, 1.0]])), ',') AS layers
FROM (SELECT DISTINCT p_size AS n FROM part)""")
def b13(spark, sf):
    sizes = I.table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct()
    return sizes.select("n", F.array_join(depth_layers(F.col("n")), ",").alias("layers"))


@query("b14_lens_layers", """
SELECT n, layer, layer - 1 AS lens_layer FROM (
  SELECT n, layer, max(layer) OVER (PARTITION BY n) AS deepest FROM (
    SELECT n, unnest(list_distinct([greatest(1, CAST(round_even(n * f, 0) AS INTEGER)) for f in [0.25, 0.5, 0.75, 1.0]])) AS layer
    FROM (SELECT DISTINCT p_size AS n FROM part)))
WHERE layer < deepest""")
def b14(spark, sf):
    from capsonde.operators.lens import lens_layers

    sizes = I.table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct()
    return lens_layers(sizes.withColumn("layers", depth_layers(F.col("n"))), "n")


@query("b15_label_words", r"""
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[^\p{L}\p{N}]+'),
  lambda w: w <> '' AND w NOT IN ('and', 'to', 'of', 'the', 'in', 'for', 'with', 'from', 'on')), ' ') AS words FROM pages""")
def b15(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", F.array_join(T.label_words(F.col("url")), " ").alias("words")
    )


@query("b17_query_variants", """
SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS variants FROM (
  SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [b, replace(b, ' ', '-'), split_part(b, ' (', 1)] ELSE [b, replace(b, ' ', '-')] END AS list_distinct_ordered
  FROM (SELECT *, p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END AS b FROM part))""")
def b17(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""))
    return I.table(spark, sf, "part").select(
        "p_partkey", F.array_join(T.query_variants(name), "|").alias("variants")
    )


@query("b20_file_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '__', 'g') AS file FROM pages")
def b20(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("file"))


@query("b25_stream_mean", """
SELECT vec_id, CAST(i AS INTEGER) AS dim, round((CAST(embedding[i + 1] AS DOUBLE) + embedding[i + 17] + embedding[i + 33] + embedding[i + 49]) / 4, 6) + 0 AS x
FROM embeddings, unnest(range(0, 16)) r(i)""")
def b25(spark, sf):
    from capsonde.functions.vectors import stream_mean

    streams = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    return I.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(stream_mean(streams)).alias("dim", "x")
    ).withColumn("x", F.round("x", 6) + F.lit(0.0))


# Catalogue inputs: segments as clusters, nations as benchmarks, orders as split listings.
SELECTION = """
selection AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name) AS rank
  FROM (SELECT c_mktsegment AS cluster_id, n_name AS name, count(*) AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)),
top AS (SELECT * FROM selection WHERE cluster_id <> 'MACHINERY' AND rank <= 6)
"""


def selection(spark, sf):
    c = I.table(spark, sf, "customer").join(
        I.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    counts = c.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("n_name").alias("name"))))
    return counts.groupBy(F.col("c_mktsegment").alias("cluster_id")).agg(listed.alias("l")).select(
        F.ascii("cluster_id").cast("bigint").alias("pos"),
        "cluster_id",
        F.lower("cluster_id").alias("cluster_name"),
        (F.col("cluster_id") == "MACHINERY").alias("excluded"),
        F.transform("l", lambda e: F.struct(e["name"].alias("name"), (-e["m"]).alias("n"))).alias("top_scorer_benchmarks"),
    )


def final_mentions(spark, sf):
    c = I.table(spark, sf, "customer").join(
        I.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return c.select(
        F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("final_cluster_id"),
        F.col("n_name").alias("benchmark_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Title "), (F.col("c_custkey") % 7).cast("string"))).alias("paper_title"),
    )


TITLES = """
titles AS (
  SELECT benchmark, array_to_string(list_sort(list(title)), '|') AS paper_titles FROM (
    SELECT * FROM (
      SELECT n_name AS benchmark, CASE WHEN c_custkey % 5 <> 0 THEN 'Title ' || (c_custkey % 7) ELSE '' END AS title, min(c_custkey) AS pos
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY pos) <= 3) GROUP BY benchmark)
"""


@query("d1_benchmark_targets", with_ctes(SELECTION, TITLES, body="""
SELECT name AS benchmark, CAST(sum(n) AS BIGINT) AS mentions,
       string_agg(lower(cluster_id) || ' (' || cluster_id || ')', '|' ORDER BY ascii(cluster_id), cluster_id) AS clusters,
       any_value(paper_titles) AS paper_titles
FROM top LEFT JOIN titles ON benchmark = name GROUP BY name"""))
def d1(spark, sf):
    t = G.benchmark_targets(selection(spark, sf), final_mentions(spark, sf))
    return t.select(
        "benchmark", "mentions", F.array_join("clusters", "|").alias("clusters"),
        F.array_join("paper_titles", "|").alias("paper_titles"),
    )


@query("d2_benchmark_titles", with_ctes(TITLES, body="SELECT benchmark, paper_titles FROM titles"))
def d2(spark, sf):
    kept = selection(spark, sf).filter(~F.col("excluded"))
    t = G.benchmark_titles(kept, final_mentions(spark, sf))
    return t.withColumn("paper_titles", F.array_join("paper_titles", "|"))


@query("c4_mentions_of_kept", """
SELECT c_mktsegment AS final_cluster_id, count(*) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL""")
def c4(spark, sf):
    kept = selection(spark, sf).filter(~F.col("excluded")).select(F.col("cluster_id").alias("final_cluster_id"))
    return final_mentions(spark, sf).join(kept, "final_cluster_id", "left_semi").groupBy("final_cluster_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("g2_targets_by_mentions", with_ctes(SELECTION, body="""
SELECT benchmark, mentions, row_number() OVER (ORDER BY mentions DESC, first) AS position
FROM (SELECT name AS benchmark, CAST(sum(n) AS BIGINT) AS mentions, min(ascii(cluster_id) * 100 + rank) AS first FROM top GROUP BY name)"""))
def g2(spark, sf):
    targets = G.benchmark_targets(selection(spark, sf), final_mentions(spark, sf))
    return G.numbered_targets(targets).select("benchmark", "mentions", "position")


CANDIDATES_SQL = """
cands AS (
  SELECT n_name AS benchmark, CAST(c_custkey % 3 AS INTEGER) AS query_no, c_custkey AS pos,
         'org' || (c_custkey * 7 % 23) || '/' || n_name AS id, c_custkey * 10 AS downloads, c_custkey % 50 AS likes
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
merged AS (
  SELECT benchmark, id, arg_min(downloads, query_no * 100000000 + pos) AS downloads,
         arg_min(likes, query_no * 100000000 + pos) AS likes,
         CAST(row_number() OVER (PARTITION BY benchmark ORDER BY min(query_no * 100000000 + pos)) AS INTEGER) AS candidate_no
  FROM cands GROUP BY benchmark, id)
"""


def candidates(spark, sf):
    c = I.table(spark, sf, "customer").join(
        I.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("c_custkey")
    return c.select(
        F.col("n_name").alias("benchmark"), (k % 3).cast("int").alias("query_no"), k.alias("pos"),
        F.concat(F.lit("org"), (k * 7 % 23).cast("string"), F.lit("/"), "n_name").alias("id"),
        (k * 10).alias("downloads"), (k % 50).alias("likes"), F.col("c_name").alias("desc"),
    )


@query("g7_merged_candidates", with_ctes(CANDIDATES_SQL, body="""
SELECT benchmark, id, downloads, likes, candidate_no, candidate_no <= 10 AS shown FROM merged"""))
def g7(spark, sf):
    return G.merged_candidates(candidates(spark, sf)).drop("desc")


@query("b18_accepted_matches", with_ctes(CANDIDATES_SQL, body="""
SELECT s_name AS benchmark, CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 30 < 23 AND EXISTS
         (SELECT 1 FROM cands c WHERE c.benchmark = n_name AND c.id = 'org' || (s_suppkey % 30) || '/' || n_name)
       THEN 'org' || (s_suppkey % 30) || '/' || n_name END AS match
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""))
def b18(spark, sf):
    s = I.table(spark, sf, "supplier").join(
        I.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    k = F.col("s_suppkey")
    proposed = F.when(k % 4 == 1, F.concat(F.lit("org"), (k % 30).cast("string"), F.lit("/"), "n_name")).when(k % 4 == 2, "None")
    proposals = s.select(
        F.col("s_name").alias("benchmark"), "n_name", proposed.alias("proposed"), F.lit("high").alias("confidence")
    )
    known = candidates(spark, sf).select("benchmark", "id").distinct().join(
        s.select(F.col("s_name").alias("supplier"), F.col("n_name").alias("benchmark")), "benchmark"
    )
    by_supplier = known.select(F.col("supplier").alias("benchmark"), "id")
    return G.accepted_matches(proposals.drop("n_name"), by_supplier).select("benchmark", "match")


SPLITS_SQL = """
splits AS (
  SELECT 'org/c ' || o_custkey AS dataset_id, o_custkey, o_orderkey AS pos,
         CASE o_orderstatus WHEN 'F' THEN 'Main' WHEN 'O' THEN 'extra' ELSE 'all' END AS config,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Train' WHEN '2-HIGH' THEN 'TEST' WHEN '3-MEDIUM' THEN 'validation'
              WHEN '5-LOW' THEN 'dev' ELSE 'weird' END AS split
  FROM orders),
chosen_config AS (
  SELECT dataset_id, config FROM splits
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY config = 'extra', pos) = 1),
chosen AS (
  SELECT dataset_id, config, split FROM splits JOIN chosen_config USING (dataset_id, config)
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY
    coalesce(list_position(['test', 'testing', 'validation', 'valid', 'val', 'dev', 'eval', 'train'], lower(split)), 99), pos) = 1)
"""


def splits(spark, sf):
    o = I.table(spark, sf, "orders")
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.concat(F.lit("org/c "), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(status == "F", "Main").when(status == "O", "extra").otherwise("all").alias("config"),
        F.when(prio == "1-URGENT", "Train").when(prio == "2-HIGH", "TEST").when(prio == "3-MEDIUM", "validation")
        .when(prio == "5-LOW", "dev").otherwise("weird").alias("split"),
    )


@query("b19_picked_splits", with_ctes(SPLITS_SQL, body="SELECT dataset_id, config, split FROM chosen"))
def b19(spark, sf):
    return G.pick_split(splits(spark, sf))


@query("a8_manifest", with_ctes(SPLITS_SQL, body="""
SELECT 'org/c ' || (c_custkey % 700) AS dataset_id, count(*) AS n_benchmarks,
       array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS clusters,
       CASE WHEN any_value(ch.split) IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
       any_value(ch.config) AS config, any_value(ch.split) AS split,
       CASE WHEN any_value(ch.split) IS NOT NULL THEN coalesce(any_value(r.n_rows), 0) END AS n_rows,
       CASE WHEN any_value(ch.split) IS NOT NULL THEN 'org__c__' || any_value(c_custkey % 700) || '.jsonl' END AS file,
       CASE WHEN any_value(ch.split) IS NOT NULL THEN CASE WHEN any_value(r.n_rows) IS NULL THEN '' ELSE 'acctbal,name' END END AS columns
FROM customer LEFT JOIN chosen ch ON ch.dataset_id = 'org/c ' || (c_custkey % 700)
LEFT JOIN (SELECT s_suppkey, count(*) AS n_rows FROM supplier GROUP BY ALL) r ON r.s_suppkey = c_custkey % 700
GROUP BY 1"""))
def a8(spark, sf):
    c = I.table(spark, sf, "customer")
    matches = c.select(
        F.concat(F.lit("org/c "), (F.col("c_custkey") % 700).cast("string")).alias("match"),
        F.col("c_custkey").alias("pos"), F.col("c_name").alias("benchmark"), F.array("c_mktsegment").alias("clusters"),
    )
    rows = I.table(spark, sf, "supplier").select(
        F.concat(F.lit("org/c "), F.col("s_suppkey").cast("string")).alias("dataset_id"),
        F.lit(0).alias("row_idx"),
        F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))).alias("row_json"),
    )
    out = G.manifest(matches, G.pick_split(splits(spark, sf)), rows).drop("error")
    return out.withColumn("clusters", F.array_join("clusters", ",")).withColumn("columns", F.array_join("columns", ","))


@query("g6_distinct_members", """
SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY ALL""")
def g6(spark, sf):
    pairs = I.table(spark, sf, "documents").select("source", "lang").distinct()
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("langs"))


@query("g5_shards_concatenated", """
SELECT kind, count(*) AS n, sum(id) AS ids FROM (
  SELECT 'labelled' AS kind, doc_id AS id FROM labels UNION ALL SELECT 'plain', doc_id FROM documents
  UNION ALL SELECT 'benchmark', item_id FROM benchmark) GROUP BY kind""".replace("sum(id) AS ids", "CAST(sum(id) AS BIGINT) AS ids"))
def g5(spark, sf):
    def part(kind, name, key):
        return I.table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))

    whole = part("labelled", "labels", "doc_id").unionByName(part("plain", "documents", "doc_id")).unionByName(
        part("benchmark", "benchmark", "item_id")
    )
    return whole.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
