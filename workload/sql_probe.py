"""Common table expressions of the probe oracles: plain pairwise and row-wise definitions."""

TEXTS = """
texts AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS uid, 'b' || e.label || '_' || (e.vec_id % 3) AS dataset_id,
         ['cap' || e.label, 'par' || (e.label % 2)] AS clusters,
         coalesce(d.text, '') AS text, coalesce(length(d.text), 0) AS n_chars
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)
"""

MEMBERS = "members AS (SELECT unnest(clusters) AS cluster_id, dataset_id, uid FROM texts)"

HIDDEN = """
hidden AS (
  SELECT 1 AS layer, CAST(vec_id AS VARCHAR) AS uid, embedding[1:32] AS h FROM embeddings
  UNION ALL SELECT 2, CAST(vec_id AS VARCHAR), embedding[33:64] FROM embeddings
  UNION ALL SELECT 3, CAST(vec_id AS VARCHAR), embedding FROM embeddings)
"""

LONG = """
long AS (SELECT layer, uid, unnest(range(1, len(h) + 1)) AS i, CAST(unnest(h) AS DOUBLE) AS x
         FROM hidden)
"""

STATS = """
stats AS (SELECT layer, i, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd FROM long GROUP BY ALL)
"""

Z = "z AS (SELECT layer, uid, i, (x - mu) / sd AS z FROM long JOIN stats USING (layer, i))"

CANDIDATES = """
cand AS (
  SELECT c.cluster_id, t.dataset_id, t.uid
  FROM (SELECT DISTINCT cluster_id FROM members) c
  JOIN texts t ON NOT list_contains(t.clusters, c.cluster_id)
  QUALIFY row_number() OVER (
    PARTITION BY c.cluster_id, t.dataset_id ORDER BY md5('0:' || t.uid), t.uid) <= 5)
"""

SPLIT = """
n_pos AS (SELECT cluster_id, count(*) AS n_pos FROM members GROUP BY ALL),
drawn AS (
  SELECT cluster_id, dataset_id, uid,
         row_number() OVER (PARTITION BY cluster_id
                            ORDER BY md5('0:' || cluster_id || ':' || uid), uid) AS neg_rank,
         least(count(*) OVER (PARTITION BY cluster_id), 6 * n_pos) AS n
  FROM cand JOIN n_pos USING (cluster_id)),
split AS (
  SELECT cluster_id, dataset_id, uid, neg_rank,
         CASE WHEN neg_rank <= n // 2 THEN 'train' ELSE 'test' END AS part
  FROM drawn WHERE neg_rank <= n)
"""

FOLDS = """
sizes AS (SELECT cluster_id, dataset_id AS hold, count(*) AS n_test FROM members GROUP BY ALL),
folds AS (
  SELECT * FROM (
    SELECT cluster_id, hold,
           CAST(sum(n_test) OVER w - n_test AS BIGINT) AS n_train, n_test,
           count(*) OVER w AS n_datasets
    FROM sizes WINDOW w AS (PARTITION BY cluster_id))
  WHERE n_datasets >= 2 AND n_train >= 10 AND n_test >= 10)
"""

NEG_MEAN = """
neg_mean AS (
  SELECT layer, cluster_id, i, avg(z) AS m FROM split JOIN z USING (uid)
  WHERE part = 'train' GROUP BY ALL)
"""

LOBO_DIR = """
lobo_gap AS (
  SELECT p.layer, p.cluster_id, p.hold, p.i, p.m - n.m AS g
  FROM (SELECT layer, f.cluster_id, f.hold, i, avg(z) AS m
        FROM folds f JOIN members m ON m.cluster_id = f.cluster_id AND m.dataset_id <> f.hold
        JOIN z USING (uid) GROUP BY ALL) p
  JOIN neg_mean n ON n.layer = p.layer AND n.cluster_id = p.cluster_id AND n.i = p.i),
lobo_dir AS (
  SELECT layer, cluster_id, hold, i,
         g / (sqrt(sum(g * g) OVER (PARTITION BY layer, cluster_id, hold)) + 1e-8) AS v
  FROM lobo_gap)
"""

LOBO_SCORE = """
lobo_test AS (
  SELECT f.cluster_id, f.hold, m.uid, true AS y
  FROM folds f JOIN members m ON m.cluster_id = f.cluster_id AND m.dataset_id = f.hold
  UNION ALL
  SELECT f.cluster_id, f.hold, s.uid, false
  FROM folds f JOIN split s ON s.cluster_id = f.cluster_id AND s.part = 'test'),
lobo_score AS (
  SELECT d.layer, t.cluster_id, t.hold, t.uid, t.y, sum(z.z * d.v) AS s
  FROM lobo_test t JOIN lobo_dir d USING (cluster_id, hold)
  JOIN z ON z.layer = d.layer AND z.uid = t.uid AND z.i = d.i GROUP BY ALL)
"""


def pairwise_auc(name: str, scores: str, keys: str) -> str:
    """AUC by comparing every positive with every negative."""
    on = " AND ".join(f"p.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
{name} AS (
  SELECT {sel}, avg(CASE WHEN abs(p.s - n.s) < 1e-12 THEN 0.5 WHEN p.s > n.s THEN 1 ELSE 0 END) AS auc,
         count(DISTINCT p.uid) AS n_pos, count(DISTINCT n.uid) AS n_neg
  FROM (SELECT * FROM {scores} WHERE y) p JOIN (SELECT * FROM {scores} WHERE NOT y) n ON {on}
  GROUP BY ALL)"""


LOBO_AUC = pairwise_auc("lobo_auc", "lobo_score", "layer, cluster_id, hold")

BASE = (TEXTS, MEMBERS, HIDDEN, LONG, STATS, Z, CANDIDATES, SPLIT)
LOBO = (*BASE, FOLDS, NEG_MEAN, LOBO_DIR, LOBO_SCORE, LOBO_AUC)

# Full directions: all positives against the training negatives.
FULL_DIR = """
full_gap AS (
  SELECT p.layer, p.cluster_id, p.i, p.m - n.m AS g
  FROM (SELECT layer, cluster_id, i, avg(z) AS m FROM members JOIN z USING (uid) GROUP BY ALL) p
  JOIN neg_mean n USING (layer, cluster_id, i)),
full_dir AS (
  SELECT layer, cluster_id, i,
         g / (sqrt(sum(g * g) OVER (PARTITION BY layer, cluster_id)) + 1e-8) AS v
  FROM full_gap)
"""

FULL_SCORE = """
full_score AS (
  SELECT d.layer, s.cluster_id, s.uid, sum(z.z * d.v) AS s
  FROM split s JOIN full_dir d USING (cluster_id)
  JOIN z ON z.layer = d.layer AND z.uid = s.uid AND z.i = d.i
  WHERE s.part = 'test' GROUP BY ALL)
"""

HALVES = """
halves AS (
  SELECT cluster_id, uid,
         row_number() OVER (PARTITION BY cluster_id
                            ORDER BY md5('0:' || cluster_id || ':' || uid), uid)
           <= count(*) OVER (PARTITION BY cluster_id) // 2 AS first_half
  FROM members)
"""

WITHIN = """
within_gap AS (
  SELECT p.layer, p.cluster_id, p.i, p.m - n.m AS g
  FROM (SELECT layer, cluster_id, i, avg(z) AS m FROM halves JOIN z USING (uid)
        WHERE first_half GROUP BY ALL) p
  JOIN neg_mean n USING (layer, cluster_id, i)),
within_dir AS (
  SELECT layer, cluster_id, i,
         g / (sqrt(sum(g * g) OVER (PARTITION BY layer, cluster_id)) + 1e-8) AS v
  FROM within_gap),
within_test AS (
  SELECT cluster_id, uid, true AS y FROM halves WHERE NOT first_half
  UNION ALL SELECT cluster_id, uid, false FROM split WHERE part = 'test'),
within_score AS (
  SELECT d.layer, t.cluster_id, t.uid, t.y, sum(z.z * d.v) AS s
  FROM within_test t JOIN within_dir d USING (cluster_id)
  JOIN z ON z.layer = d.layer AND z.uid = t.uid AND z.i = d.i GROUP BY ALL)
"""

SPEC = """
spec_gap AS (
  SELECT p.layer, p.cluster_id, p.i, p.m - n.m AS g
  FROM (SELECT layer, cluster_id, i, avg(z) AS m FROM members JOIN z USING (uid) GROUP BY ALL) p
  JOIN (SELECT layer, cluster_id, i, avg(z) AS m FROM split JOIN z USING (uid) GROUP BY ALL) n
  USING (layer, cluster_id, i)),
spec_dir AS (
  SELECT layer, cluster_id AS direction, i,
         g / (sqrt(sum(g * g) OVER (PARTITION BY layer, cluster_id)) + 1e-8) AS v
  FROM spec_gap),
spec_score AS (
  SELECT layer, direction, uid, sum(z * v) AS s FROM spec_dir JOIN z USING (layer, i) GROUP BY ALL),
spec_z AS (
  SELECT layer, direction, uid,
         (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-8) AS s
  FROM spec_score WINDOW w AS (PARTITION BY layer, direction)),
matrix AS (
  SELECT layer, cluster_id, direction, avg(s) AS z_mean
  FROM spec_z JOIN members USING (uid) GROUP BY ALL)
"""
