"""Queries over clustering and its quality, on the ``documents`` table.

The SQL counterparts follow the loop for two fixed rounds; ``kmeans_fit`` runs to convergence
and has none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.stopwords import stopwords
from doccat.operators import cluster as cl
from doccat.operators import evaluate as ev
from doccat.operators import skos
from doccat.operators import vectors as vc
from doccat.operators.scale import cut, laid_rows
from doccat.plans import jobs
from doccat.plans.registry import documents, new_folder, query
from doccat.plans.texts import vector_sql

K, ROUNDS, SEED = 15, 2, 42

SEED_SQL = f"""
, seeds AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY key, doc_id) - 1 AS INTEGER) AS cluster_id, doc_id FROM (
    SELECT doc_id, md5('{SEED}:' || doc_id) AS key FROM (SELECT DISTINCT doc_id FROM v)
    ORDER BY key, doc_id LIMIT {K})),
norm AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id),
c0 AS MATERIALIZED (SELECT cluster_id, term, w FROM v JOIN seeds USING (doc_id))
"""


def assign_sql(i: int) -> str:
    """CTE ``a{i}``: labels from the centres ``c{i}``."""
    return f"""
, a{i} AS MATERIALIZED (
  SELECT doc_id, cluster_id, greatest(1 - cosine, 0) AS distance FROM (
    SELECT doc_id, cluster_id, coalesce(cosine, 0) AS cosine, row_number() OVER (
      PARTITION BY doc_id ORDER BY round(coalesce(cosine, 0), 9) DESC, cluster_id) AS r
    FROM (SELECT doc_id, cluster_id FROM norm, (SELECT DISTINCT cluster_id FROM c{i}))
    LEFT JOIN (
      SELECT doc_id, cluster_id, dot / (norm.norm * cn.norm) AS cosine FROM (
        SELECT v.doc_id, c.cluster_id, sum(v.w * c.w) AS dot FROM v JOIN c{i} c USING (term) GROUP BY ALL)
      JOIN norm USING (doc_id)
      JOIN (SELECT cluster_id, sqrt(sum(w * w)) AS norm FROM c{i} GROUP BY ALL) cn USING (cluster_id)
    ) USING (doc_id, cluster_id))
  WHERE r = 1)
"""


def centre_sql(i: int) -> str:
    """CTE ``c{i + 1}``: means of the members in ``a{i}``."""
    return f"""
, c{i + 1} AS MATERIALIZED (
  SELECT cluster_id, term, sum(w) / any_value(n) AS w FROM v JOIN a{i} USING (doc_id)
  JOIN (SELECT cluster_id, count(*) AS n FROM a{i} GROUP BY ALL) USING (cluster_id) GROUP BY ALL
  UNION ALL SELECT cluster_id, term, w FROM c{i} WHERE cluster_id NOT IN (SELECT cluster_id FROM a{i}))
"""


def fit_sql(bigrams: bool = False) -> str:
    """CTEs with the final centres ``c2`` and labels ``a2`` after two rounds."""
    out = vector_sql(bigrams=bigrams, max_df_percent=25) + SEED_SQL
    for i in range(ROUNDS):
        out += assign_sql(i) + centre_sql(i)
    return out + assign_sql(ROUNDS)


FIT = fit_sql()


def ranked_sql(source: str, key: str, name: str) -> str:
    """CTE ``name``: top ten words of each key, n-grams split."""
    return f"""
, {name} AS MATERIALIZED (
  SELECT {key}, term, weight, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY weight DESC, lower(term), term) AS INTEGER) AS rank FROM (
      SELECT {key}, term, max(weight) AS weight FROM (
        SELECT {key}, unnest(string_split(term, ' ')) AS term, CAST(round_even(w, 2) AS DOUBLE) AS weight
        FROM {source}) GROUP BY ALL))
  WHERE rank <= 10)
"""


def text_sql(ranked: str, key: str, name: str) -> str:
    return f"""
, {name} AS (SELECT {key}, '[' || string_agg(term || '=' || CAST(weight AS VARCHAR), ', ' ORDER BY rank) || ']'
  AS top_terms FROM {ranked} GROUP BY {key})
"""


def _vectors(spark, sf_dir, max_ngram: int = 1):
    docs = documents(spark, sf_dir)
    return vc.vectorize(docs, stopwords(), max_ngram=max_ngram, max_df_percent=25).vectors


def _fit(vectors) -> cl.Clusters:
    """Two rounds, whatever the movement."""
    return cl.kmeans_fit(vectors, K, max_iter=ROUNDS, tol=-1.0, seed=SEED)


@query("kmeans_seeds", vector_sql(max_df_percent=25) + SEED_SQL + "SELECT cluster_id, doc_id FROM seeds")
def kmeans_seeds(spark, sf_dir):
    return cl.kmeans_seeds(_vectors(spark, sf_dir), K, SEED)


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    fit = cl.kmeans_fit(_vectors(spark, sf_dir), K, seed=SEED)
    return fit.assigned.withColumn("distance", F.round("distance", 6))


@query(
    "kmeans_two_rounds",
    FIT + "SELECT doc_id, cluster_id, round(distance, 6) AS distance FROM a2",
)
def kmeans_two_rounds(spark, sf_dir):
    return _fit(_vectors(spark, sf_dir)).assigned.withColumn("distance", F.round("distance", 6))


@query(
    "assign_clusters",
    vector_sql(max_df_percent=25) + SEED_SQL + assign_sql(0)
    + "SELECT doc_id, cluster_id, round(distance, 6) AS distance FROM a0",
)
def assign_clusters(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    centres = cut(cl.seed_centroids(vectors, cut(cl.kmeans_seeds(vectors, K, SEED))))
    return cl.assign_clusters(vectors, centres, K).withColumn("distance", F.round("distance", 6))


@query("centroids", FIT + "SELECT cluster_id, term, round(w, 6) AS w FROM c2")
def centroids(spark, sf_dir):
    return _fit(_vectors(spark, sf_dir)).centroids.withColumn("w", F.round("w", 6))


@query(
    "cluster_sizes",
    FIT + """SELECT cluster_id, count(*) AS n_docs, count(DISTINCT cluster_id) AS n_clusters FROM a2
             GROUP BY ROLLUP (cluster_id)""",
)
def cluster_sizes(spark, sf_dir):
    return cl.cluster_sizes(_fit(_vectors(spark, sf_dir)).assigned)


@query(
    "cluster_top_terms",
    FIT + ranked_sql("c2", "cluster_id", "tops")
    + "SELECT cluster_id, term, weight, rank FROM (SELECT DISTINCT cluster_id FROM a2) LEFT JOIN tops USING (cluster_id)",
)
def cluster_top_terms(spark, sf_dir):
    fit = _fit(_vectors(spark, sf_dir))
    return cl.cluster_top_terms(fit.centroids, fit.assigned)


@query(
    "member_top_terms",
    FIT + ranked_sql("v", "doc_id", "tops")
    + "SELECT cluster_id, doc_id, term, weight, rank FROM a2 JOIN tops USING (doc_id)",
)
def member_top_terms(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return cl.member_top_terms(vectors, _fit(vectors).assigned)


BIGRAM_VECTORS = vector_sql(bigrams=True, max_df_percent=25)


@query(
    "drop_shingles",
    BIGRAM_VECTORS + """SELECT doc_id, term, max(weight) AS weight FROM (
      SELECT doc_id, unnest(string_split(term, ' ')) AS term, CAST(round_even(w, 2) AS DOUBLE) AS weight FROM v)
      GROUP BY ALL""",
)
def drop_shingles(spark, sf_dir):
    rows, key = laid_rows(_vectors(spark, sf_dir, 2))
    weights = rows.select(*key, "term", F.bround("w", 2).alias("weight"))
    return vc.drop_shingles(weights, *key).select("doc_id", "term", "weight")


@query(
    "top_terms_order",
    BIGRAM_VECTORS + ranked_sql("v", "doc_id", "tops") + "SELECT doc_id, term, weight, rank FROM tops",
)
def top_terms_order(spark, sf_dir):
    return vc.rank_terms(_vectors(spark, sf_dir, 2), "doc_id")


CONCEPTS = """
, concepts AS MATERIALIZED (
  SELECT cluster_id, doc_id, cluster_id || '_' || row_number() OVER (ORDER BY cluster_id, doc_id) AS concept FROM a2)
"""


@query("concept_ids", FIT + CONCEPTS + "SELECT cluster_id, doc_id, concept FROM concepts")
def concept_ids(spark, sf_dir):
    return cl.concept_ids(_fit(_vectors(spark, sf_dir)).assigned)


@query(
    "cluster_report",
    FIT + ranked_sql("c2", "cluster_id", "tops") + text_sql("tops", "cluster_id", "named")
    + ranked_sql("v", "doc_id", "mine") + text_sql("mine", "doc_id", "each") + """
, sizes AS (SELECT cluster_id, count(*) AS n FROM a2 GROUP BY ALL)
SELECT -1 AS cluster_id, 0 AS section, CAST(NULL AS BIGINT) AS doc_id, 'Number of clusters: ' || count(*) AS line FROM sizes
UNION ALL SELECT 2147483647, 9, NULL, 'Number of clustered documents: ' || count(*) FROM a2
UNION ALL SELECT cluster_id, 1, NULL, 'Cluster ' || cluster_id || ' (' || n || ')' FROM sizes
UNION ALL SELECT cluster_id, 2, NULL, 'TopTerms: ' || coalesce(top_terms, '[]') FROM sizes LEFT JOIN named USING (cluster_id)
UNION ALL SELECT cluster_id, 3, doc_id, '  ' || rpad(CAST(doc_id AS VARCHAR), 40, ' ') || ':' || top_terms
FROM a2 JOIN each USING (doc_id)""",
)
def cluster_report(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    fit = _fit(vectors)
    return cl.cluster_report(vectors, fit.centroids, fit.assigned)


INTER = """
, cu AS MATERIALIZED (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS u FROM c2),
ids AS (SELECT DISTINCT cluster_id AS c FROM c2),
inter_pairs AS MATERIALIZED (
  SELECT i.c AS i, j.c AS j, greatest(1 - coalesce(dot, 0), 0) AS d FROM ids i JOIN ids j ON i.c < j.c
  LEFT JOIN (SELECT x.cluster_id AS i, y.cluster_id AS j, sum(x.u * y.u) AS dot FROM cu x JOIN cu y
             ON x.term = y.term AND x.cluster_id < y.cluster_id GROUP BY ALL) p ON p.i = i.c AND p.j = j.c),
inter AS (SELECT min(d) AS min_inter, max(d) AS max_inter,
  (avg(d) - min(d) + 1e-6::DOUBLE) / (max(d) - min(d) + 1e-6::DOUBLE) AS avg_inter FROM inter_pairs)
"""
INTRA = """
, du AS MATERIALIZED (SELECT cluster_id, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u
                      FROM v JOIN a2 USING (doc_id)),
intra_pairs AS MATERIALIZED (
  SELECT a.cluster_id, greatest(1 - coalesce(dot, 0), 0) AS d FROM a2 a
  JOIN a2 b ON a.cluster_id = b.cluster_id AND a.doc_id < b.doc_id
  LEFT JOIN (SELECT x.doc_id AS i, y.doc_id AS j, sum(x.u * y.u) AS dot FROM du x JOIN du y
             ON x.cluster_id = y.cluster_id AND x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL) p
  ON p.i = a.doc_id AND p.j = b.doc_id),
intra AS MATERIALIZED (
  SELECT cluster_id, n AS n_docs, coalesce(density, 1) AS density, coalesce(low, 0) AS min_intra,
         coalesce(high, 0) AS max_intra
  FROM (SELECT cluster_id, count(*) AS n FROM a2 GROUP BY ALL) LEFT JOIN (
    SELECT cluster_id, (avg(d) - min(d) + 1e-6::DOUBLE) / (max(d) - min(d) + 1e-6::DOUBLE) AS density,
           min(d) AS low, max(d) AS high FROM intra_pairs GROUP BY ALL) USING (cluster_id))
"""


def _rounded(df):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query(
    "inter_cluster",
    FIT + INTER + """SELECT round(min_inter, 6) AS min_inter, round(max_inter, 6) AS max_inter,
                     round(avg_inter, 6) AS avg_inter FROM inter""",
)
def inter_cluster(spark, sf_dir):
    return _rounded(ev.inter_cluster(_fit(_vectors(spark, sf_dir)).centroids))


@query(
    "intra_cluster",
    FIT + INTRA + """SELECT cluster_id, n_docs, round(density, 6) AS density, round(min_intra, 6) AS min_intra,
                     round(max_intra, 6) AS max_intra FROM intra""",
)
def intra_cluster(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _rounded(ev.intra_cluster(vectors, _fit(vectors).assigned))


@query(
    "intra_mean",
    FIT + INTRA + """SELECT round(avg(density), 6) AS avg_intra, round(max(max_intra), 6) AS max_intra FROM intra""",
)
def intra_mean(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _rounded(ev.intra_mean(ev.intra_cluster(vectors, _fit(vectors).assigned)))


QUALITY = INTER + INTRA + """
, q AS (SELECT *, 2 * avg_inter / (avg_inter * avg_intra + 1) AS harmonic_mean, min_inter / max_intra AS dunn_index
  FROM inter, (SELECT avg(density) AS avg_intra, max(max_intra) AS max_intra FROM intra))
"""


@query("harmonic_mean", FIT + QUALITY + "SELECT round(harmonic_mean, 6) AS harmonic_mean FROM q")
def harmonic_mean(spark, sf_dir):
    return _quality(spark, sf_dir).select("harmonic_mean")


@query("dunn_index", FIT + QUALITY + "SELECT round(dunn_index, 6) AS dunn_index FROM q")
def dunn_index(spark, sf_dir):
    return _quality(spark, sf_dir).select("dunn_index")


def _quality(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    fit = _fit(vectors)
    intra = cut(ev.intra_cluster(vectors, fit.assigned))
    return _rounded(ev.cluster_quality(ev.inter_cluster(fit.centroids), intra))


@query(
    "skos_clusters",
    FIT + CONCEPTS + ranked_sql("c2", "cluster_id", "tops") + text_sql("tops", "cluster_id", "named")
    + ranked_sql("v", "doc_id", "mine") + text_sql("mine", "doc_id", "each") + f"""
, heads AS (SELECT cluster_id, '<{skos.BASE}collection_' || cluster_id || '>' AS s, coalesce(top_terms, '[]') AS top_terms
  FROM (SELECT DISTINCT cluster_id FROM a2) LEFT JOIN named USING (cluster_id)),
members AS (SELECT cluster_id, '<{skos.BASE}concept_' || concept || '>' AS s, doc_id, top_terms
  FROM concepts JOIN each USING (doc_id))
SELECT s AS subject, 'rdf:type' AS predicate, 'skos:Collection' AS object, false AS is_literal FROM heads
UNION ALL SELECT s, 'skos:note', top_terms, true FROM heads
UNION ALL SELECT '<{skos.BASE}collection_' || cluster_id || '>', 'skos:member', s, false FROM members
UNION ALL SELECT s, 'rdf:type', 'skos:Concept', false FROM members
UNION ALL SELECT s, 'skos:definition', CAST(doc_id AS VARCHAR), true FROM members
UNION ALL SELECT s, 'skos:note', top_terms, true FROM members""",
)
def skos_clusters(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    fit = _fit(vectors)
    return skos.skos_clusters(vectors, fit.centroids, fit.assigned)


QUALITY_COLUMNS = "min_inter max_inter avg_inter avg_intra max_intra harmonic_mean dunn_index".split()


@query(
    "job_cluster",
    fit_sql(bigrams=True) + QUALITY
    + "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in QUALITY_COLUMNS) + " FROM q",
)
def job_cluster(spark, sf_dir):
    """The whole job with default vectors (words and collocations), for two rounds."""
    result = jobs.job_cluster(documents(spark, sf_dir), new_folder(spark), k=K, max_iter=ROUNDS, tol=-1.0)
    return _rounded(result.quality)
