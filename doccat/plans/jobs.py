"""The four jobs, each from a source to written results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions.stopwords import stopwords
from doccat.operators import analyze, cluster, evaluate, similar, skos, vectors
from doccat.operators.scale import cut
from doccat.sources import records, sinks


def job_extract(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """XML records to entities, field texts, field lists and unique values.

    Records that are not well-formed go to ``rejects`` with the reason, and ``counts`` has one row with
    the number of records read, kept and rejected.
    """
    parsed = cut(records.parse_records(records.read_xml_records(spark, folder)))
    entities = cut(records.number_entities(parsed))
    rejects = parsed.filter("reason IS NOT NULL").select("path", "reason")
    sinks.write_table(rejects, f"{out}/rejects")
    bad = F.count_if(F.col("reason").isNotNull())
    counts = parsed.agg(
        F.count("*").alias("n_records"), (F.count("*") - bad).alias("n_entities"), bad.alias("n_rejects")
    )
    sinks.write_table(counts, f"{out}/counts")
    sinks.write_table(entities, f"{out}/entities")
    sinks.write_field_docs(entities, f"{out}/documents")
    sinks.write_field_lists(entities, f"{out}/lists")
    sinks.write_unique_values(entities, f"{out}/unique")
    return entities


def job_content_words(docs: DataFrame, lexicon: DataFrame, out: str, **options) -> DataFrame:
    """Texts reduced to their content words."""
    texts = cut(analyze.content_words(docs, lexicon, **options))
    sinks.write_content_words(texts, out)
    return texts


@dataclass
class SimilarResult:
    corpus: vectors.Corpus
    similar: DataFrame


def find_similar(
    docs: DataFrame,
    min_support: int = 1,
    max_ngram: int = 1,
    min_df: int = 1,
    max_df_percent: float = 100,
    k: int = 10,
    stops: list[str] | None = None,
    asked: Column | None = None,
) -> SimilarResult:
    """Vectors and the ``k`` most similar documents of each document, or of those that meet ``asked``."""
    words = stopwords() if stops is None else stops
    corpus = vectors.vectorize(docs, words, min_support, max_ngram, min_df, max_df_percent)
    return SimilarResult(corpus, cut(similar.similar_topk(corpus.vectors, k, asked=asked)))


def intermediates(corpus: vectors.Corpus, stops: list[str]) -> dict[str, DataFrame]:
    return {
        "tokens": analyze.token_lists(corpus.docs, stops),
        "dictionary": vectors.dictionary(corpus.df),
        "tf": corpus.tf,
        "tf_text": vectors.vector_text(corpus.tf, "tf", integral=True),
        "df": corpus.df,
        "df_sorted": vectors.df_sorted(corpus.df),
        "tfidf": corpus.vectors,
        "tfidf_text": vectors.vector_text(corpus.vectors),
    }


def job_similar(
    docs: DataFrame, out: str, stops: list[str] | None = None, **options
) -> SimilarResult:
    """Similar documents, their report and their SKOS statements.

    A document that ``asked`` leaves out stays in both with its top terms; only its search is left out.
    """
    words = stopwords() if stops is None else stops
    result = find_similar(docs, stops=words, **options)
    sinks.write_intermediates(intermediates(result.corpus, words), f"{out}/steps")
    sinks.write_table(result.similar, f"{out}/similar")
    report = similar.similar_report(result.corpus.vectors, result.similar)
    entries = report.orderBy("doc_id").select(F.concat("report", F.lit("\n")).alias("report"))
    sinks.write_lines(entries, f"{out}/report")
    sinks.write_turtle(skos.skos_similar(result.corpus.vectors, result.similar), f"{out}/turtle")
    return result


@dataclass
class ClusterResult:
    corpus: vectors.Corpus
    clusters: cluster.Clusters
    quality: DataFrame


def job_cluster(
    docs: DataFrame,
    out: str,
    k: int = 15,
    max_ngram: int = 2,
    min_support: int = 1,
    min_df: int = 1,
    max_df_percent: float = 25,
    max_iter: int = 20,
    tol: float = 1e-3,
    seed: int = 42,
    stops: list[str] | None = None,
) -> ClusterResult:
    """Clusters, their report, SKOS statements and quality figures."""
    words = stopwords() if stops is None else stops
    corpus = vectors.vectorize(docs, words, min_support, max_ngram, min_df, max_df_percent)
    fit = cluster.kmeans_fit(corpus.vectors, k, max_iter, tol, seed)
    name = f"clusters_{k}_{max_ngram}_{min_support}_{min_df}_{max_df_percent:g}"
    sinks.write_intermediates(intermediates(corpus, words), f"{out}/steps")
    sinks.write_table(fit.assigned, f"{out}/{name}/members")
    sinks.write_table(fit.centroids, f"{out}/{name}/centres")
    report = cluster.cluster_report(corpus.vectors, fit.centroids, fit.assigned)
    lines = report.orderBy("cluster_id", "section", "doc_id").select("line")
    sinks.write_lines(lines, f"{out}/{name}/report")
    statements = skos.skos_clusters(corpus.vectors, fit.centroids, fit.assigned)
    sinks.write_turtle(statements, f"{out}/{name}/turtle")
    intra = cut(evaluate.intra_cluster(corpus.vectors, fit.assigned))
    quality = cut(evaluate.cluster_quality(evaluate.inter_cluster(fit.centroids), intra))
    sinks.write_table(intra, f"{out}/{name}/intra")
    sinks.write_table(quality, f"{out}/{name}/quality")
    return ClusterResult(corpus, fit, quality)
