"""k-means under cosine distance as a loop of joins and aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doccat.operators.scale import PART, LaidOut, by_part, cut, drop_cut, fits_broadcast
from doccat.operators.vectors import dense_index, rank_terms, top_terms_text

# Cosines are compared at this precision, so that the order of a sum cannot change a label.
PLACES = 9
# Angles are exact to far less than this, in radians.
SLACK = 1e-7
# Share of the documents above which all are scored anew rather than picked out, and of those that changed their cluster
# above which centres are formed anew.
ANEW = 0.8
PATCHED = 0.4
# Ids and labels of so many documents take less than a broadcast may, whatever the ids.
FEW = 50_000
# Entries of vectors that a partition holds on average.
PART_ROWS = 2_000_000


def seed_order(doc_id: Column, seed: int) -> Column:
    """A reproducible shuffle key: uniform, and the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")))


def kmeans_seeds(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(cluster_id, doc_id)`` of ``k`` random documents, numbered in draw order."""
    draw = vectors.select("doc_id").distinct().select("doc_id", seed_order(F.col("doc_id"), seed).alias("key"))
    chosen = draw.orderBy("key", "doc_id").limit(k)
    # The window sees the k chosen rows only.
    at = F.row_number().over(W.orderBy("key", "doc_id")) - 1
    return chosen.select(at.alias("cluster_id"), "doc_id")


def seed_centroids(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(cluster_id, term, w)``: the vectors of the seed documents; there are ``k`` of them."""
    return vectors.join(F.broadcast(seeds), "doc_id").select("cluster_id", "term", "w")


def _columns(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def _wide(centres: DataFrame, k: int) -> DataFrame:
    """``(term, c0 .. c{k-1})``: one row per term with its weight in every centre."""
    per_centre = [
        F.sum(F.when(F.col("cluster_id") == i, F.col("w"))).alias(c)
        for i, c in enumerate(_columns(k))
    ]
    return centres.groupBy("term").agg(*per_centre)


def _long(wide: DataFrame, k: int) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("cluster_id"), F.col(c).alias("w")) for i, c in enumerate(_columns(k))]
    return wide.select("term", F.inline(F.array(*cells))).filter(F.col("w").isNotNull()).select(
        "cluster_id", "term", "w"
    )


def _norms(wide: DataFrame, k: int) -> list[float]:
    """Norm of each centre: ``k`` numbers."""
    row = wide.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in _columns(k)]).first()
    return [x or 0.0 for x in row]


def _lay_out(vectors: DataFrame) -> LaidOut:
    laid = getattr(vectors, "laid", None)
    if laid is not None:
        return laid
    rows = vectors.select("doc_id", "term", "w")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return LaidOut(rows, "doc_id", max(cores, math.ceil(rows.count() / PART_ROWS)))


def _scored(laid: LaidOut, wide: DataFrame, norms: list[float], rows: DataFrame | None = None) -> DataFrame:
    """``doc_id, cluster_id, distance, up, lows`` from wide centres: also the angle to the nearest and to each.

    A posting meets one row with its weight in all centres, so the join adds no rows. That
    table grows with the vocabulary: it is broadcast only when its size allows, else each part of the vectors is
    sent the terms it has. ``rows`` are some of the laid out ones.
    """
    return _scores(laid.met(wide, "term", rows, "left"), norms, PART, "doc_id")


def _scores(met: DataFrame, norms: list[float], *key: str) -> DataFrame:
    """The result of :func:`_scored` from postings with the weights of their terms in all centres."""
    k = len(norms)
    dots = [F.sum(F.col("w") * F.col(c)).alias(c) for c in _columns(k)]
    sums = met.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)

    def score(i: int) -> Column:
        cosine = F.coalesce(F.col(f"c{i}") / (F.col("norm") * norms[i]), F.lit(0.0)) if norms[i] else F.lit(0.0)
        return F.struct(
            F.round(cosine, PLACES).alias("shown"), F.lit(-i).alias("minus_id"), cosine.alias("cosine")
        )

    scores = F.array(*[score(i) for i in range(k)])
    found = sums.filter(F.col("norm") > 0).select("doc_id", scores.alias("scores"))
    found = found.select("doc_id", "scores", F.array_max("scores").alias("best"))
    return found.select(
        "doc_id",
        (-F.col("best.minus_id")).alias("cluster_id"),
        F.greatest(F.lit(1.0) - F.col("best.cosine"), F.lit(0.0)).alias("distance"),
        _angle(F.col("best.cosine")).alias("up"),
        F.transform("scores", lambda x: _angle(x["cosine"])).alias("lows"),
    )


def _nearest(scored: DataFrame) -> DataFrame:
    """``doc_id, cluster_id, distance``: the labels."""
    return scored.select("doc_id", "cluster_id", "distance")


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def assign_clusters(vectors: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``(doc_id, cluster_id, distance)``: the nearest centre of each document.

    A document without a term in any centre is at distance 1 of all; ties go to the lowest
    cluster.
    """
    wide = cut(_wide(centres, k))
    norms = _norms(wide, k)
    if fits_broadcast(wide):
        return _nearest(_scores(vectors.join(F.broadcast(wide), "term", "left"), norms, "doc_id"))
    with by_part(vectors.sparkSession):
        return cut(_nearest(_scored(_lay_out(vectors), wide, norms)))


def _sizes(assigned: DataFrame, k: int) -> list[int]:
    """Members of each cluster: ``k`` numbers."""
    rows = assigned.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()
    found = {r["cluster_id"]: r["n"] for r in rows}
    return [found.get(i, 0) for i in range(k)]


def _sums(labelled: DataFrame, k: int) -> DataFrame:
    """Wide sums per term of postings with ``cluster_id, sign`` of their documents.

    Sums per term are formed before the shuffle: no cluster is a hot key.
    """
    # First one sum per cluster and term, then a row per term: a posting meets one sum, not ``k``.
    sums = labelled.groupBy("term").pivot("cluster_id", list(range(k))).agg(F.sum(F.col("w") * F.col("sign")))
    return sums.select("term", *[F.col(f"`{i}`").alias(c) for i, c in enumerate(_columns(k))])


def _divided(sums: DataFrame, sizes: list[int], previous: DataFrame | None) -> DataFrame:
    """Wide mean vectors. Every document has a label, so every term gets a row; an empty cluster keeps its centre."""
    k = len(sizes)
    means = [(F.col(c) / float(n)).alias(c) for c, n in zip(_columns(k), sizes) if n]
    new = sums.select("term", *means)
    if 0 not in sizes:
        return new
    empty = [c for c, n in zip(_columns(k), sizes) if not n]
    if previous is None:
        return new.select("term", *[F.col(c) if c not in empty else F.lit(None).cast("double").alias(c) for c in _columns(k)])
    kept = new.join(previous.select("term", *empty), "term", "left")
    return kept.select("term", *_columns(k))


def _labels(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "cluster_id", F.lit(1.0).alias("sign"))


def _means(vectors: DataFrame, assigned: DataFrame, previous: DataFrame | None, k: int) -> DataFrame:
    return _divided(_sums(vectors.join(_labels(assigned), "doc_id"), k), _sizes(assigned, k), previous)


def centroids(
    vectors: DataFrame, assigned: DataFrame, k: int, previous: DataFrame | None = None
) -> DataFrame:
    """``(cluster_id, term, w)``: mean vector of the members; an empty cluster keeps its centre."""
    old = None if previous is None else _wide(previous, k)
    return _long(_means(vectors, assigned, old, k), k)


def _compare(old: DataFrame, new: DataFrame, old_norms: list[float]) -> tuple[list[float], list[float]]:
    """Cosine of each old centre with its new one, and the new norms; a centre without a norm has not moved."""
    k = len(old_norms)
    before = old.select("term", *[F.col(c).alias(f"old_{c}") for c in _columns(k)])
    dots = [F.sum(F.col(c) * F.col(f"old_{c}")) for c in _columns(k)]
    squares = [F.sum(F.col(c) * F.col(c)) for c in _columns(k)]
    row = [x or 0.0 for x in new.join(before, "term", "left").agg(*dots, *squares).first()]
    norms = [math.sqrt(x) for x in row[k:]]
    return [d / (a * b) if a and b else 1.0 for d, a, b in zip(row[:k], old_norms, norms)], norms


@dataclass
class Clusters:
    centroids: DataFrame
    assigned: DataFrame
    iterations: int
    converged: bool
    # Documents that were compared with all centres, and those that changed their cluster, in each round.
    scored: list[int] = field(default_factory=list)
    moved: list[int] = field(default_factory=list)


def _aged(state: DataFrame, cosines: list[float]) -> DataFrame:
    """The angles of ``state`` after the centres have moved: up by the own centre's move, lows by each one's."""
    moves = F.array(*[F.lit(math.acos(max(-1.0, min(1.0, c))) + SLACK) for c in cosines])
    return state.select(
        "doc_id", "cluster_id", "distance", (F.col("up") + F.get(moves, F.col("cluster_id"))).alias("up"),
        F.zip_with("lows", moves, lambda low, move: low - move).alias("lows"),
    )


def _settled() -> Column:
    """Whether the own centre is surely the nearest, also at the precision at which cosines are compared."""
    up = F.cos(F.least(F.col("up") + SLACK, F.lit(math.pi)))

    def farther(low: Column, i: Column) -> Column:
        least = F.least(F.greatest(low - SLACK, F.lit(0.0)), F.lit(math.pi))
        return (i == F.col("cluster_id")) | (up - F.cos(least) > 10.0 ** (1 - PLACES))

    return F.forall(F.transform("lows", farther), lambda x: x)


def kmeans_fit(
    vectors: DataFrame, k: int, max_iter: int = 20, tol: float = 1e-3, seed: int = 42, bounds: bool = True
) -> Clusters:
    """Lloyd's algorithm from ``k`` random documents; labels come from the final centres.

    Vectors are laid out by document once and stay so: scoring and the update shuffle only
    sums, and the terms of the centres where they are too many for a broadcast. Each round writes its labels and centres and deletes those of the round before, so the
    plan does not grow and a lost executor costs one round at most.

    With ``bounds`` a document carries an upper bound of the angle to its centre and a lower one of the angle to each
    other. Angles obey the triangle inequality, so a bound changes by no more than its centre moves, and a document is
    scored again only when its bounds meet. Centres are corrected by the documents that have changed
    their cluster; where many have, they are formed anew, and so they are at the end. The labels are those of the plain loop.
    """
    with by_part(vectors.sparkSession):
        return _fit(vectors, k, max_iter, tol, seed, bounds)


def _fit(vectors: DataFrame, k: int, max_iter: int, tol: float, seed: int, bounds: bool) -> Clusters:
    laid = _lay_out(vectors)
    if laid is not getattr(vectors, "laid", None):
        laid = laid.written(laid.rows)
    scored, changed = [], []
    wide = cut(_wide(seed_centroids(laid.rows, cut(kmeans_seeds(laid.rows, k, seed))), k))
    norms = _norms(wide, k)
    state = cosines = before = None
    sizes: list[int] = []
    done, rounds, corrected = False, 0, False
    while rounds < max_iter and not done:
        now, n_scored = _rescored(laid, state, wide, norms, cosines if bounds else None, sum(sizes))
        moved = F.coalesce(F.sum((F.col("old") != F.col("cluster_id")).cast("long")), F.lit(0))
        found = {r["cluster_id"]: r for r in now.groupBy("cluster_id").agg(F.count("*").alias("n"), moved.alias("m")).collect()}
        counts = [found[i]["n"] if i in found else 0 for i in range(k)]
        n_docs, n_moved = sum(counts), sum(r["m"] for r in found.values())
        corrected = bounds and state is not None and n_moved <= PATCHED * n_docs
        if corrected:
            centres = cut(_corrected(laid, now.filter("old <> cluster_id"), n_moved, wide, sizes, counts))
        else:
            centres = cut(_divided(_sums(_matched(laid, _labels(now), n_docs), k), counts, wide))
        scored.append(n_docs if n_scored is None else n_scored)
        changed.append(n_docs if state is None else n_moved)
        cosines, norms = _compare(wide, centres, norms)
        for table in (state, before):
            if table is not None:
                drop_cut(table)
        state, sizes, before, wide = now, counts, wide, centres
        done, rounds = max([0.0, *(1.0 - c for c in cosines)]) <= tol, rounds + 1
    if corrected:
        # Corrected centres keep traces of terms that no member has any more.
        wide = cut(_divided(_sums(_matched(laid, _labels(state), sum(sizes)), k), sizes, before))
        norms = _norms(wide, k)
    assigned = cut(_nearest(_scored(laid, wide, norms)))
    return Clusters(_long(wide, k), assigned, rounds, done, scored, changed)


def _rescored(
    laid: LaidOut, state: DataFrame | None, wide: DataFrame, norms: list[float], cosines: list[float] | None, n_docs: int
) -> tuple[DataFrame, int | None]:
    """The state of the next round with the ``old`` labels, a written table, and how many documents were scored (all: None)."""
    if state is None:
        return cut(_scored(laid, wide, norms).withColumn("old", F.col("cluster_id"))), None
    labels = state.select("doc_id", F.col("cluster_id").alias("old"))
    if cosines is not None:
        aged = _aged(state, cosines).withColumn("old", F.col("cluster_id")).withColumn("settled", _settled())
        n_stale = aged.filter(~F.col("settled")).count()
        if n_stale <= ANEW * n_docs:
            stale = _small(aged.filter(~F.col("settled")).select("doc_id", "old"), n_stale)
            rows = _matched(laid, stale.select("doc_id"), n_stale, "left_semi")
            again = _scored(laid, wide, norms, rows).join(stale, "doc_id")
            return cut(aged.filter("settled").drop("settled").unionByName(again)), n_stale
    return cut(_scored(laid, wide, norms).join(_small(labels, n_docs), "doc_id")), None


def _small(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of ids and labels, ``n`` of them, broadcast if they are few or their measured bytes fit."""
    return F.broadcast(rows) if n <= FEW or fits_broadcast(rows) else rows


def _matched(laid: LaidOut, rows: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """The postings joined with ``rows`` of their documents, ``n`` of them; the postings stay where they are."""
    if n <= FEW or fits_broadcast(rows):
        return laid.rows.join(F.broadcast(rows), "doc_id", how)
    return laid.rows.join(laid.beside(rows).hint("shuffle_hash"), [PART, "doc_id"], how)


def _corrected(
    laid: LaidOut, moved: DataFrame, n_moved: int, wide: DataFrame, sizes: list[int], counts: list[int]
) -> DataFrame:
    """Wide means after the documents ``moved (doc_id, old, cluster_id)``, from the means of ``sizes`` members before."""
    k = len(sizes)
    ends = F.array(
        F.struct("cluster_id", F.lit(1.0).alias("sign")), F.struct(F.col("old").alias("cluster_id"), F.lit(-1.0).alias("sign"))
    )
    delta = _sums(_matched(laid, moved.select("doc_id", F.inline(ends)), 2 * n_moved), k)
    delta = delta.select("term", *[F.col(c).alias(f"d_{c}") for c in _columns(k)])
    added = [
        (F.coalesce(c, F.lit(0.0)) * float(n) + F.coalesce(f"d_{c}", F.lit(0.0))).alias(c) for c, n in zip(_columns(k), sizes)
    ]
    return _divided(wide.join(delta, "term", "left").select("term", *added), counts, wide)


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """``(cluster_id, n_docs, n_clusters)``; the row without a cluster_id holds the totals."""
    return assigned.rollup("cluster_id").agg(
        F.count("*").alias("n_docs"), F.count_distinct("cluster_id").alias("n_clusters")
    )


def cluster_top_terms(centres: DataFrame, assigned: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster_id, term, weight, rank)`` for clusters with members.

    A cluster without a centre stays, with an empty term.
    """
    alive = assigned.select("cluster_id").distinct()
    return alive.join(rank_terms(centres, "cluster_id", k), "cluster_id", "left")


def member_top_terms(vectors: DataFrame, assigned: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster_id, doc_id, term, weight, rank)`` for each clustered document."""
    ranked = rank_terms(vectors, "doc_id", k)
    return assigned.select("cluster_id", "doc_id").join(ranked, "doc_id")


def concept_ids(assigned: DataFrame) -> DataFrame:
    """``(cluster_id, doc_id, concept)``: a number that runs on over clusters and members.

    It comes from a range sort, not from a window that would put a cluster into one task.
    """
    placed = dense_index(assigned.select("cluster_id", "doc_id"), ["cluster_id", "doc_id"], "at")
    number = (F.col("at") + 1).cast("string")
    return placed.select(
        "cluster_id",
        "doc_id",
        F.concat(F.col("cluster_id").cast("string"), F.lit("_"), number).alias("concept"),
    )


def cluster_report(
    vectors: DataFrame, centres: DataFrame, assigned: DataFrame, k: int = 10
) -> DataFrame:
    """``(cluster_id, section, doc_id, line)``: the report as ordered lines.

    Order by cluster_id (totals at both ends), section, doc_id. Lines stay rows, so that no
    cluster has to fit into one cell.
    """
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    no_doc = F.lit(None).cast(assigned.schema["doc_id"].dataType)
    first = totals.select(
        F.lit(-1).alias("cluster_id"), F.lit(0).alias("section"), no_doc.alias("doc_id"),
        F.concat(F.lit("Number of clusters: "), F.col("c").cast("string")).alias("line"),
    )
    last = totals.select(
        F.lit(2**31 - 1).alias("cluster_id"), F.lit(9).alias("section"), no_doc.alias("doc_id"),
        F.concat(F.lit("Number of clustered documents: "), F.col("n").cast("string")).alias("line"),
    )
    heads = sizes.select(
        "cluster_id", F.lit(1).alias("section"), no_doc.alias("doc_id"),
        F.format_string("Cluster %d (%d)", "cluster_id", "n").alias("line"),
    )
    named = top_terms_text(rank_terms(centres, "cluster_id", k), "cluster_id")
    tops = sizes.join(named, "cluster_id", "left").select(
        "cluster_id", F.lit(2).alias("section"), no_doc.alias("doc_id"),
        F.concat(F.lit("TopTerms: "), F.coalesce("top_terms", F.lit("[]"))).alias("line"),
    )
    each = top_terms_text(rank_terms(vectors, "doc_id", k), "doc_id")
    name = F.regexp_replace(F.col("doc_id").cast("string"), "^/", "")
    padded = F.when(F.length(name) < 40, F.rpad(name, 40, " ")).otherwise(name)
    members = assigned.select("cluster_id", "doc_id").join(each, "doc_id").select(
        "cluster_id", F.lit(3).alias("section"), "doc_id",
        F.concat(F.lit("  "), padded, F.lit(":"), F.col("top_terms")).alias("line"),
    )
    return first.unionByName(heads).unionByName(tops).unionByName(members).unionByName(last)
