import random

import pytest
from pyspark.sql import functions as F

from doccat.operators import cluster as cl
from doccat.operators import evaluate as ev
from doccat.operators import scale
from doccat.operators import vectors as vc
from doccat.plans import jobs
from test_vectors import SMALL, brute, docs_of


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, cluster_id int, distance double")


@pytest.fixture(scope="module")
def small(spark):
    return scale.cut(vc.vectorize(docs_of(spark, SMALL), []).vectors)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    topics = [["lac", "rive", "eau", "pont"], ["route", "rue", "tram", "gare"], ["forêt", "arbre", "sol", "parc"]]
    texts = ["lac rive lac"] * 20
    texts += [" ".join(rng.choices(rng.choice(topics), k=rng.randint(1, 8))) for _ in range(39)]
    texts.append("isolé")
    return scale.cut(vc.vectorize(docs_of(spark, [(f"d{i:02d}", t) for i, t in enumerate(texts)]), []).vectors)


def test_quality_fixture(spark, small):
    assigned = labels(spark, [("d1", 0, 0.1), ("d2", 0, 0.1), ("d3", 1, 0.0)])
    centres = cl.centroids(small, assigned, 2)
    found = {(r["cluster_id"], r["term"]): r["w"] for r in centres.collect()}
    assert found[0, "forêt"] == pytest.approx(0.317560, abs=1e-6)
    assert found[0, "zone"] == pytest.approx(0.672426, abs=1e-6)
    q = ev.cluster_quality(ev.inter_cluster(centres), ev.intra_cluster(small, assigned)).first()
    assert q["min_inter"] == pytest.approx(0.770266, abs=1e-6)
    assert q["max_intra"] == pytest.approx(0.498969, abs=1e-6)
    assert q["dunn_index"] == pytest.approx(1.543714, abs=1e-5)
    assert q["avg_intra"] == pytest.approx(1.0)


def test_undefined_figures_are_null(spark, small):
    alone = labels(spark, [("d1", 0, 0.0), ("d2", 1, 0.0), ("d3", 2, 0.0)])
    intra = ev.intra_cluster(small, alone)
    assert {(r["density"], r["min_intra"], r["max_intra"]) for r in intra.collect()} == {(1.0, 0.0, 0.0)}
    centres = cl.centroids(small, labels(spark, [("d1", 0, 0.0), ("d2", 0, 0.0), ("d3", 0, 0.0)]), 1)
    q = ev.cluster_quality(ev.inter_cluster(centres), intra).first()
    assert q["avg_inter"] is None and q["dunn_index"] is None


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_intra_equals_brute_force(spark, mixed, block_rows):
    docs = [r[0] for r in mixed.select("doc_id").distinct().orderBy("doc_id").collect()]
    assigned = labels(spark, [(d, 1 if i % 5 == 0 else 0 if i < 50 else 2, 0.0) for i, d in enumerate(docs)])
    cluster = {r["doc_id"]: r["cluster_id"] for r in assigned.collect()}
    cos = brute([tuple(r) for r in mixed.select("doc_id", "term", "w").collect()])
    for row in ev.intra_cluster(mixed, assigned, block_rows).collect():
        members = sorted(d for d in docs if cluster[d] == row["cluster_id"])
        gaps = [1 - cos.get((a, b), 0.0) for i, a in enumerate(members) for b in members[i + 1 :]]
        low, high = max(min(gaps), 0.0), max(gaps)
        mean = sum(gaps) / len(gaps)
        assert row["n_docs"] == len(members)
        assert row["min_intra"] == pytest.approx(low, abs=1e-9)
        assert row["max_intra"] == pytest.approx(high, abs=1e-9)
        assert row["density"] == pytest.approx((mean - low + 1e-6) / (high - low + 1e-6), abs=1e-6)


def test_kmeans_labels_every_document_once_and_repeats(spark, mixed, monkeypatch):
    fit = cl.kmeans_fit(mixed, 4, seed=5)
    assert 1 <= fit.iterations <= 20
    rows = fit.assigned.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 60
    assert {r["cluster_id"] for r in rows} <= set(range(4))
    assert fit.centroids.select("cluster_id").distinct().count() == 4
    totals = cl.cluster_sizes(fit.assigned).filter("cluster_id IS NULL").first()
    assert totals["n_docs"] == 60
    # Labels are nearest to the final centres, and the shuffled join gives the same ones.
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    again = {r["doc_id"]: r["cluster_id"] for r in cl.assign_clusters(mixed, fit.centroids, 4).collect()}
    assert again == {r["doc_id"]: r["cluster_id"] for r in rows}


def test_objective_falls(spark, mixed):
    totals = []
    for rounds in (1, 2, 4):
        fit = cl.kmeans_fit(mixed, 3, max_iter=rounds, tol=-1.0, seed=1)
        totals.append(fit.assigned.agg(F.sum("distance")).first()[0])
    assert totals[2] <= totals[0] * 1.05


def test_empty_cluster_keeps_its_centre(spark, small):
    first = labels(spark, [("d1", 0, 0.0), ("d2", 0, 0.0), ("d3", 1, 0.0)])
    old = cl.centroids(small, first, 2)
    all_in_one = labels(spark, [("d1", 0, 0.0), ("d2", 0, 0.0), ("d3", 0, 0.0)])
    new = cl.centroids(small, all_in_one, 2, old)
    kept = new.filter("cluster_id = 1").exceptAll(old.filter("cluster_id = 1"))
    assert kept.count() == 0 and new.filter("cluster_id = 1").count() == 2
    assert cl.centroids(small, all_in_one, 2).filter("cluster_id = 1").count() == 0


def test_concepts_run_on_over_clusters(spark):
    assigned = labels(spark, [("b", 0, 0.0), ("a", 0, 0.0), ("c", 2, 0.0)])
    found = {r["doc_id"]: r["concept"] for r in cl.concept_ids(assigned).collect()}
    assert found == {"a": "0_1", "b": "0_2", "c": "2_3"}


def test_report_never_cuts_a_name(spark, small):
    long = "n" * 50
    vectors = small.withColumn("doc_id", F.when(F.col("doc_id") == "d1", long).otherwise(F.col("doc_id")))
    assigned = labels(spark, [(long, 0, 0.0), ("d2", 0, 0.0), ("d3", 1, 0.0)])
    report = cl.cluster_report(vectors, cl.centroids(vectors, assigned, 2), assigned)
    lines = [r["line"] for r in report.orderBy("cluster_id", "section", "doc_id").collect()]
    assert lines[0] == "Number of clusters: 2" and lines[-1] == "Number of clustered documents: 3"
    assert "Cluster 0 (2)" in lines
    assert any(x.startswith(f"  {long}:[") for x in lines)
    assert any(x.startswith("  d2" + " " * 38 + ":[") for x in lines)


def test_jobs_write_valid_turtle_and_all_tables(spark, tmp_path):
    docs = docs_of(spark, [("/a.txt", 'zone "zone" forêt'), ("/b.txt", "zone route"), ("/c.txt", "route pont pont")])
    out = str(tmp_path / "similar")
    for _ in range(2):
        jobs.job_similar(docs, out)
    assert spark.read.parquet(f"{out}/similar").count() == 4
    assert spark.read.parquet(f"{out}/steps/dictionary").count() == 4
    files = [p for p in (tmp_path / "similar" / "turtle").iterdir() if p.name.startswith("part-")]
    lines = []
    for file in files:
        text = file.read_text(encoding="utf-8").splitlines()
        if text:
            assert text[0].startswith("@prefix rdf:") and text[1].startswith("@prefix skos:")
            lines += text[2:]
    assert all(line.startswith("<http") and line.endswith(" .") for line in lines)
    assert sum("skos:related" in line for line in lines) == 4
    assert sum("rdf:type skos:Concept" in line for line in lines) == 3
    report = "\n".join(r["value"] for r in spark.read.text(f"{out}/report").collect())
    assert "b.xml : " in report and "   a.xml: 0.5" in report

    out = str(tmp_path / "cluster")
    result = jobs.job_cluster(docs, out, k=2, max_df_percent=100)
    name = "clusters_2_2_1_1_100"
    assert spark.read.parquet(f"{out}/{name}/members").count() == 3
    assert result.quality.count() == 1
    assert spark.read.text(f"{out}/{name}/turtle").filter("value LIKE '%skos:member%'").count() == 3


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        scale.checkpoint_folder(Session)


@pytest.mark.parametrize("k, seed", [(1, 1), (4, 5), (9, 8)])
def test_bounds_do_not_change_the_labels(spark, mixed, monkeypatch, k, seed):
    """After every number of rounds, with all centres corrected and every document picked out that may change."""
    monkeypatch.setattr(cl, "ANEW", 1.0)
    monkeypatch.setattr(cl, "PATCHED", 1.0)
    for rounds in (3, 20):
        plain = cl.kmeans_fit(mixed, k, rounds, seed=seed, bounds=False)
        fast = cl.kmeans_fit(mixed, k, rounds, seed=seed)
        assert fast.iterations == plain.iterations and fast.converged == plain.converged

        def shown(fit):
            labels = {(r["doc_id"], r["cluster_id"]): pytest.approx(r["distance"], abs=1e-9) for r in fit.assigned.collect()}
            return labels, {(r["cluster_id"], r["term"]): pytest.approx(r["w"], abs=1e-9) for r in fit.centroids.collect()}

        assert shown(fast) == shown(plain)
    assert fast.scored[0] == fast.moved[0] == plain.scored[-1] and fast.moved[1:] == plain.moved[1:]


def test_settled_documents_are_not_scored_again(spark):
    """Three groups without a common term: once the centres stand still, nobody is compared."""
    texts = [(f"d{g}{i}", f"{w} {w} {w}{i % 3}") for g, w in enumerate(("lac", "rue", "parc")) for i in range(12)]
    vectors = scale.cut(vc.vectorize(docs_of(spark, texts), []).vectors)
    fit = cl.kmeans_fit(vectors, 3, 6, tol=-1.0, seed=3)
    assert fit.iterations == 6 and fit.scored[0] == 36 and fit.moved[-1] == 0 and fit.scored[-1] < 36


def test_postings_stay_where_they_are_beyond_the_broadcast_limit(spark, mixed, monkeypatch):
    """Centres too large for a broadcast come to the parts; the postings take part in no further shuffle."""
    plain = cl.kmeans_fit(mixed, 4, 5, tol=-1.0, seed=5)
    expected = {r["doc_id"]: (r["cluster_id"], pytest.approx(r["distance"], abs=1e-9)) for r in plain.assigned.collect()}
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(cl, "FEW", 0)
    monkeypatch.setattr(cl, "PART_ROWS", 20)
    found = cl.kmeans_fit(mixed, 4, 5, tol=-1.0, seed=5)
    assert {r["doc_id"]: (r["cluster_id"], r["distance"]) for r in found.assigned.collect()} == expected
    laid = cl._lay_out(mixed)
    wide = scale.cut(cl._wide(plain.centroids, 4))
    with scale.by_part(spark):
        plan = cl._scored(laid, wide, cl._norms(wide, 4))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(_part" in line for line in moved) == 2 and not any("doc_id#" in line for line in moved)


@pytest.mark.parametrize("layout", [True, False])
def test_members_are_not_sent_to_every_block(spark, monkeypatch, capsys, layout):
    """Blocks of a cluster are read from a table; extremes are those of all pairs, whether few or many documents may share few terms."""
    rng = random.Random(5)
    words = [a + b + "ot" for a in "bcdfg" for b in "aeiou"]
    texts = [(i, "partout ailleurs " + " ".join(rng.choices(words, k=9))) for i in range(90)] + [(200, "seul"), (201, "partout"), (202, "partout")]
    vectors = vc.vectorize(docs_of(spark, [(str(i), t) for i, t in texts]), []).vectors
    if not layout:
        vectors = scale.cut(vectors)
    labels = scale.cut(vectors.select("doc_id").distinct().selectExpr("doc_id", "CAST(doc_id AS INT) % 3 AS cluster_id"))
    docs, cluster = {}, {r["doc_id"]: r["cluster_id"] for r in labels.collect()}
    for r in vectors.collect():
        docs.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    norm = {d: sum(w * w for w in v.values()) ** 0.5 for d, v in docs.items()}
    gaps = {}
    for a in docs:
        for b in docs:
            if a < b and cluster[a] == cluster[b]:
                dot = sum(w * docs[b].get(t, 0.0) for t, w in docs[a].items())
                gaps.setdefault(cluster[a], []).append(1 - dot / (norm[a] * norm[b]))
    for share in (ev.HOT_SHARE, 2):
        monkeypatch.setattr(ev, "HOT_SHARE", share)
        found = ev.intra_cluster(vectors, labels, 8)
        got = {r["cluster_id"]: (r["min_intra"], r["max_intra"]) for r in found.collect()}
        assert got == {c: (pytest.approx(min(g), abs=1e-9), pytest.approx(max(g), abs=1e-9)) for c, g in gaps.items()}
    capsys.readouterr()
    found.explain()
    assert "CartesianProduct" in capsys.readouterr().out
