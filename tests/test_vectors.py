import math
import random

import pytest
from pyspark.sql import functions as F

from doccat.operators import scale
from doccat.operators import similar as sm
from doccat.operators import vectors as vc

SMALL = [("d1", "zone zone forêt"), ("d2", "zone route"), ("d3", "route pont pont")]


def docs_of(spark, rows, id_type="string"):
    return spark.createDataFrame(rows, f"doc_id {id_type}, text string")


def test_tfidf_fixture(spark):
    vectors = vc.vectorize(docs_of(spark, SMALL), []).vectors
    found = {(r["doc_id"], r["term"]): r["w"] for r in vectors.collect()}
    expected = {
        ("d1", "zone"): 0.637746, ("d1", "forêt"): 0.635119, ("d2", "zone"): 0.707107,
        ("d2", "route"): 0.707107, ("d3", "route"): 0.449436, ("d3", "pont"): 0.709660,
    }
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_pruning(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 10)], "term string, df long")
    kept = {r["term"]: r["df_used"] for r in vc.df_prune(df, 10, min_df=3, max_df_percent=50).collect()}
    assert kept == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        vc.df_prune(df, 10, min_df=11)


def test_min_support(spark):
    tf = vc.tf_vectors(docs_of(spark, SMALL), [], min_support=3)
    assert {r["term"] for r in tf.collect()} == {"zone"}


def test_dictionary_is_dense_and_sorted(spark):
    words = [(f"w{i:05d}",) for i in range(3000)]
    random.Random(1).shuffle(words)
    rows = vc.dictionary(spark.createDataFrame(words, "term string").repartition(7)).collect()
    assert sorted((r["term_id"], r["term"]) for r in rows) == list(enumerate(w for (w,) in sorted(words)))


def test_salted_join_equals_plain_join(spark):
    fact = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("d")
    )
    dim = fact.groupBy("k").agg(F.count("*").alias("n"))
    salted = scale.salted_join(fact, dim, "k", spread="d", weight="n", salts=8, share=10)
    plain = fact.join(dim, "k")
    assert salted.exceptAll(plain).count() == 0 and salted.count() == 5000


def test_vectors_are_the_same_beyond_the_broadcast_limit(spark, monkeypatch):
    docs = docs_of(spark, [(i, "commun " + "abcdefg"[i % 7] * 4 + " " + "vwxyz"[i % 5] * 3 + " rare" + "abcdefghij"[i % 10] * (1 + i // 10)) for i in range(60)], "long")
    plain = scale.cut(vc.vectorize(docs, [], max_ngram=2).vectors)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    salted = vc.vectorize(docs, [], max_ngram=2).vectors
    rounded = [F.round("w", 9).alias("w"), "doc_id", "term"]
    assert salted.select(*rounded).exceptAll(plain.select(*rounded)).count() == 0
    assert salted.count() == plain.count()


def test_vector_text_and_rank(spark):
    v = spark.createDataFrame(
        [("d", "zone industrielle", 0.4), ("d", "zone", 0.3), ("d", "Arbre", 0.4)], "doc_id string, term string, w double"
    )
    assert [(r["term"], r["weight"]) for r in vc.rank_terms(v, "doc_id").orderBy("rank").collect()] == [
        ("Arbre", 0.4), ("industrielle", 0.4), ("zone", 0.4),
    ]
    whole = vc.rank_terms(v, "doc_id", 2, shingles=False)
    assert vc.top_terms_text(whole, "doc_id").first()["top_terms"] == "[Arbre=0.4, zone industrielle=0.4]"
    assert vc.vector_text(v).first()["line"] == "d = {Arbre: 0.4, zone: 0.3, zone industrielle: 0.4}"


def brute(rows):
    """Cosines of all pairs from rows of (doc_id, term, w)."""
    docs = {}
    for doc, term, w in rows:
        docs.setdefault(doc, {})[term] = w
    norm = {d: math.sqrt(sum(w * w for w in v.values())) for d, v in docs.items()}
    cos = {}
    for a in docs:
        for b in docs:
            shared = docs[a].keys() & docs[b].keys()
            if a != b and shared:
                cos[a, b] = sum(docs[a][t] * docs[b][t] for t in shared) / (norm[a] * norm[b])
    return cos


def top(cos, k):
    best = {}
    for (a, b), c in cos.items():
        best.setdefault(a, []).append((-round(c, 9), b))
    return {
        (a, b, rank): pytest.approx(-c, abs=2e-9)
        for a, near in best.items()
        for rank, (c, b) in enumerate(sorted(near)[:k], 1)
    }


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the documents are copies, and one term is in nearly all documents."""
    rng = random.Random(7)
    words = [a + b + "ot" for a in "bcdfglmp" for b in "aeiou"]
    texts = ["copie conforme partout"] * 30
    texts += ["partout " + " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(55)]
    texts += ["seul unique", "", "partout"]
    rng.shuffle(texts)
    docs = docs_of(spark, [(i * 3, t) for i, t in enumerate(texts)], "long")
    return scale.cut(vc.vectorize(docs, []).vectors)


@pytest.mark.parametrize("method, block_rows", [("blocks", 1024), ("blocks", 8), ("terms", 1024), ("auto", 1024)])
def test_similar_equals_brute_force(spark, skewed, monkeypatch, method, block_rows):
    monkeypatch.setattr(sm, "STRETCH", 7)
    if method == "terms":
        monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    expected = top(brute([tuple(r) for r in skewed.select("doc_id", "term", "w").collect()]), 5)
    found = sm.similar_topk(skewed, 5, method, block_rows).collect()
    assert {(r["doc_id"], r["other_id"], r["rank"]): r["cosine"] for r in found} == expected


@pytest.mark.parametrize("method", ["blocks", "terms", "auto"])
@pytest.mark.parametrize("rows, tile", [(16_384, 2048), (5, 4)])
def test_search_equals_brute_force(spark, skewed, monkeypatch, method, rows, tile):
    """Queries are copies, members of a set under another id, and single documents; the others are only found."""
    monkeypatch.setattr(sm, "SEARCH_ROWS", rows)
    expected = top(brute([tuple(r) for r in skewed.select("doc_id", "term", "w").collect()]), 5)
    found = sm.similar_topk(skewed, 5, method, tile, F.col("doc_id") % 7 == 0).collect()
    wanted = {key: c for key, c in expected.items() if key[0] % 7 == 0}
    assert wanted and {(r["doc_id"], r["other_id"], r["rank"]): r["cosine"] for r in found} == wanted
    assert sm.similar_topk(skewed, 5, method, tile, F.lit(False)).count() == 0


def test_similar_fixture(spark):
    similar = sm.similar_topk(vc.vectorize(docs_of(spark, SMALL), []).vectors)
    found = {(r["doc_id"], r["other_id"]): r["cosine"] for r in similar.collect()}
    assert found == {
        ("d1", "d2"): pytest.approx(0.501031, abs=1e-6), ("d2", "d1"): pytest.approx(0.501031, abs=1e-6),
        ("d2", "d3"): pytest.approx(0.378330, abs=1e-6), ("d3", "d2"): pytest.approx(0.378330, abs=1e-6),
    }


def expanded(vectors):
    """All pairs that ``cosine_pairs`` and ``cosine_sets`` stand for, both ways."""
    members = {}
    for r in sm.cosine_sets(vectors).collect():
        members.setdefault(r["rep"], []).append(r["doc_id"])
    out = {(x, y): 1.0 for m in members.values() for x in m for y in m if x != y}
    for r in sm.cosine_pairs(vectors, 0.0).collect():
        assert (r["n_a"], r["n_b"]) == (len(members[r["a"]]), len(members[r["b"]]))
        for x in members[r["a"]]:
            for y in members[r["b"]]:
                out[x, y] = out[y, x] = r["cosine"]
    return out


def test_pairs_cover_all_documents_through_their_copies(spark, skewed):
    rows = [tuple(r) for r in skewed.select("doc_id", "term", "w").collect()]
    assert expanded(skewed) == {k: pytest.approx(v) for k, v in brute(rows).items()}


def test_pairs_of_documents_with_terms_of_their_own(spark):
    """Documents that share a term are not equal if each has another one that nobody else has."""
    rows = [(d, t, 1.0) for d, own in ((1, "x"), (2, "y"), (3, "z")) for t in ("a", own)]
    vectors = spark.createDataFrame(rows, "doc_id long, term string, w double")
    assert expanded(vectors) == {(a, b): pytest.approx(0.5) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    more = rows + [(d, t, 1.0) for d in (4, 5) for t in ("a", "b")]
    found = expanded(spark.createDataFrame(more, "doc_id long, term string, w double"))
    assert len(found) == 20 and found[4, 5] == pytest.approx(1.0) and found[1, 2] == pytest.approx(0.5)


@pytest.fixture(scope="module")
def near_copies(spark):
    """Texts with a few words changed, next to copies and to texts that share one frequent word."""
    rng = random.Random(11)
    words = [a + b + "ot" for a in "bcdfglmp" for b in "aeiou"]
    texts = ["copie conforme partout"] * 20
    for _ in range(12):
        text = rng.choices(words, k=rng.randint(3, 25))
        for _ in range(rng.randint(1, 6)):
            texts.append("partout " + " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in text))
    vectors = vc.vectorize(docs_of(spark, [(i * 3, t) for i, t in enumerate(texts)], "long"), []).vectors
    return scale.cut(vectors)


@pytest.mark.parametrize("bound", [0.3, 0.5, 0.8])
@pytest.mark.parametrize("stretch", [7, 2048])
def test_pairs_above_a_bound_equal_the_full_join(spark, near_copies, monkeypatch, bound, stretch):
    """By rare terms and by blocks; also with long lists cut short and nothing broadcast."""
    monkeypatch.setattr(sm, "STRETCH", stretch)
    if stretch == 7:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)

    def pairs(method):
        found = sm.cosine_pairs(near_copies, bound, method).collect()
        return {(r["a"], r["b"], r["n_a"], r["n_b"]): pytest.approx(r["cosine"]) for r in found}

    whole, rare = pairs("blocks"), pairs("prefix")
    assert rare == whole and whole and pairs("auto") == whole


def test_rare_terms_leave_fewer_pairs(spark):
    """A hundred documents share a frequent term of little weight: none of their pairs is a candidate."""
    rows = [(d, "common", 0.2) for d in range(100)] + [(d, f"own{d % 50}", 1.0) for d in range(100)]
    rows += [(d, f"more{d % 50}", float(1 + d // 50)) for d in range(100)]
    vectors = spark.createDataFrame(rows, "doc_id long, term string, w double")
    postings = scale.cut(sm.indexed_postings(scale.cut(sm._equal_sets(vectors)), 0.5))
    df = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    found = sm.candidate_pairs(postings, df, 0.5).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(d, d + 50) for d in range(50)]
    assert len(sm.cosine_pairs(vectors, 0.5, "prefix").collect()) == 50


@pytest.mark.parametrize("bound, method", [(0.0, "auto"), (0.5, "blocks"), (0.5, "prefix")])
def test_links_count_the_pairs(spark, near_copies, bound, method):
    """Each document has the links of its pairs, copies among them, and they are counted before they leave their tasks."""
    rows = [tuple(r) for r in near_copies.select("doc_id", "term", "w").collect()]
    sets = {r["doc_id"]: (r["rep"], r["n"]) for r in sm.cosine_sets(near_copies).collect()}
    want = {d: [*sets[d], 0, None] for d in sets}
    for (a, b), c in brute(rows).items():
        if c >= bound:
            want[a][2] += 1
            if sets[a][0] != sets[b][0]:
                want[a][3] = max(c, want[a][3] or 0.0)
    found = sm.cosine_pairs(near_copies, bound, method, links=True).collect()
    got = {r["doc_id"]: [r["rep"], r["n"], r["n_links"], r["nearest"]] for r in found}
    assert len(found) == len(got) == len(want)
    assert got == {d: [*w[:3], w[3] and pytest.approx(w[3])] for d, w in want.items()}


def test_pairs_are_not_shuffled(near_copies, capsys):
    """Blocks are read by the tasks that compare them, and no posting pair or copy of a block goes through a shuffle."""
    reps = scale.cut(sm._equal_sets(near_copies).withColumn("n", F.lit(1).cast("long")))
    postings = scale.cut(sm.indexed_postings(reps, 0.5))
    df = scale.cut(postings.groupBy("term_id").agg(F.count("*").alias("df")))
    for found in (sm.candidate_pairs(postings, df, 0.5), sm.cosine_pairs(near_copies, 0.0)):
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("expand", [4, 40, 1 << 22])
def test_candidates_of_postings_in_pieces(spark, near_copies, monkeypatch, expand):
    """Sums of a document go on from one piece of its postings to the next."""
    import pyarrow as pa

    monkeypatch.setattr(sm, "EXPAND", expand)
    reps = sm._equal_sets(near_copies).collect()
    batch = pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "terms": r["terms"], "us": r["us"]} for r in reps])
    posted = sm.indexed(batch, 0.4).to_pylist()
    docs = {}
    for p in posted:
        doc = docs.setdefault(p["doc_id"], {"doc_id": p["doc_id"], "start": p["start"], "rest": p["rest"], "index": []})
        doc["index"].append({k: p[k] for k in ("term_id", "u", "before")})
    side = pa.Table.from_pylist(list(docs.values()))
    pairs = [(i, j) for rows, cols in sm.reaching(side, side, True, 0.4) for i, j in zip(rows.tolist(), cols.tolist())]
    both = [(i, j) for rows, cols in sm.reaching(side, side, False, 0.4) for i, j in zip(rows.tolist(), cols.tolist())]
    ids, wanted = list(docs), brute([tuple(r) for r in near_copies.select("doc_id", "term", "w").collect()])
    found = {(ids[i], ids[j]) for i, j in pairs}
    assert len(found) == len(pairs) and len(both) == len(set(both)) == 2 * len(pairs) + len(ids)
    assert {k for k, c in wanted.items() if c >= 0.4 and set(k) <= set(ids)} <= found | {(b, a) for a, b in found}


def test_pair_dots():
    import numpy as np
    import pyarrow as pa

    from doccat.operators.blocks import dot_block, pair_dots

    rng = np.random.default_rng(3)

    def side(n):
        terms = [np.sort(rng.choice(40, rng.integers(0, 20), replace=False)) for _ in range(n)]
        return pa.table({"terms": pa.array(terms, pa.list_(pa.int64())), "us": pa.array([rng.random(len(t)) for t in terms], pa.list_(pa.float64()))})

    a, b = side(30), side(30)
    whole = np.zeros((2, 30, 40))
    for k, t in enumerate((a, b)):
        for row, (terms, us) in enumerate(zip(t.column("terms").to_pylist(), t.column("us").to_pylist())):
            whole[k, row, terms] = us
    assert np.allclose(dot_block(a, b), whole[0] @ whole[1].T)
    one = pair_dots(*(t.column(c).combine_chunks() for t in (a, b) for c in ("terms", "us")))
    assert np.allclose(one, np.diag(whole[0] @ whole[1].T))


def test_vectors_stay_laid_out_by_document(spark, monkeypatch):
    """Counts and vectors are read back without a shuffle, and tables too large for a broadcast give the same rows."""
    from doccat.operators import blocks, cluster, evaluate

    rng = random.Random(7)
    rows = [(i % 55 if i else None, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", f"w{i % 9}xx"]) for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None), (98, "")], "doc_id long, text string")

    def run():
        made = vc.vectorize(docs, [])
        fit = cluster.kmeans_fit(made.vectors, 3, max_iter=2, tol=-1.0)
        tables = {
            "tf": made.tf, "vectors": made.vectors, "unit": vc.unit(made.vectors).select("doc_id", "term", "u"),
            "top": vc.rank_terms(made.vectors, "doc_id"), "text": vc.vector_text(made.vectors),
            "packed": blocks.pack(made.vectors).selectExpr("doc_id", "size(terms) AS n", "self_dot"),
            "labels": fit.assigned, "intra": evaluate.intra_cluster(made.vectors, fit.assigned),
        }
        return made, {n: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect()), key=repr) for n, t in tables.items()}

    made, broadcast = run()
    for table in (made.tf, made.vectors):
        rows, key = scale.laid_rows(table)
        plan = rows.groupBy(*key).count()._jdf.queryExecution().executedPlan().toString()
        assert key == [scale.PART, "doc_id"] and "Exchange" not in plan and "Scan parquet" in plan
    laid = made.vectors.laid
    dealt = laid.beside(spark.range(4000).withColumnRenamed("id", "doc_id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == laid.parts and max(r[1] for r in dealt) < 2 * 4000 / laid.parts
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("doccat_")]
    assert len({r[0] for r in broadcast["tf"]}) == 56 and all(broadcast.values())
    plain = vc.log_normalize(vc.tfidf(made.tf.select("*"), made.pruned, made.n_docs)).collect()
    assert sorted(((r[0], r[1], round(r[2], 9)) for r in plain), key=repr) == broadcast["vectors"]
    monkeypatch.setattr(scale, "BROADCAST_BYTES", -1)
    assert run()[1] == broadcast


@pytest.mark.parametrize("method", ["blocks", "terms"])
def test_pairs_of_a_search_are_summed_where_blocks_meet(spark, skewed, monkeypatch, method):
    """Too many pairs for a shuffle, and a task that folds what it has found after each two blocks."""
    from doccat.operators import blocks

    monkeypatch.setattr(sm, "PAIR_ROWS", 0)
    monkeypatch.setattr(sm, "_near_by_terms", None)
    monkeypatch.setattr(blocks, "FOLD_ROWS", 1)
    rows = [tuple(r) for r in skewed.select("doc_id", "term", "w").collect()]
    found = sm.similar_topk(skewed, 5, method, 8).collect()
    assert {(r["doc_id"], r["other_id"], r["rank"]): r["cosine"] for r in found} == top(brute(rows), 5)
    reps = scale.cut(blocks.pack(skewed))
    near = sm._near_by_blocks(reps, 9, 5, method == "blocks").collect()
    assert len(near) <= 9 * 5 * reps.count()
