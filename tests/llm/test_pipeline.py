"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from test_operators import brute_components, brute_fingerprint, brute_repeats, brute_spans

import corpus_pipeline
from doccat.llm import decontam, queries
from doccat.llm.common import PieceEncoder
from doccat.operators.scale import cut

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_quality_of_many_and_missing_languages(spark, tmp_path):
    """Forty languages, null and unknown ones, and spoiled texts: the verdicts are those of the SQL."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    k = F.col("doc_id") % 100
    lang = F.when(k % 5 == 0, None).when(k % 7 == 0, F.concat(F.lit("rare"), "doc_id")).otherwise(F.concat("lang", (k % 10).cast("string")))
    text = F.when(k % 20 == 3, F.translate("text", "aeiou .", "#$7%|X-")).when(k == 50, None).otherwise(F.col("text"))
    made = docs.select("doc_id", text.alias("text"), lang.alias("lang"), "source", "n_chars")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert made.select("lang").distinct().count() > 40
    assert compare(spark, con, str(tmp_path), queries.QUERIES["op1_divergence"], queries.ORACLES["op1_divergence"]) is None


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_suffix_query(spark, documents):
    got = sorted(tuple(r) for r in queries.QUERIES["op8_suffix"](spark, SF_DIR).collect())
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert got == sorted(brute_repeats(rows))


def test_simhash_query(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op3_simhash"](spark, SF_DIR).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    low = brute_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, low)}


def test_language_query(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_byte_cnn"](spark, SF_DIR).collect()}
    held = [r for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_pipeline_stages(spark, documents):
    con = connect(SF_DIR)
    docs, columns = documents, documents.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontaminate", "remove_pii", "pack_sequences"]

    good = cut(stages["quality_rules"](spark, docs, SF_DIR))
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op1_divergence']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == columns and 0 < len(kept) < docs.count()

    one = cut(stages["near_dedup"](spark, good, SF_DIR))
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    low = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert {r["doc_id"] for r in one.collect()} == set(low) and one.columns == columns

    clean = cut(stages["decontaminate"](spark, one, SF_DIR))
    index = decontam.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    fine = set()
    for r in one.collect():
        h = decontam.hashes_of(decontam.words_of(r["text"]))
        found = [
            k for k, c in enumerate(index.counts) if c.keys() & set(h.tolist())
            and max(index.similarity(k, h[s : s + c.total()]) for s in range(max(1, len(h) - c.total() + 1))) >= 0.8
        ]
        if not found:
            fine.add(r["doc_id"])
    assert {r["doc_id"] for r in clean.collect()} == fine and clean.columns == columns

    private = cut(stages["remove_pii"](spark, clean, SF_DIR))
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in private.collect():
        text, at, parts = before[r["doc_id"]], 0, []
        for kind, start, end in brute_spans(text):
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert r["text"] == "".join([*parts, text[at:]]) and r["n_chars"] == len(r["text"])
    assert private.count() == len(before) and private.columns == columns

    packed = stages["pack_sequences"](spark, private, SF_DIR).toPandas()
    encode = PieceEncoder(queries.vocabulary("word_bpe_49k.json"), False).encode
    pieces = set()
    for r in private.collect():
        ids = np.append(encode(r["text"]), 1).astype("<u4")
        for s in range(0, len(ids), 2048):
            pieces.add((r["doc_id"], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert set(packed[key].itertuples(index=False, name=None)) == pieces and len(packed) == len(pieces)
    by = packed.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 2048
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(whole[key].itertuples(index=False, name=None)) == pieces
