"""Every registered query as it is registered, on whole small tables: against its SQL, or against a plain version."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import bpe, hilbert, packing, quality, rans, simhash, toxicity
from pagewright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_text_ops import best_fit_brute, near_brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = QUERIES[name](spark, DIR)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall())) and sorted(names) == sorted(got.columns)


def test_op1(spark, documents):
    got = QUERIES["op1_bpe"](spark, DIR).collect()
    assert len(got) == len(documents) and all(r.round_trip for r in got)
    texts = [documents[r.doc_id].text for r in got]
    assert bpe.Encoder(bpe.read_vocabulary()).encode(texts) == [r.tokens for r in got]


def test_op2(spark, documents):
    rows = sorted((i, r.text) for i, r in documents.items())
    ids = [i for i, _ in rows]
    want = sorted((ids[i], ids[c], n) for i, c, n in near_brute(rows, simhash.MAX_BITS))
    assert sorted(map(tuple, QUERIES["op2_simhash_near_dedup"](spark, DIR).collect())) == want


def test_op5(spark, documents):
    fill, size = Counter(), Counter()
    for r in QUERIES["op5_best_fit_packing"](spark, DIR).collect():
        fill[r.bin_id] += r.size
        size[r.doc_id] += r.size
    sizes = {i: len(r.text.encode()) for i, r in documents.items() if r.text}
    assert size == Counter(sizes) and max(fill.values()) <= packing.CAPACITY
    rests = [s % packing.CAPACITY for s in sizes.values() if s % packing.CAPACITY]
    full = sum(s // packing.CAPACITY for s in sizes.values())
    assert sorted(fill.values()) == sorted(best_fit_brute(rests, packing.CAPACITY) + [packing.CAPACITY] * full)  # one group, hence plain best fit


def test_op6_and_op9(spark, documents):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scores = toxicity._Scores(model.weights)
    want = set()
    for i, r in documents.items():
        p, parts = toxicity.located(r.text, scores, model.bias)
        if p >= model.threshold:
            worst = max(x[3] for x in parts)
            want |= {(i, k) for k, _, _, q in parts if q >= 0.5 or q == worst}
    assert {(r.doc_id, r.sentence_no) for r in QUERIES["op6_toxicity"](spark, DIR).collect()} == want
    kept = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, DIR).collect()}
    ranked = quality.train(docs, labels)
    all_scores = dict(zip(documents, ranked.scores([r.text for r in documents.values()])))
    assert kept == {i: s for i, s in all_scores.items() if s >= ranked.threshold}


def test_op7(spark, documents):
    blocks = QUERIES["op7_token_binary"](spark, DIR)
    tokens = {r.doc_id: r.tokens for r in bpe.encode(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    values, counts = np.unique(np.concatenate(list(tokens.values())), return_counts=True)
    table = rans.FrequencyTable.of(values, counts, rans.MOST_PRECISION)
    assert {r.doc_id: r.tokens for r in rans.decode_blocks(blocks, table).collect()} == tokens


def test_op8(spark, documents):
    got = QUERIES["op8_hilbert_sharding"](spark, DIR).collect()
    assert {r.doc_id: (r.text, r.source, r.lang, r.n_chars) for r in got} == {i: (r.text, r.source, r.lang, r.n_chars) for i, r in documents.items()}
    assert len(got) == len(documents) and sum(len((r.text or "").encode()) + 1 for r in got) <= hilbert.SHARD_BYTES and {r.shard_id for r in got} == {0}
    place = {}
    for r in got:  # a place for each cell, hence for each source and language within a level of the size
        place.setdefault((r.source, r.lang, r.n_chars), set()).add(r.hilbert)
    assert all(len(p) == 1 for p in place.values())


def test_op10(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    got = {}
    for r in QUERIES["op10_mih_neighbours"](spark, DIR).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {ids[k] for k in asked} and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[ids[k]] & set(ids[np.argsort(-s[k])[:10]])) / 10 for k in asked]) >= 0.9


def test_pipeline_agrees_with_its_stages_done_plainly(spark, documents, tmp_path):
    """Each stage's decisions by plain Python over what the stage before kept."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    now = dict(documents)
    frame = lambda: spark.createDataFrame([tuple(r) for r in now.values()], schema)
    model = toxicity.train(frame(), labels)
    scores = toxicity._Scores(model.weights)
    now = {i: r for i, r in now.items() if toxicity.located(r.text, scores, model.bias)[0] < model.threshold}
    ranked = quality.train(frame(), labels)
    now = {i: r for i, r in now.items() if ranked.scores([r.text])[0] >= ranked.threshold}
    first = {}
    for i in sorted(now):
        first.setdefault(now[i].text, i)
    now = {i: now[i] for i in first.values()}
    rows = sorted((i, r.text) for i, r in now.items())
    drop = {rows[i][0] for i, c, _ in near_brute(rows) if i != c}
    size = Counter()
    for r in corpus_pipeline.run(spark, DIR).collect():
        size[r.doc_id] += r.size
    assert size == Counter({i: len(r.text.encode()) for i, r in now.items() if i not in drop and r.text})


def test_pipeline_over_awkward_and_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, doc_score double, SCORE2 int, text_ string"
    long = "Some wörds in a long text, over and over. " * 9000
    rows = [(1, "same text here", "en"), (1, "same text here", "en"), (2, None, None), (3, "", "en"), (4, "", "de"), (None, "same text here", "en"), (None, None, None), (5, long, "en"), (6, long, "en"), (7, "   ", "en")]
    full = [(*r, "s", len(r[1] or ""), "x", 1.0, 2.0, 3, "y") for r in rows]
    for name, docs, known in (("awkward", full, [(1, 1, 0), (2, None, None), (None, 1, 1), (99, 0, 1)]), ("empty", [], [])):
        spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        size = Counter()
        for r in out:
            size[r.doc_id] += r.size
        assert size == (Counter({1: 14, 5: len(long.encode()), 7: 3}) if docs else Counter())
