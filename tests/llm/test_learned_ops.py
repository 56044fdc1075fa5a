"""Toxicity, quality and neighbour search: held-out accuracy, recall against brute force, and the cases that are defined
apart; the pipeline over a small folder of tables, stage by stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import mih, packing, quality, toxicity
from tests.llm.test_text_ops import LONG, awkward, empty, frame

INSULTS = ["grubbo", "snarlix", "vomple"]


def corpus(n, seed):
    """Texts, whether they hold an insult, whether they are no junk, and where the insult stands."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        parts = [[rnd.choice(words) for _ in range(rnd.randint(4, 12))] for _ in range(rnd.randint(2, 14))]
        toxic, at = rnd.random() < 0.25, None
        if toxic:
            at = rnd.randrange(len(parts))
            parts[at].insert(rnd.randrange(len(parts[at])), rnd.choice(INSULTS) + rnd.choice(["", "", "s", "ed"]))
        good = rnd.random() > 0.2
        text = ". ".join(" ".join(p).capitalize() for p in parts) + "."
        if not good:
            text = " ".join(w + rnd.choice(["$$$", "###", "%%%"]) for w in text.split()) if rnd.random() < 0.5 else text.upper().replace(" ", "!! ")
        out.append((i, text, int(toxic), int(good), at))
    return out


def labelled(spark, rows):
    return frame(spark, [(i, g, t) for i, _, t, g, _ in rows], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents_and_its_sentences(spark):
    rows = [r for r in corpus(900, 1) if r[3]]
    docs = frame(spark, [r[:2] for r in rows])
    model = toxicity.train(docs.where("doc_id < 600"), labelled(spark, [r for r in rows if r[0] < 600]))
    held = [r for r in rows if r[0] >= 600]
    found = {}
    for r in toxicity.locate(docs.where("doc_id >= 600"), model).collect():
        found.setdefault(r.doc_id, []).append((r.score, r.sentence_no, r.start, r.sentence))
    bad = {r[0] for r in held if r[2]}
    assert len(bad & set(found)) >= 0.95 * len(bad) and len(set(found) - bad) <= 0.02 * len(held)
    texts, places = {r[0]: r[1] for r in held}, {r[0]: r[4] for r in held}
    right = [max(found[i])[1] == places[i] for i in bad & set(found)]
    assert np.mean(right) > 0.95
    assert all(texts[i][s : s + len(t)] == t for i, x in found.items() for _, _, s, t in x)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs.where("doc_id >= 600"), model).collect()}
    assert kept == {r[0] for r in held} - set(found)


def test_noisy_or_agrees_with_its_definition():
    scores = toxicity._Scores({"bad": 2.0, "ba-": 0.5, "worse": 4.0})
    p, parts = toxicity.located("Bad words here. nothing!\nWORSE, bad", scores, -3.0)
    q = [1 / (1 + np.exp(3.0 - x)) for x in (2.0, 6.0)]
    assert [k for k, *_ in parts] == [0, 2] and np.allclose([x[3] for x in parts], q) and np.isclose(p, 1 - (1 - q[0]) * (1 - q[1]))


def test_what_speaks_against_toxicity_only_lessens_what_speaks_for_it():
    scores = toxicity._Scores({"bad": 2.0, "kind": -3.0})
    p, parts = toxicity.located("Bad and kind. Kind! Bad?", scores, -1.0)
    q = [1 / (1 + np.exp(1.0 - x)) for x in (-1.0, 2.0)]
    assert [k for k, *_ in parts] == [0, 2] and np.allclose([x[3] for x in parts], q) and np.isclose(p, 1 - (1 - q[0]) * (1 - q[1]))
    assert toxicity.located("Kind, kind. All kind!", scores, -1.0) == (0.0, [])
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("abcdefgh", k=6)) + (" foul" if k % 2 else "") + (" not" if k % 4 == 1 else "") + "." for k in range(800)]
    model = toxicity.fit(texts, np.array([k % 4 == 3 for k in range(800)]))
    assert model.weights["foul"] > 0 > model.weights["not"]


def test_the_slopes_agree_with_differences_and_the_likelihood_with_its_definition():
    rng = np.random.default_rng(4)
    documents = [[rng.integers(0, 6, rng.integers(1, 5)).tolist() for _ in range(rng.integers(0, 4))] for _ in range(25)]
    toxic = rng.random(25) < 0.4
    w, b = rng.standard_normal(6), -0.7
    triples = [(f, s, d) for d, x in enumerate(documents) for s, words in enumerate(x) for f in words]
    number = {k: i for i, k in enumerate(dict.fromkeys((d, s) for _, s, d in triples))}
    feature, sentence = np.array([f for f, _, _ in triples]), np.array([number[d, s] for _, s, d in triples])
    document = np.array([d for d, _ in number])

    def plain(w, b):
        total = 0.0
        for words, y in zip(documents, toxic):
            if words:
                none = np.prod([1 - 1 / (1 + np.exp(-(b + sum(w[f] for f in s)))) for s in words])
                total += np.log(1 - none if y else none)
        return total / len(documents)

    value, slopes, of_bias = toxicity.likelihood(w, b, feature, sentence, document, toxic)
    assert np.isclose(value, plain(w, b))
    step = 1e-6
    want = [(plain(w + step * e, b) - plain(w - step * e, b)) / (2 * step) for e in np.eye(6)]
    assert np.allclose(slopes, want, atol=1e-6) and np.isclose(of_bias, (plain(w, b + step) - plain(w, b - step)) / (2 * step), atol=1e-6)


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    model = toxicity.ToxicityModel({"line": 9.0}, -2.0, 0.5)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    want = Counter((r.doc_id, r.text) for r in docs.collect() if "line" not in (r.text or ""))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert {(r.doc_id, r.sentence_no) for r in toxicity.locate(docs, model).collect()} == {(8, 0), (8, 1), (9, 0)}
    none = toxicity.train(docs, frame(spark, [(1, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.drop_toxic(empty(spark), model).count() == 0 and toxicity.locate(empty(spark), model).count() == 0


def test_quality_on_held_out_documents(spark):
    rows = corpus(900, 2)
    docs = frame(spark, [r[:2] for r in rows])
    model = quality.train(docs, labelled(spark, [r for r in rows if r[0] < 500]))
    kept = {r.doc_id for r in quality.keep_good(docs.where("doc_id >= 500"), model).collect()}
    good, bad = ({r[0] for r in rows if r[0] >= 500 and r[3] == k} for k in (1, 0))
    assert len(good & kept) >= 0.99 * len(good) and len(bad & kept) <= 0.03 * len(bad)
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    pairs = [(g, b) for g in sorted(good)[:60] for b in sorted(bad)[:30]]
    assert np.mean([score[g] > score[b] for g, b in pairs]) > 0.98
    below = np.mean([s < model.threshold for s in score.values()])
    assert abs(below - np.mean([r[3] == 0 for r in rows if r[0] < 500])) < 0.06


def test_the_threshold_is_a_quantile_and_each_row_is_scored_once(spark):
    rows = corpus(700, 5)
    docs, labels = frame(spark, [r[:2] for r in rows]), labelled(spark, [r for r in rows if r[0] % 3])
    model = quality.fit_labelled(docs, labels)
    scored = quality.score(docs, model)
    score = {r.doc_id: r.score for r in scored.collect()}
    slope, offset = model.curve
    level = np.mean([1 / (1 + np.exp(-(slope * s + offset))) for s in score.values()])
    want = sorted(score.values())[max(int(np.ceil(level * len(score))) - 1, 0)]
    assert quality.with_threshold(model, scored).threshold == want and abs(level - np.mean([r[3] == 0 for r in rows])) < 0.02
    kept = {r.doc_id for r in quality.filter_good(docs, labels).collect()}
    assert kept == {i for i, s in score.items() if s >= want} == {r.doc_id for r in quality.keep_good(docs, quality.train(docs, labels)).collect()}
    assert quality.filter_good(docs, labels)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    assert quality.score(docs.withColumnRenamed("doc_id", "score"), model, "score").columns == ["score", "score_"]


def test_a_score_does_not_depend_on_its_batch():
    rows = corpus(300, 8)
    texts = [*(r[1] for r in rows), None, "", "x"]
    model = quality.fit([r[1] for r in rows], np.array([r[3] == 1 for r in rows]))
    together = model.scores(texts)
    assert all((model.scores([t]) == s).all() for t, s in zip(texts, together)) and (model.scores(texts[7:90]) == together[7:90]).all()
    assert len(model.scores([])) == 0


def test_the_weights_lower_the_pairwise_loss_to_its_least():
    rows = corpus(400, 6)
    texts, good = [r[1] for r in rows], np.array([r[3] == 1 for r in rows])
    model = quality.fit(texts, good)
    z = np.clip((quality.text_features(texts) - model.mean) / model.scale, -8, 8)

    def loss(w):  # over all pairs
        s = z @ w
        return np.mean([np.log1p(np.exp(-np.clip(s[good] - b, -30, 30))) for b in s[~good]])

    assert loss(model.weights) < 0.1 < loss(np.zeros(14))
    for k in range(14):
        for step in (0.5, -0.5):
            assert loss(model.weights + step * np.eye(14)[k]) > loss(model.weights) - 0.02


def test_the_curve_has_the_least_loss():
    rng = np.random.default_rng(0)
    s = rng.standard_normal(300)
    good = rng.random(300) < 1 / (1 + np.exp(-(2 * s + 1)))
    slope, offset = quality._curve(s, good, ridge=0)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * s + b)))
        return -np.mean(np.where(good, np.log(1 - p), np.log(p)))

    assert all(loss(slope, offset) <= loss(slope + a, offset + b) for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01)) and -3 < slope < -1
    parted = quality._curve(np.arange(10.0), np.arange(10) > 4)
    assert np.isfinite(parted).all() and parted[0] < -1


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    flat = quality.train(docs, frame(spark, [(1, None, 1), (99, 0, 1), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    kept = quality.keep_good(docs, flat)
    assert kept.columns == docs.columns and kept.count() == docs.count() and quality.score(docs, flat).count() == docs.count()
    model = quality.train(docs, frame(spark, [(5, 0, 1), (6, 0, 1), (8, 1, 1), (9, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    texts = [r.text for r in quality.keep_good(docs, model).collect()]
    assert LONG not in texts and "a b c" in texts
    assert quality.keep_good(empty(spark), model).count() == 0


def exact(x, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("clusters,block", [(0, 100), (20, 16_384)])
def test_neighbours_recall(spark, clusters, block):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    if clusters:
        x = x * 0.4 + rng.standard_normal((clusters, 24)).astype(np.float32)[rng.integers(0, clusters, 700)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in mih.nearest_neighbours(df, queries=F.lit(True), block=block, rounds=3).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.similarity))
    want, s = exact(x, 10)
    assert np.mean([len({n for _, n, _ in got.get(i, [])} & set(want[i])) / 10 for i in range(700)]) >= 0.95
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert np.allclose([q for _, _, q in found], [s[i, n] for _, n, _ in found], atol=1e-5) and all(a[2] >= b[2] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("block", [120, 16_384])
def test_neighbours_of_vectors_with_a_large_common_mean(spark, block):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 24)) * 0.4 + rng.standard_normal((20, 24))[rng.integers(0, 20, 700)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 2.5 * np.eye(24)[0]).astype(np.float32)
    assert np.linalg.norm((x / np.linalg.norm(x, axis=1, keepdims=True)).mean(0)) > 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in mih.nearest_neighbours(df, queries=F.lit(True), block=block, rounds=3).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want, _ = exact(x, 10)
    assert [len(got.get(i, ())) for i in range(700)] == [10] * 700
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in range(700)]) >= 0.95


def test_probing_finds_every_code_within_the_radius_and_only_what_its_substrings_reach():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    queries = items[:60] ^ (rng.random((60, 8)) < 0.4) * rng.integers(0, 256, (60, 8), dtype=np.uint8)
    index = mih.SubstringIndex(items)
    distance = np.bitwise_count(queries[:, None] ^ items[None]).sum(2)
    apart = np.bitwise_count(queries.view("<u2")[:, None] ^ items.view("<u2")[None])
    for radius in (0, 3, 4, 7, 11, 13, 22):
        q, i = index.candidates(queries, radius)
        found = np.zeros(distance.shape, bool)
        found[q, i] = True
        assert found.sum() == len(q) and found[distance <= radius].all()
        assert (found == (apart <= radius // 4 - (np.arange(4) > radius % 4)).any(2)).all()
        assert index.values(radius) == sum(len(mih.ball(r)) for r in index.reach(radius) if r >= 0)


def test_near_neighbours_cost_a_few_comparisons_each():
    rng = np.random.default_rng(6)
    n, k = 20_000, 10
    x = rng.standard_normal((n // 40, 48))[rng.integers(0, n // 40, n)] + rng.standard_normal((n, 48)) * 0.06
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    mean, turns = mih.learn_rotations(x[:4000], 256, 3)
    codes = np.packbits((x - mean) @ turns > 0, axis=1, bitorder="little")
    block = mih.Block(x, codes, np.arange(n), mean, 256, k, 2.0)
    q = np.arange(0, n, 20)
    found = list(block.probe(x[q], codes[q], q, mih.FIRST_RADIUS))
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    want = np.argsort(-np.where(q[:, None] == np.arange(n), -2, x[q] @ x.T), axis=1)[:, :k]
    got = [set(b[a == i]) for i in range(len(q))]
    assert np.mean([len(g & set(w)) / k for g, w in zip(got, want)]) >= 0.95
    assert block.by_code < 0.02 * n * len(q) and block.by_cosine <= block.by_code


def test_queries_are_every_twentieth_id(spark):
    x = np.random.default_rng(9).standard_normal((400, 16)).astype(np.float32)
    rows = [(i, v.tolist(), str(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, rank array<float>, name string")
    got = mih.nearest_neighbours(df, k=3, vector_col="rank")
    assert {r.vec_id for r in got.collect()} == set(range(0, 400, 20)) and got.count() == 60
    assert 0 < len({r.name for r in mih.nearest_neighbours(df, k=3, id_col="name", vector_col="rank").collect()}) < 60


def test_neighbours_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, None, "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0], "x"), (None, [0.0, 2.0], "x"), (5, [0.0, 0.0], "x"), (6, [None, 1.0], "x"), (7, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, num string")
    got = {}
    for r in mih.nearest_neighbours(df, k=10, queries=F.lit(True)).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, round(r.similarity, 3)))
    assert set(got) == {1, None, 5, 7} and len(got[1]) == 8 and (1, 1, 1.0) in got[1]
    assert sorted(got[None])[0] == (1, 7, 0.707) and all(s == 0 for _, _, s in got[5])
    assert mih.nearest_neighbours(df.where("false")).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = corpus(500, 7)
    clean = [r for r in rows if r[3] and not r[2]]
    texts = [r[:2] for r in rows]
    texts += [(1000 + k, r[1]) for k, r in enumerate(clean[:40])]  # exact copies
    texts += [(2000 + k, r[1].replace(" a", " b", 1) + " x.") for k, r in enumerate(clean[40:60]) if len(r[1]) > 300]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in now.collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
    bad = {r[0] for r in rows if r[2] and r[3]}
    assert len(kept[0] & bad) <= 0.1 * len(bad) and {r[0] for r in clean} <= kept[0]
    assert len({r[0] for r in clean} - kept[1]) <= 2
    assert not {i for i in kept[2] if 1000 <= i < 2000} and {r[0] for r in clean} & kept[1] == {r[0] for r in clean} & kept[2]
    assert len({i for i in kept[3] if i >= 2000}) <= 2 and len({r[0] for r in clean} & kept[3]) >= 0.97 * len(clean)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, size, fill = dict(texts), Counter(), Counter()
    for r in out:
        size[r.doc_id] += r.size
        fill[r.bin_id] += r.size
    assert set(size) == kept[3] and all(size[i] == len(lengths[i].encode()) for i in size) and max(fill.values()) <= packing.CAPACITY
