"""BPE, rANS, exact, near and line dedup against brute force, and the cases that are defined apart."""

import os
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagewright.llm import bpe, hilbert, lines, packing, radix, rans, simhash

DOCS = "doc_id long, text string"
LONG = "Long wörds and more. " * 8000


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (4, "", "y"), (None, "a b c", "z"), (None, None, None), (5, LONG, "l"), (6, LONG, "l"),
        (7, LONG + "end", "l"), (8, "line\n\nline\n \nlast", "k"), (8, "other", "k"), (9, "line", "k"),
    ]
    df = frame(spark, rows, "doc_id long, text string, extra string")
    clash = ["g", "d", "n", "id", "th", "a", "b", "key", "root", "kept", "u", "v", "first", "h1", "pos", "dropped", "hilbert", "shard_id", "cell", "size", "item", "_pw_id", "_pw_cell", "TOTAL"]
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))


def empty(spark):
    return frame(spark, [])


# -- byte-level BPE


def reference():
    tokens = bpe.read_vocabulary()
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tokens, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_agrees_with_a_known_encoder():
    tokens, known = reference()
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "a", "the", "123", "É", "漢", "😀", "!", "...", " ", "\r\n", "²", "Ⅷ", "l", "e", "aaaa", "\x85", "\x1c", "<|endoftext|>"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(4000)] + ["a" * 5000, "ab" * 2000, ""]
    encoder = bpe.Encoder(tokens)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == known.encode_ordinary(text), repr(text)


def naive_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_replay_agrees_with_merging_each_word():
    tokens = bpe.read_vocabulary()
    ranks = {t: i for i, t in enumerate(tokens)}
    rnd = random.Random(8)
    words = [bytes(rnd.choices(b"aaabbc theing\xc3\xa9", k=rnd.randint(1, 40))) for _ in range(1500)] + [b"", b"z"]
    flat, offsets = bpe.MergeReplay(tokens).replay(np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words))))
    for k, w in enumerate(words):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == naive_merge(w, ranks)


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_polynomial_hashes_confuse_are_told_apart(n):
    tokens, known = reference()
    pair = [thue_morse(n, 0), thue_morse(n, 1)]
    want = [known.encode_ordinary(t) for t in pair]
    encoder = bpe.Encoder(tokens)
    assert encoder.encode([" ".join(pair), *pair]) == [known.encode_ordinary(" ".join(pair)), *want]
    blocks = list(encoder.block([[pair[0]], [pair[1]]]))
    assert [t.tolist() for t, _ in blocks] == want


def test_bpe_round_trip_and_awkward_rows(spark):
    docs = awkward(spark)
    got = bpe.encode(docs, check_round_trip=True, block_chars=1000)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.round_trip in (True, None) for r in rows)
    assert all((r.tokens is None) == (r.round_trip is None) and r.n_tokens == len(r.tokens or []) for r in rows)
    back = Counter((r.doc_id, r.text) for r in bpe.decode(got).collect())
    assert back == Counter((r.doc_id, r.text) for r in docs.collect())
    assert bpe.encode(empty(spark)).count() == 0 and bpe.decode(bpe.encode(empty(spark))).count() == 0
    odd = spark.createDataFrame([(1, [-1, 99_999_999, 64])], "doc_id int, tokens array<int>")
    assert bpe.decode(odd).first().text == "a"


# -- rANS


@pytest.mark.parametrize("n,lanes,every,kinds,precision", [(0, 4, 2, 5, 14), (1, 4, 2, 5, 14), (7, 4, 2, 1, 14), (1000, 8, 3, 300, 10), (5000, 64, 5, 5, 16), (40_000, 256, 16, 9000, 16)])
def test_rans_round_trip_by_segments(n, lanes, every, kinds, precision):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds * 7).astype(np.int32)
    values, counts = np.unique(ids, return_counts=True) if n else (np.array([3]), np.array([1]))
    codec = rans.Codec(rans.FrequencyTable.of(values, counts, precision), lanes, every)
    payload, checkpoints = codec.encode(codec.table.numbers(ids))
    decoded = lambda *g: codec.table.ids_of(codec.decode(payload, checkpoints, n, *g))
    assert (decoded() == ids).all()
    for g in range(codec.segments(n)):  # each on its own
        assert (decoded(g, g + 1) == ids[g * lanes * every : (g + 1) * lanes * every]).all()


def test_rans_compresses_near_the_entropy_and_notices_damage():
    ids = np.random.default_rng(1).integers(0, 4, 200_000).astype(np.int32)
    codec = rans.Codec(rans.FrequencyTable.of(*np.unique(ids, return_counts=True)), 64, 10_000)
    payload, checkpoints = codec.encode(codec.table.numbers(ids))
    assert len(payload) < 1.01 * len(ids) / 4
    with pytest.raises(ValueError, match="checksum"):
        codec.decode(bytes([payload[0] ^ 1]) + payload[1:], checkpoints, len(ids))
    with pytest.raises(ValueError, match="lacks"):
        codec.table.numbers(np.array([9]))


def test_rans_tables(spark):
    tokens = spark.createDataFrame([(1, [5, 6, 5]), (1, [5, 6, 5]), (2, []), (3, None), (None, [70_000])], "doc_id int, tokens array<int>")
    table = rans.frequency_table(tokens)
    assert table.freq.sum() == 1 << 14 and table.ids.tolist() == [5, 6, 70_000]
    blocks = rans.encode_blocks(tokens, table, lanes=2, block_symbols=3, checkpoint_steps=1)
    back = rans.decode_blocks(blocks, table, lanes=2, checkpoint_steps=1)
    count = lambda df: Counter((r.doc_id, None if r.tokens is None else tuple(r.tokens)) for r in df.collect())
    assert count(back) == count(tokens)
    assert rans.encode_blocks(tokens.where("false"), rans.frequency_table(tokens.where("false"))).count() == 0
    docs = awkward(spark)
    table = rans.frequency_table(docs, "text")
    back = rans.decode_blocks(rans.encode_blocks(docs, table, tokens_col="text", block_symbols=50_000), table)
    assert Counter((r.doc_id, None if r.tokens is None else bytes(r.tokens).decode()) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    with pytest.raises(ValueError, match="bits"):
        rans.frequency_table(spark.range(5).select(F.array(F.col("id").cast("int")).alias("tokens")), precision=2)


def test_rans_takes_more_ids_than_fourteen_bits(spark):
    tokens = spark.range(300).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: (F.col("id") * 100 + k).cast("int")).alias("tokens"))
    table = rans.frequency_table(tokens)
    assert len(table.ids) == 30_000 and table.precision == 15
    back = rans.decode_blocks(rans.encode_blocks(tokens, table, lanes=16), table, lanes=16)
    assert {r.doc_id: r.tokens for r in back.collect()} == {r.doc_id: r.tokens for r in tokens.collect()}
    whole = rans.FrequencyTable.of(np.arange(50_256), np.ones(50_256))
    assert whole.precision == 16 and whole.freq.min() == 1 and whole.freq.sum() == 1 << 16


def scalar_rans(numbers, freq, precision, lanes):
    """The payload's words by a coder of one symbol at a time."""
    start = np.concatenate(([0], np.cumsum(freq))).tolist()
    states, words = [1 << 16] * lanes, []
    steps = -(-len(numbers) // lanes)
    for t in range(steps - 1, -1, -1):
        out = []
        for lane, s in enumerate(numbers[t * lanes : (t + 1) * lanes]):
            x, f = states[lane], int(freq[s])
            if x >= f << (32 - precision):
                out.append(x & 0xFFFF)
                x >>= 16
            states[lane] = (x // f << precision) + x % f + int(start[s])
        words = out + words
    return words, states


@pytest.mark.parametrize("n,kinds,lanes", [(1, 1, 1), (500, 3, 4), (3000, 400, 7), (2000, 70_000, 16)])
def test_rans_agrees_with_a_coder_of_one_symbol_at_a_time(n, kinds, lanes):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, kinds, n).astype(np.int32)
    table = rans.FrequencyTable.of(np.arange(kinds), np.bincount(ids, minlength=kinds) + 1)
    numbers = table.numbers(ids)
    payload, checkpoints = rans.Codec(table, lanes, 10**6).encode(numbers)
    words, states = scalar_rans(numbers.tolist(), table.freq, table.precision, lanes)
    assert np.frombuffer(payload, "<u2").tolist() == words and np.frombuffer(checkpoints, "<u4", lanes, 8).tolist() == states


@pytest.mark.parametrize("kinds", [60_000, 100_000])
def test_rans_escapes_ids_beyond_the_table(spark, kinds):
    ids = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: ((F.col("id") * 1000 + k) % kinds - 5).cast("int"))
    tokens = spark.range(kinds // 1000 + 20).select(F.col("id").alias("doc_id"), ids.alias("tokens"))
    table = rans.frequency_table(tokens)
    assert table.escapes == (kinds > 65_536) and table.freq.sum() == 1 << 16 and table.freq.min() > 0
    back = rans.decode_blocks(rans.encode_blocks(tokens, table, lanes=16, block_symbols=30_000, checkpoint_steps=50), table, lanes=16, checkpoint_steps=50)
    assert {r.doc_id: r.tokens for r in back.collect()} == {r.doc_id: r.tokens for r in tokens.collect()}
    whole = rans.FrequencyTable.of(np.arange(kinds), np.arange(kinds) + 1)
    seen = np.array([0, kinds - 1, 5, -(2**31), 2**31 - 1] if whole.escapes else [0, kinds - 1, 5])
    assert whole.ids_of(whole.numbers(seen)).tolist() == seen.tolist()


def test_op7_codes_the_tokens_of_the_vocabulary(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: r.tokens for r in bpe.op1_bpe(spark, folder).collect()}
    blocks = rans.op7_token_binary(spark, folder)
    assert blocks.agg(F.sum("n_symbols")).first()[0] == sum(map(len, filter(None, want.values())))
    table = rans.frequency_table(bpe.encode(spark.read.parquet(f"{folder}/documents.parquet")), precision=rans.MOST_PRECISION)
    assert {r.doc_id: r.tokens for r in rans.decode_blocks(blocks, table).collect()} == want


def test_packed_tokens_are_the_same(spark):
    docs = awkward(spark)
    lists, packed = bpe.encode(docs), bpe.encode(docs, packed=True)
    unpack = lambda x: None if x is None else np.frombuffer(bytes(x), "<u2").tolist()
    rows = lambda df, f: Counter((r.doc_id, None if f(r.tokens) is None else tuple(f(r.tokens)), r.n_tokens) for r in df.collect())
    assert rows(packed, unpack) == rows(lists, lambda x: x)
    table = rans.frequency_table(packed, width=2)
    assert (table.ids == rans.frequency_table(lists).ids).all()
    wide = spark.createDataFrame([(r.doc_id, None if r.tokens is None else np.array(r.tokens, "<i4").tobytes()) for r in lists.collect()], "doc_id long, tokens binary")
    assert (rans.frequency_table(wide).ids == table.ids).all()
    back = rans.decode_blocks(rans.encode_blocks(packed, table, block_symbols=5000, width=2), table)
    assert Counter((r.doc_id, None if r.tokens is None else tuple(r.tokens)) for r in back.collect()) == Counter((r.doc_id, None if r.tokens is None else tuple(r.tokens)) for r in lists.collect())


# -- exact dedup


def test_exact_duplicates_agree_with_grouping(spark):
    rnd = random.Random(2)
    base = ["x" * 255, "x" * 256, "x" * 257, "é" * 128, "x" * 256 + "a", "x" * 3000 + "b", "x" * 3000, ""]
    rows = [(i, rnd.choice(base) + rnd.choice(["", "", "y", "z" * 400])) for i in range(300)]
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    want = {(i, least[t]) for i, t in rows if least[t] != i}
    docs = frame(spark, rows)
    assert {tuple(r) for r in radix.exact_duplicates(docs).collect()} == want
    assert {r.doc_id for r in radix.drop_exact_duplicates(docs).collect()} == set(least.values())


def test_exact_awkward_rows(spark):
    docs = awkward(spark)
    kept = radix.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(1, "a b c"), (2, None), (None, None), (3, ""), (5, LONG), (7, LONG + "end"), (8, "line\n\nline\n \nlast"), (8, "other"), (9, "line")]
    assert got == sorted(want, key=str)
    pairs = Counter(tuple(r) for r in radix.exact_duplicates(docs).collect())
    assert pairs == Counter([(1, 1), (None, 1), (4, 3), (6, 5)])
    assert radix.exact_duplicates(empty(spark)).count() == 0 and radix.drop_exact_duplicates(empty(spark)).count() == 0


# -- near dedup


def near_brute(rows, bits=simhash.MAX_BITS):
    """(id, class, links) of every row of a class of at least two, from the distances of all pairs."""
    fp, some = simhash.fingerprints([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            distance = int(np.bitwise_count(fp[i] ^ fp[j]).sum())
            if some[i] and some[j] and distance <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                if distance:
                    links[i].add(fp[j].tobytes())
                    links[j].add(fp[i].tobytes())
    classes = [find(i) for i in range(len(rows))]
    size = Counter(classes)
    return sorted((i, c, len(links[i])) for i, c in enumerate(classes) if size[c] > 1)


def copies(n=40, seed=4, shares=(0.02,)):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(3000)]
    rows = []
    for _ in range(n):
        text, share = rnd.choices(words, k=rnd.randint(30, 300)), rnd.choice(shares)
        for _ in range(rnd.choice([1, 1, 2, 12])):
            edited = [w if rnd.random() > share else rnd.choice(words) for w in text]
            rows.append((len(rows), " ".join(edited)))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("given", [{}, {"key_bytes": 1, "max_bits": 20}, {"key_bytes": 3, "max_bits": 24}, {"max_bits": 13, "positions": 16}, {"most_listed": 9}])
def test_near_duplicates_agree_with_all_pairs(spark, given):
    rows = copies(30, 5, (0.01, 0.03, 0.06, 0.1))
    want = near_brute(rows, given.get("max_bits", simhash.MAX_BITS))
    assert len(want) > 40 and sum(n for _, _, n in want) > 150
    assert found(simhash.near_duplicates(frame(spark, rows), **given)) == want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows), **given).collect()}
    assert kept == {i for i, _ in rows} - {i for i, c, _ in want if i != c}


def test_a_filter_that_would_lose_pairs_is_refused(spark):
    with pytest.raises(ValueError, match="certain"):
        simhash.near_duplicates(frame(spark, copies(3)), positions=16, max_bits=16)


@pytest.mark.parametrize("positions,matches,key_bytes", [(16, 4, 2), (16, 4, 3), (8, 3, 2), (8, 1, 1), (32, 4, 2), (12, 5, 1)])
def test_every_pair_with_enough_matches_shares_a_key(positions, matches, key_bytes):
    rnd = random.Random(1)
    lists = simhash._Lists(positions, matches, key_bytes, 0)
    keys = [{p, *rest} for p in lists.places for c in lists.classes if p in c for rest in combinations([q for q in c if q > p], key_bytes - 1)]
    for _ in range(300):
        shared = set(rnd.sample(range(positions), matches))
        assert any(shared >= k for k in keys)


@pytest.mark.parametrize("max_bits", [0, 1, 9, 13, 24, 28])
def test_a_mask_leaves_out_whatever_differs(max_bits):
    rng = np.random.default_rng(max_bits)
    masks = simhash.covering_masks(max_bits)
    assert np.bitwise_count(masks).sum(1).min() >= 16
    for k in range(600):
        among = np.arange(256) if k % 2 else np.arange(256)[: max(max_bits, int(rng.integers(1, 256)))]  # also close together
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(among, min(max_bits, len(among)), replace=False)] = 1
        assert (np.packbits(bits, bitorder="little").view(np.uint64) & masks == 0).all(1).any()


@pytest.mark.parametrize("given", [{}, {"together": 9}, {"max_bits": 13, "positions": 16}, {"max_bits": 20, "together": 25}])
def test_many_fingerprints_meet_under_masks_as_all_pairs_do(spark, given):
    rows = copies(30, 5, (0.01, 0.03, 0.06, 0.1))
    want = near_brute(rows, given.get("max_bits", simhash.MAX_BITS))
    assert found(simhash.near_duplicates(frame(spark, rows), many=0, **given)) == want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows), many=0, **given).collect()}
    assert kept == {i for i, _ in rows} - {i for i, c, _ in want if i != c}
    assert simhash.near_duplicates(empty(spark), many=-1).count() == 0


@pytest.mark.parametrize("counted", [True, False])
def test_few_of_all_pairs_of_like_fingerprints_are_looked_at_under_masks(counted, monkeypatch):
    """Texts of one language have many bits in common, so that the lists of two bytes are long."""
    rng = np.random.default_rng(3)
    n, looked = 2_000, []
    bits = rng.random((n, 256)) < np.where(rng.random(256) < 0.5, 0.2, 0.8)
    bits[1::20] = bits[::20] ^ (rng.random((n // 20, 256)) < 0.03)
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    true = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda fp, i, *rest: looked.append(len(i)) or true(fp, i, *rest))
    met = {frozenset(p) for i, j, *_ in simhash._Masks(32, 4, 28).pairs(fp, None, counted) for p in zip(i.tolist(), j.tolist())}
    x = np.bitwise_count(fp[:, None, :] ^ fp).sum(2) <= 28
    assert met == {frozenset(p) for p in np.argwhere(np.triu(x, 1)).tolist()} and len(met) > 80
    under_masks = sum(looked)
    looked.clear()
    lists, raw = simhash._Lists(32, 4, 2, 28), fp.view(np.uint8).reshape(n, 32)
    for p in lists.places:
        order = np.argsort(raw[:, p], kind="stable")
        for _ in lists.pairs(p, raw[order, p].astype(np.int64), fp[order], None, counted):
            pass
    assert 5 * under_masks < sum(looked)


def test_linked_rows_take_their_whole_components_along():
    rng = np.random.default_rng(4)
    label = np.arange(300)
    pairs = rng.integers(0, 300, (6, 40, 2))
    for i, j in pairs.transpose(0, 2, 1):
        simhash._link(label, i, j)
    simhash._settle(label)
    want = list(range(300))
    for i, j in pairs.reshape(-1, 2):
        low, high = sorted((want[i], want[j]))
        want = [low if x == high else x for x in want]
    assert label.tolist() == want


def test_a_large_family_meets_under_masks_and_is_joined_soon():
    rng = np.random.default_rng(2)
    n = 100_000
    fp = np.tile(rng.integers(0, 2**63, 4, dtype=np.int64).view(np.uint64), (n, 1))
    for _ in range(12):
        fp[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    began = time.time()
    joined = sum(len(i) for i, *_ in simhash._Masks(32, 4, 28).pairs(fp, None, False, range(0, 283, 40)))
    assert joined >= len(np.unique(fp, axis=0)) - 1 and time.time() - began < 60


def test_a_large_family_of_near_equal_fingerprints_is_joined_soon():
    rng = np.random.default_rng(2)
    n = 200_000
    fp = np.tile(rng.integers(0, 2**63, 4, dtype=np.int64).view(np.uint64), (n, 1))
    for _ in range(6):
        fp[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(8, 64, n).astype(np.uint64)
    lists = simhash._Lists(32, 4, 2, 28)
    began = time.time()
    first = next(x for x in lists.places)
    joined = sum(len(i) for i, *_ in lists.pairs(first, np.zeros(n, np.int64), fp, None, False))
    assert joined >= len(np.unique(fp, axis=0)) - 1 and time.time() - began < 60


def test_near_awkward_rows(spark):
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(1, "a b c")] == 1 and got[(None, "a b c")] == 0
    assert got[(2, None)] == 1 and got[(None, None)] == 1 and got[(3, "")] == 1 and got[(4, "")] == 1
    assert got[(5, LONG)] == 1 and got[(6, LONG)] == 0
    assert got[(8, "other")] == 1
    listed = simhash.near_duplicates(docs).collect()
    assert len(listed) - len({r.class_id for r in listed}) == docs.count() - kept.count()
    renamed = simhash.near_duplicates(docs.withColumnRenamed("doc_id", "class_id"), id_col="class_id")
    assert renamed.columns == ["class_id", "class_id_", "n_links"] and renamed.count() == len(listed)
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_whole_texts_go_to_python_a_thousand_at_once(spark, monkeypatch):
    sizes, true = [], simhash.materialise
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(simhash, "materialise", lambda df, tag: sizes.append((tag, spark.conf.get(key))) or true(df, tag))
    before = spark.conf.get(key)
    simhash.drop_near_duplicates(frame(spark, copies(3)))
    assert ("simhash", "1000") in sizes and spark.conf.get(key) == before


# -- line dedup


def line_brute(rows):
    seen, out = set(), []
    for i, text in rows:
        kept, gone = [], 0
        for line in text.split("\n"):
            if line.strip(" ") and line in seen:
                gone += 1
            else:
                kept.append(line)
            seen.add(line)
        out.append((i, "\n".join(kept), gone))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_agree_with_one_pass(spark, batches):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["a", "b", " ", "", f"only {i}", "c d", f"k{rnd.randint(0, 40)}"]) for _ in range(rnd.randint(1, 9)))) for i in range(80)]
    got = lines.dedup_lines(frame(spark, rows), batches=batches)
    assert sorted(tuple(r) for r in got.collect()) == line_brute(rows)


def test_runs_are_compacted_and_closed(spark):
    dedup = lines.LineDedup(spark, buckets=2, fanout=2)
    for k in range(5):
        dedup.add(frame(spark, [(k, f"line {k}\nshared")]))
    assert [len(level) for level in dedup.levels] == [1, 0, 1]
    again = dedup.add(frame(spark, [(9, "line 0\nline 4\nnew")])).first()
    assert (again.text, again.n_dropped) == ("new", 2)
    dedup.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_run_is_one_sorted_file_a_bucket_and_joins_need_no_sort(spark):
    dedup = lines.LineDedup(spark, buckets=4, fanout=3)
    for k in range(3):
        dedup.add(frame(spark, [(100 * k + i, f"line {k} {i}\nshared") for i in range(60)]))
    assert [len(level) for level in dedup.levels] == [0, 1]
    (name, path), = dedup.levels[1]
    assert len([f for f in os.listdir(path.removeprefix("file:").replace("//", "/")) if f.endswith(".parquet")]) == 4
    assert spark.table(name).count() == 181
    dedup.add(frame(spark, [(900, "one more")]))
    with lines._sorted_runs(spark):
        plan = dedup._met(dedup._lines(frame(spark, [(901, "line 0 0\nx")]).select(F.col("doc_id").alias("id"), "text")))._jdf.queryExecution().executedPlan().toString()
    dedup.close()
    assert plan.count("SortMergeJoin") >= 2 and plan.count("Scan parquet") >= 2
    below = [plan.splitlines()[k - 4 : k] for k, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "line_run" in line]
    assert len(below) == 2 and not any("Sort [" in x or "Exchange" in x for lot in below for x in lot[1:])


@pytest.mark.parametrize("kind", ["string", "timestamp", "binary"])
def test_lines_with_ids_of_other_types(spark, kind):
    rows = [(i, f"a\nonly {i}\nb {i % 5}") for i in range(40)]
    df = frame(spark, rows).withColumn("doc_id", F.format_string("doc-%03d", "doc_id") if kind != "timestamp" else F.timestamp_seconds("doc_id")).withColumn("doc_id", F.col("doc_id").cast(kind))
    df = df.withColumn("n_dropped", F.lit("theirs")).withColumn("N_DROPPED_", F.lit(1))
    assert len(lines.batch_conditions(df, "doc_id", 4)) == (1 if kind == "binary" else 4)
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_dropped__"]
    assert sorted((int(r.text.split("only ")[1].split("\n")[0]), r.text, r["n_dropped__"]) for r in got.collect()) == line_brute(rows)


def test_batches_are_ranges_that_the_scan_takes(spark, tmp_path):
    frame(spark, [(i, "x") for i in range(100)]).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    parts = [docs.where(c) for c in lines.batch_conditions(docs, "doc_id", 4)]
    assert [p.count() for p in parts] == [25] * 4
    assert all("LessThanOrEqual(doc_id" in p._jdf.queryExecution().executedPlan().toString() for p in parts[:3])


def test_line_awkward_rows(spark):
    docs = awkward(spark)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"]
    rows = Counter((r.doc_id, r.text, r.n_dropped) for r in got.collect())
    assert rows[(8, "line\n\n \nlast", 1)] == 1 and rows[(9, "", 1)] == 1 and rows[(2, None, 0)] == 1 and rows[(3, "", 0)] == 1 and rows[(6, "", 1)] == 1
    assert rows[(1, "a b c", 0)] == 2 and rows[(None, "", 1)] == 1
    assert lines.dedup_lines(empty(spark)).count() == 0


# -- packing


def best_fit_brute(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b + s <= capacity]
        if fit:
            bins[bins.index(max(fit))] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_best_fit_agrees_with_trying_all_bins():
    rnd = random.Random(9)
    for _ in range(30):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))]
        bins = Counter()
        for s, b in zip(sizes, packing.best_fit(sizes, 100)):
            bins[b] += s
        assert sorted(bins.values()) == best_fit_brute(sizes, 100)


@pytest.mark.parametrize("group_items", [20, 1000])
def test_packing_covers_everything_once(spark, group_items):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.choice([1, 7, 40, 61, 99, 100, 101, 250])) for i in range(400)]
    out = packing.pack(frame(spark, rows), capacity=100, group_items=group_items, fan_in=3).collect()
    fill, pieces = Counter(), {}
    for r in out:
        fill[r.bin_id] += r.size
        pieces.setdefault(r.doc_id, []).append((r.start, r.size))
    assert max(fill.values()) <= 100
    for i, text in rows:
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == len(text)
    total = sum(len(t) for _, t in rows)
    assert len(fill) <= 1.15 * -(-total // 100)


def test_items_that_cannot_be_joined_end_the_rounds(spark):
    rows = [(i, "x" * 60) for i in range(100)]
    assert len({r.bin_id for r in packing.pack(frame(spark, rows), capacity=100, group_items=10).collect()}) == 100


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    out = packing.pack(docs, capacity=1000).collect()
    size = Counter()
    for r in out:
        size[r.doc_id] += r.size
    assert size[1] == 10 and size[None] == 5 and size[5] == len(LONG.encode()) and 2 not in size and 3 not in size
    assert packing.pack(empty(spark)).count() == 0


# -- Hilbert sharding


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_once_and_steps_to_neighbours(dims, bits):
    grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
    place = hilbert.hilbert_index(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def walk(dims, bits):
    """The cells of a Hilbert curve in their order, cell by cell: Gray codes, each turned into the frame of its parent."""
    n = dims

    def rotate(x, k):
        k %= n
        return ((x >> k) | (x << (n - k))) & ((1 << n) - 1)

    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    out = []

    def visit(level, entry, direction, corner):
        if level < 0:
            out.append(tuple(corner))
            return
        for w in range(1 << n):
            cell = rotate(gray(w), n - 1 - direction) ^ entry if False else ((gray(w) << (direction + 1)) | (gray(w) >> (n - direction - 1))) & ((1 << n) - 1)
            cell ^= entry
            e = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            d = 0 if w == 0 else trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n
            turned = ((e << (direction + 1)) | (e >> (n - direction - 1))) & ((1 << n) - 1)
            visit(level - 1, entry ^ turned, (direction + d + 1) % n, [c | ((cell >> k & 1) << level) for k, c in enumerate(corner)])

    visit(bits - 1, 0, 0, [0] * n)
    return out


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 2), (3, 3)])
def test_the_curve_fills_each_half_before_the_next_like_a_recursive_one(dims, bits):
    recursive = walk(dims, bits)
    grid = np.array(recursive)
    place = hilbert.hilbert_index(grid, bits)
    path = grid[np.argsort(place)]
    for cells in (grid, path):  # both step to neighbours, and fill each block of every level before the next one
        assert (np.abs(np.diff(cells, axis=0)).sum(1) == 1).all()
        for level in range(1, bits):
            block = [tuple(c) for c in cells >> level]
            assert sum(a != b for a, b in zip(block, block[1:])) == (1 << dims * (bits - level)) - 1


def test_cells_and_cuts_agree_with_plain_ones(spark):
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randint(0, 50), "pre" + rnd.choice("abcdefghijkl"), rnd.choice([None, 1.5, 2.5, rnd.random()])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, v double")
    got = {r.doc_id: r for r in hilbert.shard(docs, ["source", "v"], bits=2, shard_bytes=900).collect()}

    def levels(values):
        known = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
        return known

    names = sorted(r[2] for r in rows)
    cuts, total = [], 0
    for value, n in sorted(Counter(names).items()):
        if (total + n) * 4 // 300 > total * 4 // 300:
            cuts.append(value)
        total += n
    numbers = sorted(r[3] for r in rows if r[3] is not None)
    inner = [numbers[max(-(-len(numbers) * k // 4) - 1, 0)] for k in (1, 2, 3)]
    cells = {r[0]: (sum(r[2] > c for c in cuts), 0 if r[3] is None else sum(r[3] > c for c in sorted(set(inner)))) for r in rows}
    places = dict(zip(cells, hilbert.hilbert_index(np.array(list(cells.values())), 2).tolist()))
    assert {i: r.hilbert for i, r in got.items()} == places
    shard, filled, of = 0, 0, {}
    for place in sorted(set(places.values())):
        size = sum(len(rows[i][1]) + 1 for i in places if places[i] == place)
        if size >= 900:
            shard += filled > 0
            of[place] = set(range(shard, shard - (-size // 900)))
            shard, filled = max(of[place]) + 1, 0
            continue
        if filled and filled + size > 900:
            shard, filled = shard + 1, 0
        of[place] = {shard}
        filled += size
    assert all(r.shard_id in of[r.hilbert] for r in got.values())


def test_many_dimensions_get_fewer_bits_and_no_name_clashes(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), *((F.col("id") * p % 7).alias(f"k{p}") for p in range(1, 7)), *(F.lit(1).alias(x) for x in ("shard_id", "SHARD_ID_", "hilbert", "hilbert_", "hilbert__")))
    for n in (4, 6):
        out = hilbert.shard(docs, [f"k{p}" for p in range(1, n + 1)], shard_bytes=300)
        assert out.columns == [*docs.columns, "hilbert___", "shard_id__"] and out.count() == 200
        assert 3 <= out.select("shard_id__").distinct().count() <= 200


def test_shards(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(1, 200), rnd.choice("abcdefgh"), rnd.random()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    out = hilbert.shard(docs, ["source", "score"], bits=4, shard_bytes=4000)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    fill, span = Counter(), {}
    for r in got:
        fill[r.shard_id] += len(r.text) + 1
        low, high = span.get(r.shard_id, (r.hilbert, r.hilbert))
        span[r.shard_id] = min(low, r.hilbert), max(high, r.hilbert)
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 4000
    cuts = [span[k] for k in sorted(span)]
    assert all(a[1] < b[0] for a, b in zip(cuts, cuts[1:]))  # runs of the curve
    bounds = {r.shard_id: r for r in hilbert.manifest(out, ["source", "score"]).collect()}
    read = sum(bounds[k].min_source <= "c" <= bounds[k].max_source and bounds[k].min_score <= 0.2 for k in bounds)
    assert read < 0.6 * len(bounds)  # the rest is pruned


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_strings_that_begin_alike_are_told_apart(spark, kind):
    rows = [(i, "x" * 99, f"https://example.org/source_{i % 40:04d}") for i in range(800)]
    docs = spark.createDataFrame([*rows, (800, "x", None)], "doc_id long, text string, source string").withColumn("source", F.col("source").cast(kind))
    bounds = hilbert.manifest(hilbert.shard(docs, ["source"], shard_bytes=5000), ["source"]).collect()
    text = lambda v: v if isinstance(v, str) else bytes(v).decode()
    wanted = "https://example.org/source_0017"
    assert len(bounds) >= 16 and sum(b.n_rows for b in bounds) == 801
    assert sum(b.min_source is not None and text(b.min_source) <= wanted <= text(b.max_source) for b in bounds) <= 2


def test_a_cell_larger_than_a_shard_is_dealt(spark):
    docs = spark.createDataFrame([(i, "x" * 99, 1) for i in range(400)], "doc_id long, text string, k int")
    fill = Counter(r.shard_id for r in hilbert.shard(docs, ["k"], shard_bytes=5000).collect())
    assert len(fill) == 8 and max(fill.values()) < 90


def test_shard_awkward_rows(spark):
    docs = awkward(spark)
    out = hilbert.shard(docs, ["extra", "doc_id"])
    assert out.columns == [*docs.columns, "hilbert_", "shard_id_"] and out.count() == docs.count()
    assert hilbert.shard(empty(spark), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="bits"):
        hilbert.shard(docs, ["doc_id"], bits=19)
