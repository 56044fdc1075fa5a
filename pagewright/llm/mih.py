"""Operator 10: nearest neighbours by multi-index hashing.

Codes: vectors are centred and scaled to one length, and turned by rotations that iterative quantisation
learns from at most `max_sample` vectors drawn by a hash. The signs give d bits a rotation, `code_bits` in all.

Index: the code is split into substrings of 16 bits; each block of items has a table for each substring, from its value
to the items. To find every code within radius r of a query, substring j is probed within floor(r / m) bits, or one less
from place r mod m + 1 on: by the pigeonhole principle no code within r is missed. What is found makes a candidate once;
candidates within r by the whole code are reranked by the cosine of the floats. Nothing else is compared.

Radius: a first pass probes all blocks within `first_radius` and merges what it finds. The k best by cosine so far bound the angle
of the true ones. Centred vectors are what is coded, so the widest of their angles gives about angle / pi of the bits, give or take
`deviations` standard deviations: that radius is certain enough. Queries whose radius is no more than the first one are done; the
others go on with theirs to a second pass over all blocks. There, once the values to be probed outnumber a block's items, probing would
return about everything; the index is passed over then and the block's codes are compared one by one, with the radius drawn from the nearest codes.
Near neighbours hence cost a few lookups in each block, and only far ones a look at each code.

Queries, in blocks too, meet the blocks of items, so that memory depends on a block's size alone. By default the rows whose
id is divisible by 20 are the queries; all rows are items.

Defined cases: null vectors, and those with a null, NaN or infinite entry or of another length than most, aren't indexed and have no
neighbours; a zero vector has cosine 0 to all; a row isn't its own neighbour, but rows that repeat an id or vector are
each other's; ties go to the lesser id, then the earlier row; with fewer than k others all are given; a null id isn't divisible by 20; of ids that
are no whole numbers a hash is divided; extra columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finished, materialise, projected

CODE_BITS, ROUNDS, BLOCK, DEVIATIONS, MAX_SAMPLE, FIRST_RADIUS = 256, 8, 65_536, 2.0, 20_000, 31
QUERY_BLOCK, LEAST_BLOCK, SUBSTRING = 65_536, 4_096, 16


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def learn_rotations(x: np.ndarray, code_bits: int = CODE_BITS, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and a d x code_bits matrix whose signs of (v - mean) M are the code."""
    mean = x.mean(0)
    v = (x - mean).astype(np.float64)
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(-(-code_bits // d)):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.sign(v @ q).T @ v)
            q = (left @ right).T
        turns.append(q)
    return mean, np.concatenate(turns, 1)[:, :code_bits]


@cache
def ball(bits: int) -> np.ndarray:
    """All values of a substring with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(SUBSTRING), k)], np.uint16)


class SubstringIndex:
    """A table for each substring of a block's codes: its items in the order of the value, and where each value begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.parts = np.ascontiguousarray(codes).view("<u2")
        self.n, self.m = self.parts.shape
        self.items = [np.argsort(self.parts[:, j], kind="stable") for j in range(self.m)]
        self.begin = [np.concatenate(([0], np.cumsum(np.bincount(self.parts[:, j], minlength=1 << SUBSTRING)))) for j in range(self.m)]

    def reach(self, radius: int) -> list[int]:
        """How far each substring is probed; -1: not at all."""
        return [min(radius // self.m - (j > radius % self.m), SUBSTRING) for j in range(self.m)]

    def values(self, radius: int) -> int:
        """The number of values that are looked up."""
        return sum(len(ball(r)) for r in self.reach(radius) if r >= 0)

    def candidates(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, item): whatever the probes find, each once."""
        parts = np.ascontiguousarray(codes).view("<u2")
        pairs = []
        for j, r in enumerate(self.reach(radius)):
            if r >= 0:
                value = parts[:, j, None] ^ ball(r)
                first, count = self.begin[j][value], self.begin[j][value.astype(np.int64) + 1] - self.begin[j][value]
                some = count > 0
                query, first, count = np.nonzero(some)[0], first[some], count[some]
                at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
                pairs.append(np.repeat(query, count) * self.n + self.items[j][at])
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return found // max(self.n, 1), found % max(self.n, 1)


def radius_of(angle: np.ndarray, code_bits: int, deviations: float) -> np.ndarray:
    p = angle / np.pi
    return np.minimum(np.ceil(code_bits * p + deviations * np.sqrt(code_bits * p * (1 - p))), code_bits).astype(np.int64)


class Block:
    """A block of items, and what it cost to search it: how many pairs were compared by code and by cosine."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, num: np.ndarray, mean: np.ndarray, code_bits: int, k: int, deviations: float) -> None:
        self.x, self.codes, self.num, self.k, self.code_bits, self.deviations = x, codes, num, k, code_bits, deviations
        self.words, self.mean = codes.view(np.uint64), mean.astype(np.float32)
        self.index: SubstringIndex | None = None
        self.by_code = self.by_cosine = 0

    def _distance(self, qc: np.ndarray, i: np.ndarray) -> np.ndarray:
        self.by_code += len(i)
        return np.bitwise_count(qc.view(np.uint64) ^ self.words[i]).sum(1, dtype=np.uint16)

    def _best(self, q: np.ndarray, i: np.ndarray, qx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best by cosine for each query, and all that equal the last of them."""
        self.by_cosine += len(q)
        s = np.concatenate([np.einsum("nd,nd->n", qx[q[a : a + 200_000]], self.x[i[a : a + 200_000]]) for a in range(0, max(len(q), 1), 200_000)])
        order = np.lexsort((-s, q))
        q, i, s = q[order], i[order], s[order]
        begin = np.searchsorted(q, q)
        last = s[np.minimum(begin + self.k - 1, np.searchsorted(q, q, side="right") - 1)]
        keep = s >= last
        return q[keep], i[keep], s[keep]

    def probe(self, qx: np.ndarray, qc: np.ndarray, qn: np.ndarray, radius: int, lot: int = 256):
        """The best items within the radius, by the index."""
        self.index = self.index or SubstringIndex(self.codes)
        for a in range(0, len(qx), lot):
            q, i = self.index.candidates(qc[a : a + lot], radius)
            q = q + a
            near = (self._distance(qc[q], i) <= radius) & (qn[q] != self.num[i])
            found = self._best(q[near], i[near], qx)
            if len(found[0]):
                yield found

    def scan(self, qx: np.ndarray, qc: np.ndarray, qn: np.ndarray, radius: np.ndarray, lot: int = 64):
        """The best items within the radius, or within that of the k best among the nearest codes if it is less; all codes are compared."""
        near = min(4 * self.k, len(self.x))
        for a in range(0, len(qx), lot):
            own = qc[a : a + lot].view(np.uint64)
            distance = np.zeros((len(own), len(self.x)), np.uint16)
            for w in range(own.shape[1]):
                distance += np.bitwise_count(own[:, w, None] ^ self.words[None, :, w])
            self.by_code += distance.size
            distance[qn[a : a + lot, None] == self.num[None]] = 2 * self.code_bits  # a row itself
            nearest = np.argpartition(distance, near - 1, axis=1)[:, :near]
            s = np.einsum("qd,qkd->qk", qx[a : a + lot], self.x[nearest])
            self.by_cosine += s.size
            s[np.take_along_axis(distance, nearest, 1) > self.code_bits] = -np.inf
            r = radius[a : a + lot].copy()
            if near > self.k:
                best = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
                items = np.take_along_axis(nearest, best, 1)
                full = (np.take_along_axis(s, best, 1) > -np.inf).all(1)
                local = np.maximum(self.radius(qx[a : a + lot], items), np.take_along_axis(distance, items, 1).max(1))
                r = np.where(full, np.minimum(r, local), r)
            q, i = np.nonzero(distance <= r[:, None])
            if len(q):
                yield self._best(q + a, i, qx)

    def radius(self, qx: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The radius that the angles to k items of each query ask for."""
        centred = _unit(self.x[items.ravel()] - self.mean).reshape(*items.shape, -1)
        least = np.einsum("qd,qkd->qk", _unit(qx - self.mean), centred).min(1)
        return radius_of(np.arccos(np.clip(least - 1e-6, -1, 1)), self.code_bits, self.deviations)


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, code_bits: int = CODE_BITS,
    deviations: float = DEVIATIONS, block: int = BLOCK, rounds: int = ROUNDS, first_radius: int = FIRST_RADIUS, max_sample: int = MAX_SAMPLE,
) -> DataFrame:
    """(id, rank, neighbour_id, similarity): the k nearest others of every query, all vectors being searched. queries: the rows that are, a
    condition on the column `id`; if it isn't given, those whose id is divisible by 20."""
    spark = vectors.sparkSession
    source = projected(vectors, id=id_col, v=vector_col).where("v is not null")
    source = source.select("id", F.col("v").cast("array<float>").alias("v"), F.size("v").alias("d"))
    id_type = source.schema["id"].dataType
    names = [x + "_" * (x == id_col.lower()) for x in ("rank", "neighbour_id", "similarity")]
    result = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, t) for n, t in zip(names, (T.IntegerType(), id_type, T.FloatType())))])
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usual = source.where(good & (F.col("d") > 0)).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], result)
    d, n = usual["d"], usual["count"]
    number = F.col("id") if isinstance(id_type, T.IntegralType) else F.xxhash64("id")
    asked = F.coalesce(F.col("id").isNotNull() & (F.pmod(number, F.lit(20)) == 0) if queries is None else queries, F.lit(False))
    clean = source.where(good & (F.col("d") == d)).select("id", "v", asked.alias("asked"))
    clean, _ = materialise(clean.withColumn("num", F.monotonically_increasing_id()), "mih-vectors")
    drawn = clean.where(F.pmod(F.xxhash64("num"), F.lit(n)) < max_sample).select("v").limit(2 * max_sample).collect()
    if not drawn:
        drawn = clean.select("v").limit(max_sample).collect()
    mean, turns = learn_rotations(_unit(np.array([r["v"] for r in drawn], np.float32)), code_bits, rounds)
    code_bytes = -(-code_bits // 64) * 8

    def encode(batches):
        for b in batches:
            x = _unit(_matrix(b.column(1), d))
            bits = np.packbits((x - mean) @ turns > 0, axis=1, bitorder="little")
            bits = np.pad(bits, ((0, 0), (0, code_bytes - bits.shape[1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in bits], pa.binary())], names=["id", "v", "asked", "num", "code"])

    coded, _ = materialise(clean.mapInArrow(encode, T.StructType([*clean.schema, T.StructField("code", T.BinaryType())])), "mih-codes")
    blocks = max(-(-n // block), min(-(-n // LEAST_BLOCK), 16))  # enough for some tasks
    n_asked = coded.where("asked").count()
    query_blocks = max(-(-n_asked // QUERY_BLOCK), 1)
    rows = ["id", "v", "num", "code"]
    items = coded.select(F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("num"), F.lit(blocks)).alias("ib"), *rows, F.lit(0).alias("radius"))
    part = T.StructType([T.StructField("num", T.LongType()), T.StructField("id", id_type), T.StructField("other", T.LongType()), T.StructField("other_id", id_type), T.StructField("s", T.FloatType()), T.StructField("angle", T.FloatType())])

    def arrays(t: pa.Table):
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, code_bytes)
        return _unit(_matrix(t.column("v").combine_chunks(), d)), codes, t.column("num").to_numpy()

    def meet(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        q, i = (t.filter(pa.array(role == x)).combine_chunks() for x in (0, 1))
        found = []
        if q.num_rows and i.num_rows:
            (qx, qc, qn), (ix, ic, inum) = arrays(q), arrays(i)
            here, radius = Block(ix, ic, inum, mean, code_bits, k, deviations), q.column("radius").to_numpy().astype(np.int64)
            index = SubstringIndex(ic)
            for r in np.unique(radius).tolist():
                own = np.nonzero(radius == r)[0]
                if index.values(r) <= max(len(ix), 1024):
                    here.index = index
                    parts = here.probe(qx[own], qc[own], qn[own], r)
                else:
                    parts = here.scan(qx[own], qc[own], qn[own], radius[own])
                found += [(own[a], b, s) for a, b, s in parts]
        if not found:
            return pa.table({f.name: pa.array([], f.type) for f in pa.schema([("num", pa.int64()), ("id", t.schema.field("id").type), ("other", pa.int64()), ("other_id", t.schema.field("id").type), ("s", pa.float32()), ("angle", pa.float32())])})
        a, b, s = (np.concatenate(x) for x in zip(*found))
        m = mean.astype(np.float32)
        angle = np.arccos(np.clip(np.einsum("nd,nd->n", _unit(qx[a] - m), _unit(ix[b] - m)) - 1e-6, -1, 1))
        return pa.table({"num": qn[a], "id": q.column("id").take(pa.array(a)), "other": inum[b], "other_id": i.column("id").take(pa.array(b)), "s": s, "angle": angle.astype(np.float32)})

    def search(asked: DataFrame) -> DataFrame:
        """(num, id, best): the k best that are found for each query with its radius."""
        others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        sent = asked.select(F.lit(0).alias("role"), F.pmod(F.xxhash64("num"), F.lit(query_blocks)).alias("qb"), others.alias("ib"), *rows, F.col("radius").cast("int"))
        parts = items.unionByName(sent).groupBy("qb", "ib").applyInArrow(meet, part)
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col("other_id").alias("i"), "other", "angle"))), 1, k)
        return parts.groupBy("num").agg(F.first("id").alias("id"), best.alias("best"))

    every = coded.where("asked").select(*rows)
    first, _ = materialise(search(every.withColumn("radius", F.lit(min(first_radius, code_bits)))), "mih-first")
    p = F.array_max(F.transform("best", lambda b: b["angle"])) / np.pi
    asks = F.when(F.size("best") >= min(k, n - 1), F.least(F.ceil(code_bits * p + deviations * F.sqrt(code_bits * p * (1 - p))), F.lit(code_bits))).otherwise(code_bits)
    radii = first.select("num", asks.cast("int").alias("radius"))
    more = every.join(radii, "num", "left").withColumn("radius", F.coalesce("radius", F.lit(code_bits))).where(F.col("radius") > first_radius)
    more, _ = materialise(more, "mih-more")
    both = first.join(more.select("num"), "num", "left_anti").unionByName(search(more))
    out = both.select("id", F.posexplode("best").alias("rank", "b"))
    return out.select(F.col("id").alias(id_col), (F.col("rank") + 1).alias(names[0]), F.col("b.i").alias(names[1]), (-F.col("b.s")).alias(names[2]))


def op10_mih_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of those whose id is divisible by 20."""
    return finished(spark, lambda: nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "neighbours")
