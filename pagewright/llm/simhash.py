"""Operator 2: SimHash near-dedup by a byte-position inverted index with count filtering.

A document's features are its distinct words (lower case, without punctuation), each weighing the square root of
how often it occurs; its fingerprint has 256 bits. Each differing bit spoils one byte at most, so two fingerprints within
`max_bits` share at least `positions - max_bits` bytes at their places: the guaranteed minimum, `matches`. No greater one is
taken, hence no pair within `max_bits` is lost.

The index leads from a byte's place and value to fingerprints. The places are dealt into so few classes that any `matches` of them hold
`key_bytes` of one class; a fingerprint is listed under each of its bytes but a class's last ones, and within a list pairs meet
that agree in the other bytes of a key too. Where a pair meets, its shared positional bytes are tallied; pairs that reach `matches`
are verified by the whole 256 bits. More bytes a key make pairs that meet by chance rarer and keys more, so
their number follows from the number of fingerprints; the result is the same. Lists of over `most_listed` fingerprints are split into
blocks, each pair of which is a task's.

Such keys have few bits, or are thousands. More than MANY fingerprints therefore meet under masks, if `key_bytes` isn't given: the bits are cut into parts, one
of which has few of the differing bits, and each part has masks one of which hides all of them. A key is what a mask leaves of a
part, some 25 bits. Fingerprints are dealt into blocks of `together` at most, and each pair of blocks, with all masks or some, is a task's.

Documents of one fingerprint are one node. Verified pairs are joined to components, the classes; the least id names a class. Every link is
found under several keys and counted under the first of them alone. Where links needn't be counted, a pair whose
ends are linked already isn't looked at.

Defined cases: null, empty and wordless texts have no fingerprint and are never near copies; rows
with a null id come after all others in the choice of the kept row; repeated rows are copies of each
other; extra columns play no part and are kept; empty tables give empty tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, span_hashes
from .common import col, finished, fresh, give_back, materialise, projected, setting, small_batches
from .components import connected_components

POSITIONS, MAX_BITS, MOST_LISTED = 32, 28, 400_000
MANY, TOGETHER, LONG_RUN = 300_000, 750_000, 64

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_LOW7, _HIGH1 = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x * np.uint64(seed)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 32 bytes for each text, and whether it has any word."""
    n = len(texts)
    raw = [(t or "").lower().encode() for t in texts]
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, n))
    chars = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = _WORD[chars]
    start = np.nonzero(word & ~np.concatenate(([False], word[:-1])))[0]
    end = np.nonzero(word & ~np.concatenate((word[1:], [False])))[0] + 1
    doc = np.searchsorted(ends, start, side="right")
    h = span_hashes(chars, start, end)
    # the distinct words of each text, and how often each occurs
    tagged = _mixed(h, _SEEDS[0]) + _mixed(doc.astype(np.uint64) + np.uint64(1), _SEEDS[3])
    order = np.argsort(tagged)
    tagged = tagged[order]
    first = np.nonzero(np.concatenate(([True], tagged[1:] != tagged[:-1])))[0] if len(tagged) else np.zeros(0, np.int64)
    weight = np.sqrt(np.diff(np.append(first, len(tagged))))
    h, doc = h[order][first], doc[order][first] * 256
    out = np.zeros((n, 32), np.uint8)
    for seed in range(4):
        m = np.ascontiguousarray(_mixed(h, _SEEDS[seed])).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            tally = np.bincount(doc + m[:, j], weights=weight, minlength=n * 256).reshape(n, 256) @ _SIGNS
            # sums of roots in another order may differ in their last digits, so that 0 isn't quite 0
            out[:, seed * 8 + j] = np.packbits(tally > 1e-6, axis=1, bitorder="little")[:, 0]
    some = np.zeros(n, bool)
    some[doc // 256] = True
    return out, some


def position_classes(positions: int, matches: int, key_bytes: int) -> list[list[int]]:
    """Classes of byte places, one of which holds key_bytes of any `matches` places."""
    n = max(1, (matches - 1) // (key_bytes - 1)) if key_bytes > 1 else 1
    return [list(range(k, positions, n)) for k in range(n)]


def _keys(positions: int, matches: int, key_bytes: int) -> int:
    return sum(len(list(combinations(c, key_bytes))) for c in position_classes(positions, matches, key_bytes))


def usual_key_bytes(n: int, positions: int, matches: int) -> int:
    """Of how many bytes keys cost least for n fingerprints: each key sorts all of them, and ten times as many pairs meet as in a table
    without any likeness."""
    cost = lambda b: _keys(positions, matches, b) * (150.0 * n + 15.0 * 10 * n * n / (2 * 256.0**b))
    return min(range(1, min(matches, 3) + 1), key=cost)


_FP = T.StructType([T.StructField(x, T.LongType()) for x in "abcd"])


def _signed(docs: DataFrame) -> DataFrame:
    """id, th (which tells rows of one id apart) and the fingerprint in four longs."""
    source = docs.select("id", F.xxhash64("text").alias("th"), "text").where("text is not null")
    schema = T.StructType([source.schema["id"], T.StructField("th", T.LongType()), *_FP])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2):
                fp, some = fingerprints(b.column(2).to_pylist())
                longs = fp.view(np.int64)
                keep = pa.array(some)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(longs[:, k]) for k in range(4))], names=["id", "th", *"abcd"]).filter(keep)
        whole = b = None
        give_back()

    return source.mapInArrow(run, schema)


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The label at the end of each row's labels."""
    at = label[x]
    while (label[at] != at).any():
        at = label[at]
    return at


def _link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """The components of both ends become one: the greater root takes the lesser as its label, until no pair has two roots."""
    while len(i):
        a, b = _roots(label, i), _roots(label, j)
        label[i], label[j] = a, b
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _settle(label: np.ndarray) -> None:
    """Every row takes the label of its label, until nothing changes."""
    while (label[label] != label).any():
        label[:] = label[label]


def _tree(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of verified pairs as many as join what isn't joined yet, but one for each two labels; all are joined."""
    a, b = _roots(label, i), _roots(label, j)
    new = a != b
    i, j, a, b = i[new], j[new], a[new], b[new]
    if len(i):
        low, high = np.minimum(a, b), np.maximum(a, b)
        once = np.unique(low * len(label) + high, return_index=True)[1]
        i, j = i[once], j[once]
        _link(label, i, j)
    return i, j


def _verified(fp: np.ndarray, i: np.ndarray, j: np.ndarray, mask: np.ndarray, matches: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share `matches` bytes at the indexed places and differ in no more than max_bits bits. Those that differ in more within
    half of the bits already are let go before the tally. fp: by columns."""
    near = np.bitwise_count(fp[:, 0][i] ^ fp[:, 0][j])
    near += np.bitwise_count(fp[:, 1][i] ^ fp[:, 1][j])
    some = np.nonzero(near <= max_bits)[0]
    i, j = i[some], j[some]
    x = fp[i] ^ fp[j]
    shared = np.bitwise_count(~(((x & _LOW7) + _LOW7) | x) & mask).sum(1, dtype=np.uint8) >= matches
    i, j, x = i[shared], j[shared], x[shared]
    near = np.bitwise_count(x).sum(1, dtype=np.uint16) <= max_bits
    return i[near], j[near]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place where its run of equal keys ends."""
    ends = np.append(np.nonzero(np.diff(sorted_keys))[0] + 1, len(sorted_keys))
    return np.repeat(ends, np.diff(np.concatenate(([0], ends))))


def _lots(begin: np.ndarray, end: np.ndarray, lot: int = 400_000):
    """All pairs of a place i with the places from begin[i] to before end[i], in lots."""
    counts = np.maximum(end - begin, 0)
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = int(total[at - 1]) if at else 0
        to = max(int(np.searchsorted(total, before + lot, side="right")), at + 1)
        c = counts[at:to]
        if c.sum() > 4 * lot:  # one place with very many partners
            for a in range(int(begin[at]), int(end[at]), lot):
                j = np.arange(a, min(a + lot, int(end[at])))
                yield np.full(len(j), at), j
        elif len(c) and c.any():
            i = np.repeat(np.arange(at, to), c)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + begin[i]
        at = to


class _Lists:
    """The lists of one byte place: which other bytes complete a key, and what makes a pair this key's own."""

    def __init__(self, positions: int, matches: int, key_bytes: int, max_bits: int) -> None:
        self.classes = position_classes(positions, matches, key_bytes)
        self.matches, self.key_bytes, self.max_bits = matches, key_bytes, max_bits
        self.mask = np.full(32, 0x80, np.uint8)
        self.mask[positions:] = 0
        self.mask = self.mask.view(np.uint64)
        self.places = [p for c in self.classes for p in (c[: len(c) - key_bytes + 1] if key_bytes > 1 else c[: positions - matches + 1])]

    def pairs(self, place: int, key: np.ndarray, fp: np.ndarray, apart: np.ndarray | None, counted: bool):
        """(i, j, joins): verified pairs of rows that share a list (the same key), and which of them join components; each pair
        under its first key, or without `counted` only pairs that join. apart: blocks that meet and not their own rows."""
        raw, fp = fp.view(np.uint8).reshape(len(fp), 32), np.asfortranarray(fp)
        own = next(k for k, c in enumerate(self.classes) if place in c)
        cls = self.classes[own]
        label = np.arange(len(fp))
        lists = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if not counted:  # what is near its list's first row needs no other key
            yield from self._with_heads(lists, fp, label)
        for rest in combinations([p for p in cls if p > place], self.key_bytes - 1):
            k = lists
            for q in rest:
                k = k * 256 + raw[:, q]
            if counted:
                order = np.argsort(k, kind="stable")
                begin, end = np.arange(1, len(k) + 1), _runs(k[order])
                for i, j in _lots(begin, end):
                    i, j = order[i], order[j]
                    if apart is not None:
                        across = apart[i] != apart[j]
                        i, j = i[across], j[across]
                    i, j = _verified(fp, i, j, self.mask, self.matches, self.max_bits)
                    if len(i):
                        first = self._first(raw, i, j, own, place, rest)
                        i, j = i[first], j[first]
                        yield i, j, *_tree(label, i, j)
            else:
                _settle(label)
                least = np.full(lists.max(initial=0) + 1, len(fp))
                np.minimum.at(least, lists, label)
                if (label == least[lists]).all():
                    return  # each list is joined
                yield from self._joining(k, fp, label)

    def _first(self, raw: np.ndarray, i: np.ndarray, j: np.ndarray, own: int, place: int, rest: tuple[int, ...]) -> np.ndarray:
        same = raw[i] == raw[j]
        key, last = {place, *rest}, max((place, *rest))
        first = ~same[:, [p for p in self.classes[own] if p < last and p not in key]].any(1)
        for c in self.classes[:own]:
            first &= same[:, c].sum(1) < self.key_bytes
        return first

    def _with_heads(self, k: np.ndarray, fp: np.ndarray, label: np.ndarray):
        """Pairs of the first row of each key with those of its others that join components."""
        order = np.argsort(k, kind="stable")
        head = order[np.searchsorted(k[order], k[order])]
        apart = label[head] != label[order]
        for i, j in zip(*(np.array_split(x[apart], apart.sum() // 400_000 + 1) for x in (head, order))):
            i, j = _tree(label, *_verified(fp, i, j, self.mask, self.matches, self.max_bits))
            if len(i):
                yield i, j, i, j

    def _joining(self, k: np.ndarray, fp: np.ndarray, label: np.ndarray):
        """Pairs that join components: first each key's first row with all others, then what is still apart."""
        yield from self._with_heads(k, fp, label)
        again = True
        while again:
            again = False
            _settle(label)
            order = np.lexsort((label, k))
            end = _runs(k[order])
            pair = np.stack((k[order], label[order]))
            change = np.append(np.nonzero((np.diff(pair, axis=1) != 0).any(0))[0] + 1, len(k))
            begin = np.repeat(change, np.diff(np.concatenate(([0], change))))
            left = int(np.maximum(end - begin, 0).sum())
            for i, j in _lots(begin, end):
                left -= len(i)
                i, j = order[i], order[j]
                new = label[i] != label[j]
                i, j = _tree(label, *_verified(fp, i[new], j[new], self.mask, self.matches, self.max_bits))
                if len(i):
                    yield i, j, i, j
                    if left > 4_000_000:  # much of what is left may be joined by now
                        again = True
                        break


def covering_masks(max_bits: int) -> np.ndarray:
    """Masks of 256 bits (four words each), one of which at least leaves out all bits in which any two fingerprints within max_bits differ.

    One of the parts has at most `radius` of those bits. Each of a part's bits has a vector of radius + 1 binary digits, and each
    vector but 0 makes a mask, of the bits whose vectors have an odd number of ones in common with it. `radius` vectors leave at least one
    vector at right angles to all of them, whatever they are; its mask leaves those bits out."""
    parts = max(1, (max_bits + 4) // 6)
    edges = [256 * k // parts for k in range(parts + 1)]
    rng, out = np.random.default_rng(7), []
    for k in range(parts):
        radius = (max_bits + 1 + k) // parts - 1  # over all parts, radius + 1 add up to max_bits + 1
        size, n = edges[k + 1] - edges[k], 2 ** (radius + 1) - 1
        vectors = np.concatenate([rng.permutation(n) + 1 for _ in range(-(-size // n))])[:size]
        for v in range(1, n + 1):
            bits = np.zeros(256, np.uint8)
            bits[edges[k] : edges[k + 1]] = np.bitwise_count(vectors & v) % 2
            out.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return np.array(out)


class _Masks:
    """Fingerprints that meet under masks; what of them is near."""

    def __init__(self, positions: int, matches: int, max_bits: int) -> None:
        self.matches, self.max_bits, self.masks = matches, max_bits, covering_masks(max_bits)
        self.places = np.where(np.arange(32) < positions, 0x80, 0).astype(np.uint8).view(np.uint64)

    def _verified(self, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _verified(fp, i, j, self.places, self.matches, self.max_bits)

    def _joined(self, fp: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = label[i] != label[j]
        return _tree(label, *self._verified(fp, i[new], j[new]))

    def pairs(self, fp: np.ndarray, apart: np.ndarray | None, counted: bool, tables: range | None = None):
        """As _Lists.pairs, of all rows, under the masks of these numbers."""
        fp, label = np.asfortranarray(fp), np.arange(len(fp))
        for t in range(len(self.masks)) if tables is None else tables:
            key = np.zeros(len(fp), np.uint64)
            for c in np.nonzero(self.masks[t])[0]:
                key += (fp[:, c] & self.masks[t, c]) * np.uint64(_SEEDS[c] | 1)
            order = np.argsort(key)
            key = key[order]
            again = np.concatenate(([False], key[1:] == key[:-1]))
            met = again.copy()
            met[:-1] |= again[1:]
            order, key = order[met], key[met]  # without those that are alone
            begin, end = np.arange(1, len(key) + 1), _runs(key)
            if counted:
                for i, j in _lots(begin, end):
                    i, j = order[i], order[j]
                    if apart is not None:
                        across = apart[i] != apart[j]
                        i, j = i[across], j[across]
                    i, j = self._verified(fp, i, j)
                    i, j = self._first(fp, i, j, t)
                    if len(i):
                        yield i, j, *_tree(label, i, j)
                continue
            _settle(label)
            long = end - np.searchsorted(key, key) > LONG_RUN
            for i, j in _lots(begin, np.where(long, begin, end)):
                i, j = self._joined(fp, label, order[i], order[j])
                if len(i):
                    yield i, j, i, j
            if long.any():
                yield from self._in_long_runs(key[long], order[long], fp, label)

    def _first(self, fp: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that meet under no mask before."""
        x = fp[i] ^ fp[j]
        for mask in self.masks[:t]:
            if not len(i):
                break
            new = (x & mask).any(1)
            i, j, x = i[new], j[new], x[new]
        return i, j

    def _in_long_runs(self, key: np.ndarray, rows: np.ndarray, fp: np.ndarray, label: np.ndarray):
        """Pairs that join components: first each run's first row with all others, then what is still apart. Where much was joined, the rest is
        put in order again, so that what is in one component isn't paired."""
        for head, row in zip(*(np.array_split(x, len(rows) // 400_000 + 1) for x in (rows[np.searchsorted(key, key)], rows))):
            i, j = self._joined(fp, label, head, row)
            if len(i):
                yield i, j, i, j
        again = True
        while again:
            again, joined = False, 0
            _settle(label)
            order = np.lexsort((label[rows], key))
            key, rows = key[order], rows[order]
            own = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (label[rows[1:]] != label[rows[:-1]]))))
            begin, end = _runs(own), _runs(key)
            left = int(np.maximum(end - begin, 0).sum())
            for i, j in _lots(begin, end):
                left -= len(i)
                i, j = self._joined(fp, label, rows[i], rows[j])
                if len(i):
                    yield i, j, i, j
                    joined += len(i)
                    if left > 4_000_000 and joined > len(rows) // 50:
                        again = True
                        break


def _found_under_masks(nodes: DataFrame, n: int, positions: int, max_bits: int, counted: bool, together: int) -> DataFrame:
    """As _found, by masks. A task has two blocks, and if that makes few tasks a share of the masks. Written here, since the rows of its
    tables are whole lots of fingerprints, of which few may go to Python at once."""
    spark = nodes.sparkSession
    masks = _Masks(positions, positions - max_bits, max_bits)
    blocks = max(1, -(-n // together))
    # where links are counted, pairs within a block have a task of their own, else they are looked at with those of two blocks
    met = [(a, b) for a in range(blocks) for b in range(a, blocks) if counted or blocks == 1 or a < b]
    shares = min(len(masks.masks), -(-max(24, 2 * spark.sparkContext.defaultParallelism) // len(met)))

    def deal(batches):
        for b in batches:
            lot = np.column_stack([b.column(k).to_numpy() for k in range(5)])
            own = _mixed(lot[:, 0].view(np.uint64) + np.uint64(1), _SEEDS[1]) % np.uint64(blocks)
            some = np.unique(own).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lot[own == k].tobytes() for k in some], pa.binary())], names=["block", "lot"])

    def match(batches):
        lots, of, tasks = [], [], set()
        for b in batches:
            lots += [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for x in b.column(2)]
            of += b.column(1).to_pylist()
            tasks |= set(b.column(0).to_pylist())
        if not lots:
            return
        (task,) = tasks
        apart = np.repeat(of, [len(x) for x in lots])
        node = np.concatenate([x[:, 0] for x in lots])
        fp = np.empty((len(node), 4), np.uint64, order="F")
        for c in range(4):
            fp[:, c] = np.concatenate([x[:, c + 1] for x in lots]).view(np.uint64)
        lots.clear()
        own = met[task // shares][0] == met[task // shares][1]
        count = np.zeros(len(node), np.int64)
        for i, j, a, b in masks.pairs(fp, None if own else apart, counted, range(task % shares, len(masks.masks), shares)):
            if counted:
                count += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.nulls(len(a), pa.int64())], names=["u", "v", "n"])
        some = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], names=["u", "v", "n"])
        del node, fp, apart, count, some
        give_back()

    dealt, _ = materialise(nodes.select("node", *"abcd").mapInArrow(deal, "block int, lot binary"), "simhash-dealt")
    tasks_of = F.array(*(F.array(*(F.lit(m * shares + k) for m, pair in enumerate(met) if block in pair for k in range(shares))) for block in range(blocks)))
    sent = dealt.select(F.explode(F.element_at(tasks_of, F.col("block") + 1)).alias("task"), "block", "lot").repartitionById(len(met) * shares, F.col("task"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "8"):
        return materialise(sent.mapInArrow(match, "u long, v long, n long"), "simhash-found")[0]


def _found(nodes: DataFrame, n: int, positions: int, max_bits: int, key_bytes: int | None, counted: bool, most_listed: int) -> DataFrame:
    """(u, v, n): edges (n null) that join all linked nodes, and if they are counted the links of u (v null)."""
    matches = positions - max_bits
    if not 0 < positions <= 32 or matches < 1:
        raise ValueError(f"no byte of {positions} is certain to be shared within {max_bits} bits")
    lists = _Lists(positions, matches, min(key_bytes or usual_key_bytes(n, positions, matches), matches), max_bits)
    raw_of = lambda b: np.column_stack([b.column(k).to_numpy() for k in range(1, 5)]).view(np.uint8).reshape(b.num_rows, 32)
    blocks = np.ones(32 * 256, np.int64)
    if n > most_listed:  # else no list is longer

        def lengths(batches):
            total = np.zeros(32 * 256, np.int64)
            for b in batches:
                raw = raw_of(b)
                for p in lists.places:
                    total[p * 256 : p * 256 + 256] += np.bincount(raw[:, p], minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["list", "n"])

        # a row for each list, of which there are 32 x 256
        for r in nodes.select("node", *"abcd").mapInArrow(lengths, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
            blocks[r["list"]] = max(1, -(-r["n"] // most_listed))
    most = int(blocks.max())
    block_of = lambda node, b: (_mixed(node.view(np.uint64) + np.uint64(1), _SEEDS[1]) % b.astype(np.uint64)).astype(np.int64)

    def index(batches):
        for b in batches:
            raw, node = raw_of(b), b.column(0).to_numpy()
            for p in lists.places:
                key = p * 256 + raw[:, p].astype(np.int64)
                parts = blocks[key]
                own = block_of(node, parts)
                for other in range(int(parts.max(initial=1))):
                    take = np.nonzero(other < parts)[0]
                    low, high = np.minimum(own[take], other), np.maximum(own[take], other)
                    task = (key[take] * most + low) * most + high
                    part = b.take(pa.array(take)) if len(take) < b.num_rows else b
                    yield pa.RecordBatch.from_arrays([pa.array(task), *part.columns], names=["key", "node", *"abcd"])

    def meet(t: pa.Table, cut: int):
        part = t.slice(0, cut)
        task, node = part.column("key").to_numpy(), part.column("node").to_numpy()
        fp = np.column_stack([part.column(x).to_numpy() for x in "abcd"]).view(np.uint64)
        place = task // (most * most) // 256
        edges, links, of = [], [], []
        for lot in np.split(np.arange(cut), np.nonzero(np.diff(place))[0] + 1):
            apart = None
            if most > 1:
                low, high = task[lot] // most % most, task[lot] % most
                own = block_of(node[lot], blocks[task[lot] // (most * most)])
                # rows of a block meet each other only in the task of that block alone
                apart = np.where(low == high, -1 - np.arange(len(lot)), own)
            count = np.zeros(len(lot), np.int64)
            for i, j, a, b in lists.pairs(int(place[lot[0]]), task[lot], fp[lot], apart if counted else None, counted):
                if counted:
                    count += np.bincount(i, minlength=len(lot)) + np.bincount(j, minlength=len(lot))
                edges.append((node[lot[a]], node[lot[b]]))
            some = np.nonzero(count)[0]
            links.append(count[some])
            of.append(node[lot[some]])
        u = np.concatenate([*(x for x, _ in edges), *of])
        joins = sum(len(x) for x, _ in edges)
        v, n = np.concatenate([*(x for _, x in edges), np.zeros(len(u) - joins, np.int64)]), np.concatenate([np.zeros(joins, np.int64), *links])
        row = np.arange(len(u))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64(), mask=row >= joins), pa.array(n, pa.int64(), mask=row < joins)], names=["u", "v", "n"])

    def match(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= 200_000 and b.column(0)[-1] != held[0].column(0)[0]:
                    t = pa.Table.from_batches(held).combine_chunks()
                    keys = t.column("key").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    yield meet(t, cut)
                    held, rows = t.slice(cut).to_batches(), len(keys) - cut
        if held:
            yield meet(pa.Table.from_batches(held).combine_chunks(), rows)
        held, b, t = [], None, None
        give_back()

    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), *_FP])
    listed = nodes.select("node", *"abcd").mapInArrow(index, keyed).repartition("key").sortWithinPartitions("key")
    return listed.mapInArrow(match, "u long, v long, n long")


def _groups(docs: DataFrame, positions: int, max_bits: int, key_bytes: int | None, counted: bool, most_listed: int, many: int, together: int) -> DataFrame:
    """(id, th, root, n_links) of every row in a class of at least two."""
    with small_batches(docs.sparkSession):
        signed, _ = materialise(_signed(docs), "simhash")
    nodes = signed.groupBy(*"abcd").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes, _ = materialise(nodes, "simhash-nodes")  # written, so that the numbers stay
    n = nodes.count()
    if key_bytes or n <= many:
        found, _ = materialise(_found(nodes, n, positions, max_bits, key_bytes, counted, most_listed), "simhash-found")
    else:
        found = _found_under_masks(nodes, n, positions, max_bits, counted, together)
    roots = connected_components(found.where("n is null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    heads = roots.select("root").distinct().select(F.col("root").alias("node"), F.lit(True).alias("head"))
    joined = nodes.join(roots, "node", "left").join(heads, "node", "left").where("root is not null or head or n > 1").join(links, "node", "left")
    classes = joined.select(*"abcd", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.join(classes.hint("shuffle_hash"), list("abcd")).select("id", "th", "root", "n_links")


def _first(groups: DataFrame) -> DataFrame:
    """The kept row of each group: the least id, nulls last."""
    key = F.struct(F.col("id").isNull().alias("no"), "id", "th")
    return groups.groupBy("root").agg(F.min(key).alias("k")).select("root", F.col("k.id").alias("kept"), F.col("k.th").alias("kept_th"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", positions: int = POSITIONS,
    max_bits: int = MAX_BITS, key_bytes: int | None = None, most_listed: int = MOST_LISTED, many: int = MANY, together: int = TOGETHER,
) -> DataFrame:
    """(id, class_id, n_links): each row of a class of at least two rows, with the least id of its class and the number of
    other fingerprints within max_bits of its own. Rows of one fingerprint are copies and no links; rows without any copy or link
    aren't listed. An id column of another of these names keeps its name, and the added one gets underscores."""
    groups, _ = materialise(_groups(projected(docs, id=id_col, text=text_col), positions, max_bits, key_bytes, True, most_listed, many, together), "simhash-groups")
    names = [x + "_" * (x == id_col.lower()) for x in ("class_id", "n_links")]
    return groups.join(_first(groups), "root").select(F.col("id").alias(id_col), F.col("kept").alias(names[0]), F.col("n_links").alias(names[1]))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", positions: int = POSITIONS,
    max_bits: int = MAX_BITS, key_bytes: int | None = None, most_listed: int = MOST_LISTED, many: int = MANY, together: int = TOGETHER,
) -> DataFrame:
    """The rows of docs with one of each class, all columns kept."""
    groups, _ = materialise(_groups(projected(docs, id=id_col, text=text_col), positions, max_bits, key_bytes, False, most_listed, many, together), "simhash-groups")
    k_id, k_th, k_n = (fresh(docs.columns, x) for x in ("id", "th", "n"))
    first = _first(groups)
    joined = groups.join(first, "root").groupBy("id", "th", "kept", "kept_th").agg(F.count("*").alias("n"))
    same = F.col("id").eqNullSafe(F.col("kept")) & F.col("th").eqNullSafe(F.col("kept_th"))
    fate = joined.select(F.col("id").alias(k_id), F.col("th").alias(k_th), F.when(same, F.col("n")).otherwise(0).alias(k_n))
    fate, _ = materialise(fate.where(f"{k_n} <> 1"), "simhash-fate")
    tagged = docs.withColumn(k_th, F.xxhash64(col(text_col)))
    match = lambda right: col(id_col).eqNullSafe(right[k_id]) & (tagged[k_th] == right[k_th]) & col(text_col).isNotNull()
    kept = tagged.join(fate.hint("shuffle_hash"), match(fate), "left_anti").drop(k_th)
    if fate.where(f"{k_n} > 1").isEmpty():
        return kept
    # rows that repeat a kept row's id and text: any one of them, as they can't be told apart
    again = tagged.join(fate.where(f"{k_n} > 1").select(k_id, k_th).hint("shuffle_hash"), match(fate), "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, k_th]).drop(k_th))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that has near or exact copies."""
    return finished(spark, lambda: near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")), "near-duplicates")
