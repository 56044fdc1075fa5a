"""Operator 1: byte-level BPE by corpus-level merge replay.

Every task takes its share of the corpus as one vocabulary of distinct pretokens. All their bytes
lie in one array of symbols; an inverted index leads from each token pair (by its merge rank) to the
positions where it stands. The merges are then replayed once, in rank order, over all words at
the same time: a merge touches the positions its pair is indexed at and re-ranks their left and
right neighbours only. The occurrences are finally replaced by their word's tokens.

There is no shuffle: the split of a word depends on nothing but the word, so a task's vocabulary is
as good as the whole corpus's. The tables of a task are bounded by `block_chars` characters.

Defined cases: a null text has null tokens and n_tokens 0; an empty text has an empty list; a null
id stays null; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import ctypes
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import projected

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSEEN = 0, 1, 2, 3, 255


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """The tokens by rank, which is also their id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Pretokeniser:
    """Splits many texts at once, by character classes, as the usual pattern does:
    contractions, then runs of letters, of digits or of other signs with one blank before them, then
    white space, whose last character is left to what follows."""

    def __init__(self) -> None:
        self.classes = np.full(0x110000, _UNSEEN, np.uint8)
        self.tests = [(k, regex.compile(p)) for k, p in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"))]

    def classify(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.classes[chars]
        if (kinds == _UNSEEN).any():
            for c in np.unique(chars[kinds == _UNSEEN]).tolist():
                self.classes[c] = next((k for k, p in self.tests if p.match(chr(c))), _OTHER)
            kinds = self.classes[chars]
        return kinds

    def starts(self, chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Where pretokens start; doc_starts: where the (non-empty) texts start."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self.classify(chars)
        first = np.zeros(n + 1, bool)
        first[doc_starts] = True
        first[n] = True
        begin = first.copy()
        begin[1:n] |= kinds[1:] != kinds[:-1]
        space = kinds == _SPACE
        # the last white character before a sign of the same text starts a token; a blank takes the sign with it
        last = np.nonzero(space[: n - 1] & ~space[1:] & ~first[1:n])[0]
        begin[last] = True
        blank = last[chars[last] == 32]
        begin[blank + 1] = False
        # contractions: an apostrophe alone between its run's borders, no blank before it
        at = np.nonzero((chars[: n - 1] == 39) & begin[: n - 1] & (kinds[1:] == _LETTER) & ~first[1:n])[0]
        if len(at):
            a = chars[at + 1]
            two = at + 2 < n
            two[two] = ~first[at[two] + 2]
            b = np.where(two, chars[np.minimum(at + 2, n - 1)], 0)
            one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            pair = two & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for mask, step in ((one, 2), (pair & ~one, 3)):
                hit = at[mask]
                begin[hit + 1] = False
                after = hit[hit + step < n] + step
                # a blank's last place was already settled: only the inside of a run of letters is new
                begin[after[kinds[after] == _LETTER]] = True
        return np.nonzero(begin[:n])[0]


class MergeReplay:
    """The merge table of a vocabulary and its replay over a corpus of words."""

    def __init__(self, tokens: list[bytes]) -> None:
        ids = {t: i for i, t in enumerate(tokens)}
        self.size = len(tokens)
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        # only pairs of equal tokens can overlap, as in aaa
        self.twice = {merged[i] for i, k in enumerate(keys) if k % (self.size + 1) == 0}
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        edges = [0, 64, 128, 256, 512]
        while edges[-1] < self.size:
            edges.append(min(edges[-1] + max(512, edges[-1] // 4), self.size))
        self.windows = list(zip(edges, edges[1:]))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def replay(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in one array, and the offsets of the words in it. raw: the bytes of all words."""
        n = len(raw)
        ends = np.cumsum(lengths)
        sym = self.bytes[raw]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends[lengths > 0] - 1] = -1
        prv[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        inner = np.nonzero(nxt >= 0)[0]
        for part in np.array_split(inner, len(inner) // 500_000 + 1):
            rank[part] = self.ranks(sym[part], sym[part + 1])
        del inner
        merging = np.zeros(n, bool)
        for low, high in self.windows:
            # the index of this window of ranks; a rank that a merge brings forth is above its own
            here = np.nonzero(rank < high)[0]
            if not len(here):
                continue
            here = here[np.argsort(rank[here], kind="stable")]
            r = rank[here]
            cuts = np.nonzero(np.diff(r))[0] + 1
            index: dict[int, list[np.ndarray]] = defaultdict(list)
            heap = []
            for part in np.split(here, cuts):
                k = int(rank[part[0]])
                index[k].append(part)
                heap.append(k)  # ascending, hence a heap
            while heap:
                k = heappop(heap)
                parts = index.pop(k)
                p = parts[0] if len(parts) == 1 else np.concatenate(parts)
                p = p[rank[p] == k]
                if not len(p):
                    continue
                if len(p) > 1 and k in self.twice:
                    p = self._apart(np.sort(p), nxt)
                q = nxt[p]
                sym[p] = k
                alive[q] = False
                rank[q] = NONE
                after = nxt[q]
                nxt[p] = after
                has = after >= 0
                prv[after[has]] = p[has]
                merging[p] = True
                left = prv[p]
                left = left[left >= 0]
                left = left[~merging[left]]
                merging[p] = False
                rank[p[~has]] = NONE
                touched = np.concatenate((p[has], left))
                if not len(touched):
                    continue
                new = self.ranks(sym[touched], sym[nxt[touched]])
                rank[touched] = new
                known = new != NONE
                touched, new = touched[known], new[known]
                soon = new < high
                if soon.any():
                    t, w = touched[soon], new[soon]
                    if len(w) > 1:
                        o = np.argsort(w, kind="stable")
                        t, w = t[o], w[o]
                    for part in np.split(t, np.nonzero(np.diff(w))[0] + 1) if len(w) > 1 else (t,):
                        j = int(rank[part[0]])
                        if j not in index:
                            heappush(heap, j)
                        index[j].append(part)
        kept = np.cumsum(alive)
        offsets = np.zeros(len(lengths) + 1, np.int64)
        offsets[1:] = np.where(ends > 0, kept[np.maximum(ends, 1) - 1], 0) if n else 0
        return sym[alive], offsets

    @staticmethod
    def _apart(p: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of pairs that overlap (as in aaa) every second, from the left."""
        chained = nxt[p[:-1]] == p[1:]
        if not chained.any():
            return p
        number = np.arange(len(p))
        fresh_start = np.concatenate(([True], ~chained))
        start = np.maximum.accumulate(np.where(fresh_start, number, 0))
        return p[(number - start) % 2 == 0]


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            t = np.full(size, np.uint64(b), np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[base] = tables[0], tables[1]
    return _powers[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A polynomial hash of each span, from one running sum."""
    up, down = _power_tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def _spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of some spans, one after another; fewer than 2^31."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return values[_places(starts - (ends - sizes), sizes)]


def _places(shift: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from 0, each span's shifted by its own amount."""
    out = np.repeat(shift.astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _distinct(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans that cover all values without a gap: the distinct ones' hashes and places, and which of them each span is."""
    found, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    first = at[back]
    same = bool((sizes == sizes[first]).all())
    for i, j in zip(lots := [*range(0, len(starts), 100_000)], [*lots[1:], len(starts)]):
        if same:
            own = values[starts[i] : starts[j - 1] + sizes[j - 1]]
            same = bool((own == values[_places(starts[first[i:j]] - (starts[i:j] - starts[i]), sizes[i:j])]).all())
    if same:
        return found, at, back
    keys: dict[bytes, int] = {}  # different spans of one hash: by their values
    back = np.fromiter((keys.setdefault(values[s : s + n].tobytes(), len(keys)) for s, n in zip(starts.tolist(), sizes.tolist())), np.int64, len(starts))
    at = np.unique(back, return_index=True)[1]
    return hashes[at], at, back


@dataclass(frozen=True)
class Words:
    """The distinct words of some texts (hashes, letters and sizes), the word of each pretoken and the number of pretokens of each text."""

    hashes: np.ndarray
    letters: np.ndarray
    sizes: np.ndarray
    used: np.ndarray
    counts: np.ndarray


class Encoder:
    """Encodes a task's share of the corpus, block by block."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.split, self.merges = Pretokeniser(), MergeReplay(tokens)

    def words(self, texts: list[str]) -> Words:
        """The pretokens of some texts, and which of their distinct words each is. Hashes only gather what may be one word;
        letters decide: all are compared with those of the first of their hash."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(lengths) - lengths
        starts = self.split.starts(chars, begins[lengths > 0])
        sizes = np.diff(np.append(starts, len(chars))).astype(np.int32) if len(starts) else starts.astype(np.int32)
        counts = np.searchsorted(starts, begins + lengths) - np.searchsorted(starts, begins)
        hashes, at, back = _distinct(chars, starts, sizes, span_hashes(chars, starts, starts + sizes))
        return Words(hashes, _spans(chars, starts[at], sizes[at]), sizes[at], back.astype(np.int32), counts)

    def block(self, batches: Iterable[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each batch the tokens of its texts and how many each has. Texts are asked for and tokens given batch by batch."""
        hashes, letters, sizes, used, counts = [], [], [], [], []
        for texts in batches:
            p = self.words([t or "" for t in texts])
            for kept, x in zip((hashes, letters, sizes, used, counts), (p.hashes, p.letters, p.sizes, p.used, p.counts)):
                kept.append(x)
        firsts = np.cumsum([0, *map(len, sizes)])
        joined, lengths = np.concatenate(letters), np.concatenate(sizes)
        letters.clear()
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        _, at, number = _distinct(joined, starts, lengths, np.concatenate(hashes))
        distinct, lengths, number = _spans(joined, starts[at], lengths[at]), lengths[at], number.astype(np.int32)
        del joined, starts, hashes
        ends = np.concatenate(([0], np.cumsum(1 + (distinct >= 0x80) + (distinct >= 0x800) + (distinct >= 0x10000))))
        raw = np.frombuffer(distinct.tobytes().decode("utf-32-le").encode(), np.uint8)
        flat, offsets = self.merges.replay(raw, np.diff(ends[np.concatenate(([0], np.cumsum(lengths)))]))
        del distinct, ends, raw
        n = np.diff(offsets)
        for first, of, per_text in zip(firsts, used, counts):
            yield _gather(flat, offsets[:-1], n, number[first + of], per_text)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        tokens, counts = next(self.block([texts]))
        return [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] if texts else []


def _gather(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, used: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a sequence of words, and how many each of the runs of `counts` words has."""
    n = sizes[used]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(at[used] - (ends - n), n)
    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return flat[take], np.diff(edges)


def decode_tokens(tokens: list[bytes], ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each run of ids; unknown ids add nothing."""
    key = id(tokens)
    if key not in _flat:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        _flat.clear()
        _flat[key] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths
    raw, at, lengths = _flat[key]
    ok = (ids >= 0) & (ids < len(tokens))
    safe = np.where(ok, ids, 0)
    sizes = np.where(ok, lengths[safe], 0)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    data = raw[np.arange(total) + np.repeat(at[safe] - (ends - sizes), sizes)].tobytes()
    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


_flat: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
_encoders: dict[int, Encoder] = {}


def _encoder(key: int, tokens: list[bytes]) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(tokens)
    return _encoders[key]


def release() -> None:
    """Forget what a Python worker keeps from one task to the next for tokenising, and give the memory back: for
    tasks of another kind that follow in the same worker."""
    for kept in (_encoders, _powers, _flat):
        kept.clear()
    give_back()


def give_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc holds what was freed
    if trim:
        trim(0)


def packed_bytes(vocabulary: list[bytes]) -> int:
    """How many bytes a packed token takes."""
    return 2 if len(vocabulary) <= 1 << 16 else 4


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
    block_chars: int = 32_000_000, check_round_trip: bool = False, packed: bool = False,
) -> DataFrame:
    """(id, tokens array<int>, n_tokens) of every row; with check_round_trip also whether decoding
    gives the text again; packed: tokens as binary, little-endian, in as many bytes each as
    packed_bytes() says. The vocabulary is read on the driver and sent out: its size is fixed."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = hash(vocabulary)
    source = projected(docs, id=id_col, text=text_col)
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("tokens", T.BinaryType() if packed else T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]
    if check_round_trip:
        fields.append(T.StructField("round_trip", T.BooleanType()))
    names = [f.name for f in fields]

    def out(batch: pa.RecordBatch, tokens: np.ndarray, counts: np.ndarray, vocabulary: list[bytes]) -> pa.RecordBatch:
        missing = np.asarray(batch.column(1).is_null())
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        if packed:
            width = packed_bytes(vocabulary)
            data = [pa.array(~missing).buffers()[1], pa.py_buffer(ends * np.int32(width)), pa.py_buffer(tokens.astype(f"<u{width}"))]
            lists = pa.Array.from_buffers(pa.binary(), len(counts), data)
        else:
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(missing, False)), pa.array(tokens))
        columns = [batch.column(0), lists, pa.array(counts.astype(np.int32))]
        if check_round_trip:
            texts = batch.column(1).to_pylist()
            back = decode_tokens(vocabulary, tokens, counts)
            columns.append(pa.array([None if t is None else t.encode() == x for t, x in zip(texts, back)], pa.bool_()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        vocabulary = shared.value
        encoder = _encoder(key, vocabulary)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            for batch, (tokens, counts) in zip(held, encoder.block(b.column(1).to_pylist() for b in held)):
                yield out(batch, tokens, counts, vocabulary)
            give_back()

        for whole in batches:
            for batch in slices(whole, 1):
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= block_chars:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return source.mapInArrow(run, T.StructType(fields))


def slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000):
    """Runs of rows of about `limit` bytes of text each, so that work arrays stay small."""
    n, at = batch.num_rows, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    while at < n:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def decode(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) from token lists; null lists give null, bytes that are no UTF-8 become U+FFFD,
    ids outside the vocabulary add nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = projected(tokens, id=id_col, tokens=tokens_col)
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        vocabulary = shared.value
        for b in batches:
            column = b.column(1)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            missing = column.is_null().to_pylist()
            texts = [None if m else x.decode("utf-8", "replace") for m, x in zip(missing, decode_tokens(vocabulary, ids, counts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return source.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, with the decoder's answer to whether they give its text again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check_round_trip=True)
