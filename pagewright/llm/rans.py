"""Operator 7: token ids as binary by a static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, is shared by all blocks. A block holds whole lists of
some rows; its symbols are dealt in turn to `lanes` coders whose states advance together, as one vector, and
whose 16-bit words share one stream. Blocks know nothing of each other. Every `checkpoint_steps` steps a
block notes all states and the stream's place, so that a decoder may begin there; each such segment has a
CRC-32 of its decoded symbols, and the block one of its payload.

State: 32 bits in [2^16, 2^32); frequencies sum to 2^precision, precision at most 16; a symbol
puts out one word at most. Symbols are numbered densely by the table, so that any 32-bit ids can be
encoded. Where no precision is asked for it is 14, or what more different ids need, up to 16: 65,536 ids, which all of operator
1's vocabulary (50,256) fits. Of still more different ids the most frequent half as many keep symbols of their own; any
other is an escape, counted like a symbol, and four symbols for its bytes.

Tokens come as a list column, as a binary column of two or four little-endian bytes a token, or as a text column: its ids are
then its UTF-8 bytes, with no list being made of them.

Defined cases: a null list is written as length -1 and comes back null, an empty one as 0; null ids
within a list are refused; null row ids and repeated rows are kept; rows of no symbol make a block without payload;
an empty table gives no blocks; an id that the table doesn't have is refused, unless the table has escapes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encode, packed_bytes, read_vocabulary, release, slices
from .common import col, finished, materialise, projected, scratch, setting

PRECISION, MOST_PRECISION, LANES, BLOCK_SYMBOLS, CHECKPOINT_STEPS = 14, 16, 1024, 4_000_000, 1024
LOW = 1 << 16
ESCAPE = 1 << 40  # not an id; the 256 numbers after it are the bytes that follow an escape


@dataclass(frozen=True)
class FrequencyTable:
    """Ids in ascending order, and frequencies that sum to 2^precision."""

    ids: np.ndarray
    freq: np.ndarray
    precision: int

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray, precision: int | None = None) -> FrequencyTable:
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.float64)
        if precision is None:
            precision = min(max(PRECISION, int(len(ids) - 1).bit_length()), MOST_PRECISION)
        total = 1 << precision
        if len(ids) > total:
            own = np.lexsort((ids, -counts))[: total // 2]
            return FrequencyTable.escaping(ids[own], counts[own], np.delete(ids, own), np.delete(counts, own).sum(), precision)
        return FrequencyTable._shared_out(ids, counts, precision)

    @staticmethod
    def escaping(ids: np.ndarray, counts: np.ndarray, others: np.ndarray | None, other_count: float, precision: int) -> FrequencyTable:
        """A table of ids with their counts, and of escapes for all others (of which some may be given, for the counts of their bytes)."""
        n, total = len(ids) + 257, 1 << precision
        if n > total:
            raise ValueError(f"{n} symbols need a precision of at least {int(np.ceil(np.log2(n)))} bits")
        parts = np.ones(256) if others is None else 1 + np.bincount(np.asarray(others, "<i4").view(np.uint8), minlength=256)
        parts = parts / parts.sum() * 4 * max(other_count, 1)
        return FrequencyTable._shared_out(np.concatenate((ids, ESCAPE + np.arange(257))), np.concatenate((counts, [max(other_count, 1)], parts)), precision)

    @staticmethod
    def _shared_out(ids: np.ndarray, counts: np.ndarray, precision: int) -> FrequencyTable:
        order = np.argsort(ids)
        ids, counts, total, n = ids[order], counts[order], 1 << precision, len(ids)
        if not n:
            return FrequencyTable(ids, np.zeros(0, np.int64), precision)
        freq = 1 + np.floor(counts / counts.sum() * (total - n)).astype(np.int64)
        most = np.argsort(-counts, kind="stable")
        rest = total - int(freq.sum())  # no more than n
        freq[most[:rest]] += 1
        return FrequencyTable(ids, freq, precision)

    @property
    def escapes(self) -> bool:
        return bool(len(self.ids)) and int(self.ids[-1]) == ESCAPE + 256

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Each id's symbol; an id without one gives five."""
        out = []
        for a in range(0, len(ids), 500_000):  # work arrays stay small
            part = ids[a : a + 500_000]
            at = np.searchsorted(self.ids, part)
            lacks = self.ids[np.minimum(at, len(self.ids) - 1)] != part if len(self.ids) else np.ones(len(part), bool)
            if lacks.any():
                if not self.escapes:
                    raise ValueError("the frequency table lacks an id")
                sizes = np.where(lacks, 5, 1)
                first = np.cumsum(sizes) - sizes
                wide = np.empty(int(sizes.sum()), np.int64)
                wide[first] = np.where(lacks, len(self.ids) - 257, at)
                digits = part[lacks].astype("<i4").view(np.uint8).reshape(-1, 4).astype(np.int64) + len(self.ids) - 256
                wide[first[lacks][:, None] + np.arange(1, 5)] = digits
                at = wide
            out.append(at.astype(np.uint32))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, from the first symbol of one id to the last of another."""
        if not len(numbers):
            return np.zeros(0, np.int32)
        if not self.escapes:
            return self.ids[numbers].astype(np.int32)
        at = np.nonzero(numbers == len(self.ids) - 257)[0]
        digits = (numbers[at[:, None] + np.arange(1, 5)].astype(np.int64) - (len(self.ids) - 256)).astype(np.uint8)
        ids = np.where(self.ids < ESCAPE, self.ids, 0)[numbers].astype(np.int32)
        ids[at] = np.ascontiguousarray(digits).view("<i4")[:, 0]
        keep = np.ones(len(numbers), bool)
        keep[at[:, None] + np.arange(1, 5)] = False
        return ids[keep]


class Codec:
    def __init__(self, table: FrequencyTable, lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> None:
        self.table, self.lanes, self.every = table, lanes, checkpoint_steps
        self.freq = table.freq.astype(np.uint32)
        self.start = (np.cumsum(table.freq) - table.freq).astype(np.uint32)
        # a full-range frequency (one id only) doesn't fit the renormalisation bound's 32 bits
        self.most = ((table.freq.astype(np.uint64) << np.uint64(32 - table.precision)) - np.uint64(1)).astype(np.uint32)
        self.slot = np.repeat(np.arange(len(table.ids), dtype=np.uint32), table.freq)

    def encode(self, numbers: np.ndarray) -> tuple[bytes, bytes]:
        """Symbols' payload, and the checkpoints: for each segment, from the first, the place of its words in the payload,
        the CRC-32 of its symbols, and the states to begin with."""
        n, lanes, precision = len(numbers), self.lanes, np.uint32(self.table.precision)
        steps = -(-n // lanes)
        states = np.full(lanes, LOW, np.uint32)
        words: list[np.ndarray] = []
        count, marks = 0, []
        for t in range(steps - 1, -1, -1):
            s = numbers[t * lanes : (t + 1) * lanes]
            k = len(s)
            x = states[:k]
            f = self.freq[s]
            out = x > self.most[s]
            emitted = (x[out] & np.uint32(0xFFFF)).astype(np.uint16)
            if len(emitted):
                words.append(emitted)
                count += len(emitted)
            x = np.where(out, x >> np.uint32(16), x)
            q = x // f
            states[:k] = (q << precision) + (x - q * f) + self.start[s]
            if t % self.every == 0:
                marks.append((t, count, states.copy()))
        payload = np.concatenate(words[::-1]).astype("<u2").tobytes() if words else b""
        out = []
        for t, after, x in reversed(marks):
            part = numbers[t * lanes : (t + self.every) * lanes].astype("<u4").tobytes()
            out.append(struct.pack("<II", count - after, zlib.crc32(part)) + x.astype("<u4").tobytes())
        return payload, b"".join(out)

    def segments(self, n: int) -> int:
        return -(-n // (self.lanes * self.every))

    def decode(self, payload: bytes, checkpoints: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The symbols of segments first to last (all, if not given), each proved by its checksum."""
        lanes, precision = self.lanes, np.uint32(self.table.precision)
        words = np.frombuffer(payload, "<u2").astype(np.uint32)
        size, mask = 8 + 4 * lanes, np.uint32((1 << self.table.precision) - 1)
        parts = []
        for g in range(first, self.segments(n) if last is None else last):
            at, crc = struct.unpack_from("<II", checkpoints, g * size)
            states = np.frombuffer(checkpoints, "<u4", lanes, g * size + 8).astype(np.uint32)
            begin, end = g * lanes * self.every, min(n, (g + 1) * lanes * self.every)
            numbers = np.empty(end - begin, np.uint32)
            for a in range(0, end - begin, lanes):
                k = min(lanes, end - begin - a)
                x = states[:k]
                low = x & mask
                s = self.slot[low]
                numbers[a : a + k] = s
                x = self.freq[s] * (x >> precision) + low - self.start[s]
                need = np.nonzero(x < LOW)[0]
                if len(need):
                    if at + len(need) > len(words):
                        raise ValueError(f"segment {g} ends early and can't agree with its checksum")
                    x[need] = (x[need] << np.uint32(16)) | words[at : at + len(need)]
                    at += len(need)
                states[:k] = x
            if zlib.crc32(numbers.astype("<u4").tobytes()) != crc:
                raise ValueError(f"segment {g} doesn't agree with its checksum")
            parts.append(numbers)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _symbols(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """List lengths (-1: null) and all ids. A text's ids are its UTF-8 bytes, those of binary are `width` bytes each."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("a list holds a null id")
        return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False)
    if pa.types.is_binary(column.type):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = pc.fill_null(pc.binary_length(column), -width).to_numpy(zero_copy_only=False) // width
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, "<i4", len(column) + 1, column.offset * 4)
        kind = "<u2" if width == 2 else "<i4"
        return lengths, np.frombuffer(data, kind, (ends[-1] - ends[0]) // width, ends[0]) if data and ends[-1] > ends[0] else np.zeros(0, np.int32)
    raw = column.cast(pa.binary()).to_pylist()
    lengths = np.fromiter((-1 if x is None else len(x) for x in raw), np.int32, len(raw))
    return lengths, np.frombuffer(b"".join(x for x in raw if x), np.uint8)


def frequency_table(tokens: DataFrame, tokens_col: str = "tokens", precision: int | None = None, width: int = 4) -> FrequencyTable:
    """The table of all tokens. Each task counts its own; at most 2^precision different ids (2^16, if no precision is given) come to
    the driver, the most frequent ones, and the count of all others together."""

    def count(batches):
        release()
        total: dict[int, int] = {}
        for whole in batches:
            for b in _lots(whole, 0):
                values, counts = np.unique(_symbols(b.column(0), width)[1], return_counts=True)
                for v, c in zip(values.tolist(), counts.tolist()):
                    total[v] = total.get(v, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    counts = tokens.select(col(tokens_col)).mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    most = 1 << (precision or MOST_PRECISION)
    with scratch(tokens.sparkSession):
        counts, _ = materialise(counts, "rans-counts")
        rows = counts.orderBy(F.desc("n"), "id").limit(most + 1).collect()
        ids, own = np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows])
        if len(ids) <= most:
            return FrequencyTable.of(ids, own, precision)
        half = most // 2
        rest = counts.agg(F.sum("n")).first()[0] - own[:half].sum()
    return FrequencyTable.escaping(ids[:half], own[:half], ids[half:], rest, precision or MOST_PRECISION)


def _lots(batch: pa.RecordBatch, at: int):
    """Texts and packed tokens in lots of some megabytes; token lists as they come."""
    return [batch] if pa.types.is_list(batch.column(at).type) else slices(batch, at, 4_000_000)


def _block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("n_symbols", T.IntegerType()),
        T.StructField("payload", T.BinaryType()), T.StructField("checkpoints", T.BinaryType()), T.StructField("crc", T.LongType()),
    ])


def encode_blocks(
    tokens: DataFrame, table: FrequencyTable, id_col: str = "doc_id", tokens_col: str = "tokens", lanes: int = LANES,
    block_symbols: int = BLOCK_SYMBOLS, checkpoint_steps: int = CHECKPOINT_STEPS, width: int = 4,
) -> DataFrame:
    """A row for each block: its rows' ids and list lengths, payload, checkpoints and CRC-32 of both."""
    source = projected(tokens, id=id_col, tokens=tokens_col)
    schema = _block_schema(source.schema["id"].dataType)
    shared = tokens.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        release()
        codec = Codec(shared.value, lanes, checkpoint_steps)
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            parts = [_symbols(c, width) for c in t.column(1).chunks]
            lengths, symbols = (np.concatenate(x) for x in zip(*parts))
            symbols = codec.table.numbers(symbols)
            payload, checkpoints = codec.encode(symbols)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns = [one(t.column(0).combine_chunks()), one(pa.array(lengths, pa.int32())), pa.array([len(symbols)], pa.int32()), pa.array([payload]), pa.array([checkpoints]), pa.array([zlib.crc32(checkpoints, zlib.crc32(payload))])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            column = b.column(1)
            measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
            sizes = pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, at = np.cumsum(sizes // width if pa.types.is_binary(column.type) else sizes), 0
            while at < b.num_rows:
                before = int(total[at - 1]) if at else 0
                end = max(int(np.searchsorted(total, before + block_symbols - size, side="right")), at + (not held))
                if end > at:
                    held.append(b.slice(at, end - at))
                    size += int(total[end - 1]) - before
                    at = end
                if at < b.num_rows or size >= block_symbols:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return source.mapInArrow(run, schema)


def decode_blocks(blocks: DataFrame, table: FrequencyTable, id_col: str = "doc_id", lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> DataFrame:
    """(id, tokens) of every row of every block; a damaged block is an error."""
    schema = T.StructType([T.StructField(id_col, blocks.schema["ids"].dataType.elementType), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        codec = Codec(shared.value, lanes, checkpoint_steps)
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, n, payload, checkpoints, crc = (b.column(k).slice(i, 1) for k in range(6))
                payload, checkpoints = payload[0].as_py(), checkpoints[0].as_py()
                if zlib.crc32(checkpoints, zlib.crc32(payload)) != crc[0].as_py():
                    raise ValueError("a block doesn't agree with its checksum")
                symbols = codec.table.ids_of(codec.decode(payload, checkpoints, n[0].as_py()))
                lengths = lengths.flatten().to_numpy()
                offsets = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(lengths < 0, False)), pa.array(symbols))
                yield pa.RecordBatch.from_arrays([ids.flatten(), lists], names=schema.names)

    return blocks.mapInArrow(run, schema)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids by operator 1 as rANS blocks. The tokens are written once: counting and coding both read them."""

    def make() -> DataFrame:
        tokens, _ = materialise(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), packed=True).drop("n_tokens"), "rans-tokens")
        width = packed_bytes(read_vocabulary())
        return encode_blocks(tokens, frequency_table(tokens, precision=MOST_PRECISION, width=width), width=width)

    # texts of some kilobytes: as many a batch as usual would be held several times over
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        return finished(spark, make, "rans-blocks")
