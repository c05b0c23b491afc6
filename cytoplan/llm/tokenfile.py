"""Token ids in a binary file format with a static range asymmetric numeral system (operator 6).

Documents are ordered by doc_id with a range partitioning. Each partition becomes one part of the file, in
segments of about SEGMENT ids. A segment has one frequency table, shared by its blocks. A block of about
BLOCK ids holds whole documents; its ids are dealt to LANES interleaved coders that advance together on
arrays, so it decodes by itself. Every STEPS steps a checkpoint keeps the coders' states, from which the
next stretch of the block decodes without the ones before it. Blocks carry CRC-32 checksums of their payload
and of their ids, tables one of theirs.

The file is a Parquet table: part, segment, block (-1: the segment's table), n_docs, n_tokens, body. Memory is
bounded by a segment; a document longer than BLOCK makes a block of its own size. Reading deals segments to all tasks.

Defined cases: null and empty texts hold the end id alone; repeated doc_ids stand next to each other, in
order of their texts, all in one part; a null doc_id stands first; very long texts are encoded whole, as a piece of their own; an empty table gives an empty file and result; other columns
are not looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.llm import textbuf
from cytoplan.llm.bpe import default_tokenizer
from cytoplan.llm.common import shared_folder
from cytoplan.llm.pretokens import Encoder

LANES, STEPS, BLOCK, SEGMENT = 1024, 128, 1 << 18, 1 << 22
#: Text of a part, about; there are as many parts as shuffle partitions at least.
PART_BYTES = 1 << 27
#: Frequencies add up to 2 ** SCALE_BITS; states stay in [2 ** 31, 2 ** 63) and shift 32 bits at a time.
SCALE_BITS, LOW = 20, 1 << 31
END_ID, MAGIC = 0, b"CYTB"
FILE_SCHEMA = "part int, segment int, block int, n_docs long, n_tokens long, body binary"


@lru_cache(2)
def _library_encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}

    def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in t.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    return Encoder(special, encode_words)


class Table:
    """Scaled frequencies of the ids of a segment."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq  # ascending ids; sum of freq: 2 ** SCALE_BITS
        size = int(symbols[-1]) + 1 if len(symbols) else 0
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[symbols] = freq
        self.c[symbols] = np.cumsum(freq) - freq

    @classmethod
    def fit(cls, ids: np.ndarray) -> Table:
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        if len(symbols) > 1 << (SCALE_BITS - 1):
            raise ValueError("too many different ids for one table")
        share = count[symbols].astype(np.float64) / len(ids)
        spare = (1 << SCALE_BITS) - len(symbols)
        freq = 1 + np.floor(share * spare).astype(np.int64)
        freq[np.argmax(freq)] += (1 << SCALE_BITS) - freq.sum()
        return cls(symbols, freq)

    def pack(self) -> bytes:
        body = zlib.compress(self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 1)
        return MAGIC + struct.pack("<II", len(self.symbols), zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        n, crc = struct.unpack_from("<II", data, 4)
        if data[:4] != MAGIC or zlib.crc32(data[12:]) != crc:
            raise ValueError("a frequency table is damaged")
        both = np.frombuffer(zlib.decompress(data[12:]), "<u4").astype(np.int64)
        return cls(both[:n], both[n:])

    def slots(self) -> np.ndarray:
        """The id of every slot."""
        return np.repeat(self.symbols, self.freq).astype(np.uint32)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """Id k belongs to lane k % lanes and step k // lanes. Coding goes backwards, so that decoding goes forwards."""
    n = len(ids)
    total = -(-n // lanes)
    grid = np.zeros(total * lanes, np.int64)
    grid[:n] = ids
    grid[n:] = table.symbols[0]  # padding
    freq, start = table.f[grid].reshape(total, lanes), table.c[grid].reshape(total, lanes)
    top = freq << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    count, bits, low = 0, np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
    for s in range(total - 1, -1, -1):
        f = freq[s]
        full = x >= top[s]
        out = x[full]
        if len(out):
            words.append((out & low).astype("<u4"))
            count += len(out)
            x[full] = out >> np.uint64(32)
        q = x // f
        x = (q << bits) + (x - q * f) + start[s]
        if s % steps == 0:  # decoding may begin at step s
            marks.append((count, x.astype("<u8").tobytes()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    marks.reverse()
    head = struct.pack("<IIIII", lanes, steps, n, len(marks), count)
    places = np.array([count - c for c, _ in marks], "<u4").tobytes()  # words before the mark
    body = head + places + b"".join(state for _, state in marks) + stream
    return struct.pack("<II", zlib.crc32(body), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) + body


def decode_block(data: bytes, table: Table, slots: np.ndarray, stretches: range | None = None) -> np.ndarray:
    """All ids, or those of some stretches between checkpoints (then without the check of all ids)."""
    crc, ids_crc = struct.unpack_from("<II", data)
    if zlib.crc32(memoryview(data)[8:]) != crc:
        raise ValueError("a block is damaged")
    lanes, steps, n, n_marks, count = struct.unpack_from("<IIIII", data, 8)
    places = np.frombuffer(data, "<u4", n_marks, 28)
    states = np.frombuffer(data, "<u8", n_marks * lanes, 28 + 4 * n_marks).reshape(n_marks, lanes)
    stream = np.frombuffer(data, "<u4", count, 28 + 4 * n_marks + 8 * n_marks * lanes).astype(np.uint64)
    total = -(-n // lanes)
    out = np.zeros((total, lanes), np.uint32)
    bits, mask, low, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(LOW), np.uint64(32)
    chosen = range(n_marks) if stretches is None else stretches
    for m in chosen:
        x, at = states[m].astype(np.uint64), int(places[m])
        for s in range(m * steps, min(total, (m + 1) * steps)):
            slot = x & mask
            got = slots[slot]
            out[s] = got
            x = table.f[got] * (x >> bits) + slot - table.c[got]
            need = x < low
            k = int(np.count_nonzero(need))
            if k:
                x[need] = (x[need] << half) | stream[at : at + k]
                at += k
    ids = out.reshape(-1)[:n]
    if stretches is not None:
        return out[chosen[0] * steps : (chosen[-1] + 1) * steps].reshape(-1)[: max(0, n - chosen[0] * steps * lanes)] if len(chosen) else ids[:0]
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != ids_crc:
        raise ValueError("a block's ids are damaged")
    return ids


def _write(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    coder, part, segment = _library_encoder(path), TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        table = Table.fit(flat)
        rows = [(part, segment, -1, 0, 0, table.pack())]
        ends, first, begin = np.cumsum(size), 0, 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK, "right")))
            names = pa.array(docs[first:last], pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([names, pa.array(size[first:last])], names=["doc_id", "n"]))
            index = zlib.compress(sink.getvalue(), 1)
            end = int(ends[last - 1])
            body = struct.pack("<II", len(index), zlib.crc32(index)) + index + encode_block(flat[begin:end], table)
            rows.append((part, segment, len(rows) - 1, last - first, end - begin, body))
            first, begin = last, end
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "segment", "block", "n_docs", "n_tokens", "body"])

    for batch in batches:
        for piece in textbuf.pieces(batch.column(1)):
            found, starts = coder.encode(piece)
            docs += batch.column(0).slice(piece.first, len(piece)).to_pylist()
            with_end = np.insert(found.astype(np.int64), starts[1:], END_ID)
            ids.append(with_end)
            sizes.append(np.diff(starts) + 1)
            held += len(with_end)
            if held >= SEGMENT:
                yield flush()
                docs, sizes, ids, held, segment = [], [], [], 0, segment + 1
    if docs:
        yield flush()


def write_file(documents: DataFrame, to: str, tokenizer: str | None = None) -> None:
    """Encodes every document and writes the file, in ascending order of doc_id."""
    path = tokenizer or default_tokenizer()
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)
    docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    docs.mapInArrow(lambda b: _write(b, path), FILE_SCHEMA).write.parquet(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, start, body) come segment by segment, its table before its blocks. A block decodes by itself, given the table."""
    table = slots = None
    for batch in batches:
        for i in range(len(batch)):
            block, at, body = (c[i].as_py() for c in batch.columns)
            if block < 0:
                table = Table.unpack(body)
                slots = table.slots()
                continue
            size, crc = struct.unpack_from("<II", body)
            index = body[8 : 8 + size]
            if zlib.crc32(index) != crc:
                raise ValueError("an index is damaged")
            docs = pa.ipc.open_stream(zlib.decompress(index)).read_all()
            n = docs["n"].to_numpy()
            ids = np.ascontiguousarray(decode_block(body[8 + size :], table, slots), "<u4")
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [docs["doc_id"].combine_chunks(), pa.array(at + ends - n), pa.array(n),
                 pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends * 4))), pa.py_buffer(ids)]).cast(pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, 4 bytes each) of every document.

    Where a segment's ids start follows from the counts alone, without the bodies; then segments are dealt to all tasks, and decode in parallel.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")  # a row for each segment
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = sizes.withColumn("in_part", in_part).join(before, "part").select("part", "segment", (F.col("before") + F.col("in_part")).alias("start"))
    rows = blocks.join(starts, ["part", "segment"]).repartition("part", "segment")
    own = F.sum("n_tokens").over(Window.partitionBy("part", "segment").orderBy("block")) - F.col("n_tokens")  # at most SEGMENT / BLOCK rows and one longer document
    rows = rows.select("part", "segment", "block", (F.col("start") + own).alias("start"), "body").sortWithinPartitions("part", "segment", "block")
    return rows.select("block", "start", "body").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(documents: DataFrame, tokenizer: str | None = None, to: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    to = to or f"{shared_folder(spark)}-tokens"
    write_file(documents, to, tokenizer)
    return read_file(spark, to)
