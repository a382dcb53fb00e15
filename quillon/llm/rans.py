"""Token-id files: static range asymmetric numeral system over one shared frequency table.

write_tokens() tokenises documents in ascending doc_id order into blocks of whole documents, counts ids over
all blocks, scales the counts to one shared table and codes every block on its own: interleaved lanes, a
checkpoint of all lane states every few steps, and checksums of the ids and of the payload. read_tokens()
decodes the files again, a block a row, so any executor can decode any block.

Files (a folder): `blocks` (a row per block: part, block, start, doc_ids, lens, payload), `parts` (a row per
part: part, base = ids in all parts before it, ids, docs) and `table` (a row per id in use: id, freq).
Null or empty texts have the end id alone. Equal doc_ids stay neighbours in one part, ordered by text; null doc_ids
come first. An empty table gives empty files. Columns other than doc_id and text are not read. A text longer
than a block gets a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.session import discard, fresh_path, ship, stored

#: Ids in a block at least (the last of a part may be shorter), lanes, steps between checkpoints, bits of the table at most.
BLOCK, LANES, EVERY, BITS = 1 << 19, 2048, 128, 20
#: Parts up to which their bounds go into one expression; beyond, the engine samples the rows itself.
LEAVES = 2048
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIIII")
_MAGIC = b"qra1"


def scaled(counts: dict[int, int], bits: int | None = None) -> dict[int, int]:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs. By default the table has four slots an id, so
    that decoding stays in the processor's cache, up to BITS."""
    if not counts:
        return {}
    bits = bits or min(BITS, max(12, (4 * len(counts) - 1).bit_length()))
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(i)] for i in ids], np.float64)
    if len(ids) > 1 << bits:
        raise ValueError(f"{len(ids)} ids in use need more than {bits} bits")
    freq = np.maximum(1, np.floor(n / n.sum() * (1 << bits))).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for k in order:
        if over <= 0:
            break
        less = min(over, int(freq[k]) - 1)
        freq[k] -= less
        over -= less
    return dict(zip(ids.tolist(), freq.tolist(), strict=True))


class Table:
    """The shared table laid out for coding."""

    def __init__(self, freq: dict[int, int]):
        size = max(freq, default=0) + 1
        self.bits = bits = max(1, sum(freq.values()).bit_length() - 1)
        self.freq = np.zeros(size, np.uint64)
        for k, f in freq.items():
            self.freq[k] = f
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slot: np.ndarray | None = None

    @property
    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slot


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block. Id number i goes to lane i % lanes; words are stored in the order in which decoding reads them."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, low32, b32, room = np.uint64(table.bits), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(63 - table.bits)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        sym = ids[t * lanes : (t + 1) * lanes]
        x = state[: len(sym)]
        f = table.freq[sym]
        full = np.flatnonzero(x >> room >= f)
        out = x[full]
        words[t] = (out & low32).astype(np.uint32)
        x[full] = out >> b32
        q = x // f
        x += (q << bits) - q * f + table.first[sym]
        if t % every == 0:
            marks[t] = state.copy()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint32)
    at = sorted(marks)
    body = b"".join(
        [
            before[at].astype("<u4").tobytes(),
            b"".join(marks[t].astype("<u8").tobytes() for t in at),
            np.concatenate(words).astype("<u4").tobytes() if words else b"",
        ]
    )
    head = (_MAGIC, n, lanes, every, table.bits, len(at), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return _HEAD.pack(*head) + body


def decode(data: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one segment between checkpoints. Raises ValueError where a checksum differs."""
    magic, n, lanes, every, bits, marks, of_ids, of_body = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != _MAGIC or bits != table.bits or zlib.crc32(body) != of_body:
        raise ValueError("a block is damaged or of another table")
    before = np.frombuffer(body, "<u4", marks)
    states = np.frombuffer(body, "<u8", marks * lanes, 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(body, "<u4", -1, 4 * marks + 8 * marks * lanes)
    mask, b, b32 = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    out = np.empty(n, np.uint32)
    steps = -(-n // lanes) if n else 0
    which = range(marks) if segment is None else [segment]
    for s in which:
        state, at = states[s].copy(), int(before[s])
        for t in range(s * every, min(steps, (s + 1) * every)):
            k = min(lanes, n - t * lanes)
            x = state[:k]
            low = x & mask
            sym = table.slot[low]
            out[t * lanes : t * lanes + k] = sym
            x >>= b
            x *= table.freq[sym]
            x += low - table.first[sym]
            short = np.flatnonzero(x < LOW)
            x[short] = (x[short] << b32) | words[at : at + len(short)]
            at += len(short)
    if segment is not None:
        return out[segment * every * lanes : min(n, (segment + 1) * every * lanes)]
    if zlib.crc32(out.astype("<u4").tobytes()) != of_ids:
        raise ValueError("ids differ from what was coded")
    return out


_ROWS = "part int, block int, start long, n long, doc_ids binary, nulls binary, lens binary, ids binary, counts binary"


def _to_blocks(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = bpe.encoder(path), TaskContext.get().partitionId()
        tail = struct.pack("<I", end)
        docs, lens, held, size, done, at = [], [], [], 0, 0, 0
        total = np.zeros(0, np.int64)

        def row(last: bool = False):
            nonlocal total
            ids = np.frombuffer(b"".join(held), "<u4")
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
            known = np.array([0 if d is None else d for d in docs], "<i8")
            nulls = np.array([d is None for d in docs], np.uint8)
            cells = [part, at, done, len(ids), known.tobytes(), nulls.tobytes(), np.array(lens, "<u4").tobytes(), ids.astype(kind).tobytes(), total.astype("<i8").tobytes() if last else None]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            names = [x.split()[0] for x in _ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                got = ids + tail
                docs.append(doc)
                lens.append(len(got) // 4)
                held.append(got)
                size += len(got) // 4
                if size >= block:
                    yield row()
                    done, at = done + size, at + 1
                    docs, lens, held, size = [], [], [], 0
        yield row(last=True)  # with the part's counts, even if it has no documents

    return run


def _ids(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if len(cell) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for cell in batch.column(0).drop_null():
            got = np.frombuffer(cell.as_py(), "<i8").copy()
            size = max(len(got), len(total))
            total = np.pad(got, (0, size - len(got))) + np.pad(total, (0, size - len(total)))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _ranges(rows: DataFrame, parts: int) -> DataFrame:
    """rows dealt to parts by ranges of doc_id. Only doc_id is read for the bounds, of which there is one a part."""
    if parts > LEAVES:
        return rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    at = rows.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in at})
    if not bounds:
        return rows.coalesce(1)
    # how many bounds are at or under doc_id, by halving
    def under(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= bounds[mid], under(mid + 1, hi)).otherwise(under(lo, mid))

    return rows.repartitionById(len(bounds) + 1, F.coalesce(under(0, len(bounds)), F.lit(0)))


#: Bytes of the input, as the engine's statistics have it, in a part of the files at most, about; parts at most.
PART, MOST = 128 << 20, 1_000_000


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end: int = 0, block: int = BLOCK, lanes: int = LANES, every: int = EVERY) -> str:
    """Write the token files of docs (doc_id, text); the folder's path. See the module for nulls, ties and empty tables.

    The driver holds the counts (one number an id of the vocabulary) and one row a part, no more.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "tokens")
    vocabulary = vocabulary or bpe.vocabulary()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # an input without statistics counts as endless
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // PART)) if known else 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _ranges(rows, parts).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    plain = stored(rows.mapInArrow(_to_blocks(vocabulary, end, block), _ROWS), "token-blocks", compression="snappy")
    del rows
    counts = {r["id"]: r["n"] for r in plain.select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    freq = scaled(counts)
    sums = plain.groupBy("part").agg(F.sum("n").alias("ids"), F.sum(F.length("lens") / 4).cast("long").alias("docs")).orderBy("part").collect()
    base, index = 0, []
    for r in sums:
        index.append((r["part"], base, r["ids"], r["docs"]))
        base += r["ids"]
    spark.createDataFrame(index, "part int, base long, ids long, docs long").coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame(list(freq.items()), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            keep = ["part", "block", "start", "doc_ids", "nulls", "lens"]
            for i, n in enumerate(batch.column("n").to_pylist()):
                data = encode(_ids(batch.column("ids")[i].as_py(), n), table, lanes, every)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in keep), pa.array([data], pa.binary())], [*keep, "payload"])

    out = "part int, block int, start long, doc_ids binary, nulls binary, lens binary, payload binary"
    plain.where("n > 0").drop("counts").mapInArrow(code, out).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(plain)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids (binary, unsigned 32-bit little-endian)."""
    ship(spark)
    freq = {r["id"]: r["freq"] for r in spark.read.parquet(f"{path}/table").collect()}
    shared = spark.sparkContext.broadcast(freq)
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time is held
                r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                ids = decode(r["payload"], table).astype("<u4").tobytes()
                lens = np.frombuffer(r["lens"], "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                cells = [memoryview(ids)[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["nulls"], np.uint8).astype(bool))
                cols = [pa.array([r["part"]] * len(lens), pa.int32()), doc, pa.array(r["start"] + ends - lens), pa.array(lens), pa.array([zlib.crc32(c) for c in cells], pa.int64())]
                cols += [pa.array([bytes(c) for c in cells], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    rows = spark.read.parquet(f"{path}/blocks").select("part", "start", "doc_ids", "nulls", "lens", "payload").mapInArrow(run, schema)
    base = spark.read.parquet(f"{path}/parts").select(F.col("part").alias("of"), "base")
    rows = rows.join(base, F.col("part") == F.col("of"))
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
