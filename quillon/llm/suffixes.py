"""Exact removal of byte strings that repeat across documents, by merging Burrows-Wheeler transforms of shards.

Documents lie in parts of bounded size, in the order in which they are read. Each window of `size` bytes belongs to
the smallest hash among its 26-byte strings, its anchor, so equal windows of any documents have equal anchors:

1. Each part sends its distinct anchors, by ranges of the hash; those met in two documents or more are sent back.
2. Each part sends the contexts of such anchors (the bytes of consecutive windows that share one), equal contexts once
   with their smallest doc_id. Contexts of one anchor meet in one bucket, where equal ones are kept once more.
3. A bucket deals its contexts to shards. A shard sorts its suffixes once, which gives its transform: by depth, the two
   bytes before each suffix, in the shard's order. The shards' transforms are merged by refining their interleave: at
   first the shards stand one after another; from depth d to d + 2 the interleave is dealt, stably, by the symbols that
   it reads off the transforms. No suffix of a shard is moved or compared again. Where neighbours differ in symbol or
   differed before, a block of common prefixes ends; after depth `size`, each block is one repeated string, with the
   smallest doc_id of its suffixes. Only suffixes that a window's refinement needs at a depth are carried there.

The smallest doc_id of every window goes back to the part, which removes windows whose smallest is under their own
document's. Anchors met in many parts are split: their windows are dealt one by one, by their own hash, so no bucket
holds all contexts of a passage that a large share of documents has.

The texts are moved once, to a bucketed table that every pass reads in place. Contexts are never written beside their
shuffle: the last pass finds the windows of its part anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import fresh_path, release, ship, stored

#: Bytes of a repeated string; of an anchor's string; windows that share an anchor, at most.
SIZE, GRAM = 50, 26
SPAN = SIZE - GRAM + 1
WIDTH = SIZE + SPAN - 1
#: Bytes of text in a part, and of text for each bucket of anchors, about; parts an anchor may be in before it is split.
PART, BUCKET, HOT = 8 << 20, 16 << 20, 1000
#: Files' numbers in the table of parts at most (the engine takes 100,000); beyond, a number holds several parts.
FILES = 50_000
#: Contexts in a shard, about, and shards of a bucket at most.
SHARD, SHARDS = 1 << 15, 200
#: Of zstd, for what parts and buckets send one another: most of it is text.
LEVEL = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Stands for the type of whole numbers of 64 bits that are sent in 32.
_NARROW = -1


def _pack(*arrays: np.ndarray) -> bytes:
    head, body = [], []
    for a in arrays:
        narrow = a.dtype == np.int64 and a.size > 0 and a.min() >= 0 and a.max() < 1 << 32
        head += [_NARROW if narrow else a.dtype.num, a.size]
        body.append(np.ascontiguousarray(a, np.uint32 if narrow else a.dtype).tobytes())
    data = b"".join(body)
    whole = np.array([len(arrays), len(data), *head], "<i8").tobytes()
    return whole + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(data, "<i8", 2).tolist()
    head = np.frombuffer(data, "<i8", 2 * n, 16).reshape(n, 2)
    body = pa.decompress(data[16 + 16 * n :], size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    kinds = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64)}
    for num, count in head.tolist():
        kind = np.dtype(np.uint32) if num == _NARROW else kinds[num]
        got = np.frombuffer(body, kind, count, at)
        out.append(got.astype(np.int64) if num == _NARROW else got)
        at += kind.itemsize * count
    return out


_PARTS = "part long, docs array<long>, sizes binary, text binary"


def _deal(part_bytes: int):
    """Documents, in the order in which a task reads them, to parts: a row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            cells = ([number], [docs], [sizes], [b"".join(texts)])
            types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["part", "docs", "sizes", "text"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= part_bytes:
                    yield row()
                    number, docs, texts, size = number + 1, [], [], 0
        if docs:
            yield row()

    return run


class Part:
    """The texts of a part as one run of bytes."""

    def __init__(self, number: int, docs: list[int | None], sizes: bytes, text: bytes):
        self.number, self.docs = number, docs
        size = np.frombuffer(sizes, "<i8")
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.blob = np.frombuffer(text + bytes(128), np.uint8)
        self.owner = np.array([0 if d is None else d for d in docs], np.int64)

    @classmethod
    def of(cls, group: pa.Table | pa.RecordBatch) -> Part:
        return cls(*(group.column(k)[0].as_py() for k in ("part", "docs", "sizes", "text")))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of windows that share an anchor (of at most SPAN): its hash, first start, windows and row.
        Rows with a null doc_id have none."""
        out: list[tuple[np.ndarray, ...]] = []
        held: list[int] = []
        size = 0
        for row, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), strict=True)):
            if b - a < SIZE or self.docs[row] is None:
                continue
            # documents that lie together, so that the work stays in the processor's cache
            if held and (size + b - a > 1 << 15 or row != held[-1] + 1):
                out += self._runs(held)
                held, size = [], 0
            held.append(row)
            size += b - a
        if held:
            out += self._runs(held)
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else empty

    def _runs(self, rows: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        a, b = int(self.starts[rows[0]]), int(self.ends[rows[-1]])
        step = 1 << 16
        for at in range(a, b, step):  # a long document in pieces that overlap by a window
            yield from self._piece(rows, at, min(b, at + step + SIZE - 1), min(b, at + step))

    def _piece(self, rows: list[int], a: int, b: int, last: int) -> Iterator[tuple[np.ndarray, ...]]:
        n = b - a
        if n < SIZE:
            return
        load = lambda off: np.ndarray((n,), np.uint64, buffer=self.blob.data, offset=a + off, strides=(1,))
        h = load(0) * _MUL
        for off in (8, 16, GRAM - 8):
            h ^= h >> np.uint64(29)
            h += load(off)
            h *= _MUL
        h ^= h >> np.uint64(32)
        k = 1
        while 2 * k <= SPAN:
            np.minimum(h[: n - k], h[k:], out=h[: n - k])
            k *= 2
        if k < SPAN:
            np.minimum(h[: n - (SPAN - k)], h[SPAN - k :], out=h[: n - (SPAN - k)])
        row = np.repeat(np.array(rows), np.minimum(self.ends[rows], b) - np.minimum(np.maximum(self.starts[rows], a), b).clip(max=np.minimum(self.ends[rows], b)))
        ok = np.flatnonzero((np.arange(a, b) + SIZE <= self.ends[row]) & (np.arange(a, b) < last))
        if not len(ok):
            return
        key, who = h[ok], row[ok]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate([begin, [len(ok)]]))
        if count.max() > SPAN:  # a string that repeats itself
            parts = -(-count // SPAN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, count = np.repeat(begin, parts) + nth * SPAN, np.minimum(SPAN, np.repeat(count, parts) - nth * SPAN)
        spread = key[begin] * np.uint64(0xD6E8FEB86659FD93)  # smallest hashes are small: one to one, over the whole range
        spread ^= spread >> np.uint64(32)
        yield spread * _MUL, ok[begin] + a, count, who[begin]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _short(h: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """32 bits of where hashes are in bucket k, in order: equal ones stay equal, the rest is decided by bytes."""
    return ((h - np.uint64((k << 64) // buckets)) // np.uint64((1 << 32) // buckets + 2)).astype("<u4")


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket that occurs with where it does; bucket is in order."""
    which, at = np.unique(bucket, return_index=True)
    ends = np.concatenate([at, [len(bucket)]])[1:]
    for k, a, b in zip(which.tolist(), at.tolist(), ends[: len(at)].tolist(), strict=True):
        yield k, slice(a, b)


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part.of(batch.slice(i, 1))
                h = np.unique(part.runs()[0])
                cells = []
                for k, cut in _slices(_bucket(h, buckets)):
                    cells.append((k, part.number, _short(h[cut], k, buckets).tobytes()))
                cols = zip(*cells, strict=True) if cells else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "part", "data"])

    return run


def _find_repeats(hot: int):
    def run(group: pa.Table) -> pa.Table:
        parts, lists = group.column("part").to_pylist(), [np.frombuffer(d.as_py(), "<u4") for d in group.column("data")]
        every, count = np.unique(np.concatenate([np.unique(x) for x in lists]), return_counts=True)
        twice, often = every[count > 1], every[count >= hot]

        def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            at = np.searchsorted(of, x)
            at[at == len(of)] = 0
            return of[at] == x if len(of) else np.zeros(len(x), bool)

        data = [_pack(np.packbits(member(x, twice)), np.packbits(member(x, often)), np.array([len(x)], np.int64)) for x in lists]
        return pa.table([pa.array(parts, pa.int64()), group.column("bucket"), pa.array(data, pa.binary())], ["part", "bucket", "data"])

    return run


def _distinct(ctx: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct (key, count, bytes), which of them each row is). Equal hashes are checked by bytes."""
    pad = np.zeros((len(ctx), -(-WIDTH // 8) * 8), np.uint8)
    pad[:, :WIDTH] = ctx
    h = key ^ (count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for x in pad.view(np.uint64).T:
        h = (h ^ x) * _MUL
        h ^= h >> np.uint64(31)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if (ctx[first][which] != ctx).any() or (count[first][which] != count).any() or (key[first][which] != key).any():
        whole = np.concatenate([pad, count.astype(np.uint8)[:, None], key[:, None].view(np.uint8).reshape(len(key), 8)], 1)
        _, first, which = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


def _least(which: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, which, docs)
    return out


class Windows:
    """The runs of windows in a part whose anchors repeat, and their distinct contexts in order of anchor."""

    def __init__(self, part: Part, flags: list[list[np.ndarray]]):
        """flags: what _find_repeats() sent, by bucket in order."""
        h, start, count, row = part.runs()
        known, which = np.unique(h, return_inverse=True)
        bits = lambda i: np.concatenate([np.unpackbits(g[i], count=int(g[2][0])) for g in flags]).astype(bool) if flags else np.zeros(0, bool)
        repeated, often = bits(0), bits(1)
        owner = part.owner[row]
        if len(known):
            most = np.full(len(known), np.iinfo(np.int64).min)
            np.maximum.at(most, which, owner)
            repeated = repeated | (_least(which, owner, len(known)) < most)
        keep = np.flatnonzero(repeated[which]) if len(known) else np.empty(0, np.int64)
        h, start, count, row, often = h[keep], start[keep], count[keep], row[keep], often[which[keep]] if len(known) else keep.astype(bool)
        if often.any():  # anchors met everywhere: windows one by one, by their own hash
            one = np.repeat(np.flatnonzero(often), count[often])
            nth = np.arange(len(one)) - np.repeat(np.cumsum(count[often]) - count[often], count[often])
            at = start[one] + nth
            own = np.zeros(len(at), np.uint64)
            for i in range(0, len(at), 1 << 15):
                s = slice(i, i + (1 << 15))
                for off in (*range(0, SIZE - 8, 8), SIZE - 8):
                    x = part.blob[at[s, None] + np.arange(off, off + 8)]
                    own[s] = (own[s] ^ np.ascontiguousarray(x).view(np.uint64).ravel()) * _MUL
                    own[s] ^= own[s] >> np.uint64(29)
            own ^= own >> np.uint64(32)
            h = np.concatenate([h[~often], own])
            start, count, row = np.concatenate([start[~often], at]), np.concatenate([count[~often], np.ones(len(at), np.int64)]), np.concatenate([row[~often], row[one]])
        ctx = np.zeros((len(h), WIDTH), np.uint8)
        for i in range(0, len(h), 1 << 14):
            s = slice(i, i + (1 << 14))
            ctx[s] = part.blob[start[s, None] + np.arange(WIDTH)]
            ctx[s][np.arange(WIDTH)[None, :] >= (count[s] + SIZE - 1)[:, None]] = 0
        first, which = _distinct(ctx, count, h)
        order = np.argsort(h[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: of runs; of contexts, the run each is taken from; of runs, their contexts
        self.start, self.count, self.owner = start, count, part.owner[row]
        self.first, self.which = first[order], place[which]
        self.h, self.ctx = h[self.first], ctx[self.first]


_MESSAGE, _TYPES = ["kind", "bucket", "part", "data"], (pa.string(), pa.int32(), pa.int64(), pa.binary())


def _flags_of(found: pa.Table) -> list[list[np.ndarray]]:
    return [_unpack(d.as_py()) for d in found.sort_by("bucket").column("data")]


def _send_contexts(buckets: int):
    def run(flags: pa.Table, group: pa.Table) -> pa.Table:
        cells = []
        if group.num_rows:
            part = Part.of(group)
            w = Windows(part, _flags_of(flags))
            least = _least(w.which, w.owner, len(w.first))
            count = w.count[w.first].astype(np.uint8)
            for k, cut in _slices(_bucket(w.h, buckets)):
                cells.append(("contexts", k, part.number, _pack(w.h[cut], least[cut], count[cut], w.ctx[cut].ravel())))
        cols = zip(*cells, strict=True) if cells else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _MESSAGE)

    return run


class Transform:
    """A shard's windows in order of their bytes, and its transform by depth: the two bytes before the suffixes that
    windows need there, in order of the suffixes' bytes so far."""

    def __init__(self, ctx: np.ndarray, count: np.ndarray):
        """ctx: rows of SIZE + SPAN - 1 bytes, of which the first count + SIZE - 1 are the context."""
        wide = ctx.shape[1] - 1
        pairs = (ctx[:, :-1].astype(np.uint16) << np.uint16(8) | ctx[:, 1:]).ravel()
        first = np.arange(len(ctx), dtype=np.int64) * wide
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum()) + SIZE
        if len(pairs) < 1 << 31:
            at = at.astype(np.int32)
        self.symbols: list[np.ndarray] = []
        for _ in range(0, SIZE, 2):
            at -= at.dtype.type(2)
            symbol = pairs[at]
            self.symbols.append(symbol)
            at = at[np.argsort(symbol, kind="stable")]
        self.row, self.off = np.divmod(at, wide)

    def __len__(self) -> int:
        return len(self.row)


def merge(shards: list[Transform]) -> tuple[np.ndarray, np.ndarray]:
    """(for each place in the order of all shards' windows, the shard that the next one comes from; where in that order
    blocks of equal windows begin), by refining the interleave with the symbols of the shards' transforms."""
    n = sum(map(len, shards))
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.int64), [len(s) for s in shards])
    block = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    ends = np.zeros(n, bool)
    for depth in range(SIZE // 2):
        symbol = np.empty(n, np.uint16)
        for k, shard in enumerate(shards):
            symbol[z == k] = shard.symbols[depth]
        deal = np.argsort(symbol, kind="stable")
        symbol, z, block = symbol[deal], z[deal], block[deal]
        ends[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(ends, dtype=block.dtype)
    begin = np.flatnonzero(np.concatenate([[True], ends[1:]])) if n else np.empty(0, np.int64)
    return z, begin


def least_of_windows(ctx: np.ndarray, count: np.ndarray, doc: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For each window of each context (rows, and SPAN columns of which the first `count` mean something): the smallest
    doc of all contexts that have it."""
    each = max(shard, -(-len(ctx) // SHARDS))
    cuts = [slice(a, a + each) for a in range(0, len(ctx), each)]
    shards = [Transform(ctx[c], count[c]) for c in cuts]
    z, begin = merge(shards)
    value = np.empty(len(z), np.int64)
    for k, (s, c) in enumerate(zip(shards, cuts, strict=True)):
        value[z == k] = doc[c][s.row]
    out = np.repeat(doc[:, None], SPAN, 1)
    if len(z):
        value = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.concatenate([begin, [len(z)]])))
    for k, (s, c) in enumerate(zip(shards, cuts, strict=True)):
        out[c][s.row, s.off] = value[z == k]
    return out


def _settle(group: pa.Table) -> pa.Table:
    """Contexts of a bucket, a part a row: the smallest doc_id of every window goes back to its part."""
    parts = group.column("part").to_pylist()
    sent = [_unpack(d.as_py()) for d in group.column("data")]
    key, doc, count = (np.concatenate([s[i] for s in sent]) for i in range(3))
    ctx = np.concatenate([s[3].reshape(-1, WIDTH) for s in sent])
    first, which = _distinct(ctx, count, key)
    size = count[first].astype(np.int64)
    result = least_of_windows(ctx[first], size, _least(which, doc, len(first)))
    change = np.ones(result.shape, bool)
    change[:, 1:] = result[:, 1:] != result[:, :-1]
    change &= np.arange(SPAN)[None, :] < size[:, None]
    out, at = [], 0
    for s in sent:
        w = which[at : at + len(s[0])]
        at += len(s[0])
        c = change[w]
        r, o = np.nonzero(c)
        out.append(_pack(c.sum(1).astype(np.uint8), o.astype(np.uint8), result[w][r, o]))
    return pa.table([pa.array(["least"] * len(parts)), group.column("bucket"), pa.array(parts, pa.int64()), pa.array(out, pa.binary())], _MESSAGE)


_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _covered(part: Part, flags: list[list[np.ndarray]], back: list[list[np.ndarray]]) -> np.ndarray:
    """Which bytes of a part are removed. back: what _settle() sent, by bucket in order, as the contexts are."""
    step = np.zeros(len(part.blob) + SIZE + SPAN, np.int32)
    if back:
        w = Windows(part, flags)
        changes, offset, least = (np.concatenate([b[i] for b in back]) for i in range(3))
        changes = changes.astype(np.int64)
        base = np.cumsum(changes) - changes
        each = changes[w.which]
        run = np.repeat(np.arange(len(w.start)), each)
        at = np.repeat(base[w.which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        a = offset[at].astype(np.int64)
        last = np.concatenate([run[1:] != run[:-1], [True]])
        b = np.where(last, w.count[run].astype(np.int64), np.concatenate([a[1:], [0]]))
        gone = least[at] < w.owner[run]
        s = w.start[run][gone]
        np.add.at(step, s + a[gone], 1)
        np.add.at(step, s + b[gone] + SIZE - 1, -1)
    return np.cumsum(step)[: len(part.blob)] > 0


def _cut_out(with_kept: bool):
    def run(found: pa.Table, group: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"]
        cols: list[list] = [[] for _ in types]
        if group.num_rows:
            part = Part.of(group)
            flags, least = (found.filter(pa.compute.equal(found.column("kind"), k)) for k in ("flags", "least"))
            mask = _covered(part, _flags_of(flags), _flags_of(least))
            for i, doc in enumerate(part.docs):
                a, b = int(part.starts[i]), int(part.ends[i])
                text, m = part.blob[a:b], mask[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                kept = (text[~m] if len(edge) else text).tobytes()
                spans = [{"start": x, "stop": y} for x, y in edge.reshape(-1, 2).tolist()]
                for c, x in zip(cols, (doc, b - a, int(m.sum()), spans, kept if with_kept else None, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def repeated_spans(docs: DataFrame, with_kept: bool = False, part_bytes: int = PART, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of removed bytes, end exclusive), kept (the rest, if asked) and kept_sha256.

    A byte is removed if a string of SIZE bytes that covers it also starts in a document with a smaller doc_id. Null
    texts are empty; texts under SIZE bytes keep all; rows of equal doc_id remove nothing from one another, and rows
    with a null doc_id neither remove nor lose bytes. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = int(total // part_bytes) + 1, int(total // bucket_bytes) + 1
    files = min(FILES, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"quillon_parts_{uuid.uuid4().hex}"
    # bucketed, so that no pass moves the texts
    dealt = rows.mapInArrow(_deal(part_bytes), _PARTS)
    dealt.write.bucketBy(files, "part").option("path", fresh_path(spark, "parts")).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"drop table {name}")  # its name only: the plan has the files
    anchors = texts.mapInArrow(_send_anchors(buckets), "bucket int, part long, data binary")
    flags = stored(anchors.groupBy("bucket").applyInArrow(_find_repeats(hot), "part long, bucket int, data binary"), "anchor-flags")
    del anchors
    release(spark)
    message = "kind string, bucket int, part long, data binary"
    sent = flags.groupBy("part").cogroup(texts.groupBy("part")).applyInArrow(_send_contexts(buckets), message)
    back = sent.groupBy("bucket").applyInArrow(_settle, message)
    found = back.unionByName(flags.withColumn("kind", F.lit("flags")))
    return found.groupBy("part").cogroup(texts.groupBy("part")).applyInArrow(_cut_out(with_kept), _OUT + ", kept_sha256 string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
