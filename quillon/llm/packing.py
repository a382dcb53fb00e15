"""Best-fit packing by bin completion.

Only lengths matter to a packing, and there are at most `capacity` of them, so the search runs on the driver over
counts by length, however many documents there are. Best-fit decreasing gives the incumbent. If it doesn't meet the
waste bound, branch and bound fills bins around the largest piece left, over undominated fillings, least waste first:
which sums the other pieces can reach is found first, so that only fillings of a wanted waste are walked. A filling is
used as often as it can be, then, as other branches, fewer times. Branches whose bound reaches the incumbent are
pruned, as are pieces left that were met before with as few bins; best-fit of what is left renews the incumbent. With
`nodes` and `width` both None the search is exact. The plan (bin shapes with multiplicities) then goes to the pieces
by their rank among equals; pieces that fill a sequence need no rank.

Null texts pack as the end id alone; equal doc_ids are separate documents, told apart by their order of text hash;
an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.session import ship, stored

CAPACITY = 1024
#: Nodes of the branch-and-bound search, and fillings tried at a node, before the incumbent stands; None: no limit.
NODES, WIDTH = 3000, 8
#: Entries of a worker's cache of pieces of text: a stage of a pipeline shares its worker's memory with others.
CACHE = 200_000
#: Lengths left at a node up to which best-fit of them may renew the incumbent.
RENEW = 48
#: Pieces of one length in a bucket within which ranks are counted, and buckets whose sums are added up at once, about.
BUCKET, GROUP = 500, 4096

Shape = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Shape, int]]:
    """Best-fit decreasing over counts by length: bin shapes with how many bins have each."""
    open_: dict[int, list[tuple[Shape, int]]] = {}
    done: list[tuple[Shape, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            for shape, many in open_.pop(room):
                each = room // length
                full = min(many, left // each)
                more = [(each, full)] if full else []
                left -= each * full
                if full < many and left:
                    more.append((left, 1))
                    left, used = 0, full + 1
                else:
                    used = full
                for k, bins in more:
                    rest = room - k * length
                    new = (*shape, (length, k))
                    (open_.setdefault(rest, []) if rest else done).append((new, bins))
                if many > used:
                    open_.setdefault(room, []).append((shape, many - used))
        each = capacity // length
        for k, bins in ((each, left // each), (left % each, 1)):
            if k and bins:
                rest = capacity - k * length
                (open_.setdefault(rest, []) if rest else done).append((((length, k),), bins))
    return done + [x for group in open_.values() for x in group]


def fillings(first: int, counts: dict[int, int], capacity: int) -> Iterator[Shape]:
    """Undominated fillings of a bin that holds `first`, least waste first: no piece left could be added, and none in
    it could give way to a single longer one that fits."""
    room = capacity - first
    lengths = sorted((x for x, n in counts.items() if n > (x == first) and x <= room), reverse=True)
    shorter = [-x for x in lengths]
    most = [min(counts[x] - (x == first), room // x) for x in lengths]
    mask = (1 << (room + 1)) - 1
    reach = [1]  # from the end: bit t is set if the lengths from there on have fillings of sum t
    for x, n in zip(reversed(lengths), reversed(most), strict=True):
        sums, step = reach[-1], 1
        while n > 0:  # as many as a binary number has
            k = min(step, n)
            sums |= sums << (k * x) & mask
            n, step = n - k, 2 * step
        reach.append(sums)
    reach.reverse()

    def grow(k: int, left: int) -> Iterator[list[tuple[int, int]]]:
        """Fillings of sum `left` exactly from lengths[k:]."""
        if not left:
            yield []
            return
        for j in range(max(k, bisect_left(shorter, -left)), len(lengths)):
            x = lengths[j]
            for n in range(min(most[j], left // x), 0, -1):
                if reach[j + 1] >> (left - n * x) & 1:
                    for tail in grow(j + 1, left - n * x):
                        yield [(x, n), *tail]
            if not reach[j + 1] >> left & 1:
                return

    def undominated(shape: list[tuple[int, int]], waste: int) -> bool:
        if not waste:
            return True
        held = dict(shape)
        free = [x for x, n in zip(lengths, most, strict=True) if counts[x] - (x == first) > held.get(x, 0)]
        return not any(y <= waste for y in free) and not any(x < y <= x + waste for x in held for y in free)

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for shape in grow(0, total):
                if undominated(shape, room - total):
                    held = dict(shape)
                    yield ((first, 1 + held.pop(first, 0)), *held.items())


def bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: by the sum, and, for every k, by pieces over half a bin with what of k and more can't join them."""
    c = np.zeros(capacity + 2, np.int64)
    for x, n in counts.items():
        c[x] = n
    number, mass = np.cumsum(c), np.cumsum(c * np.arange(capacity + 2))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    big = number[capacity] - number[capacity - k]  # over capacity - k: nothing counted can join them
    halves = number[capacity - k] - number[half]
    free = halves * capacity - (mass[capacity - k] - mass[half])
    small = mass[half] - np.where(k > 0, mass[k - 1], 0)
    return int((big + halves + np.maximum(0, -(-(small - free) // capacity))).max())


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES, width: int | None = WIDTH) -> list[tuple[Shape, int]]:
    """Bin shapes with multiplicities for all pieces: best-fit decreasing, or better where the search finds it within
    `nodes` nodes of `width` fillings each. The optimum if both are None."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    low = bound(counts, capacity)
    met: dict[tuple[tuple[int, int], ...], int] = {}

    def branches(rest: dict[int, int], used: int, plan: tuple) -> Iterator[tuple[dict[int, int], int, tuple]]:
        """What is left after each filling around the largest piece, used as often as it can be; then fewer times."""
        options = list(islice(fillings(max(rest), rest, capacity), width))
        fewer = []
        for shape in options:
            most = min(rest[x] // k for x, k in shape)
            fewer += [(shape, n) for n in range(most - 1, 0, -1)][:width]
            yield _after(rest, shape, most), used + most, (plan, (shape, most))
        for shape, n in fewer:
            yield _after(rest, shape, n), used + n, (plan, (shape, n))

    def listed(plan: tuple) -> list[tuple[Shape, int]]:
        out = []
        while plan:
            plan, last = plan
            out.append(last)
        return out[::-1]

    stack = [iter([(counts, 0, ())])]
    visited = 0
    while stack and bins > low and (nodes is None or visited < nodes):
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        rest, used, plan = node
        visited += 1
        if not rest:
            if used < bins:
                best, bins = listed(plan), used
            continue
        if used + bound(rest, capacity) >= bins:
            continue
        if len(rest) <= RENEW:
            key = tuple(sorted(rest.items()))
            if met.get(key, bins) <= used:
                continue
            met[key] = used
            tail = best_fit(rest, capacity)
            if used + (more := sum(n for _, n in tail)) < bins:
                best, bins = listed(plan) + tail, used + more
        stack.append(branches(rest, used, plan))
    return best


def _after(rest: dict[int, int], shape: Shape, many: int) -> dict[int, int]:
    out = dict(rest)
    for x, k in shape:
        out[x] -= k * many
        if not out[x]:
            del out[x]
    return out


_PIECES = "doc_id long, tie long, piece int, start long, length int, ids_crc32 long"


def _cut(path: str, end: int, capacity: int, with_ids: bool):
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = bpe.encoder(path, CACHE), struct.pack("<I", end)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            docs, ties, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, tie, own in zip(docs, ties, enc.encode_many(texts), strict=True):
                ids = memoryview(own + tail)
                n = len(ids) // 4
                at, piece = 0, 0
                to = n % capacity or capacity
                while at < n:
                    cell = ids[4 * at : 4 * to]
                    row = (doc, tie, piece, at, to - at, zlib.crc32(cell), *[bytes(cell)] * with_ids)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    at, to, piece = to, to + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, end: int = 2, vocabulary: str | None = None, with_ids: bool = False, nodes: int | None = NODES, width: int | None = WIDTH
) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked).

    Documents of over `capacity` ids are cut into pieces of that length, the first of which may be shorter. A piece
    that fills a sequence has it alone. `nodes` and `width` bound the search (see complete()), never what is packed.
    The driver holds one count a length and the shapes, which `capacity` bounds.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_cut(vocabulary or bpe.vocabulary(), end, capacity, with_ids), _PIECES + ", ids binary" * with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts.pop(capacity, None)
    plan = complete(counts, capacity, nodes, width)
    first, spans, used = 0, [], dict.fromkeys(counts, 0)
    for shape, many in plan:
        at = 0
        for length, k in shape:
            spans.append((length, used[length], used[length] + k * many, first, k, at))
            used[length] += k * many
            at += k * length
        first += many
    out = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*out, (F.monotonically_increasing_id() + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    # ranks among equals: rows by bucket, then buckets by their sums, so that no task holds all pieces of a length
    dealt = spark.createDataFrame([(x, -(-n // BUCKET)) for x, n in counts.items()], "d_length int, d_buckets int")  # at most `capacity` rows
    part = pieces.where(F.col("length") < capacity).join(F.broadcast(dealt), F.col("length") == F.col("d_length"))
    part = part.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.col("d_buckets"))).drop("d_length", "d_buckets")
    sums = part.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("of", F.floor(F.col("bucket") / GROUP))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("length", "of").agg(F.sum("n").alias("n"))
    groups = groups.select(F.col("length").alias("g_length"), F.col("of").alias("g_of"), upto(Window.partitionBy("length").orderBy("of")).alias("g_before"))
    sums = sums.select(F.col("length").alias("s_length"), F.col("bucket").alias("s_bucket"), "of", upto(Window.partitionBy("length", "of").orderBy("bucket")).alias("before"))
    sums = sums.join(groups, (F.col("s_length") == F.col("g_length")) & (F.col("of") == F.col("g_of")))
    sums = sums.select("s_length", "s_bucket", (F.col("before") + F.col("g_before")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "tie", "piece", "start")) - 1
    ranked = part.withColumn("within", within).join(sums, (F.col("length") == F.col("s_length")) & (F.col("bucket") == F.col("s_bucket")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    # a row for each length of each shape: bounded by the lengths, which capacity bounds
    shapes = spark.createDataFrame(spans, "t_length int, low long, high long, first long, k int, at int")
    on = (F.col("length") == F.col("t_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(shapes), on)
    turn = F.col("rank") - F.col("low")
    placed = placed.select(
        *out,
        (F.col("first") + F.floor(turn / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("at") + (turn % F.col("k")) * F.col("length")).cast("long").alias("offset"), *["ids"] * with_ids,
    )
    return full.unionByName(placed)
