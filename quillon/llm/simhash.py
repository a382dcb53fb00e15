"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint has four segments of 16 bits on a ring. If two fingerprints differ in at most r bits in all
(r < 4 here), some segment starts a chain whose first k segments differ in at most k * r / 4 bits, for every k: so
the first segment is equal, two differ in 1 bit at most, three in 2. Candidates meet on the first two segments, the
second with any one zero bit raised on one side, which is the chain of length two written as an equality; longer
chains and the full distance are checked where they meet.

Rows that meet under one key give links to the smallest partner instead of all pairs, a star for each cluster,
which joins what all pairs would. Keys with over `HOT` rows are dealt out anew by the bytes of the other half, at
least one of which must be equal, and what is still large in pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.session import discard, ship, stored, unused

#: Rows that may meet under one key in one task; beyond, they are dealt out again.
HOT = 4096
#: Removed rows up to which their ids and hashes are broadcast, 16 bytes each.
BROADCAST = 1_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the XXH64 (seed 42) of all word shingles, ASCII letters in lower case; 0 without words."""
    import xxhash

    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    pieces = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    n = len(pieces)
    sums = np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n)
    for at in range(0, n, 1 << 16):
        sums += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got)], ["doc_id", "tie", "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment as a chain's start (own), and one for each zero bit of the next segment, raised."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        out, own, who = [], [], []
        for s in range(4):
            ring = (fp >> np.uint64(16 * s)) | ((fp << np.uint64(64 - 16 * s)) if s else np.uint64(0))
            low = ring & np.uint64(0xFFFFFFFF)
            tag = np.uint64(s << 32)
            out.append(low | tag)
            own.append(np.ones(len(fp), bool))
            who.append(fp)
            for bit in range(16, 32):
                b = np.uint64(1 << bit)
                zero = (low & b) == 0
                out.append(low[zero] | b | tag)
                own.append(np.zeros(int(zero.sum()), bool))
                who.append(fp[zero])
        for k, o, f in zip(out, own, who, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(o)], ["key", "fp", "own"])


def _viable(x: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Whether the chain that begins at segment `start` stays within its budgets, and the whole within `most`; x: differing bits."""
    ring = np.where(start == 0, x, (x >> (16 * start).astype(np.uint64)) | (x << ((64 - 16 * start) % 64).astype(np.uint64)))
    ok = np.ones(x.shape, bool)
    for k in range(1, 5):
        part = ring if k == 4 else ring & np.uint64((1 << (16 * k)) - 1)
        ok &= 4 * np.bitwise_count(part).astype(np.int64) <= k * most
    return ok


def _stars(most: int):
    def links(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one key: each row linked to the smallest fingerprint of its cluster here."""
        start = ((key[0] >> np.uint64(32)) & np.uint64(3)) * np.ones(1, np.uint64)
        mine = np.unique(fp[own])
        every = np.unique(fp)
        a, b = [], []
        label = np.arange(len(every))
        at = np.searchsorted(every, mine)
        for i in range(0, len(mine), 512):  # blocks of rows that hold the key as it is, against all
            near = _viable(mine[i : i + 512, None] ^ every[None, :], start[:, None], most)
            r, c = np.nonzero(near)
            a.append(at[i : i + 512][r])
            b.append(c)
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(every))
        return every[label[moved]], every[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch | None:
            key, sub, fp, own = cols
            cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            has = np.add.reduceat(own.astype(np.int64), begin) if len(key) else begin
            out = []
            two = (end - begin == 2) & (has >= 1)  # most groups: two rows, at once
            i = begin[two]
            near = _viable(fp[i] ^ fp[i + 1], (key[i] >> np.uint64(32)) & np.uint64(3), most) & (fp[i] != fp[i + 1])
            i = i[near]
            out.append((np.minimum(fp[i], fp[i + 1]), np.maximum(fp[i], fp[i + 1])))
            for k in np.flatnonzero((end - begin > 2) & (has >= 1)):
                s = slice(begin[k], end[k])
                out.append(links(key[s], fp[s], own[s]))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            got = [got[0].view(np.uint64), got[1], got[2].view(np.uint64), got[3].astype(bool)]
            cols = tuple(np.concatenate(x) for x in zip(*held, got, strict=True)) if held else tuple(got)
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            split = int(last[-1]) + 1 if len(last) else 0
            if split:
                yield flush(tuple(c[:split] for c in cols))
            held = [tuple(c[split:] for c in cols)]
        if held and len(held[0][0]):
            yield flush(held[0])

    return run


def _dealt(keys: DataFrame, hot: int) -> DataFrame:
    """keys with a column sub: 0, or for keys with over `hot` rows the byte of the other half and the pair of blocks."""
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = stored(many.select(F.col("key").alias("hot_key")), "hot-keys")
    if not many.limit(1).count():
        return keys.withColumn("sub", F.lit(0).cast("long"))
    joined = keys.join(many, F.col("key") == F.col("hot_key"), "left")
    cool = joined.where("hot_key is null").select("key", "fp", "own", F.lit(0).cast("long").alias("sub"))
    ring = F.expr("shiftrightunsigned(fp, 16 * cast(shiftrightunsigned(key, 32) as int)) | if(key < 4294967296L, 0L, shiftleft(fp, 64 - 16 * cast(shiftrightunsigned(key, 32) as int)))")
    other = F.shiftrightunsigned(ring, 32)
    # r < 4 differing bits among four bytes: one byte at least is equal
    bytes_ = F.array(*[(F.lit(1 + j) * 256 + F.shiftrightunsigned(other, 8 * j).bitwiseAND(F.lit(255))).cast("long") for j in range(4)])
    warm = joined.where("hot_key is not null").select("key", "fp", "own", F.explode(bytes_).alias("sub"))
    size = warm.groupBy(F.col("key").alias("w_key"), F.col("sub").alias("w_sub")).agg(F.count("*").alias("n"))
    blocks = size.select("w_key", "w_sub", F.ceil(F.col("n") / hot).cast("long").alias("blocks"))
    warm = warm.join(blocks, (F.col("key") == F.col("w_key")) & (F.col("sub") == F.col("w_sub")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    warm = warm.select("key", "fp", "own", "sub", F.explode(pairs).alias("pair"))
    return cool.unionByName(warm.select("key", "fp", "own", (F.col("sub") + F.col("pair") * 2048).alias("sub")))


def _labelled(docs: DataFrame, most: int, words: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie and fp of each row, tie a hash of the text; of and label of each distinct fp: the smallest fp it
    is linked with)."""
    if not 0 <= most <= 3:
        raise ValueError("the keys used here hold for 0 to 3 differing bits")
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    prints = stored(rows.mapInArrow(_fingerprints(words), "doc_id long, tie long, fp long"), "fingerprints")
    distinct = stored(prints.select("fp").distinct(), "distinct-fingerprints")
    keys = stored(distinct.mapInArrow(_keys, "key long, fp long, own boolean"), "keys")
    dealt = _dealt(keys, hot).select("key", "sub", "fp", "own")
    met = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "sub").sortWithinPartitions("key", "sub")
    linked = components(met.mapInArrow(_stars(most), "a long, b long"))
    discard(keys)
    return prints, distinct.join(linked, distinct.fp == linked.node, "left").select(F.col("fp").alias("of"), F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, most: int = 3, words: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits), component_id: the smallest doc_id reachable by links of at most
    `most` (3 at most) differing bits, itself included.

    Null, empty and blank texts have fingerprint 0 and link like any other; texts of any length are read whole;
    repeated rows stay rows; rows with a null doc_id link others but never name a component unless all are null; an
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    prints, labels = _labelled(docs, most, words, hot)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = first.join(labels, first.fp == labels["of"]).select("fp", "first", "label")
    heads = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = named.join(heads, "label").select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(of, prints.fp == F.col("of_fp")).select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, most: int = 3, words: int = 3, hot: int = HOT) -> DataFrame:
    """docs without all but one row of each group of near duplicates; all columns stay, whatever their names.

    The row that stays has the group's smallest doc_id (a null counts as larger than any) and, of texts that share that
    id, the one with the smallest hash; of rows that repeat both, any one. Rows of one doc_id whose texts aren't near
    duplicates are judged apart. Null, empty and blank texts are one group. An empty table stays empty.
    """
    prints, labels = _labelled(docs, most, words, hot)
    rows = prints.select("fp", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie").alias("row"))
    rows = stored(rows.groupBy("fp", "row").agg(F.count("*").alias("n")), "rows-of-groups")
    discard(prints)
    # the first row of each fingerprint, then of each group: a group's rows needn't meet, only its fingerprints
    first = rows.groupBy("fp").agg(F.min("row").alias("first"))
    named = stored(first.join(labels, first.fp == labels["of"]).select("fp", "first", "label"), "first-rows")
    heads = named.groupBy("label").agg(F.min("first").alias("head")).select(F.col("label").alias("of"), "head")
    head = stored(named.join(heads, named.label == heads["of"]).select(F.col("fp").alias("of"), "head"), "heads")
    turned = rows.join(head, rows.fp == head["of"]).select("row.doc_id", "row.tie", F.col("row").eqNullSafe(F.col("head")).alias("first"), "n")
    turned = stored(turned, "turns")
    for done in (rows, named, head):
        discard(done)
    own, tie = unused(docs, "id", "tie")
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(tie, F.xxhash64(F.col("text").cast("string")))

    def side(of: DataFrame) -> tuple[DataFrame, Column]:
        """`of` for a join with keyed, by id and hash. Few enough go to all executors, so that the texts needn't move."""
        id_, hash_ = unused(keyed, "of_id", "of_tie")
        out = of.select(F.col("doc_id").alias(id_), F.col("tie").alias(hash_))
        out = F.broadcast(out) if of.limit(BROADCAST + 1).count() <= BROADCAST else out
        return out, F.col(own).eqNullSafe(F.col(id_)) & (F.col(tie) == F.col(hash_))

    gone = turned.where("not first").select("doc_id", "tie")
    found = keyed.join(*side(gone), "left_anti")
    again = turned.where("first and n > 1").select("doc_id", "tie")
    if again.limit(1).count():  # rows that repeat id and text: one of each, found with partial aggregates
        single, repeated = found.join(*side(again), "left_anti"), found.join(*side(again), "left_semi")
        found = single.unionByName(repeated.dropDuplicates([own, tie]))
    return found.drop(own, tie)
