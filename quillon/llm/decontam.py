"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. An automaton over word numbers
goes to the workers; documents stream through it word by word, which keeps the length of the longest suffix that
occurs in an item. A length of at least `window` marks the last `window` words; items of fewer words count whole.
Words outside the items' vocabulary and pairs of words that no item has reset the automaton, so only runs of known
pairs are walked.

Items are cut into pieces that overlap by a window less a word, and pieces are dealt to shards of a checked number of
words, whose automata executors build as flat arrays. So many shards as have a checked number of words together go to
the workers at a time; items beyond them are further rounds over the documents, which send on only rows with hits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, ship, stored, unused

#: Words in a window; words of items in one automaton, about (twice as many at most); automata held at a time.
WINDOW, SHARD, HELD = 13, 250_000, 4

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


class _Builder:
    """A generalised suffix automaton under construction, with edges as dictionaries."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone


def _ranges(owners: list[int], states: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by owner, where each owner's begin)."""
    own = np.array(owners, np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(states + 1)).astype(np.int32)


class Automaton:
    """Generalised suffix automaton of items (id, words), as flat arrays: some 60 bytes a word."""

    #: Edges looked up so far that a worker holds at most.
    CACHE = 1 << 18

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        vocabulary: dict[bytes, int] = {}
        built = _Builder()
        held: list[tuple[int, int]] = []  # (state, item): a window of the item ends there
        whole: list[tuple[int, int]] = []  # (state, item): a short item ends there
        pairs: set[int] = set()
        self.names = [name for name, _ in items]
        self.least = min([window, *(len(w) for _, w in items if w)])
        for i, (_, parts) in enumerate(items):
            last, before = 0, -1
            for k, w in enumerate(parts):
                c = vocabulary.setdefault(w, len(vocabulary))
                last = built.add(last, c)
                if before >= 0:
                    pairs.add(before << 32 | c)
                before = c
                if k + 1 >= window:
                    held.append((last, i))
            if 0 < len(parts) < window:
                whole.append((last, i))
        self.words = b" ".join(vocabulary)
        self.pairs = np.array(sorted(pairs), np.uint64)
        n = len(built.len)
        self.len, self.link = np.array(built.len, np.int32), np.array(built.link, np.int32)
        key = np.array([s << 32 | c for s, edges in enumerate(built.next) for c in edges], np.uint64)
        to = np.array([t for edges in built.next for t in edges.values()], np.int32)
        order = np.argsort(key)
        self.edge, self.to = key[order], to[order]
        # items of a state's window: its own and those of all states below it, as one range
        held = sorted(set(held))
        count = np.bincount([s for s, _ in held], minlength=n).astype(np.int64)
        by_len = np.argsort(self.len, kind="stable").tolist()
        below = count.copy()
        for s in reversed(by_len[1:]):
            below[self.link[s]] += below[s]
        low, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
        free[0] = count[0]
        self.top, self.near = np.zeros(n, np.int32), np.zeros(n, np.int32)
        short = {s for s, _ in whole}
        for s in by_len[1:]:
            up = self.link[s]
            low[s] = free[up]
            free[up] += below[s]
            free[s] = low[s] + count[s]
            self.top[s] = self.top[up] if self.len[up] >= window else s  # the state of the last `window` words
            self.near[s] = s if s in short else self.near[up]  # the first one up the links that ends a short item
        self.low, self.high = low.astype(np.int32), (low + below).astype(np.int32)
        self.items = np.zeros(len(held), np.int32)
        at = dict(enumerate(low.tolist()))
        for s, i in held:
            self.items[at[s]] = i
            at[s] += 1
        order, self.short_at = _ranges([s for s, _ in whole], n)
        self.short = np.array([i for _, i in whole], np.int32)[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def _ready(self) -> None:
        self._number = {w: i for i, w in enumerate(self.words.split(b" "))} if self.words else {}
        self._known: dict[int, int] = {}
        self._views = [memoryview(x) for x in (self.link, self.len, self.top, self.near)]

    def match(self, parts: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (start, end) inside occurrences, merged, and the items that occur."""
        if not hasattr(self, "_number"):
            self._ready()
        get, window = self._number.get, self.window
        ids = np.array([get(w, -1) for w in parts], np.int64)
        if not len(ids) or not len(self.to):
            return [], set()
        pair = (ids[:-1] << 32 | ids[1:]).astype(np.uint64)
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[joined]), len(self.pairs) - 1)
            joined[joined] = self.pairs[at] == pair[joined]
        else:
            joined[:] = False
        begin = np.flatnonzero(np.concatenate([[True], ~joined]))
        end = np.concatenate([begin[1:], [len(ids)]])
        fit = (end - begin >= self.least) & (ids[begin] >= 0)
        spans: list[list[int]] = []
        tops: set[int] = set()
        shorts: set[int] = set()
        link, length, top, near = self._views
        known, edge, to = self._known, self.edge, self.to
        for a, b in zip(begin[fit].tolist(), end[fit].tolist(), strict=True):
            state = n = 0
            for j, c in enumerate(ids[a:b].tolist(), a + 1):
                while True:
                    key = state << 32 | c
                    target = known.get(key)
                    if target is None:
                        i = int(np.searchsorted(edge, np.uint64(key)))
                        target = int(to[i]) if i < len(edge) and edge[i] == key else -1
                        if len(known) >= self.CACHE:
                            known.clear()
                        known[key] = target
                    if target >= 0:
                        break
                    state = link[state]
                    n = length[state]
                state, n = target, n + 1
                size = 0
                if n >= window:
                    size = window
                    tops.add(top[state])
                s = near[state]
                if s == state and length[s] > n:  # the item is longer than what matches here
                    s = near[link[s]]
                while s:
                    size = max(size, length[s])
                    if s in shorts:  # then so are those up its links
                        break
                    shorts.add(s)
                    s = near[link[s]]
                if size:
                    while spans and spans[-1][0] >= j - size:
                        spans.pop()
                    if spans and spans[-1][1] >= j - size:
                        spans[-1][1] = j
                    else:
                        spans.append([j - size, j])
        found = [self.items[self.low[s] : self.high[s]] for s in tops] + [self.short[self.short_at[s] : self.short_at[s + 1]] for s in shorts]
        return [tuple(s) for s in spans], {self.names[i] for i in (np.unique(np.concatenate(found)).tolist() if found else ())}


_MATCH = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _matcher(shared: Broadcast, hits_only: bool):
    """Rows (doc_id, _hash, _text) -> (doc_id, _hash, n_words, spans, items), by the automata of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                parts = words(text)
                found = [a.match(parts) for a in automata]
                spans = [{"start": a, "stop": b} for a, b in _union([s for f, _ in found for s in f])]
                if spans or not hits_only:
                    rows.append((i, len(parts), spans, sorted(set().union(*(f for _, f in found)))))
            at, n, spans, items = zip(*rows, strict=True) if rows else ([], [], [], [])
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in ("doc_id", "_hash")]
            cols = [*own, pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_hash", "n_words", "spans", "items"])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(spans: Column) -> Column:
    """The same of a column of spans."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def _pieces(window: int, most: int):
    """Items (i, t) -> pieces (i, n words, t): of `most` words at most, overlapping so that each window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = words(t)
                step = max(1, most - window + 1)
                for at in range(0, max(1, len(parts) - window + 1), step) if parts else ():
                    own = parts[at : at + step + window - 1]
                    rows.append((i, len(own), b" ".join(own)))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["i", "n", "t"])

    return run


def _build(window: int):
    def run(group: pa.Table) -> pa.Table:
        items = [(i, t.split(b" ")) for i, t in zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True)]
        return pa.table({"data": pa.array([pickle.dumps(Automaton(items, window))], pa.binary())})

    return run


def _rounds(benchmark: DataFrame, window: int, shard: int, held: int) -> Iterator[list[Automaton]]:
    """The automata of all items, `held` at a time on the driver: each has 2 * shard words at most."""
    ship(benchmark.sparkSession)
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    pieces = stored(texts.mapInArrow(_pieces(window, max(window, shard // 8)), "i string, n long, t binary"), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = int(-(-total // shard))
    while True:
        own = F.pmod(F.xxhash64("i", "t"), F.lit(max(1, shards))).cast("int")
        largest = pieces.groupBy(own).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= 2 * shard or shards > total:
            break
        shards *= 2
    # repeated pieces once: so that a text that fills the table makes no shard larger
    dealt = pieces.distinct().withColumn("shard", own)
    for first in range(0, max(1, shards), held):
        some = dealt.where((F.col("shard") >= first) & (F.col("shard") < first + held))
        yield [pickle.loads(r["data"]) for r in some.groupBy("shard").applyInArrow(_build(window), "data binary").collect()]
    discard(pieces)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words, end exclusive), items (ids as sorted strings), contaminated.

    A document is contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; texts of
    any length are read whole; items without words match nothing; items of one id count once, a null id as an empty
    one; repeated documents are separate rows; an empty benchmark contaminates nothing, and an empty table gives no
    rows. Columns other than doc_id and text (item_id and text) are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    found, more = None, []
    for automata in _rounds(benchmark, window, shard, held):
        turn = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(automata), found is not None), "doc_id long, _hash long, " + _MATCH)
        if found is None:
            found = turn
        else:  # rows that repeat id and text have the same hits
            more.append(turn.groupBy("doc_id", "_hash").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
    if more:
        every = reduce(DataFrame.unionByName, more).groupBy(F.col("doc_id").alias("_of"), F.col("_hash").alias("_with"))
        every = every.agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        found = found.join(every, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_with")), "left")
        both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
        found = found.select("doc_id", "n_words", _merged(both("spans", "_spans")).alias("spans"), F.sort_array(F.array_distinct(both("items", "_items"))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """docs without contaminated documents; the others stay as they are, null and empty texts too. All columns stay,
    whatever their names; rows with equal doc_id are judged by their own texts."""
    spark = docs.sparkSession
    rounds = _rounds(benchmark, window, shard, held)
    shared = spark.sparkContext.broadcast(next(rounds))
    if (second := next(rounds, None)) is not None:  # hits of several rounds meet by the rows' numbers
        return _cleaned_by_rows(docs, [shared, spark.sparkContext.broadcast(second), *map(spark.sparkContext.broadcast, rounds)])

    @F.pandas_udf("boolean")
    def keep(texts):
        import pandas as pd

        out = []
        for text in texts:
            parts = words(text)
            n_hit = sum(b - a for a, b in _union([s for x in shared.value for s in x.match(parts)[0]]))
            out.append(not (n_hit and 20 * n_hit >= len(parts)))
        return pd.Series(out, dtype=bool)

    return docs.where(keep(F.col("text").cast("string")))


def _cleaned_by_rows(docs: DataFrame, rounds: list[Broadcast]) -> DataFrame:
    """As cleaned(), where the automata of all items don't go to the workers at once: hits of a text meet by its hash."""
    text = F.col("text").cast("string")
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    hits = [texts.mapInArrow(_matcher(b, True), "doc_id long, _hash long, " + _MATCH).groupBy("_hash").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans")) for b in rounds]
    every = reduce(DataFrame.unionByName, hits).groupBy("_hash").agg(F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    own, gone = unused(docs, "hash", "gone")
    bad = every.where(20 * n_hit >= F.col("n_words")).select(F.col("_hash").alias(gone))
    return docs.withColumn(own, F.xxhash64(text)).join(bad, F.col(own) == F.col(gone), "left_anti").drop(own)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
k as (select item_id, ws, least(13, len(ws)) as n from b where len(ws) > 0),
w as (select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as s from k, unnest(range(1, cast(len(ws) - n + 2 as bigint))) as u(i)),
z as (select distinct n from w),
x as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as s from d, z, unnest(range(1, cast(greatest(len(ws) - n + 2, 1) as bigint))) as u(i)),
o as (select x.doc_id, x.i, x.n, w.item_id from x join w on x.n = w.n and x.s = w.s),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from o) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, cast(item_id as varchar) as item_id from o) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""
