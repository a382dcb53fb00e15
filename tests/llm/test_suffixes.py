import random

import numpy as np

from quillon.llm import suffixes
from tests.llm import brute, data


def check(spark, rows, **options):
    found = suffixes.repeated_spans(data.frame(spark, rows), with_kept=True, **options).collect()
    want = brute.repeats(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == want[r.doc_id], r.doc_id
        assert r.n_removed == sum(s.stop - s.start for s in r.spans)
        assert len(r.kept) == r.n_bytes - r.n_removed
    return found


def test_op3_matches_plain_version(spark):
    found = check(spark, data.rows())
    assert sum(r.n_removed for r in found) > 0


def test_op3_many_parts_and_split_anchors(spark):
    rng = random.Random(6)
    line = "This very common licence line stands in most of the documents here, word for word, \x00 é."
    rows = []
    for i in range(60):
        own = " ".join(rng.choices(data.WORDS, k=40))
        rows.append((i, own[:100] + line[: rng.randint(45, len(line))] + own[100:]))
    rows += [(100, "ab" * 400), (101, "ab" * 300 + "c"), (102, "x" + "ab" * 300), (103, "ab" * 24 + "abc" * 40), (104, "abc" * 40)]
    check(spark, rows, part_bytes=2000, bucket_bytes=3000, hot=3)
    check(spark, rows, part_bytes=2000, bucket_bytes=3000, hot=1000)


def test_op3_long_documents_in_pieces(spark):
    rng = random.Random(7)
    long_ = "".join(rng.choices("abcdefgh ", k=150_000))
    rows = [(1, long_), (2, "new start " + long_[65_000:66_000] + long_[131_000:131_100]), (3, long_[65_400:65_600])]
    found = {r.doc_id: r for r in suffixes.repeated_spans(data.frame(spark, rows)).collect()}
    assert found[1].n_removed == 0
    assert [(s.start, s.stop) for s in found[2].spans] == [(10, 1110)]
    assert found[3].n_removed == 200


def test_op3_nulls_and_ties(spark):
    t = "one text of well over fifty bytes, to be sure that a window is there"
    found = suffixes.repeated_spans(data.frame(spark, [(5, t), (5, t), (None, t), (7, t), (8, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (5, 0), (5, 0), (7, len(t)), (8, 0)]
    assert suffixes.repeated_spans(data.frame(spark, [])).count() == 0


def test_merge_of_transforms_orders_and_blocks():
    rng = np.random.default_rng(2)
    ctx = rng.integers(97, 99, (30, suffixes.WIDTH)).astype(np.uint8)
    ctx[5:25] = ctx[4]
    ctx[20:, 60:] = 0
    count = np.array([1 + i % suffixes.SPAN for i in range(20)] + [11] * 10)
    cuts = [slice(0, 8), slice(8, 9), slice(9, 27), slice(27, 30)]
    shards = [suffixes.Transform(ctx[c], count[c]) for c in cuts]
    window = lambda row, off: bytes(ctx[row, off : off + suffixes.SIZE])
    for s, c in zip(shards, cuts, strict=True):
        own = [window(c.start + r, o) for r, o in zip(s.row, s.off, strict=True)]
        assert own == sorted(own) and len(own) == count[c].sum()
        assert all(len(x) == len(s) for x in s.symbols)
    z, begin = suffixes.merge(shards)
    at, order = [0] * len(shards), []
    for k in z.tolist():
        order.append(window(cuts[k].start + shards[k].row[at[k]], shards[k].off[at[k]]))
        at[k] += 1
    assert order == sorted(order) and len(order) == count.sum()
    assert begin.tolist() == [i for i, w in enumerate(order) if i == 0 or w != order[i - 1]]
    doc = rng.permutation(30).astype(np.int64)
    for size in (4, 100):
        least = suffixes.least_of_windows(ctx, count, doc, shard=size)
        every = {}
        for r in range(30):
            for o in range(count[r]):
                every[window(r, o)] = min(every.get(window(r, o), 99), doc[r])
        assert all(least[r, o] == every[window(r, o)] for r in range(30) for o in range(count[r]))


def test_op3_more_parts_than_files_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FILES", 3)
    monkeypatch.setattr(suffixes, "SHARDS", 2)
    check(spark, data.rows(), part_bytes=300, bucket_bytes=10)


def test_numbers_of_parts_and_buckets_at_scale():
    h = np.sort(np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64))
    buckets = 12_000_000
    got = list(suffixes._slices(suffixes._bucket(h, buckets)))
    assert len(got) <= 1000 and sum(s.stop - s.start for _, s in got) == 1000
    assert all(0 <= k < buckets for k, _ in got)
    assert all((np.diff(suffixes._short(h[s], k, buckets).astype(np.int64)) >= 0).all() for k, s in got)
    for k in (0, 1, buckets // 3, buckets - 1):  # the last hash of a bucket
        low, high = -(-(k << 32) // buckets) << 32, (-(-((k + 1) << 32) // buckets) << 32) - 1
        at = np.array([low, high], np.uint64)
        assert suffixes._bucket(at, buckets).tolist() == [k, k]
        assert (high - (k << 64) // buckets) // ((1 << 32) // buckets + 2) < 1 << 32
