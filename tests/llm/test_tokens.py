import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import packing, rans
from tests.llm import brute, data


def test_round_trip_and_segments():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 2048, 2049, 300_000):
        ids = (rng.zipf(1.4, n) % 50_000).astype(np.uint32)
        counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True))
        table = rans.Table(rans.scaled(counts))
        block = rans.encode(ids, table, every=16)
        assert (rans.decode(block, table) == ids).all()
        if n > 40_000:
            assert (rans.decode(block, table, segment=1) == ids[16 * 2048 : 32 * 2048]).all()
            with pytest.raises(ValueError):
                rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_op1_matches_plain_version(spark):
    rows = data.rows()
    path = rans.write_tokens(data.frame(spark, rows), block=2000, lanes=16, every=8)
    got = rans.read_tokens(spark, path).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute.tokens(rows)
    text = dict(rows)
    assert all(list(np.frombuffer(r.ids, "<u4")) == brute.ids_of(text[r.doc_id], 0) for r in got)


def test_op1_empty_and_null_ids(spark):
    empty = data.frame(spark, []).select("doc_id", "text")
    assert rans.read_tokens(spark, rans.write_tokens(empty)).count() == 0
    got = rans.read_tokens(spark, rans.write_tokens(data.frame(spark, [(None, "a b"), (None, None), (5, "c"), (5, "c")]))).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 1), (1, 3), (4, 2), (6, 2)]


def test_op9_matches_plain_version(spark):
    rows = data.rows()
    got = packing.pack(data.frame(spark, rows), capacity=128, with_ids=True).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute.pieces(rows, 128)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert packing.bound(counts, 128) <= len(bins) <= sum(n for _, n in packing.best_fit(counts, 128))


def test_op9_empty_and_ties(spark):
    assert packing.pack(data.frame(spark, [])).count() == 0
    got = packing.pack(data.frame(spark, [(None, None), (3, "a"), (3, "a")])).collect()
    assert len(got) == 3 and {r.sequence_id for r in got} == {got[0].sequence_id} and sorted(r.offset for r in got) in ([0, 1, 3], [0, 2, 4], [0, 2, 3])


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def bins_of(plan):
    return sum(n for _, n in plan)


def test_search_is_exact_without_limits():
    rng = random.Random(1)
    lost = 0
    for counts in [Counter(rng.randint(2, 18) for _ in range(rng.randint(1, 12))) for _ in range(150)] + [{3: 2, 4: 5, 6: 1, 8: 1, 9: 1, 11: 1}]:
        plan = packing.complete(counts, 20, None, None)
        held = Counter()
        for shape, many in plan:
            assert sum(x * k for x, k in shape) <= 20
            for x, k in shape:
                held[x] += k * many
        assert held == counts
        assert bins_of(plan) == optimum(sorted(Counter(counts).elements(), reverse=True), 20)
        lost += bins_of(packing.best_fit(counts, 20)) > bins_of(plan)
    assert lost


def test_search_beats_best_fit():
    rng = random.Random(1)
    counts = Counter(rng.randint(200, 600) for _ in range(3000))
    assert packing.bound(counts, 1024) <= bins_of(packing.complete(counts)) < bins_of(packing.best_fit(counts, 1024))


def test_fillings_are_undominated_and_in_order():
    counts = {6: 3, 5: 3, 4: 3, 3: 3, 2: 6}
    shapes = list(packing.fillings(6, counts, 10))
    wastes = [10 - sum(x * k for x, k in s) for s in shapes]
    assert shapes[0] == ((6, 1), (4, 1)) and wastes == sorted(wastes) and min(wastes) >= 0
    assert ((6, 1), (3, 1)) not in shapes and ((6, 1), (2, 2)) in shapes
    assert list(packing.fillings(9, {9: 1, 5: 2}, 10)) == [((9, 1),)]


def test_op9_full_pieces_stand_alone(spark):
    got = packing.pack(data.frame(spark, [(1, "tie " * 500), (2, "tie " * 500), (3, None), (None, "a b c")]), capacity=16).collect()
    full = [r.sequence_id for r in got if r.length == 16]
    assert len(set(full)) == len(full) > 50 and not set(full) & {r.sequence_id for r in got if r.length < 16}


def test_pieces_are_cut_as_the_library_cuts_them():
    from quillon.llm import bpe

    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r\n", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " '", "''", "a", "The", "naïve", "é", "ß", "×", "÷", "42", "½", "²", "…", "–", "don't", "it's'll",
            "'sabc", "'rest", "'lly", "!!", "?", ".", "<|endoftext|>", "日本", "x1y2", "«", "-", "_", "I'M", "\x0b", "\xa0", " \n", " \n x", "\n 's", " 're", "’s", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)] + ["".join(rng.choices(bits[:35], k=rng.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "\n", "'s"]
    enc = bpe.Encoder(bpe.vocabulary(), cache=500)
    assert sum(enc._sure(t or "") for t in texts) > 2000
    for together in (1, 300, 10**7):
        bpe.TOGETHER, held = together, bpe.TOGETHER
        try:
            assert [list(np.frombuffer(x, "<u4")) for x in enc.encode_many(texts)] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        finally:
            bpe.TOGETHER = held
