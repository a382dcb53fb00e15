import random

from quillon.llm import simhash
from tests.llm import brute, data


def test_fingerprints():
    for _, text in data.rows():
        assert simhash.fingerprint(text) == brute.fingerprint(text)


def check(spark, rows, **options):
    got = simhash.near_duplicates(data.frame(spark, rows), **options).collect()
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    assert {(r.doc_id, r.fp % 2**64) for r in got} == set(prints)
    assert {r.doc_id: r.component_id for r in got} == brute.groups(prints)
    assert len(got) == len(rows)


def test_op4_matches_plain_version(spark):
    check(spark, data.rows())


def test_op4_hot_keys_are_dealt_out(spark):
    rng = random.Random(5)
    words = rng.choices(data.WORDS, k=300)
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(i % 4):
            w[rng.randrange(300)] = f"w{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows, hot=8)


def test_op4_chain_condition_loses_no_link(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for f in prints[:100]:
        x = f
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.append(x)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in prints], "fp long")
    keys = df.mapInArrow(simhash._keys, "key long, fp long, own boolean")
    for hot in (4096, 1):
        dealt = simhash._dealt(keys, hot).select("key", "sub", "fp", "own").repartition(3, "key", "sub").sortWithinPartitions("key", "sub")
        from quillon.llm.components import components

        got = {r.node % 2**64: r.label for r in components(dealt.mapInArrow(simhash._stars(3), "a long, b long")).collect()}
        want = brute.groups(list(enumerate(prints)))
        for i, f in enumerate(prints):
            for j, g in enumerate(prints):
                assert (want[i] == want[j]) == (f == g or (f in got and got[f] == got.get(g)))


def test_op4_empty_and_kept(spark):
    assert simhash.near_duplicates(data.frame(spark, [])).count() == 0
    rows = [(4, "a b c d"), (4, "a b c d"), (7, "a b c d"), (9, "other words here now"), (None, "a b c d")]
    got = simhash.kept(data.frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == [4, 9]
    assert got.columns == data.frame(spark, []).columns


def test_kept_judges_rows_not_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(rng.choices(data.WORDS, k=60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, c), (1, d), (5, a), (5, d), (5, d), (6, b + " x y z w v u"), (None, None), (7, ""), (8, "  ")]
    docs = spark.createDataFrame([(i, t, str(i), "x", 3) for i, t in rows], "doc_id long, text string, gone_id string, _turn string, id int")
    got = simhash.kept(docs)
    assert got.columns == docs.columns
    # a and d go by their smallest id; b and c have no id but no copy either; without words: one group
    want = [(None, b), (None, c), (1, d), (5, a), (6, rows[7][1]), (7, "")]
    if brute.groups([(0, brute.fingerprint(b)), (1, brute.fingerprint(rows[7][1]))])[1] == 0:
        want = [w for w in want if w != (None, b)]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in want)
    assert all(r.gone_id == str(r.doc_id) and r._turn == "x" for r in got.collect())
    same = spark.createDataFrame([(None, a)] * 40 + [(3, b)] * 40, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.kept(same).collect()) == sorted([(0, a), (3, b)])
    assert simhash.kept(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    from quillon.llm.components import components

    n = 300
    ids = [2, *range(100, 100 + n), 1]
    links = list(zip(ids, ids[1:], strict=False)) + [(-5, -9), (-9, -7), (50, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, 1) | dict.fromkeys((-5, -9, -7), -9)


def test_very_long_text(spark):
    long_ = "word another third " * 200_000
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(1, long_), (2, long_ + "tail"), (3, "short")], "doc_id long, text string")).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3
    assert got[1].fp & (2**64 - 1) == brute.fingerprint(long_)
