import random

import numpy as np

from quillon.llm import decontam, langid, quality, rules, toxicity
from tests.llm import brute, data


def test_op5_matches_plain_version(spark):
    rows = data.rows()
    got = rules.digest(rules.measure(data.frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {d: brute.rules(t) for d, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert rules.measure(data.frame(spark, [])).count() == 0


def test_op5_policies_and_ablations(spark):
    ledger = rules.measure(data.frame(spark))
    rows = ledger.collect()
    for policy in rules.POLICIES:
        of = rules.mask(policy)
        got = {r.rule: r for r in rules.ablations(ledger, policy).collect()}
        for name, r in got.items():
            bit = rules.mask((name,))
            assert r.failed == sum(bool(x.failures & bit) for x in rows)
            assert r.failed_alone == sum(x.failures & of == bit for x in rows)
            assert r.dropped == sum(bool(x.failures & of) for x in rows)
        assert set(got) in (set(rules.POLICIES[policy]), set())


def test_op8_matches_plain_version(spark):
    rng = random.Random(4)
    rows = data.rows()
    items = [(i, " ".join(rng.choices(data.WORDS, k=rng.choice([0, 2, 5, 13, 30])))) for i in range(15)]
    items += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, "One two")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = {d: brute.contamination(t, items) for d, t in rows}
    for shard in (2_000_000, 200):
        got = decontam.digest(decontam.contamination(data.frame(spark, rows), bench, shard=shard)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    left = decontam.cleaned(data.frame(spark, rows), bench, shard=200, held=1)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, w in want.items() if not w[4])
    assert left.columns == data.frame(spark, rows).columns
    none = decontam.contamination(data.frame(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    assert decontam.contamination(data.frame(spark, []), bench).count() == 0


LANGS = {"aa": "kala mona tiru sebo lano", "bb": "strech wurtz flinge doch pfeil", "cc": "quíe ñado ésta llover cióna"}


def texts(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        out.append((i, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(8, 60))), lang))
    return out


def test_op10_finds_languages(spark):
    rng = random.Random(1)
    rows = texts(rng, 150)
    extra = [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "é", None)]
    mixed = " ".join(rng.choices(LANGS["aa"].split(), k=60) + rng.choices(LANGS["bb"].split(), k=30))
    df = spark.createDataFrame([(*r, 5, "x") for r in rows + extra + [(904, mixed, None)]], "doc_id long, text string, lang string, score int, lang_pred string")
    langs, model = langid.fit(df)
    assert langs == sorted(LANGS)
    got = {r.doc_id: r for r in langid.predict(df, langs, model).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert got[904].lang_pred == "aa" and set(got[904].shares) == {"aa", "bb"} and 0.5 < got[904].score < 0.8
    assert abs(sum(got[904].shares.values()) - 1) < 1e-9
    left = langid.accepted(df)
    assert left.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in left.collect())
    assert langid.predict(df.limit(0), langs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, *langid.fit(df.limit(0))).collect()} == {"und"}


def test_op10_letters_are_of_category_l(spark):
    df = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 _"), (2, "½ é"), (3, "x²y"), (4, "٣٤"), (5, "ʰ"), (6, "a\u0301" * 3)], "doc_id long, text string")
    langs, model = langid.fit(spark.createDataFrame(texts(random.Random(1), 30), "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langs, model).collect()}
    assert {d for d, p in got.items() if p == "und"} == {1, 4}
    assert langid._words("x²Y½ Ünï_code3b") == ["x", "y", "ünï", "code", "b"]


def test_op10_set_is_the_best_of_all(spark):
    """The likelihood of the set found against that of every set, by plain expectation-maximisation to the end."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for trial in range(25):
        model = rng.dirichlet(np.full(40, 0.6), 4)
        parts = rng.choice(4, rng.integers(1, 4), replace=False)
        true = np.zeros(4)
        true[parts] = rng.dirichlet(np.full(len(parts), 4.0))
        counts = rng.multinomial(int(rng.integers(20, 800)), true @ model)
        used = np.flatnonzero(counts)
        n, like = counts[used], model[:, used]

        def penalised(chosen, n=n, like=like):
            share = np.full(len(chosen), 1 / len(chosen))
            for _ in range(400):
                joint = share @ like[list(chosen)]
                share = share * (like[list(chosen)] @ (n / joint)) / n.sum()
            return float(n @ np.log(share @ like[list(chosen)])) - 0.5 * (len(chosen) - 1) * np.log(n.sum()), share

        best = max((penalised(c)[0], c) for k in range(1, 5) for c in combinations(range(4), k))
        got = langid.infer(used, n, model)
        chosen = tuple(np.flatnonzero(got))
        assert penalised(chosen)[0] >= best[0] - 0.5, (trial, chosen, best)
        assert np.abs(got[list(chosen)] - penalised(chosen)[1]).max() < 0.05


def test_op10_very_long_text(spark):
    rows = texts(random.Random(1), 40)
    langs, model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long_ = "kala mona " * 200_000 + "strech " * 100_000
    got = langid.predict(spark.createDataFrame([(1, long_)], "doc_id long, text string"), langs, model).collect()[0]
    assert got.lang_pred == "aa" and set(got.shares) == {"aa", "bb"}


def test_op10_proportions_raise_the_likelihood():
    rng = np.random.default_rng(0)
    model = rng.dirichlet(np.ones(50), 3)
    counts = rng.multinomial(4000, 0.7 * model[0] + 0.3 * model[2])
    used = np.flatnonzero(counts)
    share = langid.infer(used, counts[used], model)
    assert share[1] == 0 and abs(share[0] - 0.7) < 0.1


def test_op2_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(data.WORDS, k=rng.randint(60, 200)))
    bad = lambda: " ".join(w + rng.choice(["$$$", "%%%", "!!"]) for w in rng.choices(data.WORDS, k=rng.randint(60, 200)))
    rows = [(i, good() if i % 5 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 600, 2)] + [(99999, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.quality(data.frame(spark, rows + data.AWKWARD), labels).collect()}
    assert len(got) == 600 + len(data.AWKWARD) and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.3) == (i % 5 != 0) for i in range(600))
    assert right >= 590
    none = quality.quality(data.frame(spark, rows[:5]), labels.limit(0)).collect()
    assert len(none) == 5
    assert quality.quality(data.frame(spark, []), labels).count() == 0


def test_op2_prior_and_risk():
    rng = np.random.default_rng(5)
    p = rng.normal(1.5, 1, (3000, 4))
    u = np.concatenate([rng.normal(1.5, 1, (2100, 4)), rng.normal(-1.5, 1, (900, 4))])
    model = quality.train(p, u)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.scores(u[:2100]) >= 0.5).mean() > 0.95 and (model.scores(u[2100:]) < 0.5).mean() > 0.95


def test_op2_risk_matches_its_definition():
    rng = np.random.default_rng(6)
    cost = lambda z, y: np.log1p(np.exp(-y * z))
    for prior, shift in ((0.3, 0.0), (0.6, 1.0), (0.9, 3.0)):
        zp, zu = rng.normal(shift, 1, 40), rng.normal(-shift, 1, 70)

        def plain(zp, zu, prior=prior):
            negative = cost(zu, -1).mean() - prior * cost(zp, -1).mean()
            return prior * cost(zp, 1).mean(), negative

        value, gp, gu = quality.risk(zp, zu, prior)
        positive, negative = plain(zp, zu)
        assert abs(value - positive - max(0, negative)) < 1e-9
        # the step's direction: that of the whole risk, or away from a negative part under 0
        goal = (lambda *z: sum(plain(*z))) if negative >= 0 else (lambda *z: -plain(*z)[1])
        for z, g, at in ((zp, gp, 0), (zu, gu, 1)):
            for i in (0, 7, 31):
                up, down = [zp.copy(), zu.copy()], [zp.copy(), zu.copy()]
                up[at][i] += 1e-5
                down[at][i] -= 1e-5
                assert abs((goal(*up) - goal(*down)) / 2e-5 - g[i]) < 1e-6, (prior, at, i, len(z))


def test_op7_likelihood_is_the_largest():
    rng = np.random.default_rng(2)
    words = ["a", "b", "c"]
    rows = []
    for _ in range(400):
        x = {int(i): 1.0 for i in np.flatnonzero(rng.random(3) < 0.4)} | {6: float(rng.random())}
        z = 2.0 * (0 in x) + 1.0 * (1 in x) + x[6] + rng.logistic()
        rows.append((x, int((z > 1) + (z > 2.2) + (z > 3.5))))

    def cost(w, cuts, decay=1e-3):
        """Mean negative log-likelihood of the grades, with the weights' decay."""
        out = decay * (w @ w) / 2
        for x, y in rows:
            above = [1.0, *(1 / (1 + np.exp(c - sum(w[i] * v for i, v in x.items()))) for c in cuts), 0.0]
            out -= np.log(above[y] - above[y + 1]) / len(rows)
        return out

    model = toxicity.train(toxicity.Model(words, np.zeros(0), np.zeros(0)), rows, steps=3000, rate=0.02)
    assert (np.diff(model.cuts) > 0).all() and model.weights[0] > model.weights[1] > 0
    best = cost(model.weights, model.cuts)
    for _ in range(30):
        assert cost(model.weights + rng.normal(0, 0.1, 7), model.cuts) > best
        assert cost(model.weights, model.cuts + np.sort(rng.normal(0, 0.1, 3))) > best


def test_op7_very_long_text(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "fine words here " * 20 + ("vile vile" if i % 2 else "")) for i in range(40)] + [(100, "vile " * 500_000), (101, "fine words " * 300_000)]
    got = {r.doc_id: r for r in toxicity.toxicity(data.frame(spark, rows), labels).collect()}
    assert got[100].toxic and not got[101].toxic


def test_op7_grades_toxic_rows(spark):
    rng = random.Random(8)

    def row(i):
        w = rng.choices(data.WORDS, k=rng.randint(30, 200))
        n = 0 if i % 4 else rng.choice([1, 3, 20])
        for _ in range(n):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "Nasty,", "SCUMMY"]))
        return i, " ".join(w), n

    rows = [row(i) for i in range(500)]
    labels = spark.createDataFrame([(i, 1, int(n > 0)) for i, _, n in rows if i % 3], "doc_id long, quality int, toxic int")
    df = data.frame(spark, [(i, t) for i, t, _ in rows] + data.AWKWARD)
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert len(got) == 500 + len(data.AWKWARD)
    assert all(got[i].toxic == (n > 0) for i, _, n in rows)
    mean = lambda k: np.mean([got[i].severity for i, _, n in rows if n == k])
    assert mean(0) < 0.2 < mean(1) < mean(20) <= 3
    assert not any(got[d].toxic for d, _ in data.AWKWARD)
    assert all(r.severity == 0 for r in toxicity.toxicity(df, labels.limit(0)).collect())
    assert toxicity.toxicity(data.frame(spark, []), labels).count() == 0


def test_op8_shared_windows_short_items_and_long_ones(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(12)]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(f"i{k}", draw(n)) for k, n in enumerate([1, 2, 2, 3, 5, 12, 13, 14, 30, 30, 200, 400])]
    items += [("i9", items[8][1]), ("twin", items[10][1]), (None, draw(20)), ("none", None), ("dots", "...")]
    rows = [(i, draw(rng.randint(0, 80)) + " " + items[rng.randrange(4, 12)][1][rng.randint(0, 30) :] + " " + rng.choice(["other", ""])) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows] + [(None, rows[3][1], "y", 2), (7, rows[8][1], "z", 3)], "doc_id long, text string, _hash string, gone int")
    named = [("" if i is None else i, t) for i, t in items]
    for part in (named, [x for x in named if x[1] and len(x[1].split()) > 4]):
        bench = spark.createDataFrame(part, "item_id string, text string")
        want = sorted((r.doc_id or 0, *brute.contamination(r.text, part)) for r in docs.collect())
        for shard, held in ((250_000, 4), (300, 1)) if len(part) == len(named) else ((250_000, 4),):
            got = decontam.digest(decontam.contamination(docs, bench, shard=shard, held=held)).collect()
            assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
            left = decontam.cleaned(docs, bench, shard=shard, held=held)
            assert left.columns == docs.columns
            assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_op8_very_long_text():
    long_ = ["a", "b"] * 400_000
    item = ["a", "b"] * 7
    automaton = decontam.Automaton([("x", [w.encode() for w in item])])
    spans, found = automaton.match([w.encode() for w in long_])
    assert spans == [(0, 800_000)] and found == {"x"}
