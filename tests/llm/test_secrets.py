import math
import random
import re
import string

from pyspark.sql import functions as F

from quillon.llm import secrets
from tests.llm import brute, data


def check(spark, rows):
    got = secrets.digest(secrets.find_secrets(data.frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {d: brute.secrets(t) for d, t in rows}
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id][:4], (r, want[r.doc_id])
        assert set(filter(None, want[r.doc_id][4].split(","))) <= set(filter(None, r.spans.split(",")))
    return {r.doc_id: r for r in got}


def test_op6_matches_plain_version(spark):
    rng = random.Random(2)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", "password", "=", ":", " ", "\"", "'", "AKIA", "0123456789abcdef", "deadbeef", "é", "日", "\n", "\x01", "Q7", "abcdefghijkl", "=="]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(300)]
    check(spark, rows + data.AWKWARD + [(5000, "token = " + "a" * 11), (5001, "deadbeefdeadbeef " * 700)])


def test_op6_finds_random_strings_and_spares_text(spark):
    rng = random.Random(4)
    alphabet = string.ascii_letters + string.digits
    odd = [(i, "key is " + "".join(rng.choices(alphabet, k=40)) + " there") for i in range(20)]
    plain = [(100 + i, "PackageVersion2WithLongCamelCaseNames and aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 11111111111111111111111a") for i in range(20)]
    got = check(spark, odd + plain + [(999, None)])
    assert sum("random:" in got[i].spans for i, _ in odd) >= 18
    assert not any("random:" in got[i].spans for i, _ in plain)
    at = got[odd[0][0]].spans.split(":")
    assert at == ["random", "7", "47"] or at == [""]


def test_op6_redacts(spark):
    rows = [(1, "a token=abcdefghijklmno b"), (2, "clean"), (3, None), (4, "password: deadbeefdeadbeef, deadbeefdeadbeef")]
    got = {r.doc_id: r for r in secrets.redacted(data.frame(spark, rows)).collect()}
    assert got[1].text == "a [redacted] b" and got[1].n_chars == 14
    assert got[2].text == "clean" and got[3].text is None
    assert got[4].text == "[redacted], [redacted]"
    assert secrets.redacted(data.frame(spark, [])).count() == 0
    assert secrets.redacted(data.frame(spark, rows)).columns == data.frame(spark, rows).columns


def test_op6_finds_short_keys_of_every_encoding(spark):
    rng = random.Random(6)
    upper, digits = string.ascii_uppercase, string.digits
    keys = {("hex", 32): digits + "ABCDEF", ("hex", 40): digits + "ABCDEF", ("hex", 64): digits + "ABCDEF", ("base32", 32): upper + "234567", ("alnum", 20): string.ascii_letters + digits, ("alnum", 24): string.ascii_letters + digits}
    planted = {(name, n): ["".join(rng.choices(a, k=n)) for _ in range(40)] for (name, n), a in keys.items()}
    number = lambda: "".join(rng.choices(digits, k=rng.randint(4, 9)))
    plain = {
        "hex": (["DEAD", "BEEF", "FACADE", "CAFE", "ADD", "BAD"], number),
        "base32": (["RELEASE", "PACKAGE", "VERSION", "CANDIDATE", "SERVER"], lambda: rng.choice("234567")),
        "alnum": (["Package", "version", "Names", "With", "release", "Http"], lambda: rng.choice(digits)),
    }
    rows, ordinary = [], []
    for (name, n), strings in planted.items():
        rows += strings
        words, more = plain[name]
        for _ in range(3 * len(strings)):
            text = ""
            while len(text) < n:
                text += rng.choice(words) + rng.choice([more(), ""])
            ordinary.append(text[: n - 1] + "2")
    got = check(spark, list(enumerate(["key " + s + " end" for s in rows + ordinary])))
    found = ["random:" in got[i].spans for i in range(len(got))]
    for k, (name, n) in enumerate(planted):
        assert sum(found[40 * k : 40 * k + 40]) >= 22, (name, n)
    assert sum(found[len(rows) :]) <= len(ordinary) // 100


def test_op6_ratio_matches_plain_version(spark):
    rng = random.Random(9)
    for name, alphabet, _ in secrets.ENCODINGS:
        symbols, first, styles = secrets.ordinary(alphabet)
        assert abs(sum(math.exp(symbols[c] + first[secrets._kind(c)]) for c in alphabet) - 1) < 1e-9
        assert all(abs(sum(math.exp(style[a + b]) for b in first) - 1) < 1e-9 for style in styles for a in first)
        texts = ["".join(rng.choices(alphabet, k=rng.randint(20, 70))) for _ in range(30)] + ["".join(rng.choices(alphabet[:3], k=25)) for _ in range(5)]
        s, n = F.col("s"), F.length("s").cast("double")
        counts = F.array(*[(n - F.length(F.replace(s, F.lit(c), F.lit("")))) for c in alphabet])
        frame = spark.createDataFrame([(t,) for t in texts], "s string")
        for r in frame.select("s", secrets._ratio(s, n, counts, alphabet, F.lit(16.0)).alias("x")).collect():
            kinds = [secrets._kind(c) for c in r.s]
            best = max(sum(style[a + b] for a, b in zip(kinds, kinds[1:], strict=False)) for style in styles)
            want = -len(r.s) * math.log(16) - sum(symbols[c] for c in r.s) - first[kinds[0]] - best
            assert abs(r.x - want / math.log(10)) < 1e-6, (name, r.s)


def phi(x):
    return math.erfc(-x / math.sqrt(2)) / 2


def plain_battery(value):
    """The battery by its definitions; None for ordinary text."""
    body = value.rstrip("=")
    if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or len(body) < 20:
        return None
    k = next(k for k, e in enumerate(secrets.ENCODINGS) if re.search(e[2], value))
    name, alphabet, _ = secrets.ENCODINGS[k]
    s = body.lower() if name == "hex" else body
    n, size = len(s), len(alphabet)
    place = [alphabet.index(c) for c in s]
    chi2 = sum((place.count(i) - n / size) ** 2 / (n / size) for i in range(size))
    high = [p >= size // 2 for p in place]
    runs, ones = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
    mean = 2 * ones * (n - ones) / n + 1
    runs_p = 2 * phi(-abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    d = [p - sum(place) / n for p in place]
    serial = sum(a * b for a, b in zip(d, d[1:], strict=False)) / max(sum(a * a for a in d), 1e-9)
    serial_p = 2 * phi(-abs((serial + 1 / n) * math.sqrt(n)))
    two_cases = size > 36 and re.search("[a-z]", s) and re.search("[A-Z]", s)
    even = size if size <= 36 or two_cases else size - 26
    spare = 2 / (9 * (even - 1))
    chi2_p = phi(-((((chi2 + n) * even / size - n) / (even - 1)) ** (1 / 3) - 1 + spare) / math.sqrt(spare)) if (chi2 + n) * even / size > n else None
    if chi2_p is None:  # the cube root of a negative number
        x = ((chi2 + n) * even / size - n) / (even - 1)
        chi2_p = phi(-(-(abs(x) ** (1 / 3)) - 1 + spare) / math.sqrt(spare))
    half = -sum(math.log(max(p, 1e-30)) for p in (chi2_p, runs_p, serial_p))
    joint = math.exp(-half) * (1 + half + half * half / 2)
    extra = 0.0
    for own in (string.digits, string.ascii_uppercase, string.ascii_lowercase, "+/-_"):
        symbols = [c for c in alphabet if c in own]
        shares = [secrets._SHARES[c.lower()] if c.isalpha() else 1 for c in symbols]
        if symbols:
            extra += size * (sum(s.count(c) for c in symbols) / n) ** 2 * sum((x / sum(shares)) ** 2 for x in shares)
    extra = max(0.0, extra - 1)
    low = phi((chi2 - (size - 1 + n * extra)) / math.sqrt(2 * (size - 1 + 2 * n * extra)))
    symbols, first, styles = secrets.ordinary(alphabet)
    kinds = [secrets._kind(c) for c in s]
    fit = max(sum(style[a + b] for a, b in zip(kinds, kinds[1:], strict=False)) for style in styles)
    ratio = (-n * math.log(even) - sum(symbols[c] for c in s) - first[kinds[0]] - fit) / math.log(10)
    evidence = max(-math.log10(low), ratio - (math.log10(3) if size > 36 else 0)) - math.log10(2)
    return k, n, chi2, chi2_p, runs_p, serial_p, joint, max(0.0, evidence + min(0.0, math.log10(joint / 0.05)))


def test_op6_battery_and_control_match_plain_versions(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices(a, k=rng.randint(15, 80))) + rng.choice(["", "=", "=="]) for _, a, _ in secrets.ENCODINGS for _ in range(40)]
    texts += ["a1" * 20, "Release2Candidate3Package", "0123456789abcdef" * 3, "1" * 30 + "a", "abcdefghij1234567890", "A1" + "B" * 40, "CAFE" * 8 + "12"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", secrets.battery(F.col("s")).alias("b")).collect()
    evidences = []
    for r in got:
        want = plain_battery(texts[r.i])
        assert (r.b.encoding < 0) == (want is None), texts[r.i]
        if want:
            assert (r.b.encoding, r.b.n) == want[:2]
            for x, y in zip((r.b.chi2, r.b.chi2_p, r.b.runs_p, r.b.serial_p, r.b.joint_p), want[2:7], strict=True):
                assert abs(x - y) < 1e-6 * max(1, abs(y)), (texts[r.i], r.b, want)
            assert texts[r.i][:4] != "a1a1" or r.b.evidence == 0
            if r.b.evidence < 6 and want[7] < 6:  # beyond, approximations of far tails differ
                assert abs(r.b.evidence - want[7]) < 0.02 * max(1, want[7]), (texts[r.i], r.b, want)
            evidences.append((want[0], int(math.log2(want[1])), r.b.evidence))
    tried = ", ".join(f"struct(0L as start, 1L as stop, {e} as encoding, {s} as size, {x!r}D as evidence)" for e, s, x in evidences)
    scanned = spark.range(1).select(F.struct(F.expr(f"array({tried})").alias("tried")).alias("found"))
    for level in (0.001, 0.05):
        want = set()
        for key in {x[:2] for x in evidences}:
            bins = sorted((math.floor(x[2] * secrets.BINS) for x in evidences if x[:2] == key), reverse=True)
            good = [b for b in bins if b > 0 and 10 ** (-b / secrets.BINS) <= level * sum(c >= b for c in bins) / len(bins)]
            if good:
                want.add((*key, min(good) / secrets.BINS))
        assert set(secrets.thresholds(scanned, level)) == want


def test_op6_strings_around_base_spans_are_tried(spark):
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits
    draw = lambda n: "".join(rng.choices(alphabet, k=n))
    rows = [(i, "see " + draw(30) + "deadbeefdeadbeef" + draw(30) + " end") for i in range(20)] + [(100, "token=" + draw(40)), (101, "token=" + draw(40) + " " + draw(60))]
    got = check(spark, rows)
    assert sum("random:4:80" in got[i].spans for i in range(20)) >= 18
    assert got[100].spans.count("random") == 0 and got[101].spans.count("random") == 1
    left = {r.doc_id: r for r in secrets.redacted(data.frame(spark, rows)).collect()}
    assert sum(left[i].text == "see [redacted] end" for i in range(20)) >= 18
    odd = spark.createDataFrame([(1, "x token=abcdefghijklmno", "keep", "this")], "doc_id long, text string, _new string, found string")
    out = secrets.redacted(odd).collect()[0]
    assert (out.text, out._new, out["found"]) == ("x [redacted]", "keep", "this")
