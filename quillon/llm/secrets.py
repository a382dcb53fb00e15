"""Secret scans with DataFrame functions only.

Base patterns give spans by kind. Beside them, long unbroken strings go through a battery of randomness tests: their
encoding is inferred (hex, base32, alphanumeric or base64), and over its alphabet three statistics are taken:
chi-squared of uniformity, the number of runs of the alphabet's halves, and lag-one serial correlation.

Each string's p-value says how likely ordinary text of that length would look as random. Of two tests the better
counts, at half the level each: chi-squared as low as the string's where letters, digits and signs are as many as in it
but drawn by their shares in words, and a likelihood ratio. The latter holds symbols
drawn evenly against a model of ordinary strings: letters of one case, digits and signs come in stretches, and letters
by their shares in words. Ordinary strings of the model exceed a ratio of x with a probability of 1/x at most, whatever
their length and style, so that strings of 20 symbols can be told as well. The three tests' own p-values, of as much
deviation from an even draw, are joined by Fisher's method; where the joint p-value is under JOINT, the evidence is
less by as many orders of magnitude. That can only make a p-value larger, so the level holds. Benjamini-Hochberg control
then holds within each class of length and encoding, over all texts.

How spans are found without positions from the engine: a mark that no text holds is put around the matches, the text
is split at it, and the lengths of the parts add up to positions, in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import stored, unused

KINDS = ("assign", "access", "hex", "random")
_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: By kind: the pattern, and what in a match must have `least` code points: all of it, or what follows this head.
_BASE = ((_HEAD + r"[A-Za-z0-9+/_.=-]+", _HEAD, 12), (r"AKIA[A-Z0-9]{14,}", None, 18), (r"[0-9a-f]{16,}", None, 16))
_LONG = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_MARK = "\x01"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are tried: name, alphabet and pattern.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    ("base32", _UPPER + "234567", r"^[A-Z2-7]+=*$"),
    ("alnum", _DIGITS + _UPPER + _LOWER, r"^[A-Za-z0-9]+$"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", r"^[A-Za-z0-9+/]+=*$"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", r"^[A-Za-z0-9_-]+=*$"),
)
#: Ordinary strings, by styles: how a symbol's kind (lower case, upper case, digit, sign) follows the kind before it.
#: Rows are scaled to the kinds that an alphabet has; names and paths are one style, constants in upper case another.
_STYLES = (
    {"l": {"l": 0.84, "u": 0.06, "d": 0.04, "s": 0.06}, "u": {"l": 0.55, "u": 0.35, "d": 0.04, "s": 0.06},
     "d": {"l": 0.06, "u": 0.06, "d": 0.78, "s": 0.10}, "s": {"l": 0.55, "u": 0.20, "d": 0.20, "s": 0.05}},
    {"l": {"l": 0.60, "u": 0.20, "d": 0.10, "s": 0.10}, "u": {"l": 0.02, "u": 0.84, "d": 0.05, "s": 0.09},
     "d": {"l": 0.02, "u": 0.12, "d": 0.74, "s": 0.12}, "s": {"l": 0.10, "u": 0.70, "d": 0.15, "s": 0.05}},
)
#: Shares of letters in Latin-script words, in percent, and how far they are trusted against even shares.
_SHARES = dict(zip(_LOWER, (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1), strict=True))
_TRUST = 0.7
#: Level of false discoveries in each class; joint p-value of the three tests under which evidence is less; bins a unit of -log10 p.
LEVEL, JOINT, BINS = 0.001, 0.05, 10
_CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _starts(sizes: Column) -> Column:
    """Sums of the sizes before each, by chunks, so that many don't cost their square."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def running(values: Column, first: Column) -> Column:
        state = F.struct(none.alias("a"), first.alias("s"))
        step = lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).alias("s"))
        return F.aggregate(values, state, step, lambda acc: acc["a"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda j: F.slice(sizes, j * _CHUNK + 1, F.lit(_CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, x: acc + x))
    return F.flatten(F.zip_with(chunks, running(sums, zero), running))


def _matches(text: Column, pattern: str) -> Column:
    """All matches as (start, stop, value), in order."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)

    def cut(p: Column) -> Column:
        starts = _starts(F.transform(p, lambda x: F.length(x).cast("long")))
        every = F.zip_with(p, starts, lambda v, s: F.struct(s.alias("start"), (s + F.length(v)).alias("stop"), v.alias("value")))
        return F.filter(every, lambda x, i: i % 2 == 1)

    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return F.when(text.rlike(pattern), _let(pieces, cut)).otherwise(none)


def _base(text: Column, kind: int) -> Column:
    """Spans (start, kind, stop) of a base kind: matches first, then those long enough."""
    pattern, head, least = _BASE[kind]
    body = (lambda m: F.regexp_replace(m["value"], "^" + head, "")) if head else (lambda m: m["value"])
    long_ = F.filter(_matches(text, pattern), lambda m: F.length(body(m)) >= least)
    return F.transform(long_, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def _normal(x: Column) -> Column:
    """The standard normal distribution function up to 1e-7, by Abramowitz and Stegun 26.2.17."""

    def tail(z: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * _let(1 / (1 + 0.2316419 * F.abs(z)), poly)

    return _let(x, lambda z: _let(tail(z), lambda p: F.when(z < 0, p).otherwise(1 - p)))


def _evidence(x: Column) -> Column:
    """-log10 of the lower tail at x; far out by its expansion, where the tail itself would be 0."""
    far = lambda z: (z * z / 2 + F.log(F.greatest(-z, F.lit(1.0))) + 0.9189385) / math.log(10)
    near = lambda z: F.greatest(-F.log10(F.greatest(_normal(z), F.lit(1e-12))), F.lit(0.0))
    return _let(x, lambda z: F.when(z < -5, far(z)).otherwise(near(z)))


def _kind(symbol: str) -> str:
    return "l" if symbol in _LOWER else "u" if symbol in _UPPER else "d" if symbol in _DIGITS else "s"


def ordinary(alphabet: str) -> tuple[dict[str, float], dict[str, float], list[dict[str, float]]]:
    """Natural logs of the model of ordinary strings: each symbol's share within its kind, each kind's chance to come
    first, and by style that of each pair of kinds. Alphabets of one case have the style of that case alone."""
    kinds: dict[str, list[str]] = {}
    for c in alphabet:
        kinds.setdefault(_kind(c), []).append(c)
    symbols = {}
    for kind, own in kinds.items():
        shares = [_SHARES[c.lower()] if kind in "lu" else 1.0 for c in own]
        for c, x in zip(own, shares, strict=True):
            symbols[c] = math.log(_TRUST * x / sum(shares) + (1 - _TRUST) / len(own))
    first = {kind: math.log(len(own) / len(alphabet)) for kind, own in kinds.items()}
    styles = [style for style, case in zip(_STYLES, "lu", strict=True) if case in kinds]
    return symbols, first, [{a + b: math.log(style[a][b] / sum(style[a][k] for k in kinds)) for a in kinds for b in kinds} for style in styles]


def repeats(alphabet: str) -> list[tuple[int, int, float]]:
    """Where each kind's symbols stand in an alphabet, how many they are, and the chance that two ordinary symbols of
    that kind are equal."""
    out = []
    for kind, own in groupby(alphabet, _kind):
        symbols = list(own)
        shares = [_SHARES[c.lower()] if kind in "lu" else 1.0 for c in symbols]
        out.append((alphabet.index(symbols[0]), len(symbols), sum(x * x for x in shares) / sum(shares) ** 2))
    return out


def _extra(counts: Column, n: Column, alphabet: str) -> Column:
    """What each symbol of ordinary text adds to chi-squared, where as many of each kind occur as in the string."""
    parts = [F.pow(_sum(F.slice(counts, at + 1, size)) / n, F.lit(2.0)) * chance for at, size, chance in repeats(alphabet)]
    return F.greatest(sum(parts, F.lit(0.0)) * len(alphabet) - 1, F.lit(0.0))


def _ratio(s: Column, n: Column, counts: Column, alphabet: str, even: Column) -> Column:
    """log10 of the likelihood of s as symbols drawn from `even` ones over that as an ordinary string of the style it fits best."""
    symbols, first, styles = ordinary(alphabet)
    dot = lambda x, weights: _sum(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b))

    def pairs(k: Column) -> Column:  # of unlike kinds: they can't overlap; of like kinds: their runs' lengths, each less one
        like = lambda p: n - F.length(F.regexp_replace(k, p[0] + "+", "_"))
        unlike = lambda p: (n - F.length(F.replace(k, F.lit(p), F.lit("")))) / 2
        return F.array(*[like(p) if p[0] == p[1] else unlike(p) for p in styles[0]])

    def begin(k: Column) -> Column:
        return sum((F.startswith(k, F.lit(kind)).cast("double") * x for kind, x in first.items()), F.lit(0.0))

    kinds = F.translate(s, alphabet, "".join(map(_kind, alphabet)))
    best = lambda x: F.greatest(*[dot(x, style.values()) for style in styles], F.lit(-math.inf))
    follow = _let(kinds, lambda k: begin(k) + _let(pairs(k), best))
    return (-n * F.log(even) - dot(counts, [symbols[c] for c in alphabet]) - follow) / math.log(10)


def battery(value: Column) -> Column:
    """Struct of a string: encoding (its place in ENCODINGS, -1: ordinary text), n, chi2, its p-value against an even
    draw, those of runs and serial correlation, all three joint_p, and evidence: -log10 of the p-value of ordinary text.

    Strings without both a digit and a letter are ordinary, as are those of under 20 symbols.
    """

    def tested(k: int, s: Column) -> Column:
        _, alphabet, _ = ENCODINGS[k]
        size = len(alphabet)

        def of(x: Column) -> Column:  # s, n, the halves as a string of 0 and 1, places in the alphabet, and counts of its symbols
            s, n, halves, place, counts = x["s"], x["n"], x["h"], x["r"], x["q"]
            chi2 = _sum(F.transform(counts, lambda c: c * c)) * size / n - n
            mean = _let(F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double"), lambda ones: 2 * ones * (n - ones) / n + 1)
            spread = lambda m: F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(1e-9)))
            runs = 2 * _normal(-F.abs(_let(mean, lambda m: (F.length(F.regexp_replace(halves, "0+|1+", "x")) - m) / spread(m))))
            pairs = lambda d: _sum(F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda a, b: a * b))
            squares = lambda d: F.greatest(_sum(F.transform(d, lambda a: a * a)), F.lit(1e-9))
            serial = _let(_let(_sum(place) / n, lambda m: F.transform(place, lambda y: y - m)), lambda d: pairs(d) / squares(d))
            serial_p = 2 * _normal(-F.abs((serial + 1 / n) * F.sqrt(n)))
            z = lambda c: _let(_extra(counts, n, alphabet), lambda x: (c - (size - 1 + n * x)) / F.sqrt(2 * (size - 1 + 2 * n * x)))
            # an even draw has the whole alphabet or, where that has two cases, one of them: three draws of which any may be it
            one_case = size - len(_LOWER)
            even = F.when(s.rlike("[a-z]") & s.rlike("[A-Z]"), F.lit(float(size))).otherwise(float(one_case)) if size > 36 else F.lit(float(size))
            draws = math.log10(3) if size > 36 else 0.0
            spare = lambda e: 2 / (9 * (e - 1))
            uneven = lambda c, e: (F.cbrt(((c + n) * e / size - n) / (e - 1)) - 1 + spare(e)) / F.sqrt(spare(e))  # noqa: E731  Wilson and Hilferty's normal for chi-squared
            better = lambda c, e: F.greatest(_evidence(z(c)), _ratio(s, n, counts, alphabet, e) - draws) - math.log10(2)
            sure = lambda p: -F.log(F.greatest(p, F.lit(1e-30)))
            joint = lambda x: -x + F.log(1 + x + x * x / 2)  # noqa: E731  the log of Fisher's of three tests, x half of his statistic
            less = lambda j: F.least((j - math.log(JOINT)) / math.log(10), F.lit(0.0))
            tests = F.struct(chi2.alias("c"), runs.alias("r"), serial_p.alias("p"), even.alias("e"))
            return _let(tests, lambda y: _let(_normal(-uneven(y["c"], y["e"])), lambda q: _let(joint(sure(q) + sure(y["r"]) + sure(y["p"])), lambda j: F.struct(
                F.lit(k).alias("encoding"), n.cast("int").alias("n"), y["c"].alias("chi2"), q.alias("chi2_p"), y["r"].alias("runs_p"), y["p"].alias("serial_p"),
                F.exp(j).alias("joint_p"), F.greatest(better(y["c"], y["e"]) + less(j), F.lit(0.0)).alias("evidence")))))

        half = F.translate(s, alphabet, "0" * (size // 2) + "1" * (size - size // 2))
        place = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
        counts = F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"))
        return _let(F.struct(s.alias("s"), F.length(s).cast("double").alias("n"), half.alias("h"), place.alias("r"), counts.alias("q")), of)

    body = F.regexp_replace(value, "=+$", "")
    plain = F.struct(F.lit(-1).alias("encoding"), F.length(body).alias("n"), F.lit(0.0).alias("chi2"), *[F.lit(1.0).alias(x) for x in ("chi2_p", "runs_p", "serial_p", "joint_p")], F.lit(0.0).alias("evidence"))
    out = F.when(~value.rlike("[0-9]") | ~value.rlike("[A-Za-z]") | (F.length(body) < 20), plain)
    for k, (name, _, pattern) in enumerate(ENCODINGS):
        out = out.when(value.rlike(pattern), tested(k, F.lower(body) if name == "hex" else body))
    return out.otherwise(plain)


def scan(text: Column) -> Column:
    """Struct of a text: base (spans (start, kind, stop) by start, then kind) and tried ((start, stop, encoding, size,
    evidence) of long strings that no base span holds whole; size is the class of length, by powers of two)."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    clean = F.when(F.instr(whole, _MARK) > 0, F.translate(whole, _MARK, "\x02")).otherwise(whole)
    return _let(clean, lambda t: _let(F.array_sort(F.concat(*[_base(t, k) for k in range(3)])), lambda b: _beside(t, b)))


def _beside(clean: Column, b: Column) -> Column:
    strings = F.filter(_matches(clean, _LONG), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    free = F.filter(strings, lambda m: ~F.exists(b, lambda s: (s["start"] <= m["start"]) & (m["stop"] <= s["stop"])))
    tried = F.transform(free, lambda m: _let(battery(m["value"]), lambda t: F.struct(
        m["start"].alias("start"), m["stop"].alias("stop"), t["encoding"].alias("encoding"),
        F.floor(F.log2(F.greatest(t["n"], F.lit(1)).cast("double"))).cast("int").alias("size"), t["evidence"].alias("evidence"))))
    return F.struct(b.alias("base"), F.filter(tried, lambda t: t["encoding"] >= 0).alias("tried"))


def thresholds(scanned: DataFrame, level: float = LEVEL) -> list[tuple[int, int, float]]:
    """(encoding, size, least evidence) of each class with discoveries; one row a class comes to the driver."""
    tried = scanned.select(F.explode("found.tried").alias("t")).select("t.*")
    bins = tried.groupBy("encoding", "size", F.floor(F.col("evidence") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("encoding", "size")
    over = F.sum("n").over(each.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = bins.withColumn("over", over).withColumn("all", F.sum("n").over(each))
    good = ranked.where((F.col("bin") > 0) & (-F.col("bin") / BINS <= F.log10(level * F.col("over") / F.col("all"))))
    return [(r["encoding"], r["size"], r["bin"] / BINS) for r in good.groupBy("encoding", "size").agg(F.min("bin").alias("bin")).collect()]


def _all_spans(found: Column, least: list[tuple[int, int, float]]) -> Column:
    def held(t: Column) -> Column:
        out = F.lit(False)
        for encoding, size, bar in least:
            out = out | ((t["encoding"] == encoding) & (t["size"] == size) & (t["evidence"] >= bar))
        return out

    more = F.transform(F.filter(found["tried"], held), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    return F.array_sort(F.concat(found["base"], more))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, stop) in code points, by start, then kind; kind is a place in
    KINDS, and spans has base and the strings found random.

    Null and empty texts have no spans; repeated rows are rows; an empty table gives no rows. Columns other than
    doc_id and text are not read. What pass one finds is written to the shared folder: texts are read once.
    """
    scanned = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), scan(F.col("text")).alias("found")), "secrets")
    least = thresholds(scanned, level)
    return scanned.select("doc_id", F.col("found.base").alias("base"), _all_spans(F.col("found"), least).alias("spans"))


def redacted(docs: DataFrame, level: float = LEVEL, mark: str = "[redacted]") -> DataFrame:
    """docs with every secret in text replaced by `mark` (spans that overlap by one); n_chars, if there, is the new
    length where a text changed. All rows and columns stay, whatever their names; null and empty texts stay as they
    are. The thresholds need the long strings of all texts, for which only texts that have any are scanned before the
    pass that replaces.
    """
    text = F.col("text").cast("string")
    found = scan(text)
    some = F.when(text.rlike(_LONG), found["tried"])
    least = thresholds(docs.select(F.struct(some.alias("tried")).alias("found")), level)
    state = "struct<out:string,at:bigint>"

    def replace(text: Column, spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
            return F.struct(new.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

        first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")).cast(state)
        return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    changed = _let(found, lambda f: _let(_all_spans(f, least), lambda s: F.when(F.size(s) > 0, replace(text, s))))
    names = docs.columns
    (new,) = unused(docs, "new")
    out = docs.withColumn(new, changed)
    values = {"text": F.coalesce(new, "text")}
    if "n_chars" in names:
        values["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in names])


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
