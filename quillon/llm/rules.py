"""Rule bitmask ledger.

measure() reads each text once and leaves a ledger: measurements and one failure bit for every rule. Policies are
versioned sets of rules; applying one, comparing two or dropping a rule only reads the bits, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import ship

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: str  # SQL over the measurements


#: The ledger's rules; a bit never changes its meaning, new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "n_letters >= 50 and 2 * n_upper > n_letters"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version; each has the rules whose failure drops a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


def measures(text: str | None) -> tuple[int, ...]:
    """All measurements of one text, in the order of the ledger; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8")
    parts = data.split()
    n = len(parts)
    # code points: all bytes but those that continue one
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    points = len(text)
    word_chars = points - int(counts[9:14].sum()) - int(counts[32])
    symbols = int(sum(counts[ord(c)] for c in "#*$%&|<>"))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in parts], np.int64)
        size = len(number)
        key = ids[:-2] * size + ids[1:-1]
        if size > 2_000_000:  # three numbers may not fit 63 bits: number the pairs first
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        hit[:-2] |= again
        hit[1:-1] |= again
        hit[2:] |= again
        repeat = int(hit.sum())
    upper = int(counts[65:91].sum())
    return n, word_chars, symbols, dup, repeat, lines, upper, upper + int(counts[97:123].sum())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measures(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(_MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *_MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measurements and `failures`, a bit for each rule that fails.

    Null, empty and blank texts have no words and fail few_words; repeated rows are rows; an empty table gives an
    empty ledger. Columns other than doc_id and text are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_run, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return out.withColumn("failures", failures)


def apply(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (so come back without it), and that the
    policy drops in all. Failure bits are counted first, a row for each of at most 2**rules patterns."""
    of = mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    counted = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(of)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in RULES if r.name in names]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    rows = counted.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("dropped"),
    )


def digest(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    base = F.col("failures").bitwiseAND(F.lit(mask("base"))) != 0
    return apply(ledger, policy).select("doc_id", *_MEASURES[:5], base.alias("base_failed"), "kept")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as n_letters from d),
g as (select doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) as k
    from w, unnest(range(1, cast(greatest(len(ws) - 1, 1) as bigint))) as u(i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from g) where n > 1),
h as (select doc_id, count(distinct i + j) as n_repeat_words from r, (values (0), (1), (2)) as o(j) group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    len(ls) as n_lines, n_upper, n_letters from w left join h on w.doc_id = h.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or 4 * n_symbols > n_words or (n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines)
        or (n_words > 0 and word_chars < 2 * n_words) or word_chars > 20 * n_words or (n_letters >= 50 and 2 * n_upper > n_letters)) as kept
from f
"""
