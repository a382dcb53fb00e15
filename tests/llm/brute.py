"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import xxhash


def ids_of(text, end):
    from tokenizers import Tokenizer

    from quillon.llm import bpe

    if not hasattr(ids_of, "tok"):
        ids_of.tok = Tokenizer.from_file(bpe.vocabulary())
    return ids_of.tok.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def tokens(rows):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = ids_of(text, 0)
        out.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def pieces(rows, capacity=1024):
    out = []
    for doc, text in rows:
        ids = ids_of(text, 2)
        to, at, k = len(ids) % capacity or capacity, 0, 0
        while at < len(ids):
            out.append((doc, k, at, to - at, crc(ids[at:to])))
            at, to, k = to, to + capacity, k + 1
    return sorted(out)


def fingerprint(text, words=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, most=3):
    """prints: [(doc, fp)] -> {doc: smallest doc reachable}."""
    fps = sorted({f for _, f in prints})
    at = {f: f for f in fps}

    def root(f):
        while at[f] != f:
            f = at[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                at[root(a)] = root(b)
    low = {}
    for doc, f in prints:
        low[root(f)] = min(doc, low.get(root(f), doc))
    return {doc: low[root(f)] for doc, f in prints}


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))):
        found += [(m.start(), k + 1, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    found.sort()
    base = ",".join(f[2] for f in found)
    n = [sum(f[1] == k for f in found) for k in range(3)]
    return *n, hashlib.sha256(base.encode()).hexdigest(), base


def contamination(text, items, n=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    doc = words(text)
    hit, which = set(), set()
    windows = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    for size in {len(w) for w in windows}:
        for i in range(len(doc) - size + 1):
            found = windows.get(tuple(doc[i : i + size]))
            if found:
                which |= found
                hit |= set(range(i, i + size))
    sha = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
    return len(doc), len(hit), len(which), sha, bool(hit) and 20 * len(hit) >= len(doc)


def repeats(rows, size=50):
    """rows: [(doc, text)] -> {doc: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    first, data = {}, {}
    for doc, text in rows:
        b = data[doc] = (text or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            first[w] = min(doc, first.get(w, doc))
    out = {}
    for doc, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < doc:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
