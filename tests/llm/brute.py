"""Plain versions of the operators' results, straight from their definitions."""
from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, k in enumerate(windows):
        if n[k] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def substrings(docs, k):
    """(doc_id, n_words, n_removed, sha256): words of windows that a smaller id has go; no id is the largest."""
    order = lambda i: (i is None, i or 0)
    split = [(i, WORD.findall(x or "")) for i, x in docs]
    owner = {}
    for i, w in split:
        for p in range(len(w) - k + 1):
            key = tuple(w[p:p + k])
            owner[key] = min(owner.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if owner[tuple(w[p:p + k])] < order(i):
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def suffixes(docs, k):
    """(doc_id, n_bytes, n_removed, n_spans, sha256, n_later); no id is the largest."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    data = [(i, (x or "").encode()) for i, x in docs]
    n, owner = Counter(b[p:p + k] for _, b in data for p in range(len(b) - k + 1)), {}
    for i, b in data:
        for p in range(len(b) - k + 1):
            owner[b[p:p + k]] = min(owner.get(b[p:p + k], order(i)), order(i))
    out = []
    for i, b in data:
        gone, later = bytearray(len(b)), bytearray(len(b))
        for p in range(len(b) - k + 1):
            if n[b[p:p + k]] > 1:
                gone[p:p + k] = b"\1" * k
            if owner[b[p:p + k]] < order(i):
                later[p:p + k] = b"\1" * k
        out.append((i, len(b), sum(gone), sum(g for g, _ in itertools.groupby(gone)), sha(bytes(x for x, g in zip(b, gone) if not g)), sum(later)))
    return out


def fingerprint(text) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash(docs, bits=3):
    """{doc_id: (fingerprint, component)}."""
    by = defaultdict(list)
    for i, x in docs:
        by[fingerprint(x)].append(i)
    parent = {f: f for f in by}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(by, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for f, ids in by.items():
        groups[find(f)] += ids
    return {i: (f"{f:016x}", min(groups[find(f)])) for f, ids in by.items() for i in ids}


def winnowing(docs, items, size=13):
    """{doc_id: (n_words, n_hit, n_items, sha256 of the items)}."""
    def words(x):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (x or "").encode()))

    windows = defaultdict(set)
    for i, x in items:
        w = words(x)
        for a in range(max(len(w) - size + 1, 1) if w else 0):
            windows[tuple(w[a:a + size])].add(str(i))
    out = {}
    for i, x in docs:
        w, hit, found = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a:a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """Base spans."""
    def right(kind, t):
        d = re.sub("[^0-9]", "", t)
        if kind == "ip":
            return all(int(x) <= 255 for x in t.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    found = [(*m.span(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))
