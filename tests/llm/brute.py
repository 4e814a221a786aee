"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def raw(text):
    return (text or "").encode()


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def quality(text):
    b = raw(text)
    w = WORD.findall(b)
    g = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(g)
    rep = {p for i, x in enumerate(g) if n[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in b.split(b"\n") if WORD.search(x)]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", b)),
            len(lines) - len(set(lines)), len(rep))


def substring(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(raw(t))
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone[k:k + window] = [True] * window
            seen.add(x)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    return out


def suffix(rows, window=400):
    n = Counter()
    for _, t in rows:
        b = raw(t)
        n.update(b[k:k + window] for k in range(len(b) - window + 1))
    out = {}
    for i, t in rows:
        b = raw(t)
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if n[b[k:k + window]] > 1:
                gone[k:k + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def shingles(text):
    w = WORD.findall(lower(raw(text)))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(rows):
    s = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i)) for i in ids}


def contaminated(rows, items):
    phrases = {}
    for item, t in items:
        w = PLAIN.findall(lower(raw(t)))
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[k:k + 10]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = {}
    for i, t in rows:
        w = PLAIN.findall(lower(raw(t)))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                x = tuple(w[k:k + n])
                if x in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[x]
        names = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit))
    return out
