"""Fingerprints against sets of windows, and the neighbour of every row."""

import hashlib
import random

import numpy as np
from conftest import frame
from pyspark.sql import functions as F

from fxledger.llm import fingerprints as P, textops as tx
from fxledger.llm.queries import op12_scaled_fingerprints
from fxledger.llm.shipping import ship

SF = "/root/testdata/sf0.001"


def windows(raw):
    if not raw:
        return set()
    return {raw[i:i + P.WIDTH] for i in range(max(1, len(raw) - P.WIDTH + 1))}


def code(window):
    buf = np.frombuffer(window, np.uint8)
    return int(tx.Prefix(buf).of(np.array([0]), np.array([len(buf)]))[0]) >> 64 - P.BITS


def sketch(raw):
    h = sorted({code(w) for w in windows(raw)})
    low = [x for x in h if x < P.LIMIT]
    return low if len(low) >= P.LEAST else h[:P.LEAST]


def text_of(h):
    return "".join(f"{x:012x}" for x in h)


def brute(rows):
    """doc_id, n_chars, sha, fingerprint, edited fingerprint for rows in order."""
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(sketch(t.encode())),
                    text_of(sketch(e.encode()))))
    return out


def ordered(spark, df):
    got = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", "t", F.xxhash64("t").alias("h")).collect()
    return [(r["doc_id"], r["t"]) for r in
            sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]


def check(spark, df):
    rows = ordered(spark, df)
    got = P.next_text(df).collect()
    key = repr
    assert sorted(map(key, brute(rows))) == sorted(
        key((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]))
        for r in got)
    return got


def test_matches_brute_force(spark, docs):
    got = check(spark, docs)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == "" and by[0]["near_next"] == 1.0  # null, then empty
    assert by[4]["near_next"] == 1.0 and by[6]["near_next"] == 1.0  # copies follow
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_repeated_rows_and_null_ids(spark, repeated):
    check(spark, repeated.limit(60).union(repeated.where("doc_id is null")))


def test_empty_table_and_single_row(spark, nothing):
    assert P.next_text(nothing).count() == 0
    r, = P.next_text(frame(spark, [(5, "abcdé")])).collect()
    assert r["edited_sha256"] == hashlib.sha256("abcab".encode()).hexdigest() and r["near_next"] == 1.0


def test_likeness_is_near_the_containment():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    for n, share in ((40, 0.5), (400, 0.2), (4000, 0.05), (4000, 1.0)):
        large = " ".join(rng.choice(vocabulary) for _ in range(n))
        small = large[:int(len(large) * share)] + " ".join(rng.choice(vocabulary) for _ in range(n // 4))
        a, b = P.sketches([large.encode(), small.encode()])
        x, y = windows(large.encode()), windows(small.encode())
        true = len(x & y) / min(len(x), len(y))
        assert abs(P.likeness(a, b) - true) < 4 * (true * (1 - true) / min(len(a), len(b))) ** 0.5 + 0.02


def test_sketches_merge():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("lorem ipsum dolor sit amet etc quod erat".split()) + str(rng.randint(0, 999))
                      for _ in range(n)) for n in (2, 3, 30, 900)]
    for s in texts:
        for t in texts:
            a, b = P.sketches([s.encode(), t.encode()])
            h = sorted({code(w) for w in windows(s.encode()) | windows(t.encode())})
            low = [x for x in h if x < P.LIMIT]
            assert P.merge(a, b).tolist() == (low if len(low) >= P.LEAST else h[:P.LEAST])
            assert P.from_text(P.to_text(a)).tolist() == a.tolist()


def test_fingerprint_of_rows(spark, docs):
    got = {r["doc"]["doc_id"]: r["out"]["fingerprint"] for r in P.fingerprint(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got == {i: text_of(sketch(t.encode())) for i, t in texts.items()}


def test_query_matches_brute_force(spark):
    df = ship(spark).read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_scaled_fingerprints(spark, SF).collect()}
    want = brute(ordered(spark, df))
    assert len(got) == len(want)
    for d, n, sha, a, b in want:
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, a, b)
