"""The corpus pipeline on empty tables, null and repeated rows, and clashing columns."""

import brute

import corpus_pipeline
from fxledger.llm.shipping import ship

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    """The result of every stage, each one's input being the one before."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(ship(spark), docs, SF).cache()
        out.append((name, docs))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def bad(text):
    n, _, _, _, repeat = brute.quality(text)
    return n < 20 or 100 * repeat > 30 * n


def test_empty_table_stays_empty(spark, nothing):
    for name, out in through(spark, nothing):
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == nothing.columns


def test_null_repeated_and_clashing(spark, repeated):
    given = rows(repeated)
    stages = dict(through(spark, repeated))
    kept = rows(stages["quality_rules"])
    assert set(kept) <= set(given) and not any(bad(t) for _, t in kept)
    assert all(kept.count(r) == given.count(r) for r in set(kept))  # repeated rows stay together
    assert not any(t is None for _, t in kept)

    single = rows(stages["near_duplicates"])
    roots = brute.components([r for r in set(kept) if r[0] is not None])
    assert {i for i, _ in single} == {i for i, (_, root) in roots.items() if i == root}
    assert all(single.count(r) == kept.count(r) for r in set(single))

    for name in ("quality_rules", "near_duplicates", "substring_dedup", "decontamination"):
        assert stages[name].columns == repeated.columns
        first = {r["doc_id"]: r for r in stages[name].collect()}
        assert all(r["lang"] == "en" and r["key"] == "k" and r["score"] == 0.5 for r in first.values())
        assert all(r["n_chars"] == len(r["text"]) for r in first.values())
    assert len(rows(stages["decontamination"])) == len(single)
    pieces = stages["packing"].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in single}
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0


def test_null_ids_are_kept(spark):
    from conftest import SCHEMA, words
    import random

    rng = random.Random(3)
    texts = [" ".join(words(rng, 60)) for _ in range(4)]
    given = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (9, texts[3]), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", -1 if t is None else len(t), 7, "o", "d", "k", "h", "c", "s",
                                   "z", "f", 0.5, "i", "l") for i, t in given], SCHEMA)
    stages = dict(through(spark, docs))
    assert sorted(rows(stages["decontamination"]), key=repr) == sorted(given[:4], key=repr)
