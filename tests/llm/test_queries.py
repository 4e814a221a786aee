"""The registered queries of the operators, on a driver table."""

import os

import brute
import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from fxledger.llm import queries as Q

SF_DIR = os.environ.get("FXLEDGER_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{k}" for k in (*range(1, 14),)}
    assert set(Q.queries()) | {"pipeline"} <= names
    assert set(Q.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, Q.queries()[name], Q.oracle_sql()[name], SF_DIR) > 0


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_op6_matches_brute_force(spark):
    want = brute.components(documents(spark))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in Q.op6_jaccard_rtree(spark, SF_DIR).collect()}
    assert got == want


def test_op10_matches_brute_force(spark):
    want = brute.suffix(documents(spark))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in Q.op10_suffix_dedup(spark, SF_DIR).collect()}
    assert got == want


def test_pipeline_matches_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kind = docs.schema
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination",
                            "packing"]

    def rows(df):
        return sorted((r["doc_id"], r["text"]) for r in df.collect())

    kept = stages["quality_rules"](spark, docs, SF_DIR).cache()
    good = {r["doc_id"] for r in Q.op5_quality_rules(spark, SF_DIR).where("kept").collect()}
    assert kept.schema.names == kind.names and rows(kept) == [r for r in rows(docs) if r[0] in good]

    single = stages["near_duplicates"](spark, kept, SF_DIR).cache()
    roots = brute.components(rows(kept))
    assert rows(single) == [r for r in rows(kept) if roots[r[0]][1] == r[0]]

    cut = stages["substring_dedup"](spark, single, SF_DIR).cache()
    want = brute.substring(rows(single))
    assert {i: brute.sha(b" ".join(brute.WORD.findall(brute.raw(t)))) for i, t in rows(cut)} == {
        i: v[2] for i, v in want.items()}

    clean = stages["decontamination"](spark, cut, SF_DIR).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = brute.contaminated(rows(cut), items)
    after = dict(rows(clean))
    for i, t in rows(cut):
        if hit[i][1]:
            assert len(brute.PLAIN.findall(brute.lower(brute.raw(after[i])))) == hit[i][0] - hit[i][1]
        else:
            assert after[i] == t

    pieces = stages["packing"](spark, clean, SF_DIR).collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in pieces)
