"""Every operator against plain Python on awkward rows, and on empty tables,
repeated rows, null ids and clashing columns."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from fxledger.llm import (components, files, fm_index, jaccard_join, license_scan, packing, quality,
                          rans, repeats, substring_dedup, suffix_dedup, tokens, toxicity, warc)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# quality rules

Q = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_measures(docs, rows):
    got = by_id(quality.apply_policy(quality.ledger(docs)), *Q, "base_failed", "kept")
    for i, t in rows:
        want = brute.quality(t)
        assert got[i][:5] == want, i
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i][5] == failed and not (failed and got[i][6]), i


def test_quality_policies_and_ablation(docs, repeated, nothing):
    led = quality.ledger(docs).cache()
    kept = quality.apply_policy(led).where("kept").count()
    loose = quality.apply_policy(led, quality.BASE).where("kept").count()
    assert loose >= kept
    table = {r["rule"]: r for r in quality.ablation(led).collect()}
    assert set(table) == set(quality.DEFAULT.names)
    for name in quality.DEFAULT.names:
        others = quality.Policy("x", tuple(n for n in quality.DEFAULT.names if n != name))
        without = led.where(F.col("fail_bits").bitwiseAND(F.lit(others.mask)) == 0).count()
        assert without - led.where("fail_bits = 0").count() == table[name]["only_this_rule"]
    assert quality.ledger(repeated).count() == repeated.count()
    assert quality.ledger(nothing).count() == 0
    stays = quality.keep(docs)
    assert stays.columns == docs.columns and stays.count() == kept


# licences

def test_license_scan_equals_unpruned(docs, rows, repeated, nothing):
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(docs)).collect()}
    named = {i: r["licenses"] for i, r in got.items() if r["n_matches"]}
    texts = dict(rows)
    assert {named[i] for i in named} == {"mit", "apache-2.0"}
    assert all("icense" in texts[i] for i in named)
    assert got[0]["n_matches"] == 0 and got[0]["license"] is None
    assert license_scan.scan(repeated).count() == repeated.count()
    assert license_scan.scan(nothing).count() == 0


def test_license_keywords_never_lose_a_match():
    rng = random.Random(2)
    chosen = license_scan.keywords(license_scan.TEMPLATES)
    for text in license_scan.TEMPLATES.values():
        grams = set(license_scan.bigrams(text))
        for _ in range(200):
            w = [x for x in license_scan.normalise(text) if rng.random() > 0.12]
            mine = set(license_scan.bigrams(" ".join(w)))
            if mine and 2 * len(mine & grams) >= 0.8 * (len(mine) + len(grams)):
                assert any(k in " ".join(w) for k in chosen)


# passages

def test_substring_dedup(docs, rows):
    got = by_id(substring_dedup.digest(substring_dedup.spans(docs)),
                "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_substring_dedup_hot_anchors(docs, rows, hot):
    v = repeats.verdicts(docs, substring_dedup.UNIT, substring_dedup.match, True, hot=hot)
    found = (repeats.squeezed(docs).join(v.withColumnRenamed("key", "vkey"), F.col("key") == F.col("vkey"), "left")
             .select(F.col("key").alias("doc_id"), "z", "found"))
    got = by_id(substring_dedup.digest(found), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(rows)


def test_substring_dedup_odd_tables(docs, repeated, nothing):
    assert substring_dedup.digest(substring_dedup.spans(nothing)).count() == 0
    once = by_id(substring_dedup.digest(substring_dedup.spans(docs)), "n_removed")
    twice = substring_dedup.digest(substring_dedup.spans(repeated)).collect()
    assert len(twice) == repeated.count()  # rows that repeat an id are one document
    assert all(r["n_removed"] == once[r["doc_id"]][0] for r in twice if r["doc_id"] is not None)
    clean = substring_dedup.clean(docs)
    assert clean.schema.names == docs.schema.names and clean.count() == docs.count()


def test_automaton_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(4)]
        a = substring_dedup.Automaton()
        for t in texts:
            a.add(t)
        query = [rng.randrange(3) for _ in range(20)]
        parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([n for n in range(e + 2) if n == 0 or tuple(query[e + 1 - n:e + 1]) in parts])
                for e in range(len(query))]
        assert list(a.statistics(query)) == want


def test_suffix_dedup(docs, rows):
    small = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    got = by_id(suffix_dedup.digest(suffix_dedup.spans(few)),
                "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(small)


def test_suffix_dedup_hot_anchors(docs, rows):
    small = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    found = repeats.spans(few, suffix_dedup.UNIT, suffix_dedup.match, False, hot=1)
    got = by_id(suffix_dedup.digest(found), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(small)


def test_suffix_dedup_odd_tables(docs, rows, nothing):
    assert suffix_dedup.digest(suffix_dedup.spans(nothing)).count() == 0
    got = by_id(suffix_dedup.digest(suffix_dedup.spans(docs)), "n_bytes", "n_removed")
    texts = {i: brute.raw(t) for i, t in rows}
    assert all(got[i][0] == len(b) for i, b in texts.items())
    long = [i for i, b in texts.items() if len(b) > 50_000]
    assert len(long) == 2 and all(got[i][1] >= min(len(texts[j]) for j in long) - 400 for i in long)


def test_induced_sorting(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        monkeypatch.setattr(suffix_dedup, "SMALL", rng.choice([2, 3, 6]))
        t = np.array([rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 60))] + [0])
        got = suffix_dedup.sorted_suffixes(t, rng.choice([16, 1 << 20])).tolist()
        assert got == sorted(range(len(t)), key=lambda i: t[i:].tolist())


# benchmark passages

def items(rows):
    texts = dict(rows)
    return [(1, " ".join(texts[6].split()[20:45])), (2, "one"), (3, "Nothing like that stands there"),
            (4, None), (5, "!!"), (6, " ".join(texts[11].split()[100:109])), (7, texts[30]),
            (7, texts[30]), (None, " ".join(texts[13].split()[:12]))]


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_fm_index(spark, docs, rows, block_words):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = by_id(fm_index.digest(fm_index.find(docs, bench, block_words=block_words)),
                "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contaminated(rows, items(rows))


def test_fm_index_holds_one_block_of_phrases(spark, docs, rows):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    assert len(list(fm_index.blocks(bench, 60))) > 2
    found = fm_index.find(docs, bench, block_words=60)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_fm_index_odd_tables(spark, docs, nothing, repeated):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.find(nothing, bench).count() == 0
    assert fm_index.digest(fm_index.find(docs, none)).where("contaminated").count() == 0
    assert fm_index.digest(fm_index.find(repeated, bench)).where("n_hit > 0").count() == 2
    clean = fm_index.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text = 'one'").count() == 0


# near duplicates

@pytest.mark.parametrize("block", [2000, 4])
def test_near_duplicates(docs, rows, block):
    got = by_id(jaccard_join.near_duplicates(docs, block=block), "n_shingles", "component_id")
    assert got == brute.components(rows)


def test_near_duplicates_odd_tables(docs, repeated, nothing):
    assert jaccard_join.near_duplicates(nothing).count() == 0
    once = by_id(jaccard_join.near_duplicates(docs), "component_id")
    twice = jaccard_join.near_duplicates(repeated).collect()
    assert len(twice) == repeated.count()
    assert all(r["component_id"] == once[r["doc_id"]][0] for r in twice if r["doc_id"] is not None)
    stays = jaccard_join.representatives(docs)
    assert stays.columns == docs.columns
    assert {r["doc_id"] for r in stays.collect()} == {c for (c,) in once.values()}


def test_a_shingle_in_a_third_of_the_rows_is_led_by_aggregation(spark, docs):
    text = " ".join(f"same{i}" for i in range(20))
    rows = [(i, f"{text} x{i}") for i in range(300)]
    rows += [(1000 + i, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(600)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    heads = jaccard_join._heads(df, 2)
    whole = sorted(map(tuple, jaccard_join._led(heads).collect()))
    few = jaccard_join._led(heads, held_pairs=200)
    assert sorted(map(tuple, few.collect())) == whole and len(whole) > 250


def test_frequent_shingles_are_counted_over_all_documents(spark):
    from fxledger.llm.shipping import ship

    ids = ship(spark).range(12_000).select(F.col("id").alias("doc_id"))
    late = ids.orderBy(F.xxhash64("doc_id").desc()).limit(13)  # no sample by hashed ids has them
    once = F.concat_ws(" ", *[F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in "vwxyz"])
    docs = ids.join(F.broadcast(late.withColumn("hot", F.lit("a b c d e"))), "doc_id", "left").select(
        "doc_id", F.coalesce("hot", once).alias("text")).cache()
    often = jaccard_join.frequent(docs)
    hot, = jaccard_join.shingles(pa.array(["a b c d e"]))
    assert often[jaccard_join.cells(hot)].all() and often.sum() == 1
    assert not jaccard_join.frequent(docs.limit(0)).any()


def test_rare_shingles_come_first_in_heads(spark, docs):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"d{i}w{k}" for k in range(200))) for i in range(2)]
    rows += [(2, "a b c d e f g"), (3, "a b c d e f g h")]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    led = jaccard_join._led(jaccard_join._heads(df, 2)).select("s").distinct().collect()
    want = {jaccard_join.set_id(x) for x in jaccard_join.shingles(pa.array([t for _, t in rows[2:]]))}
    assert {r["s"] for r in led} <= want  # the first two share 36 shingles, but have 200 rarer ones each
    got = by_id(jaccard_join.near_duplicates(df), "n_shingles", "component_id")
    assert got == brute.components(rows)


@pytest.mark.parametrize("others", [2, 70])
def test_large_sets_without_a_partner_are_sifted_out(spark, docs, others):
    near = [f"n{i}" for i in range(9000)]
    rows = [(k, " ".join(f"{k}a{i}" for i in range(9000))) for k in range(others)]
    rows += [(1000, " ".join(near)), (1001, " ".join(["edit", *near[1:]])), (1002, "short")]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join._sets(df).where("s is not null").cache()
    block = sets.select(F.lit(1).cast("long").alias("block"), F.col("key").alias("rep"), "s",
                        F.lit(None).cast("long").alias("label"))
    kept = jaccard_join._sift(block, sets.select(F.col("s").alias("set"), "vec")).collect()
    assert sorted(r["rep"] for r in kept) == [1000, 1001]


def test_only_texts_with_a_possible_partner_move(docs, rows, monkeypatch):
    moved, squeezed = [], jaccard_join.repeats.squeezed

    def spy(some):
        moved.append({r["doc_id"] for r in some.select("doc_id").collect()})
        return squeezed(some)

    monkeypatch.setattr(jaccard_join.repeats, "squeezed", spy)
    got = by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id")
    assert got == brute.components(rows)
    assert any(moved) and all(len(m) < len(rows) / 2 for m in moved)


def test_a_large_family_meets_the_others_of_its_leader_once(spark, docs, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        rows.append(" ".join(w))
    for i in range(30):
        at = rng.randrange(50)
        rows.append(" ".join(base[at:at + 8] + [f"u{i}"] * rng.randint(0, 2)))
    rows = list(enumerate(rows))
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    sifted, sift = [], jaccard_join._sift

    def spy(blocks, vectors):
        sifted.append(blocks.count())
        return sift(blocks, vectors)

    monkeypatch.setattr(jaccard_join, "_sift", spy)
    got = by_id(jaccard_join.near_duplicates(df, block=20), "n_shingles", "component_id")
    assert got == brute.components(rows)
    assert len(sifted) == 3 and sifted[2] < 3 * sifted[1]


def test_across_lets_different_components_meet(spark):
    rng = random.Random(13)
    for shape in ([30, 1, 1, 2], [7] * 6, [1] * 25, [40, 30]):
        label = [i for i, n in enumerate(shape) for _ in range(n)]
        rows = [(5, rng.getrandbits(40), 100 + i, x) for i, x in enumerate(label)]
        df = spark.createDataFrame(rows, "leader long, s long, rep long, label long")
        blocks = {}
        for r in jaccard_join._across(df, 4).collect():
            blocks.setdefault(r["block"], set()).add((r["rep"], r["label"]))
        met = {(a, b) for m in blocks.values() for a, x in m for b, y in m if x != y}
        assert met == {(a, b) for _, _, a, x in rows for _, _, b, y in rows if x != y}


def test_rtree_prunes_nothing_linked():
    rng = random.Random(6)
    sets = []
    for _ in range(40):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 5)):
            sets.append(np.unique(np.array([x if rng.random() > 0.1 else rng.getrandbits(64)
                                            for x in base], dtype=np.uint64)))
    out = jaccard_join.links(sets, [None] * len(sets))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in out:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root(n) == c for n, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


# token ids

def test_pieces_equal_whole_encoding(rows, vocabulary):
    e = tokens.Encoder(vocabulary)
    odd = ["", " ", "  a", "a  b", "a \n b", "it's I'll x's", "x\u0085y  z", "\x1c a", "²³ ½", "a.\nB c,\n\nd",
           "a,b.c; (d) e!?\n", "_x_ __ é́ ñandú.", "q.\n", "\nq", "x.\n\ty z"]
    for text in odd + [t[:3000] for _, t in rows if t]:
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e(text), "<u4").tolist() == want, text[:80]


def ids_of(rows, vocabulary, end):
    t = tokens.Encoder(vocabulary).tokenizer
    return {i: t.encode(x or "", add_special_tokens=False).ids + [end] for i, x in rows}


def test_packing(docs, rows, vocabulary, repeated, nothing):
    got = packing.pack(docs, vocabulary).collect()
    want = ids_of(rows, vocabulary, 1)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at:at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    pad = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad < 0.03 * sum(map(len, want.values()))
    assert packing.pack(nothing, vocabulary).count() == 0
    whole = packing.pack(repeated, vocabulary).agg(F.sum("length")).first()[0]
    assert whole == 2 * sum(map(len, want.values())) + len(ids_of([(0, "lost id")], vocabulary, 1)[0]) + 1


def test_differencing_balances():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7, 40):
        sizes = rng.integers(1, 1000, 12 * k)
        parts = packing.difference(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) == k
        sums = [int(sizes[p].sum()) for p in parts]
        assert max(sums) - min(sums) <= 30
    parts = packing.windows(np.array([700] * 9), 1000)
    assert len(parts) == 9  # the window count rises until every window fits


def test_rans_files(spark, docs, rows, vocabulary, repeated, nothing):
    path = files.folder(spark, "rans-test")
    got = {r["doc_id"]: r for r in rans.read(rans.write(docs, path, vocabulary), path).collect()}
    at = 0
    for i, ids in sorted(ids_of(rows, vocabulary, 0).items()):
        r = got[i]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    empty = files.folder(spark, "rans-none")
    assert rans.read(rans.write(nothing, empty, vocabulary), empty).count() == 0
    twice = files.folder(spark, "rans-twice")
    r = rans.read(rans.write(repeated, twice, vocabulary), twice).collect()
    assert len(r) == repeated.count() and len({x["start"] for x in r}) == len(r)


def test_rans_many_token_files_in_one_read_partition(spark, vocabulary):
    from fxledger.llm.shipping import ship

    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in held}
    rows = [(i, " ".join(f"w{i * j}" for j in range(1 + i))) for i in range(200)]  # later files are larger
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
        path = files.folder(spark, "rans-many")
        got = sorted(rans.read(rans.write(docs, path, vocabulary), path).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    at = 0
    want = ids_of(rows, vocabulary, 0)
    assert [r["doc_id"] for r in got] == sorted(want)
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(want[r["doc_id"]]))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        at += r["n_tokens"]


def test_rans_blocks_and_damage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1023, 5000):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        counts = np.bincount(ids, minlength=50_257)
        table = rans.Table.from_bytes(rans.Table.of(counts).to_bytes())
        raw, _, lanes = rans.encode_block(ids, table, 64)
        assert (rans.decode_block(raw, n, lanes, table) == ids).all()
        if n > 100:
            assert len(raw) < 4 * n
            with pytest.raises(ValueError):
                bad = rans.decode_block(raw[:-4], n, lanes, table)
                assert bad is None


# WARC

def page_rows():
    big = "<html>" + "é" * 90 + "</html>"
    return [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (1, "http://a/x y", "short"),
            (2, "http://a/5", "short"), (4, "http://a/6", None), (6, "http://a/7", ""),
            (7, "http://a/8", "WARC/1.0\r\n\r\n" * 4000), (8, "http://a/\n9", "x" * 300_000)]


@pytest.mark.parametrize("split", [100, 4 << 20])
def test_warc(spark, split):
    pages = spark.createDataFrame([(*r, "x", "y") for r in page_rows()],
                                  "page_id long, url string, html string, digest string, payload string")
    manifest = warc.write(pages, files.folder(spark, "warc-test"))
    got = {r["page_id"]: r for r in warc.read(manifest, split_bytes=split).collect()}
    first = {}
    for i, _, t in sorted(page_rows()):
        b = brute.raw(t)
        keep = first.setdefault(b, i) if len(b) >= 100 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), brute.sha(b))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
        assert r["payload"] == (b if keep == i else None)


@pytest.mark.parametrize("split", [1000, 4 << 20])
def test_warc_long_urls(spark, split):
    rows = [(1, "data:text/plain," + "a" * 70_000, "z" * 200), (2, "http://a/" + "\u65e5" * 8000, "y" * 200),
            (3, "http://a/3", "z" * 200), (4, "http://a/4", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.write(pages, files.folder(spark, "warc-long")), split_bytes=split).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None)]
    assert {r["page_id"]: r["url"] for r in got}[1] == rows[0][1]


def test_warc_without_a_manifest(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body %d " % (i % 7) * 40) for i in range(200)],
                                  "page_id long, url string, html string")
    path = files.folder(spark, "warc-plain")
    manifest = warc.write(pages, path)
    with_it = sorted(map(repr, warc.read(manifest, split_bytes=5000).collect()))
    assert sorted(map(repr, warc.read_archives(spark, path, split_bytes=5000).collect())) == with_it


def test_warc_lost_records_fail(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in range(9)],
                                  "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages, files.folder(spark, "warc-lost"))
    row = manifest.collect()[0]
    with files.open_random(row["file"]) as f:
        data = bytearray(f.read())
    data[row["starts"][4] + 40] ^= 0xFF  # damage of one member
    path = tmp_path / "bad.warc.gz"
    path.write_bytes(bytes(data))
    for split in (100, 4 << 20):
        with pytest.raises(Exception, match="records instead of"):
            warc.read(manifest.withColumn("file", F.lit(str(path))), split_bytes=split).collect()
    with pytest.raises(Exception, match="a start for each record"):
        warc.read(manifest.withColumn("records", F.col("records") + 1)).collect()


def test_warc_odd_tables(spark):
    kind = "page_id long, url string, html string"
    none = warc.write(spark.createDataFrame([], kind), files.folder(spark, "warc-none"))
    assert warc.read(none).count() == 0
    twice = spark.createDataFrame([(1, "u", "z" * 200)] * 2 + [(None, "u", None)], kind)
    got = warc.read(warc.write(twice, files.folder(spark, "warc-twice"))).collect()
    assert sorted(str((r["page_id"], r["record_type"])) for r in got) == [
        "(1, 'response')", "(1, 'response')", "(None, 'response')"]


def test_warc_candidates_inside_a_member(tmp_path):
    inner = warc._member(warc.record(1, "u", b"inner", brute.sha(b"inner"), None), 6)
    data = inner * 3 + b"tail"
    outer = warc._member(warc.record(2, "u", data, brute.sha(data), None), 0)  # stored, not deflated
    path = tmp_path / "x.warc.gz"
    path.write_bytes(outer + inner)
    size = len(outer) + len(inner)
    whole = [warc.parse(r)[0] for r in warc.records_in(str(path), size, 0, size)]
    assert whole == [2, 1]


# toxicity

def toxic_rows(n=6000):
    rng = random.Random(9)
    plain = ["w%d" % i for i in range(300)]
    out = []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(5, 120))
        insult, group = rng.random() < 0.35, rng.random() < 0.35
        if insult:
            w[rng.randrange(len(w))] = "Mud,"
        if group:
            w[rng.randrange(len(w))] = "folk"
        if rng.random() < 0.15:
            w[rng.randrange(len(w))] = "vermin"
        toxic = int("vermin" in w or ("Mud," in w and "folk" in w))
        out.append((i, " ".join(w), toxic))
    return out


def test_toxicity_held_out(spark):
    from fxledger.llm.shipping import ship

    data = toxic_rows()
    docs = ship(spark).createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, ~toxicity.held_out())
    got = by_id(toxicity.score(docs, machine), "score")
    right = wrong = 0
    for i, _, y in data:
        assert 0 <= got[i][0] <= 1
        if zlib.crc32(str(i).encode()) % 5 == 0:
            right += (got[i][0] >= 0.5) == bool(y)
            wrong += (got[i][0] >= 0.5) != bool(y)
    assert right / (right + wrong) > 0.93


def either(n=5000):
    """Toxic if exactly one of two words is there: no weights of single words fit that."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        w = rng.choices(["w%d" % k for k in range(300)], k=rng.randint(5, 120))
        for mark in ("alpha", "beta"):
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = mark
        out.append((" ".join(w), int(("alpha" in w) != ("beta" in w))))
    return out


def test_interactions_that_no_weights_fit():
    data = either()
    ids, off = toxicity.terms(pa.array([t for t, _ in data]))
    label = np.array([y for _, y in data], float)
    cut = 4000
    right = {}
    for factors in (0, toxicity.FACTORS):
        m = toxicity.fit(ids[:off[cut]], off[:cut + 1], label[:cut], factors)
        z = toxicity.margin(m, ids[off[cut]:], off[cut:] - off[cut])
        right[factors] = float(((z >= 0) == label[cut:]).mean())
    assert right[0] < 0.6 and right[toxicity.FACTORS] > 0.85


def test_margin_equals_the_double_sum():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=toxicity.BUCKETS), rng.normal(size=(toxicity.BUCKETS, 4)),
                         rng.random(toxicity.BUCKETS) < 0.7)
    sets = [np.unique(rng.integers(0, toxicity.BUCKETS, k)) for k in (0, 1, 2, 17, 90)]
    got = toxicity.margin(m, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for x, z in zip(sets, got):
        x = [i for i in x if m.used[i]]
        pairs = sum(float(m.factor[a] @ m.factor[b]) for k, a in enumerate(x) for b in x[k + 1:])
        want = m.bias + sum(m.weight[i] for i in x) + pairs / max(1, len(x)) ** 0.5
        assert abs(z - want) < 1e-9


def test_repeated_documents_teach_once(spark, monkeypatch):
    from fxledger.llm.shipping import ship

    data = toxic_rows(400)
    docs = ship(spark).createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    a, b = (toxicity.train(d, labels, ~toxicity.held_out()) for d in (docs, docs.union(docs).union(docs)))
    assert a.bias == b.bias and (a.weight == b.weight).all()


def test_toxicity_odd_tables(spark, docs, nothing, repeated):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(docs, none, F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, machine).collect()} == {0.5}
    assert toxicity.score(nothing, machine).count() == 0
    assert toxicity.score(repeated, machine).count() == repeated.count()


def test_schema_has_clashing_columns():
    assert "out string" in SCHEMA and "key string" in SCHEMA
