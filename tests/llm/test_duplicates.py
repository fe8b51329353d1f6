"""MinHash near-duplicates and repeated passages against brute force; the pipeline."""

import collections
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import minhash, queries, suffix_dedup


def near(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [(d, s) for d, several in sets.items() for s in several if s]
    for i, (a, s) in enumerate(ids):
        for b, t in ids[:i]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, sets


def check_near(spark, rows):
    want, sets = near([r for r in rows if r[0] is not None])
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_near_duplicates(spark):
    random.seed(3)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 400))
    rows = []
    for g in range(12):
        base = [word() for _ in range(random.randint(3, 120))]
        for _ in range(random.randint(1, 7)):
            w = base.copy()
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = word()
            rows.append((len(rows) + 10, " ".join(w)))
    passage = " ".join(word() for _ in range(18))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(random.randint(2, 9)))) for i in range(120)]  # one bucket, many unlike texts
    rows += [(1, ""), (2, None), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (7, "A b c d e"), (8, "same words here now again"), (8, "same words here now again"), (None, "a b")]
    check_near(spark, rows)


def test_near_duplicates_of_long_texts_and_clashing_columns(spark):
    random.seed(12)
    long_ = [f"w{random.randint(0, 10**6)}" for _ in range(60_000)]
    near = [w if i % 60 else "changed" for i, w in enumerate(long_)]
    rows = [(3, " ".join(long_), 1, 2, 3), (2, " ".join(near), 1, 2, 3), (9, "x" * 500_000, 1, 2, 3), (4, " ".join(long_[:30_000]), 1, 2, 3), (7, "a " * 100_000, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, bands long, kept long")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {2: (2, True), 3: (2, False), 4: (4, True), 7: (7, True), 9: (9, True)}
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, 7, 9}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(4)
    for size in (40, 2000):
        shared, own = rng.integers(0, 1 << 63, 3 * size).astype(np.uint64), rng.integers(0, 1 << 63, (2, size // 2)).astype(np.uint64)
        a, b = (np.unique(np.concatenate((shared, own[i]))) for i in (0, 1))
        x, y = minhash.signatures([a, b])
        assert abs((x == y).mean() - len(shared) / (len(shared) + size)) < 0.17
        assert len(np.unique(minhash.signatures([a[:1]])[0] >> np.uint64(48))) == minhash.PLACES  # one element: a rank for each place


def passages(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                m[p : p + 100] = b"\1" * 100
            else:
                seen[b[p : p + 100]] = 1
        runs = sum(1 for i in range(len(m)) if m[i] and (not i or not m[i - 1]))
        out[d] = (len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


def check_passages(spark, rows):
    got = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.deduplicated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()}
    assert got == passages(rows)


def passage_rows():
    random.seed(5)
    base = ["".join(random.choice("ab é\x00") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(90):
        s = ""
        for _ in range(random.randint(0, 4)):
            b = random.choice(base)
            a = random.randint(0, 200)
            s += b[a : a + random.randint(50, 300)] + random.choice(["", "x", "yy"])
        rows.append((i * 3 - 20, s))
    copies = [(5000 + i, base[0] * 2) for i in range(30)]
    return rows + copies + [(1000, "a" * 1500), (1001, "ab" * 700), (1002, "a" * 99), (1003, None), (1004, "a" * 100), (None, base[1])]


def test_repeated_passages(spark):
    check_passages(spark, passage_rows())
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_passages_with_hot_anchors_and_small_pieces(spark, monkeypatch):
    for name, value in (("LEAST_HOT", 10), ("SEGMENT", 700), ("CHUNK", 300), ("TABLE", 50)):
        monkeypatch.setattr(suffix_dedup, name, value)
    check_passages(spark, passage_rows())


def test_maximal_repeats():
    random.seed(2)
    data = np.frombuffer("".join(random.choice("ab") for _ in range(120)).encode(), dtype=np.uint8)
    starts, least = np.arange(len(data)), 4
    order, common = suffix_dedup.suffix_array(data, starts, np.full(len(data), len(data)), 128)
    text = data.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    left = np.concatenate(([0], data[:-1]))[order].astype(np.int64)
    got = {(text[order[a] :][:n], tuple(sorted(order[a : b + 1].tolist()))) for a, b, n in suffix_dedup.maximal_intervals(common, left, least)}
    places = collections.defaultdict(list)
    for n in range(least, len(text)):
        for i in range(len(text) - n + 1):
            places[text[i : i + n]].append(i)
    want = set()
    for w, at in places.items():
        after, before = {text[i + len(w) : i + len(w) + 1] for i in at}, {text[i - 1 : i] if i else None for i in at}
        if len(at) > 1 and (len(after) > 1 or b"" in after) and (len(before) > 1 or None in before):
            want.add((w, tuple(at)))
    assert got == want


def test_pipeline(spark, tmp_path):
    random.seed(8)
    good = [" ".join(f"word{random.randint(0, 3000)}" for _ in range(60)) for _ in range(40)]
    item = "If Alice buys 12 apples for 3 dollars each in the market then how much money does Alice spend on the apples"
    texts = [*good, good[0], good[1] + " more", good[2] + " " + item, "Mail a@b.example " + " ".join(good[3].split()[::-1]), None, "short", "w " * 50]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (46, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(40)) - set() | {43} and "[EMAIL]" in rows[43]["text"] and rows[43]["n_chars"] == len(rows[43]["text"]) and rows[0]["pieces"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "pii", "sentencepieces"]


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    """Stages keep columns whose names they use themselves; an empty table gives no rows; without items or labels no document goes for them."""
    random.seed(5)
    texts = [" ".join(f"word{random.randint(0, 3000)}" for _ in range(60)) for _ in range(4)]
    rows = [(i, t, "en", "s", len(t), 1, 2, "p", 4.0) for i, t in enumerate([*texts, texts[0], texts[1]])] + [(None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item_id long, node long, pieces string, score double")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for part in "ab":
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{part}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == [*docs.columns, "pieces_2"] and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3]
    assert {(r["node"], r["pieces"], r["score"]) for r in out.collect()} == {(2, "p", 4.0)}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["op9_minhash", "op10_suffix_dedup"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(cursor.fetchall()) == sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())


def test_components_of_stars_need_no_round_and_narrow_tables_few_files(spark, monkeypatch, tmp_path):
    """A run over many shuffle partitions writes few files, and links that are stars are components as they are."""
    from veilspark.llm import common, graph

    written = []
    monkeypatch.setattr(graph, "stored", lambda df, label, **k: written.append(label) or common.stored(df, label, **k))
    stars = spark.createDataFrame([(1, 5), (9, 1), (1, 9), (2, 7), (3, 3)], "a long, b long")
    assert {tuple(r) for r in graph.components(stars).collect()} == {(5, 1), (9, 1), (1, 1), (7, 2), (2, 2)} and written == ["edges"]
    path = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 30), (21, 30)], "a long, b long")
    assert {tuple(r) for r in graph.components(path).collect()} == {(k, 0) for k in range(10)} | {(20, 20), (21, 20), (30, 20)} and len(written) > 2
    assert graph.components(stars.limit(0)).count() == 0

    held = {"spark.sql.shuffle.partitions": "128", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(5000).selectExpr("id % 997 AS x").groupBy("x").count()
        assert common.stored(rows, "rows", narrow=True).count() == 997 and len(common.stored(rows, "rows", narrow=True).inputFiles()) <= 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_spans_join_to_runs_and_membership_in_sorted_arrays():
    """What op10's tasks work out by arrays: runs of spans that overlap or touch, and which places are wanted."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, n = rng.integers(0, 60, size=(k := int(rng.integers(0, 9)))), rng.integers(1, 12, size=k)
        marks = {p for a, b in zip(x.tolist(), n.tolist(), strict=True) for p in range(a, a + b)}
        starts, stops = suffix_dedup._joined(x, n)
        assert starts.tolist() == sorted(p for p in marks if p - 1 not in marks) and stops.tolist() == sorted(p + 1 for p in marks if p + 1 not in marks)
        assert suffix_dedup._among(x, np.sort(n)).tolist() == np.isin(x, n).tolist()
