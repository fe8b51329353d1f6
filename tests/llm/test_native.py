"""Quality rules, sharding and license scan against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import license_scan, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t ", "a b c", "one two three four five six seven eight " * 4, "x\ny\nx\n \nx", "#tag *bold* $5 %", "Ünï cödé wörds " * 30, "w " * 5000, "line of words here\n" * 40, "a b c d e f g h i", "q w e r t y u i q w e r t y u i z"]
SCHEMA = "doc_id long, text string, kept string, words string, found string"


LABELS = "doc_id long, quality int, toxic int"


def frame(spark, texts):
    rows = [(i, t, "k", "w", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2] + [(None, "no id", None, None, None)], SCHEMA)


def repeated(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_statistics(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(frame(spark, TEXTS), labels).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = TEXTS[r["doc_id"]] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated(words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text[:40]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(frame(spark, []).limit(0), labels).count() == 0


def test_learned_rules(spark):
    good = [" ".join(f"word{i}{k}" for k in range(40)) for i in range(150)]
    bad = [" ".join(f"WORD{i}{k}!" for k in range(40)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(rows[i]["kept"] for i in range(150)) and not any(rows[i]["kept"] for i in range(150, 210))
    assert rows[200]["rule"] == 1 and "upper_rate" in rows[200]["rule_text"]
    kept = quality_rules.accepted(docs.withColumn("n_words", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "n_words"] and {r["doc_id"] for r in kept.collect()} == set(range(150))


def test_decision_list_against_plain_python(spark):
    """Each verdict is that of the first rule whose conditions the statistics meet, and held-out labels are judged like the others."""
    import random

    random.seed(4)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    kinds = [lambda: " ".join(word(random.randint(3, 7)) for _ in range(60)), lambda: " ".join(word(14) for _ in range(60)), lambda: " ".join(word(5) + random.choice(("#", "%", "$$", "")) for _ in range(60)), lambda: " ".join(word(5).upper() for _ in range(60))]
    texts = [(i, kinds[0 if i % 2 else 1 + i // 2 % 3]()) for i in range(480)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(480) if i % 4 < 2], LABELS)
    rows = quality_rules.judge(docs, labels).collect()
    stats = {r["doc_id"]: r for r in quality_rules.statistics(docs).collect()}
    rules = {r["rule"]: r["rule_text"] for r in rows if r["rule"]}
    assert len(rules) >= 2

    def fits(s, rule):
        names = {"mean_word": s["word_chars"] / max(s["n_words"], 1), "symbol_rate": s["n_symbols"] / max(s["n_words"], 1), "repeat_rate": s["n_repeat_words"] / max(s["n_words"], 1), "dup_line_rate": s["n_dup_lines"] / max(s["n_lines"], 1), "upper_rate": s["n_upper"] / max(s["word_chars"], 1)}
        parts = [c.split(" ") for c in rule.split(" and ")]
        return all(names[f] > float(t) if o == ">" else names[f] <= float(t) for f, o, t in parts)

    for r in rows:
        first = next((k for k in sorted(rules) if fits(stats[r["doc_id"]], rules[k])), None)
        assert (r["kept"], r["rule"] or None) == (first is None, first) if not r["base_failed"] else not r["kept"]
    unseen = [r for r in rows if r["doc_id"] % 4 >= 2]
    assert sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in unseen) > 0.97 * len(unseen)


def test_sharding(spark):
    texts = TEXTS + [f"text {i} " * (i % 50) for i in range(400)] + ["hot copy of a text"] * 300
    rows = sharding.shard(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 3
    load, places = Counter(), {}
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "no id"
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(8))
    assert max(load.values()) < 1.05 * sum(load.values()) / 8 + max(len((t or "").encode()) for t in texts)
    assert sharding.shard(frame(spark, []).limit(0)).count() == 0


def test_slot_map(spark, tmp_path):
    loads = [(i * 37) % 101 + 1 for i in range(500)]
    first = sharding.SlotMap.balanced(loads, 8)
    grown = first.rebalanced(loads, 9)
    moved = [u for u in range(500) if first.shards[u] != grown.shards[u]]
    assert grown.version == 2 and all(grown.shards[u] == 8 for u in moved) and len(moved) < 500 / 9 * 1.5
    shrunk = grown.rebalanced(loads, 7)
    totals = Counter()
    for u, s in enumerate(shrunk.shards):
        totals[s] += loads[u]
    assert set(totals) == set(range(7)) and max(totals.values()) < 1.1 * sum(loads) / 7
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_sharding_on_a_store(spark, tmp_path):
    """A second run starts from the stored map, and edits it as little as it can; a stored map routes records by itself."""
    store = f"file://{tmp_path}/store"
    docs = frame(spark, [f"text {i} " * (i % 50) for i in range(600)])
    hot = docs.union(spark.createDataFrame([(10_000 + i, "hot text " * 20, "k", "w", "f") for i in range(400)], SCHEMA))
    where = lambda df: {r["doc_id"]: r["shard"] for r in df.collect()}
    one = sharding.shard(docs, 4, 64, store)
    first = where(one)
    assert where(sharding.shard(docs, 4, 999, store)) == first and sharding.SlotMap.load(spark, store).version == 1
    grown = where(sharding.shard(docs, 5, 64, store))
    assert sharding.SlotMap.load(spark, store).version == 2 and 0 < sum(grown[k] != first[k] for k in first) < len(first) / 3
    assert all(grown[k] == 4 for k in first if grown[k] != first[k])
    skewed = sharding.shard(hot, 5, 64, store).collect()
    latest = sharding.SlotMap.load(spark, store)
    assert latest.version == 3 and max(latest.parts) > 1 and sum(latest.parts) == len(latest.shards)
    load = Counter()
    for r in skewed:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.3 * sum(load.values()) / 5
    routed = hot.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    unit = latest.unit(F.pmod("h", F.lit(64)).cast("int"), F.xxhash64("doc_id", "size", "crc"))
    assert where(routed.select("doc_id", latest.shard(unit).alias("shard"))) == {r["doc_id"]: r["shard"] for r in skewed}
    assert sharding.SlotMap.load(spark, store, 1).n_shards == 4


def test_sharding_of_one_row_repeated(spark):
    rows = sharding.shard(spark.range(3000).selectExpr("cast(7 as long) doc_id", "'same' text"), 8, 16).collect()
    shards = {r["shard"] for r in rows}
    assert len(shards) == 1  # equal records stay together, with a place each
    assert sorted(r["position"] for r in rows) == list(range(3000))


LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "This is under the MIT-license and under the MIT License", "CC BY NC cc-by-nc 4.0", "GNU General Public License, version 3 or any later version", "", None, "no words of that kind",
    "the license " * 300, "Copyright (c) 2020 Some One. All rights reserved.", "Apache License Version 2 apache license version 2", "Creative Commons Attribution-ShareAlike 3.0",
]


def test_license_scan(spark):
    rows = license_scan.scan(frame(spark, LICENSES)).collect()
    base = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for r in rows:
        if r["doc_id"] is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (LICENSES[r["doc_id"]] or "").translate(low))
        hits = [(i, k) for k, p in base.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in hits})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"].split(",") for r in rows}
    assert "gpl-3-or-later" in by[3] and "gpl" not in by[3] and by[4] == [""] and by[7] == ["license-mention"] and "cc-by-sa-3.0" in by[10]
    assert len(license_scan.signatures()) > 200 and license_scan.scan(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("operator", [lambda d, s: quality_rules.statistics(d), lambda d, s: license_scan.scan(d), lambda d, s: quality_rules.judge(d, s.createDataFrame([(0, 1, 0), (3, 0, 0)], LABELS)), lambda d, s: sharding.shard(d)])
def test_no_python(spark, operator):
    plan = operator(frame(spark, ["a"]), spark)._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|ArrowEval|BatchEvalPython|MapInPandas", plan)


def test_sentences_of_license_texts(spark):
    plain = lambda x: re.sub(r"\(\?:([^()|]*)[^()]*\)[?]?(?:\{0,6\})?", r"\1", x.replace("[", "").replace("]", "")).replace(" .* ", " as well as ").replace("?", "")
    texts = [plain(x[2]) for x in license_scan.SENTENCES if "(" not in x[2]]
    labels = [x[0] for x in license_scan.SENTENCES if "(" not in x[2]]
    rows = license_scan.scan(spark.createDataFrame([(i, f"so it says {t}, and more") for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) > 60
    for r in rows:
        assert labels[r["doc_id"]] in r["labels"].split(","), (texts[r["doc_id"]], r["labels"])
    long_ = "x " * 200_000 + "licensed under the zero clause bsd license " + "permission " * 20_000
    row = license_scan.scan(spark.createDataFrame([(1, long_)], "doc_id long, text string")).first()
    assert row["n_words"] == 220_007 and row["labels"] == "bsd-0-clause,license-statement"


def detections(text, rules):
    """All matches of all rules and what stays after suppression, in plain Python."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    found, parts = [], []
    for k, r in enumerate(rules):
        for i, w in enumerate(words):
            if w != r.anchor:
                continue
            left, right = " ".join(words[:i]) + " ", " " + " ".join(words[i + 1 :])
            a = re.search(rf"(?:^| ){r.before}$", left) if r.before else True
            b = re.search(rf"^{r.after}(?= |$)", right) if r.after else True
            if a and b:
                lead = a[0].strip().count(" ") + 1 if r.before else 0
                (found if r.open < 0 else parts).append((i - lead, -(i + (b[0].count(" ") if r.after else 0)), r.priority, k, r.label, r.base))
    chains = {}
    for start, minus_end, priority, k, label, base in sorted(parts):
        r = rules[k]
        before = chains.get((r.open, r.part - 1))
        if r.part and (before is None or before[1] > start):
            continue
        chains.pop((r.open, r.part - 1), None)
        begin = before[0] if r.part else start
        if r.last:
            found.append((begin, minus_end, priority, k, label, base))
        else:
            chains[r.open, r.part] = (begin, -minus_end)
    kept = []
    for x in sorted(found):
        if x[5] or not any(y[2] <= x[2] and y[1] <= x[1] for y in kept):
            kept.append(x)
    return sorted({x[4] for x in kept}), len(kept)


def test_license_scan_against_plain_python(spark):
    import random

    random.seed(2)
    rules = license_scan.signatures()
    some = ["gnu general public license", "version 3", "or later", "mit license", "apache license version 2 0", "all rights reserved", "copyright c 2020", "cc by nc sa 4 0", "creative commons attribution share alike 3 0", "licensed under the", "gpl v2 only", "public domain", "permission is hereby granted free of charge to any person obtaining a copy of this software", "words", "and", "under the mit license"]
    texts = [" ".join(random.choice(some) for _ in range(random.randint(1, 8))) for _ in range(150)]
    got = {r["doc_id"]: (r["labels"], r["n_detections"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, n = detections(text, rules)
        assert got[i] == (",".join(labels), n), text


def test_license_scan_reaches_the_longest_rule(spark):
    text = "all of it is under the terms of the do what the fuck you want to public license"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "wtfpl" and row["score"] == pytest.approx(0.8)


def test_license_rules_with_gaps(spark):
    """However far apart their parts are."""
    far = " ".join(f"w{i}" for i in range(300))
    isc = "permission to use copy modify and or distribute this software for any purpose {} provided that the above copyright notice"
    texts = [f"Copyright {far} with reserved font name", isc.format("with or without fee is hereby granted to all who ask for it and to nobody else at all " + far), "with reserved font name copyright", f"with reserved font name {far} copyright {far} with reserved font name with reserved font name", "copyright " * 3000 + "with reserved font name"]
    texts.append(f"your modified version must prominently offer all users interacting with it remotely {far} the corresponding source {far} license")
    rows = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [("ofl" in rows[i]["labels"].split(",")) for i in (0, 2, 3, 4)] == [True, False, True, True] and "isc" in rows[1]["labels"].split(",") and "agpl" in rows[5]["labels"].split(",")
    rules = license_scan.signatures()
    for i in (0, 1, 2, 3, 5):
        labels, n = detections(texts[i], rules)
        assert (rows[i]["labels"], rows[i]["n_detections"]) == (",".join(labels), n)
    with pytest.raises(ValueError, match="longest"):
        license_scan.longest("a .* b")
