"""Each operator on a small table of awkward rows, beside a brute-force version."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import (
    exact_dedup,
    language_model,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    toxicity,
)
from platter.llm.arrays import mix64, pack, unmix64, unpack
from platter.llm.common import remainder
from platter.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(120))
LONG = " ".join(f"long{i % 977} item{i % 1013}" for i in range(20_000))
#: (doc_id, text, lang, source, n_chars) and columns whose names the operators use inside.
ROWS = [
    (1, BASE, "en", "src0"),
    (2, BASE.upper(), "en", "src0"),
    (3, BASE.replace("word60", "other"), "en", "src1"),
    (4, " ".join(f"word{i}" for i in [*range(60, 120), *range(60)]), None, "src1"),
    (5, None, "de", None),
    (6, "", "de", "src2"),
    (7, " \t\n ", None, None),
    (8, "one two three", "fr", "src2"),
    (8, "one two three", "fr", "src2"),
    (None, "one two three", "fr", "src2"),
    (10, LONG, "es", "src0"),
    (11, "a b c d e f g h " * 3, "en", "src0"),
    (12, "line\nline\nline  two\n\nline", "en", "src0"),
    (13, "It was été ﬁ ▁ \U0001f600  \n\n x<|0x0A|> Licensed under the Apache License, Version 2.0.", "fr", "src1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), -1, "x") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, _mix string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ids(frame):
    return sorted((r[0] is not None, r[0] or 0) for r in frame.select("doc_id").collect())


def test_every_operator_keeps_all_rows_and_takes_empty_tables(docs, empty):
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    for op in (
        quality_rules.ledger,
        exact_dedup.exact_dedup,
        near_dedup.near_classes,
        mixing.mixing_report,
        lambda d: sentencepiece_codec.encode_decode(d, model_path()),
        lambda d: language_model.score_texts(d, remainder("doc_id", 5) != 1),
        lambda d: quality_classifier.score_quality(d, labels, F.lit(True)),
        lambda d: toxicity.score_toxicity(d, labels, F.lit(True)),
        lambda d: line_dedup.drop_boilerplate(d, F.col("source"), line_dedup.text_lines(F.col("text"))),
    ):
        assert ids(op(docs)) == ids(docs)
        assert op(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_rule_measures(docs):
    for r in quality_rules.ledger(docs.drop("doc_id").withColumnRenamed("n_chars", "chars").withColumn("doc_id", F.col("text"))).collect():
        text = r["doc_id"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))


def test_rule_ablation_sums_the_bits(docs):
    book = quality_rules.ledger(docs)
    bits = [r[0] for r in book.select("failure_bits").collect()]
    for r in quality_rules.ablation(book).collect():
        bit = 1 << quality_rules.RULES.index(r["rule"])
        assert (r["rejected"], r["rejected_by_it_alone"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


@pytest.mark.parametrize("digests", [True, False])
def test_exact_groups(docs, digests):
    groups = defaultdict(list)
    for r in ROWS:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")].append(r[0])
    want = Counter()
    for text, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        for m in members:
            want[(m, keep, len(members), m == keep, hashlib.sha256(text.encode()).hexdigest() if digests else None)] += 1
    rows = exact_dedup.exact_dedup(docs, digests=digests).collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4] if digests else None) for r in rows) == want


def test_near_classes_find_edits_not_moves(docs):
    kept = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert kept[1] == kept[2] == kept[3] == 1 and kept[4] == 4
    assert kept[5] == kept[6] == kept[7] == 5 and kept[8] == kept[None] == 8
    left = near_dedup.drop_near(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5, 8, 10, 11, 12, 13]
    assert left.columns == docs.columns


def test_near_classes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for group in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(14):
            words = list(base)
            for at in rng.choice(150, rng.integers(0, 7), replace=False):
                words[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame).collect()}
    hasher = near_dedup.Hasher()
    sets = [near_dedup.shingles(hasher(t.split())) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if near_dedup.aligned(sets[a], sets[b]) >= 0.8 - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert got == {i: find(i) for i in range(len(texts))}


def test_alignment_is_the_longest_chain():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.permutation(40)[:30].astype(np.uint64)
        b = a[np.sort(rng.choice(30, 27, replace=False))].copy()
        if rng.random() < 0.5:
            i, j = rng.choice(27, 2, replace=False)
            b[i], b[j] = b[j], b[i]
        table = np.zeros((31, 28), int)
        for i in range(30):
            for j in range(27):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        want = table[30, 27] / (57 - table[30, 27])
        got = near_dedup.aligned(a, b)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))


def test_codec_is_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = Counter()
    for r in ROWS:
        coded = model.encode(r[1] or "")
        want[(r[0], len(coded), tuple(coded), hashlib.sha256(",".join(map(str, coded)).encode()).hexdigest(), hashlib.sha256(model.decode(coded).encode()).hexdigest())] += 1
    got = sentencepiece_codec.encode_decode(docs, model_path()).collect()
    assert Counter((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in got) == want


def test_each_distinct_chunk_is_segmented_once(spark, tmp_path, monkeypatch):
    words = [f"word{i % 40}" for i in range(3000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 3000, 100)] + ["x" * 5000, "a\nb", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, body string").repartition(4)
    rows = frame.selectExpr("id", "coalesce(body, '') AS body")
    tool = sentencepiece_codec.codec(model_path())
    distinct = {c for t in texts for c in tool.chunks(t or "")}
    table = sentencepiece_codec.chunk_table(rows, model_path())
    assert sum(n for _, n, _, _ in table.shards) == len(distinct)
    want = [tool.segment(c) for c in sorted(distinct)]

    def parts(table, texts):
        flat, ends = table.encode(texts)
        return [x.tolist() for x in np.split(flat, ends[:-1])]

    assert parts(table, [[c] for c in sorted(distinct)]) == want
    monkeypatch.setattr(sentencepiece_codec, "SHARD_CHUNKS", 5)
    small = sentencepiece_codec.chunk_table(rows, model_path())
    assert len(small.shards) > 8 and parts(small, [[c] for c in sorted(distinct)]) == want
    assert parts(small, [["▁word1", "▁word1"], [], ["▁word2"]]) == [2 * tool.segment("▁word1"), [], tool.segment("▁word2")]


@pytest.mark.parametrize("copies", [1, 4])
def test_every_score_is_finite(spark, copies):
    train = ["a b c d"] * copies + ["a b", "c d e"] * copies + ["a c"]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100, "b d", False), (101, "a d e b c a", False), (102, "z a z", False), (103, None, False)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")
    scores = [r["score"] for r in language_model.score_texts(frame, F.col("learn")).collect()]
    assert len(scores) == len(rows) and all(math.isfinite(x) and x < 0 for x in scores)


def test_discounts_never_vanish():
    for counts in ([5, 100, 900, 9000], [0, 0, 0, 0], [1, 1, 5000, 1], [3, 0, 0, 0], [7, 1, 0, 9]):
        d = language_model.discounts(counts)
        assert d[0] == 0 and (d[1:] >= language_model.LEAST_DISCOUNT).all() and (d <= [0, 1, 2, 3]).all()


def test_rows_with_one_id_are_one_row_to_the_classifier(spark, monkeypatch):
    rows = [(i % 7, f"some text number {i} " * 12) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, quality int")
    seen = []
    real = quality_classifier.grow
    monkeypatch.setattr(quality_classifier, "grow", lambda x, y, *a: seen.append(len(y)) or real(x, y, *a))
    assert quality_classifier.score_quality(docs, labels, F.lit(True)).count() == 400
    assert seen == [7]


def test_histograms_find_the_split_that_a_full_search_finds():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (500, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(500) < 0.1)).astype(float)
    forest = quality_classifier.grow(x, y, trees=1)
    p = y.mean()
    best = max(
        ((lambda l, r: (y[l] - p).sum() ** 2 / (l.sum() * p * (1 - p) + quality_classifier.SHRINK) + (y[r] - p).sum() ** 2 / (r.sum() * p * (1 - p) + quality_classifier.SHRINK))(x[:, f] <= cut, x[:, f] > cut), f, cut)
        for f in range(4) for cut in range(11)
    )
    assert (int(forest.feature[0][0]), math.floor(forest.cut[0][0])) == best[1:]


def test_raking_is_exact_and_the_report_says_so(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 60)) + ("license " if i % 9 == 0 else ""), ["en", "de", "fr", "es", None][int(rng.integers(0, 5))], f"src{int(rng.integers(0, 3))}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    report = mixing.mixing_report(docs)
    shares = {(r["margin"], r["value"]): r for r in mixing.margin_report(report).collect()}
    for (margin, value), row in shares.items():
        if margin == "source":
            assert row["reached"] == pytest.approx(mixing.TARGETS[margin][value], abs=1e-6)
        if margin == "lang" and value == "*":
            assert row["target"] is None and row["reached"] == pytest.approx(row["observed"], abs=1e-6)
        assert row["drawn"] == pytest.approx(row["reached"], abs=0.1)
    capped = {(r["margin"], r["value"]): r["reached"] for r in mixing.margin_report(mixing.mixing_report(docs, max_weight=1.05)).collect()}
    assert capped["source", "src0"] != pytest.approx(0.15, abs=1e-3)


@pytest.mark.parametrize("text, name", [
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.", "GPL-2.0-or-later"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.", "GPL-2.0"),
    ("modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    ("under the terms of the GNU General Public License version 9 or any later one", None),
])
def test_later_versions_are_licenses_of_their_own(text, name):
    found = [v[2] for v in licenses.Scanner().scan(text)]
    assert found == [name]


def test_a_long_text_of_few_words_fails_at_every_length(spark):
    texts = [" ".join(f"w{i % k}" for i in range(n)) for n, k in ((1999, 150), (2000, 150), (9000, 150), (2000, 260), (9000, 260))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bit = 1 << quality_rules.RULES.index("few_distinct_words")
    got = {r["doc_id"]: (r["n_distinct_words"], bool(r["failure_bits"] & bit)) for r in quality_rules.ledger(docs).collect()}
    assert all(failed == (n < 199.9) for n, failed in got.values()) and {f for _, f in got.values()} == {True, False}


def test_language_model_is_kneser_ney(spark, docs):
    texts = [r[1] for r in ROWS if r[1] and len(r[1]) < 2000]
    train = texts[:5] * 2 + ["a b a b c a b", "the cat sat on the mat"]
    frame = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(train + ["the cat sat unknown b a", None])], "doc_id bigint, text string, learn boolean")
    lower = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    pairs, words = Counter(), Counter()
    for t in train:
        seq = lower(t)
        words.update(seq)
        pairs.update(zip(["<s>", *seq], seq))
    before = Counter(w for _, w in pairs)
    d = language_model.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = language_model.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    v = len(words)

    def alone(w):
        share = sum(e[min(c, 3)] for c in before.values()) / len(pairs)
        return max(before[w] - e[min(before[w], 3)], 0) / len(pairs) + share / (v + 1)

    def p(u, w):
        after = [c for (x, _), c in pairs.items() if x == u]
        if not after:
            return alone(w)
        return (max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) + sum(d[min(c, 3)] for c in after) * alone(w)) / sum(after)

    assert sum(alone(w) for w in words) + alone("?") == pytest.approx(1)
    assert sum(p("a", w) for w in words) + p("a", "?") == pytest.approx(1)
    total = sum(words.values())
    for r in language_model.score_texts(frame, F.col("learn")).collect():
        seq = lower((train + ["the cat sat unknown b a", None])[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(w in words for w in seq), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (total + 0.5 * (v + 1))) for w in seq))
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *seq], seq)))


def test_packed_blocks_come_back():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (unmix64(mix64(x)) == x).all()
    for got, want in zip(unpack(pack([x, np.arange(1000)]), 2), (x, np.arange(1000))):
        assert (got == want).all()


def test_lines_over_the_ratio_go(spark):
    pages = [(i, "h1" if i < 8 else None, f"menu\nown {i}\n\n  menu  \n" + ("often" if i < 3 else f"more {i}")) for i in range(10)]
    frame = spark.createDataFrame(pages, "page_id bigint, host string, text string")
    out = line_dedup.drop_boilerplate(frame, F.col("host"), line_dedup.text_lines(F.col("text")), ratio=0.3)
    for r in out.collect():
        gone = {"menu", "often"} if r["host"] else set()
        assert r["kept_lines"] == [x for x in r["text"].split("\n") if x.strip() not in gone]
    html = "<p>A &amp; b<br>c</p><script>var x='<p>no</p>'</script><!-- no --><b>d</b>"
    assert spark.range(1).select(line_dedup.html_lines(F.lit(html))).first()[0] == ["A & b", "c", "d"]


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_classifier.grow(x, y)
    fresh = rng.random((500, 3))
    want = (fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.3)
    assert ((forest.score(fresh) > 0.5) == want).mean() > 0.95


def test_automaton_is_edit_distance_one():
    automaton = toxicity.Automaton({"idiot": 5.0, "scum": 5.0, "moron": 6.0}, {"lowe": 4.0}, frozenset({"moron"}))
    for word, weight in (("idiot", 5), ("idi0t", 2.5), ("idiott", 2.5), ("idot", 2.5), ("iditо"[:4] + "o", 2.5), ("idito", 2.5), ("idio", 2.5), ("xdiot", 2.5), ("diot", 2.5), ("xidiot", 2.5), ("diiot", 2.5), ("scvm", 2.5), ("cum", 2.5), ("scm", 2.5), ("xdiox", 0), ("sc", 0), ("moron", 6), ("moran", 0), ("loweish", 4), ("low", 0), ("", 0)):
        assert automaton.read(word) == weight, word


def test_quoted_terms_count_less():
    scorer = toxicity.Scorer({"idiot": 6.0}, {})
    plain, quoted = scorer.score("You are an idiot and I mean it"), scorer.score('He was called "an idiot" by some')
    assert plain > 0.5 > quoted > 0


def test_licenses_are_confirmed_by_wording(spark):
    texts = ["x\nThis work is licensed under the GNU General Public License, version 2.\ny", "Licensed under the Apache License, Version 2.0.", "licence to kill", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU Lesser General Public License, version 3."]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in rows} == {0: "GPL-2.0", 1: "Apache-2.0", 2: None, 3: "CC-BY-NC-4.0", 4: "LGPL-3.0"}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["block"] for r in rows)


def test_raking_meets_its_margins():
    observed = np.random.default_rng(0).random((3, 4, 2)) * 100
    margins = [np.array([0.3, 0.3, 0.4]), np.array([0.2, 0.2, 0.3, 0.3]), np.array([0.5, 0.5])]
    fitted = mixing.rake(observed, margins, 1000)
    for axis, margin in enumerate(margins):
        assert fitted.sum(axis=tuple(a for a in range(3) if a != axis)) / fitted.sum() == pytest.approx(margin)


def _mixed_rows(langs):
    return [(i, f"plain words of row {i} and then a few more", langs[i % len(langs)], f"src{i % 3}", 42, None) for i in range(600)]


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def test_languages_without_a_target_keep_their_share(spark):
    rows = _mixed_rows(["en", "de", "fr", "es", None, "it"])
    report = mixing.mixing_report(spark.createDataFrame(rows, DOCUMENTS)).collect()
    tokens, weighted = Counter(), Counter()
    for r in report:
        tokens[r["lang"]] += r["n_tokens"]
        weighted[r["lang"]] += r["n_tokens"] * r["weight"]
    assert weighted["*"] / sum(weighted.values()) == pytest.approx(tokens["*"] / sum(tokens.values()), rel=1e-3)
    assert weighted["de"] / weighted["es"] == pytest.approx(0.18 / 0.14, rel=1e-3)
    drawn = {r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    for lang in (None, "it"):
        of_lang = {r[0] for r in rows if r[2] == lang}
        assert len(drawn & of_lang) > len(of_lang) / 5, lang


@pytest.mark.parametrize("lang", [None, "it"])
def test_tables_without_any_named_language_are_mixed(spark, lang):
    frame = spark.createDataFrame(_mixed_rows([lang]), DOCUMENTS)
    report = mixing.mixing_report(frame).collect()
    assert {r["weight"] > 0 for r in report} == {True}
    assert mixing.mix(frame).count() > 120


def test_rake_without_a_met_target_keeps_what_is_there():
    observed = np.array([[0.0, 5.0], [0.0, 15.0]])
    fitted = mixing.rake(observed, [np.array([0.5, 0.5]), np.array([1.0, 0.0])])
    assert fitted.sum(axis=1) == pytest.approx([10, 10]) and fitted.sum(axis=0) == pytest.approx([0, 20])


def test_pipeline_keeps_unlisted_languages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "ptkbd" for b in "aeiou" for c in "nmrls"]
    rows = [(i, " ".join(rng.choice(words, 60)), ["en", None, "it"][i % 3], f"src{i % 2}", 240) for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for k in range(3):
        assert len([i for i in left if i % 3 == k]) >= 5


MIT_TEXT = (
    "MIT License",
    "Copyright (c) 2020 Some Body",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
BSD_TEXT = (
    "Copyright (c) 2020, Some Body\nAll rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
)
GPL_TEXT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
)
APACHE_TEXT = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at",
)


@pytest.mark.parametrize("width", [40, 70, 80, 400])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize(
    "paragraphs,license",
    [(MIT_TEXT, "MIT"), (BSD_TEXT, "BSD-3-Clause"), (BSD_TEXT[:4], "BSD-2-Clause"), (BSD_TEXT[:2], "BSD"), (GPL_TEXT, "GPL-3.0-or-later"), (APACHE_TEXT, "Apache-2.0")],
)
def test_wrapped_license_texts(paragraphs, license, mark, width):
    import textwrap

    wrapped = f"\n{mark.rstrip()}\n".join("\n".join(mark + line for part in p.split("\n") for line in textwrap.wrap(part, width)) for p in paragraphs)
    prose = "A note on the work and what it is for, with some words of its own."
    found = list(licenses.Scanner().scan(f"{prose}\n\n{wrapped}\n\n{prose}\n"))
    named = [f[2] for f in found if f[2]]
    assert named == [license]
    assert found[0][2] == license, found
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_wrapped_cues_are_found(spark):
    rows = [(1, "Copyr. 2020 Some Body. All\nrights reserved."), (2, "free and unencumbered software released into the public\ndomain, this is")]
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 2


def test_notices_of_one_paragraph_stay_apart():
    text = "Released under the MIT License.\nsome words between them\nLicensed under the Apache License, Version 2.0.\n\nLicensed under CC BY 4.0."
    assert [f[2] for f in licenses.Scanner().scan(text)] == ["MIT", "Apache-2.0", "CC-BY-4.0"]


@pytest.mark.parametrize("edits", [0, 1])
def test_copied_documents_survive_the_pipeline_once(spark, tmp_path, edits):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "ptkbd" for b in "aeiou" for c in "nmrls"]
    text = lambda: [" ".join(rng.choice(words, 12)) for _ in range(8)]
    copied, menu, rows = text(), "home news contact about us", []
    for i in range(60):
        lines = list(copied) if i % 3 == 0 else [menu, *text()]
        if i % 3 == 0 and edits and i:
            lines[i // 3 % 8] += f" edit{i}"
        rows.append((i, "\n".join(lines), "en", "src0", 480))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.line_stage(spark, docs, str(tmp_path))
    left = corpus_pipeline.near_stage(spark, cut, str(tmp_path)).collect()
    held = [r["text"].split("\n") for r in left]
    whole = [x for x in held if sum(any(line.startswith(c) for line in x) for c in copied) == len(copied)]
    assert len(whole) == 1
    for c in copied:
        assert any(c in x for x in held)
    assert sum(menu in x for x in held) == 1
    assert {r["doc_id"] for r in left} >= {i for i in range(60) if i % 3}


def test_near_classes_of_short_texts_match_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = []
    for size in range(5, 31):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 5000, size)]
            texts += [base, [*base, "behind"], ["before", *base], [*base, "two", "more"], base[:-1], [*base[:-1], "last"]]
    texts = [" ".join(t) for t in texts] + [f"same words open all of these texts e{i}" for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame).collect()}
    hasher = near_dedup.Hasher()
    sets = [near_dedup.shingles(hasher(t.split())) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if near_dedup.aligned(sets[a], sets[b]) >= 0.8 - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert got == {i: find(i) for i in range(len(texts))}


def test_short_similar_texts_share_a_key_and_pass_the_rough_test():
    rng = np.random.default_rng(2)
    for n in range(4, 13):
        for _ in range(50):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.append(a, rng.integers(0, 2**63, n // 4).astype(np.uint64))
            assert np.intersect1d(near_dedup.bucket_keys(a), near_dedup.bucket_keys(b)).size
    assert near_dedup.ROUGH * near_dedup.SIGNATURE <= 32


def test_rows_without_ids_meet_their_own_text_only(spark, monkeypatch):
    rows = [(None, f"{BASE} tail{i} {i * 7 % 50}") for i in range(300)] + [(None, f"other{i} " * 9) for i in range(200)]
    held = {}
    real = near_dedup.stored

    def kept(frame, label):
        held[label] = frame
        return real(frame, label)

    monkeypatch.setattr(near_dedup, "stored", kept)
    frame = spark.createDataFrame([r[1:] for r in rows], "text string").withColumn("doc_id", F.lit(None).cast("bigint"))
    got = near_dedup.near_classes(frame)
    assert got.count() == 500 and got.where("kept").count() == 201
    plan = held["shingles"]._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and "mark" in plan


def test_rows_that_can_meet_no_other_class_stay_out(spark):
    rng = np.random.default_rng(11)
    rows = [(int(k), i, int(s), int(d), int(rng.integers(1, d + 1)), int(r)) for i, (k, s, d, r) in enumerate(zip(
        rng.integers(0, 25, 400), rng.integers(20, 200, 400), rng.integers(1, 60, 400), rng.integers(0, 40, 400)))]
    frame = spark.createDataFrame(rows, "key bigint, node bigint, size int, differs int, shared int, root bigint")
    got = {r["node"] for r in near_dedup._may_meet(frame, "key", 0.8).collect()}
    part = 0.2 / 1.8
    meets = {a[1] for a in rows for b in rows if a[0] == b[0] and a[5] != b[5] and a[3] + b[3] - 2 * min(a[4], b[4]) <= part * (a[2] + b[2]) + 1e-6}
    assert meets <= got < {r[1] for r in rows}


@pytest.mark.parametrize("shard, at_once", [(1 << 17, 1 << 20), (8, 50)])
def test_elements_of_several_classes_are_counted_exactly(spark, monkeypatch, shard, at_once):
    monkeypatch.setattr(near_dedup, "SHARD_ELEMENTS", shard)
    monkeypatch.setattr(near_dedup, "ELEMENTS_AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 6)), sorted({int(x) for x in rng.integers(-20, 20, 9)})) for _ in range(120)] + [(1, 1, [])]
    frame = spark.createDataFrame(rows, "anchor bigint, root bigint, apart array<bigint>").repartition(4)
    table = near_dedup._mixed_elements(frame)
    held = defaultdict(list)
    for anchor, root, apart in rows:
        for e in apart:
            held[anchor, e].append(root)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in held]), pa.array([[e] for _, e in held], pa.list_(pa.int64()))], names=["anchor", "apart"])
    found = table.find(near_dedup._element_keys(batch)[1])
    assert found.tolist() == [len(r) if len(set(r)) > 1 else 0 for r in held.values()]
    empty = near_dedup._mixed_elements(frame.where("false"))
    assert empty.find(np.array([5], np.uint64)).tolist() == [0]


def test_maps_keep_few_files_open(tmp_path):
    from platter.llm.arrays import Maps, write_arrays

    files = [(write_arrays(str(tmp_path), "x", [np.arange(i, i + 5, dtype=np.int64)]), 5) for i in range(10)] + [("", 0)]
    maps = Maps(files, ("<i8",), most=3)
    for k in [0, 1, 2, 0, 3, 9, 4, 0, 5, 10, 10, 7]:
        assert maps[k][0].tolist() == (list(range(k, k + 5)) if k < 10 else [])
        assert len(maps.open) <= 3
    assert list(maps.open) == [5, 10, 7]


def test_rounds_with_few_pairs_start_few_tasks(spark, monkeypatch):
    """Pairs are written before they are compared, so that their number is known."""
    from platter.llm import near_dedup

    held = {}
    real = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda frame, label: held.setdefault(label, frame) and real(frame, label))
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 4)] + ["all on its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dedup.near_classes(docs).collect()
    assert {r["class_id"] for r in rows if r["doc_id"] < 15} == {0} and {r["class_id"] for r in rows if r["doc_id"] == 15} == {15}
    assert "pairs" in held
    assert "Coalesce 1" in held["links"]._jdf.queryExecution().executedPlan().toString()
