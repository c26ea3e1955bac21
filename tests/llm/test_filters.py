"""Quality rules, quality classifier and license scan."""

import re
import textwrap
import zlib

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwise.llm import batches, licenses, quality_classifier as qc, quality_rules as qr

from conftest import SF_DIR

DOCS = "doc_id long, text string"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def brute_base(text):
    text = text or ""
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", " \n\t", "a", "a b c a b c", "x y z w\nx y z w\n\nx y z w", "a a a a", "é|é <b> é|é é\x85 #$", "a b c d", "\x1ca\x1cb c",
    "line\r\nline\r\n", "w" * 100_000, "one two three " * 40,
]


def test_base_figures_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOCS)
    found = {r["doc_id"]: r for r in qr.score(docs, np.zeros(64, np.int64)).collect()}
    for i, text in enumerate(TEXTS):
        n, chars, symbols, dup, repeat = brute_base(text)
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), text
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"])  # zero weights reject nothing


def test_wide_vocabularies_count_repeats_alike():
    numbers = np.random.default_rng(1).integers(0, 6, 300)
    assert qr._repeated(numbers) == qr._repeated(numbers + (1 << 22)) > 0


def test_words_are_held_one_text_at_a_time():
    class Words(list):
        live = most = 0

        def __init__(self, text):
            super().__init__(batches.words_of(text))
            Words.live += 1
            Words.most = max(Words.most, Words.live)

        def __del__(self):
            Words.live -= 1

    numbers, starts, vocabulary = batches.numbered(map(Words, ["b a b", "", "c a", "d"] * 5))
    assert Words.most <= 2 and vocabulary == [b"b", b"a", b"c", b"d"]
    assert numbers.tolist() == [0, 1, 0, 2, 1, 3] * 5 and starts.tolist() == [0] + [6 * k + n for k in range(5) for n in (3, 3, 5, 6)]


def test_llr_separates_and_is_repeatable(spark):
    good = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(80))) for i in range(30)]
    junk = [(100 + i, " ".join(f"w{(i + k * k) % 40}$$" for k in range(80))) for i in range(30)]
    docs = spark.createDataFrame(good + junk, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    weights = qr.fit(docs, qr.trusted_documents(docs, labels))
    assert (weights == qr.fit(docs.repartition(7), qr.trusted_documents(docs, labels.union(labels)))).all()
    found = {r["doc_id"]: r["llr"] for r in qr.score(docs, weights).collect()}
    assert min(found[i] for i, _ in good) > qr.THRESHOLD > max(found[i] for i, _ in junk)


def test_llr_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    weights = qr.fit(docs, qr.trusted_documents(docs, labels))
    words = [qr._code(w) for w in (b"a", b"b", b"c")]
    pair = (words[0] * 1_000_003 + words[1]) % qr.BUCKETS
    # trusted: a, b, "a b" once each of 3; raw: a twice, the rest once, of 6
    assert weights[words[0] % qr.BUCKETS] == round(np.log((1 + 4) / (1 + 4)) * qr.SCALE)
    assert weights[words[1] % qr.BUCKETS] == weights[pair] == round(np.log((1 + 4) / (0.5 + 4)) * qr.SCALE)
    assert weights[words[2] % qr.BUCKETS] == round(np.log((0 + 4) / (0.5 + 4)) * qr.SCALE)


def test_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert not qr.fit(empty, qr.trusted_documents(empty, labels)).any()
    assert qr.score(empty, np.zeros(8, np.int64)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_words long, llr string")
    assert rows(qr.keep(docs, np.zeros(8, np.int64)), "n_words") == []
    with pytest.raises(ValueError):
        qr.score(docs, np.zeros(8, np.int64))
    assert qc.classify(empty, qc.fit(empty, labels)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = qc.classify(docs.select("doc_id", "text"), qc.fit(docs, labels)).join(labels, "doc_id")
    right = found.where(qc.held_out(F.col("doc_id"))).agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3} {'abc' * (i % 5)}") for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = spark.createDataFrame([(i, (i + (i in out)) % 2) for i in range(60)], "doc_id long, quality int")
    assert rows(qc.classify(docs, qc.fit(docs, labels)), "doc_id", "score") == rows(qc.classify(docs, qc.fit(docs, flipped)), "doc_id", "score")


def test_votes_are_exact_nearest_neighbours():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    model = {"project": np.eye(6, dtype=np.float32), "vectors": qc._unit(x[:25]), "votes": (np.arange(25) % 2).astype(np.float32)}
    got = qc.vote(x[25:], model, 5)
    for row, score in zip(qc._unit(x[25:]), got):
        order = sorted(range(25), key=lambda i: -float(row @ model["vectors"][i]))[:5]
        weight = [max(float(row @ model["vectors"][i]), 0) ** 2 for i in order]
        assert score == pytest.approx(sum(w * model["votes"][i] for w, i in zip(weight, order)) / sum(weight), abs=1e-5)
    assert qc.vote(np.zeros((1, 6), np.float32), model)[0] == pytest.approx(12 / 25)


def test_repeated_ids_give_one_model_however_they_lie(spark):
    rows = [(i % 40, f"text {i} " + "good words here " * (i % 5) if i % 3 else "bad bad bad " * (i % 7)) for i in range(160)] + [(3, None), (3, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = qc.fit(docs.repartition(1), labels)
    other = qc.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7, "text"), labels)
    assert all(np.array_equal(one[k], other[k]) for k in one)


def test_equal_texts_score_alike_in_any_block():
    rng = np.random.default_rng(2)
    rows, known = rng.random((300, 30), np.float32), rng.random((50, 8), np.float32)
    model = {"project": rng.random((30, 8), np.float32), "vectors": qc._unit(known), "votes": (np.arange(50) % 2).astype(np.float32)}
    together = qc.vote(rows[:256], model)
    assert all(qc.vote(rows[i : i + 1], model)[0] == together[i] for i in range(256))


def test_neighbour_ties_go_to_the_first():
    model = {"project": np.eye(2, dtype=np.float32), "vectors": np.repeat(np.float32([[1, 0]]), 6, 0), "votes": np.float32([1, 1, 1, 0, 0, 0])}
    assert qc.vote(np.float32([[1, 0]]), model, neighbours=3)[0] == 1


def test_odd_texts_are_scored(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "ab"), (3, "xyz " * 400_000)], DOCS)
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 1), (5, None)], "doc_id long, quality int")
    found = qc.classify(docs, qc.fit(docs, labels)).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


FILES = "file_id long, path string, body string"
APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def test_license_headers_and_inheritance(spark):
    files = spark.createDataFrame(
        [
            (1, "h/a/LICENSE", MIT), (2, "h/a/b/c.html", "<p>words</p>"), (3, "h/a/b/", f"<div>{APACHE}</div>"), (4, "h/x.html", "no notice"),
            (5, "h/a/b/d/e.html", f"<p>text</p><p>{MIT}</p>"), (6, None, None), (7, "h/ab/x", "not under h/a"), (8, "h/a/z/z/z", ""),
            (8, "h/a/z/z/z", ""), (None, "h/a/q", "of the work"),
        ],
        FILES,
    )
    found = rows(licenses.scan(files), "file_id", "license", "how", "from_dir")
    assert found == sorted(
        [
            (1, "MIT", "header", None), (2, "Apache-2.0", "inherited", "h/a/b"), (3, "Apache-2.0", "header", None), (4, None, None, None),
            (5, "MIT", "header", None), (6, None, None, None), (7, None, None, None), (8, "MIT", "inherited", "h/a"),
            (8, "MIT", "inherited", "h/a"), (None, "MIT", "inherited", "h/a"),
        ],
        key=str,
    )
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0


def test_every_template_matches_itself_and_contains_an_anchor(spark):
    texts = spark.createDataFrame([(i, f"d/{i}", text) for i, (_, text) in enumerate(licenses.TEMPLATES)], FILES)
    found = {r["file_id"]: (r["license"], r["similarity"]) for r in licenses.scan(texts).collect()}
    assert found == {i: (name, 1.0) for i, (name, _) in enumerate(licenses.TEMPLATES)}


def wrapped(text, width=68, prefix=" * "):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


def license_cases():
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bsd = [licenses._BSD, licenses._BSD_REST]
    long = " ".join(bsd).split()  # some 18 paragraphs
    code = "\n\nint main(void)\n{\n    return 0;\n}\n" * 30
    return [
        ("a/x.c", "// SPDX-License-Identifier: MIT" + code, "MIT"), ("b/x.c", "# SPDX-License-Identifier: Apache-2.0\r\n" + code, "Apache-2.0"),
        ("c/x.c", "/*\n * Copyright (C) 2020 Some Body\n *\n" + wrapped(gpl.format(3)) + "\n */" + code, "GPL-3.0"), ("d/x.c", wrapped(gpl.format(2), 60, "# ") + code, "GPL-2.0"),
        ("e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"),
        ("f/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n\n".join(wrapped(t, 70, "") for t in (licenses._MIT, licenses._MIT_REST)), "MIT"),
        ("g/x.c", "/*\n" + "\n *\n".join(wrapped(t) for t in bsd) + "\n */" + code, "BSD-2-Clause"),
        ("h/x.c", "/*\r\n" + "\n *\n".join(wrapped(t) for t in (bsd[0], licenses._BSD_3, bsd[1])).replace("\n", "\r\n") + "\r\n */" + code, "BSD-3-Clause"),
        ("l/x.c", "/*\n" + "\n *\n".join(" * " + " ".join(long[i : i + 12]) for i in range(0, len(long), 12)) + "\n */" + code, "BSD-2-Clause"),
        ("i/x.html", "<p>Licensed under the <a href='x'>Apache License</a>, Version 2.0.</p>", "Apache-2.0"),
        ("j/x.c", "// SPDX-License-Identifier: Beerware" + code, None), ("k/x.c", "the GNU General Public License" + code, None),
    ]


def test_license_files_and_wrapped_headers_are_compared_whole(spark):
    cases = license_cases()
    files = spark.createDataFrame([(i, path, body) for i, (path, body, _) in enumerate(cases)], FILES)
    found = {r["file_id"]: r["license"] for r in licenses.scan(files).collect()}
    assert found == {i: license for i, (_, _, license) in enumerate(cases)}


def test_texts_left_out_of_the_headers_hold_no_match(spark):
    texts = [t for _, t in licenses.TEMPLATES] + ["", "use the general work", "GNU General Public", "the version of the library and its terms", "\n\n".join(t for _, t in licenses.TEMPLATES)]
    df = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "i long, t string")
    held = {r["i"] for r in df.where(licenses.may_match(licenses.F.col("t"))).collect()}
    vectors = defaultdict(dict)
    for template, _, term, weight in licenses.weights()[2]:
        vectors[template][term] = weight
    most = {i: max(sum(w * w for x, w in v.items() if x in set(re.findall(licenses.TERM, t.lower()))) for v in vectors.values()) for i, t in enumerate(texts)}
    assert held == {i for i, m in most.items() if m >= 0.49 - 1e-6} and set(range(len(licenses.TEMPLATES))) <= held and len(texts) - 5 not in held


def test_license_sql_compares_the_same_units(spark, tmp_path):
    from bookwise.llm import oracles

    rows_ = [(i, f"https://{path}", body) for i, (path, body, _) in enumerate(license_cases())]
    rows_ += [(50, "https://e/sub/y.c", "int x;"), (51, "https://z/", "Released under the MIT License.\r\n\r\nmore"), (52, None, None), (53, "https://z/deep/er/q", "")]
    spark.createDataFrame(rows_, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    result = con.execute(oracles.SQL["op2_license_scan"])
    names = [d[0] for d in result.description]
    theirs = Counter(tuple(r[names.index(c)] for c in ("page_id", "license", "similarity", "how", "from_dir")) for r in result.fetchall())
    ours = licenses.op2_license_scan(spark, str(tmp_path)).select("page_id", "license", "similarity", "how", "from_dir").collect()
    assert Counter(map(tuple, ours)) == theirs and sum(r["how"] == "inherited" for r in ours) >= 2


def test_labelled_rows_travel_as_the_terms_they_hold():
    rows = qc.tf_idf(qc.term_counts(["some words of a text", "", "more more words"]), np.ones(qc.TERMS, np.float32))
    sent = [{"terms": np.flatnonzero(r).astype(np.uint16).tobytes(), "row": r[np.flatnonzero(r)].tobytes()} for r in rows]
    assert sum(len(s["terms"]) + len(s["row"]) for s in sent) < 1_000
    assert np.array_equal(qc._unfolded(sent), rows)
