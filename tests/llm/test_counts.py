"""Collocations and the divergence audit, against direct counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bookwise.llm import divergence, phrases


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, least, first=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = total[lang]
        candidates = {c: a for c, a in counts.items() if len(c) > 1 and a >= least}
        scored = []
        for c, a in candidates.items():
            longer = [b for x, b in candidates.items() if len(x) > len(c) and any(x[i : i + len(c)] == c for i in range(len(x)))]
            if any(100 * b >= 100 * a for b in longer):
                continue
            score, k = min((1000 * a * n // (counts[c[:k]] * counts[c[k:]]), k) for k in range(1, len(c)))
            scored.append((score, a, " ".join(c), counts[c[:k]], counts[c[k:]], n))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right, n) in enumerate(scored[:first])]
    return Counter(out)


def text_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "The", "the", "\x1cx", "<a>"]
    rows = []
    for _ in range(300):
        w = [rng.choice(words) for _ in range(rng.randrange(30))]
        for i in range(len(w)):
            if rng.random() < 0.2:
                w[i] = rng.choice(["alpha beta gamma delta epsilon zeta", "one two three", "x.y", "stop.", "..,", "a\tb", "c\nd"])
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), " ".join(w)))
    return [*rows, (None, None), ("en", None), ("xx", ""), ("xx", " .. "), rows[0], rows[0], ("en", "q" * 100_000), ("en", "long run " * 20_000)]


def ours_phrases(spark, rows, least, first=2000):
    df = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least, first)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, first", [(5, 2000), (20, 7)])
def test_collocations_equal_direct_counts(spark, least, first):
    rows = text_rows(least)
    ours = ours_phrases(spark, rows, least, first)
    assert ours == brute_phrases(rows, least, first) and len(ours) > 10


def test_collocations_flush_and_merge_in_small_steps(spark, monkeypatch):
    rows = text_rows(3)
    corpus = phrases.Corpus("en")
    corpus.add([t or "" for _, t in rows[:200]])
    columns, n = next(phrases.grams(corpus, range(2, 3), None))
    batch = phrases.stripes(corpus, columns, n)
    keys = list(zip(batch.column("prefix").to_pylist(), batch.column("slot").to_pylist()))
    assert len(keys) == len(set(keys)) and sum(map(sum, batch.column("n").to_pylist())) == int((corpus.ids != 0).sum())
    twice = phrases.merged([batch, batch], 1, True)
    total = defaultdict(int)
    for p, x, c in zip(*(twice.column(i).to_pylist() for i in ("prefix", "next", "n"))):
        total[p] += c if x is None else 0
    words = Counter(corpus.words[i].decode() for i in corpus.ids if i)
    assert total == {w: 2 * c for w, c in words.items()}
    monkeypatch.setattr(phrases, "MERGE", 10)
    order = sorted(range(batch.num_rows), key=lambda i: keys[i])
    sorted_ = batch.take(pa.array([i for i in order for _ in range(2)]))
    steps = list(phrases._merged(3, True)(iter([sorted_.slice(i, 3) for i in range(0, sorted_.num_rows, 3)])))
    ours = Counter(tuple(r.values()) for b in steps for r in b.to_pylist() if r["next"] is not None)
    theirs = Counter(tuple(r.values()) for r in phrases.merged([batch, batch], 3, False).to_pylist())
    assert ours == theirs and len(steps) > 5


def test_collocation_scores_need_more_than_64_bits(spark):
    every = [("en", "a b", 2, "a", "b", 3_000_000_000_000), ("en", "a", 1, None, None, 4_000_000_000_001), ("en", "b", 1, None, None, 3_000_000_000_007)]
    schema = "lang string, phrase string, k int, prefix string, next string, n long"
    whole = 9_000_000_000_000_123
    counts = lambda docs, least: (spark.createDataFrame(every, schema), spark.createDataFrame([("en", whole)], "lang string, total long"))
    real, phrases.phrase_counts = phrases.phrase_counts, counts
    try:
        rows = phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    finally:
        phrases.phrase_counts = real
    assert [r.score for r in rows] == [1000 * 3_000_000_000_000 * whole // (4_000_000_000_001 * 3_000_000_000_007)]


def test_collocations_of_nothing(spark):
    assert ours_phrases(spark, [], 2) == Counter()
    assert ours_phrases(spark, [("en", None), (None, "")], 2) == Counter()
    wide = spark.createDataFrame([("en", "p q. p q", "x", 4)], "lang string, text string, phrase string, n long")
    assert [r.phrase for r in phrases.collocations(wide, 2).collect()] == ["p q"]


def brute_divergence(rows, least):
    counts, spread, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", folded(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        spread.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in spread.items() if x == lang and n >= least]
        v, sources = len(kept), [s for x, s in groups if x == lang]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        market = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[s][t] - market[t], t) for t in kept if counts[lang, s][t] > 0 and own[s][t] > market[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[: 50 if part == "term" else None])]
    return Counter(out)


def source_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("lpha", "Éta", "OMEGA")] + ["ab1cd", "x'y", "naïve"]
    rows = []
    for _ in range(250):
        source = rng.choice([None, "", "s1", "s1", "s1", "Ünder", "empty"])
        own = words if source != "s1" else words[: len(words) // 2]
        rows.append((rng.choice(["en", "de", None]), source, " ".join(rng.choices(own, k=rng.randrange(40))) if source != "empty" else None))
    return [*rows, ("zz", "p", "few terms"), ("zz", "q", ""), ("zz", None, None), rows[0], rows[0], ("en", "s1", "word " * 30_000), ("en", "s1", "q" * 100_000)]


def ours_divergence(spark, rows, least):
    df = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least)
    return Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("least, cells", [(10, 1 << 20), (3, 16)])
def test_divergence_equals_direct_counts(spark, monkeypatch, least, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = source_rows(least)
    ours = ours_divergence(spark, rows, least)
    assert ours == brute_divergence(rows, least) and len({r[:2] for r in ours}) > 8


def test_divergence_of_nothing(spark):
    assert ours_divergence(spark, [], 2) == Counter()
    assert ours_divergence(spark, [("en", "a", None), ("en", "b", "")], 2) == {("en", "a", "pair", "b", 0, 1): 1, ("en", "b", "pair", "a", 0, 1): 1}
    wide = spark.createDataFrame([("en", "a", "x x", 1, "t"), ("en", "b", "y", 2, "u")], "lang string, source string, text string, n long, term string")
    assert divergence.audit(wide, 1).where("part = 'term'").count() == 2


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 7, 123_456_789_012, 8_000_000_000_000_000])
    total = np.array([8_000_123_456_789_019])
    theirs = [1 + 10**9 * (c + 5) // (int(total[0]) + 5 * 999_999) for c in counts.tolist()]
    assert divergence.shares(counts, total, 999_999).tolist() == theirs


def test_partial_counts_hold_memory(monkeypatch):
    monkeypatch.setattr(divergence, "HOLD_ROWS", 8)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 16)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "source": ["a", "b", "c"] * 20, "text": [f"w{'abcdefghij'[i % 10]} both" for i in range(60)]})
    rows = [r for b in divergence._count(iter([batch, batch])) for r in b.to_pylist()]
    summed = Counter()
    for r in rows:
        summed[r["source"], r["term"]] += r["n"]
    assert summed["a", "both"] == 40 and summed["b", ""] == 0 and sum(summed.values()) == 240
