"""Jaccard join, components, top-k search and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from bookwise.llm import jaccard, topk
from bookwise.llm.components import connected

from conftest import SF_DIR

DOCS = "doc_id long, text string"


def sets_of(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in
             "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(doc_id, set size, smallest id reachable) of all rows, from all pairs."""
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = defaultdict(list)
    for (doc_id, _), own in zip(rows, label):
        ids[own].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((d, len(s), d if not s else smallest[own]) for (d, _), s, own in zip(rows, sets, label))


def linked(spark, rows):
    return Counter(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"e{rng.random()}"], [words[k], f"e{rng.random()}"]])
    return words


def corpus(seed):
    """Clusters of near copies around the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for size, members in ((7, 4), (9, 4), (14, 5), (25, 6), (40, 6), (60, 30), (120, 12), (400, 5), (2500, 3)):
        for _ in range(2):
            base = word(size)
            texts += [edited(rng, base, rng.randrange(0, max(2, size // 25))) for _ in range(members)]
    passage = word(55)
    texts += [word(25) + passage + word(25) for _ in range(40)]
    texts += [word(6) + passage for _ in range(15)]
    return [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    assert linked(spark, rows) == brute(rows)


def test_odd_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (None, "A b C d e F"), (4, "a b c d e f"), (9, "a B c D e f "), (4, "a b c d e f"), (2, None), (3, ""), (2, " \n"), (None, None), (7, "two words"),
        (8, "TWO\twords"), (8, "two words three"), (11, long), (12, long + " tail"), (13, "É é é é é"), (14, "é é é é é"), (15, "a b c d"), (16, "a b c d e"),
    ]
    assert linked(spark, rows) == brute(rows)
    assert linked(spark, []) == Counter()


def test_eight_words_and_one_more_are_linked(spark):
    eight = "a b c d e f g h"
    rows = [(5, eight), (3, eight + " i"), (9, "z " + eight), (4, "p q r s t u v w"), (2, "o p q r s t u v w"), (8, "k l m n o p q"), (7, "k l m n o p q r"), (6, "a b c d e f g x")]
    assert linked(spark, rows) == brute(rows)
    found = {(d, c) for d, _, c in linked(spark, rows)}
    assert {(5, 3), (9, 3), (4, 2)} <= found


def test_one_of_each_keeps_rows_whole(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(5, near, 1), (3, near + " x", 2), (3, near + " x", 2), (8, "unlike the others in all", 3), (None, near, 4), (1, None, 5), (1, "", 6), (1, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = sorted((tuple(r) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([rows[1], rows[3], rows[5], rows[6], rows[7]], key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 400), st.integers(0, 10**6))
def test_similar_sets_share_an_entry_neither_leaves_out(size, seed):
    """The promise of the allocation, on random sets at the threshold under one order of costs."""
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 2**63, size, dtype=np.uint64)
    gone = int(rng.integers(0, size // 5 + 1))
    y = np.concatenate([x[gone:], rng.integers(1, 2**63, int(rng.integers(0, size // 5 + 1)), dtype=np.uint64)])
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y))
    if 100 * both < 80 * (len(x) + len(y) - both) or min(len(x), len(y)) < 5:
        return
    ends = jaccard.bands(max(len(x), len(y)))
    cost = lambda s: (int(s) * 2654435761 % 97, s)  # noqa: E731  any order that both sets share
    entries = []
    for s in (x, y):
        own, reach = np.searchsorted(ends, len(s)), np.searchsorted(ends, len(s) * 5 // 4)
        kept = {}
        for band in {own, reach}:
            _, signature, skip = jaccard._entries(s, np.array([len(s)]), np.array([band]), ends)
            kept[band] = set(sorted({int(v) for v in signature}, key=cost, reverse=True)[int(skip[0]) :])
        entries.append(kept)
    assert any(entries[0][b] & entries[1][b] for b in entries[0].keys() & entries[1].keys())


@pytest.mark.parametrize("size", [5, 7, 9, 12, 18, 30])
def test_unrelated_short_sets_share_nothing(size):
    """Neither an empty segment nor a deletion down to one is a value: sets without a common element have none in common."""
    rng = np.random.default_rng(size)
    values, sizes = rng.integers(1, 2**63, 4_000 * size, dtype=np.uint64), np.full(4_000, size)
    ends = jaccard.bands(size)
    for band in {int(np.searchsorted(ends, size)), int(np.searchsorted(ends, size * 5 // 4))}:
        who, signature, _ = jaccard._entries(values, sizes, np.full(4_000, band), ends)
        assert len(set(who.tolist())) == 4_000
        shared = np.unique(np.unique(np.stack([who.astype(np.uint64), signature]), axis=1)[1], return_counts=True)[1]
        assert shared.max() == 1


def test_unrelated_short_texts_stay_apart_and_near_ones_meet(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 10, 11, 12, 13, 16, 22])))) for i in range(300)]
    rows += [(1000 + i, t + f" end{i % 7}") for i, t in rows[:150]] + [(2000 + i, f"start{i} " + t) for i, t in rows[100:250]]
    assert linked(spark, rows) == brute(rows)


def test_one_text_on_many_rows(spark):
    near = " ".join(f"n{i}" for i in range(40))
    rows = [(10_000 - i, near) for i in range(2_500)] + [(3, near + " tail"), (2, None), (1, "other words than those up there")]
    found = linked(spark, rows)
    assert sum(found.values()) == 2_503
    assert {(c, n) for (d, n, c), k in found.items() if d > 3} == {(3, 36)} and found[(3, 37, 3)] == found[(2, 0, 2)] == found[(1, 2, 1)] == 1


def test_hubs_and_large_components(spark):
    edges = [(9_000, i) for i in range(2_000, 4_500)] + [(i, 20_000 + i) for i in range(2_000, 4_500)] + [(9_000, 9_001), (50, 51)]
    found = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{x: 2_000 for e in edges[:-1] for x in e}, 50: 50, 51: 50}


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)]
    found = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>"


def best(rows, k):
    clean = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in clean), default=0)
    clean = [(i, v + [0] * (width - len(v))) for i, v in clean]
    out = []
    for q, a in clean:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return Counter(out)


def test_topk_is_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 2.0, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(0, 700)]
    rows += [(1000, None), (1100, [1.0, None] + [0.0] * 4), (1200, [float("nan")] * 6), (None, [1.0] * 6), (1300, [float("inf")] + [0.0] * 5), (1400, []), (1500, [0.5])]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, VECTORS))
    queries = vectors.where("vec_id % 100 = 0")
    for block in (64, 16_384):
        found = Counter(tuple(r) for r in topk.top_k(queries, vectors, 10, block, 3).collect())
        assert found == best(rows, 10)


def test_topk_keeps_vectors_with_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90, 330)]
    rows += [(400, [40_000.0, 1.0, -2.0, 0.5]), (401, [-32_768.0, 0.25, 3.0]), (402, [3e9, -3e9, 1.5, 0.1]), (500, [3e38, 1.0, -3e38, 0.0]), (501, [-3e38, 2.0, 0.0, 1.0])]
    rows += [(600 + i, [rng.gauss(0, 1e5) for _ in range(4)]) for i in range(30)]
    want = Counter({(q, r, i, s if abs(s) < 1 << 63 else None): n for (q, r, i, s), n in best(rows, 10).items()})
    vectors = topk.whole_numbers(spark.createDataFrame(rows, VECTORS))
    for block in (64, 16_384):
        found = Counter(tuple(r) for r in topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10, block, 3).collect())
        assert found == want
    assert {402, 500} <= {i for _, _, i, _ in want}
    assert {q for q, _, _, _ in want} == {100, 200, 300, 400, 500, 600}


def test_every_row_of_a_repeated_query_id_is_answered(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60, 140)]
    rows += [(100, [1.0, -2.0, 5.0]), (100, [-9.0, 0.5, 0.0]), (100, [5e4, 0.0, 1.0]), (200, [3.0, 1.0, 1.0]), (200, [3.0, 1.0, 1.0]), (131, [2.0, 2.0, 2.0])]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, VECTORS))
    found = Counter()
    for q, r, i, s in topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10, 32, 2).collect():
        found[(q, r, i, s)] += 1
    want = Counter()
    clean = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows]
    for q in (100, 200):  # the ranks of an id are over all its rows, as in the SQL
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in clean if p == q for i, b in clean if i != q)[:10]
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores))
    assert found == want


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5), st.sampled_from([3, 1000, 1 << 24]))
def test_impact_index_leaves_no_member_out(seed, n, k, size):
    rng = np.random.default_rng(seed)
    rows, query = rng.integers(-size, size, (n, 4)), rng.integers(-size, size, (1, 4))
    kept, score = topk.ImpactIndex(rows).top(query, k, [np.zeros(0, np.int64)])[0]
    exact = rows @ query[0]
    assert (score == exact[kept]).all()
    assert sorted(exact)[-k:] == sorted(score)[-k:]


def test_fewer_candidates_than_asked(spark):
    vectors = topk.whole_numbers(spark.createDataFrame([(0, [1.0]), (5, [2.0]), (3, [2.0])], VECTORS))
    assert [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors).orderBy("rank").collect()] == [(0, 1, 3, 2048 * 1024), (0, 2, 5, 2048 * 1024)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:3]:
        before = docs.collect()
        docs = function(spark, docs, SF_DIR)
        after = docs.collect()
        assert docs.columns == columns and set(after) <= set(before)
        docs = spark.createDataFrame(after, docs.schema)
        if name != "ngram_jaccard":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            # what goes is too short, or not good
            assert all(labels.get(r["doc_id"]) != 1 for r in before if r["doc_id"] in gone and len((r["text"] or "").encode().split()) >= 50)
    want = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in want})
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF_DIR)
    assert mixed.columns == columns and set(mixed.collect()) <= set(after)
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF_DIR)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


ODD_ROWS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, shard string, size string, twin string"


def test_every_stage_takes_odd_rows_and_an_empty_table(spark):
    text = "the of and in on " * 30 + "a long enough text of its own with words that differ " * 3
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, text), (4, text), (None, text + "x"), (5, "short"), (None, None), (6, "word " * 40_000), (7, " " * 1_100_000 + "end")]
    odd = spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s1", 0, "a", "b", "c", "d", "e") for i, t in rows], ODD_ROWS)
    empty = spark.createDataFrame([], ODD_ROWS)
    for k, (name, stage_) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        found = stage_(spark, odd, SF_DIR)
        assert last or found.columns == odd.columns
        ids = Counter(r["doc_id"] for r in found.select("doc_id").collect())
        if name == "ngram_jaccard":
            assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1}
        if name == "quality_rules":
            assert not {1, 2, 3, 5, 7} & set(ids) and ids[4] in (0, 2)
        if last:
            assert set(ids) == {i for i, _ in rows}
        assert stage_(spark, empty, SF_DIR).count() == 0
