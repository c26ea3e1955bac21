"""SimHash fingerprints and their links, against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from bookwise.llm import simhash

DOCS = "doc_id long, text string"


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints=None, within=3):
    prints = prints or [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= within and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = defaultdict(list)
    for (doc_id, _), own in zip(rows, label):
        ids[own].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((d, p, smallest[own]) for (d, _), p, own in zip(rows, prints, label))


def found(spark, rows):
    return Counter((r[0], r[1] % 2**64, r[2]) for r in simhash.link(spark.createDataFrame(rows, DOCS)).collect())


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([1, 2, 3, 4, 30, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            edited = list(words)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = f"E{rng.random()}"
            texts.append(" ".join(edited))
    texts += [None, "", " \t\n", "A a a a a a", "a A a a A a", "Ärger ärger ÄRGER", texts[0], texts[0].upper(), "x" * 200_000, "long word " * 30_000]
    rng.shuffle(texts)
    return [(None if i % 17 == 5 else 1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_fixture_equals_all_pairs(spark):
    from conftest import SF_DIR

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    theirs = {(d, f"{p:016x}", c) for d, p, c in brute(rows)}
    assert {tuple(r) for r in simhash.op11_simhash(spark, SF_DIR).select("doc_id", "fingerprint", "component_id").collect()} == theirs


def test_edge_tables(spark):
    assert simhash.link(spark.createDataFrame([], DOCS)).collect() == []
    wide = spark.createDataFrame([(3, "a b c d", 1, "x"), (3, "a b c d", 2, "y"), (None, "a b c d", 3, "z")], "doc_id long, text string, print long, component_id string")
    rows = simhash.link(wide).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == {(3, 3): 2, (None, 3): 1}


def test_majorities_of_long_runs():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 254, 255, 256, 0, 511, 5000])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    hashes[300:900] |= np.uint64(1 << 63)
    ends = np.cumsum(sizes)
    theirs = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[e - n : e]) > n) for e, n in zip(ends, sizes)]
    assert simhash.majorities(hashes, sizes).tolist() == theirs


def clustered(seed, n=1500):
    """Fingerprints around a few centres, with a part that a third of them share."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = set()
    while len(prints) < n:
        p = rng.choice(centres) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randrange(9)):
            p ^= 1 << rng.randrange(64)
        if rng.random() < 0.3:
            p &= ~0xFFFF
        prints.add(p)
    return sorted(prints)


@pytest.mark.parametrize("parts, crowded", [(None, 4096), (None, 40), (3, 4096), (2, 100), (1, 4096)])
def test_every_partitioning_connects_the_same(spark, monkeypatch, parts, crowded):
    prints = clustered(7)[: 1500 if parts != 1 else 30]
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    if parts:
        monkeypatch.setattr(simhash, "partition_count", lambda n, within: parts)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_edges(spark.createDataFrame(signed, "print long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    ours = Counter(Counter(root(p) for p in prints).values())
    theirs = Counter(Counter(c for _, _, c in brute([(p, None) for p in prints], prints).elements()).values())
    assert ours == theirs
    # a spanning forest of each bucket, not all pairs
    assert len(edges) < 12 * len(prints)


def test_allocation_keeps_the_threshold_sum_and_spares_crowded_parts():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    prints[:3000] &= np.uint64(0xFFFFFFFFFFFF0000)
    groups = [list(range(i, i + 16)) for i in range(0, 64, 16)]
    shares = [[simhash.near_shares(np.bincount(simhash.gathered(prints, bits).astype(int), minlength=256), 3) for bits in cut] for cut in simhash.pieces(groups)]
    thresholds = simhash.allocate(prints, groups, shares, 50_000_000, 3)
    assert set(thresholds.sum(1)) == {3 - 4 + 1}
    assert (thresholds[:3000, 0] == -1).all() and thresholds[:3000].max() >= 1
    even = simhash.allocate(prints, groups, shares, 4000, 3)
    assert (even[3000:] == 0).all()


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (5000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = 1 - bits[:, 3]
    groups = simhash.correlated_groups(bits.T @ bits, 5000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [16] * 4
    assert any({3, 40, 50} <= set(g) for g in groups)


def test_more_fingerprints_ask_for_fewer_wider_partitions():
    assert [simhash.partition_count(n) for n in (0, 10**6, 10**10)] == [4, 4, 2]
