"""Sharding, mixing, packing, archive and token counts."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bookwise.llm import common, draws, mixing, packing, sharding, tokens, warc


# --- draws -----------------------------------------------------------------------
def test_hypergeometric_follows_its_distribution():
    rng, own = np.random.default_rng(5), np.random.default_rng(6)
    mine = [draws.hypergeometric(rng, 30, 50, 20) for _ in range(20_000)]
    theirs = own.hypergeometric(30, 50, 20, 20_000)
    for k in range(0, 16):
        assert abs(np.mean(np.array(mine) == k) - np.mean(theirs == k)) < 0.015
    big = [draws.hypergeometric(rng, 10**12, 3 * 10**12, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 250_000) < 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 10**6))
def test_matrix_and_tree_keep_their_margins(sources, parts, seed):
    total = sum(sources)
    sizes = draws.even(total, parts)
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    matrix = draws.communication_matrix(np.random.default_rng(seed), sources, sizes)
    assert [sum(r) for r in matrix] == sources and [sum(c) for c in zip(*matrix)] == sizes
    leaves = draws.splitting_tree(np.random.default_rng(seed), sources, sizes)
    assert [sum(r) for r in leaves] == sizes and [sum(c) for c in zip(*leaves)] == sources


# --- sharding ----------------------------------------------------------------------
def shards_of(spark, ids, **kwargs):
    return sharding.shard_rows(spark.createDataFrame([(i,) for i in ids], "doc_id long"), **kwargs)


def test_shards_are_even_gapless_and_repeatable(spark):
    ids = [None, None, *[7] * 40, *range(1000)]
    found = shards_of(spark, ids, n_shards=24, n_blocks=16).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(ids)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    random.shuffle(ids)
    again = shards_of(spark, ids, n_shards=24, n_blocks=16).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_shards_are_uniform(spark):
    found = shards_of(spark, range(24_000), n_shards=24, n_blocks=16).collect()
    # ids divisible by 24 fall into every shard about equally, and anywhere in it
    hits = Counter(r["shard"] for r in found if r["doc_id"] % 24 == 0)
    assert len(hits) == 24 and max(hits.values()) < 75
    assert abs(np.mean([r["slot"] for r in found if r["doc_id"] < 12_000]) - 500) < 15


def test_shards_of_few_or_no_rows(spark):
    assert shards_of(spark, []).count() == 0
    assert sorted(r["shard"] for r in shards_of(spark, [1, 2, 3]).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.createDataFrame([(1, 2)], "doc_id long, shard int"))


# --- mixing --------------------------------------------------------------------------
def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess by weight until no source is above its cap."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        share = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        above = [i for i in free if share[i] > most * sizes[i]]
        if not above:
            return [share.get(i, most * sizes[i]) for i in range(len(sizes))]
        capped |= set(above)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_match_resharing(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes)) and sum(got) == pytest.approx(sum(sizes))


UNITS = "doc_id long, source string, size long"


def test_mix_meets_targets_and_places_each_copy_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "é", "", None]), rng.choice([0, 3, 10, 40])) for i in range(1500)]
    rows += [(9, "z", 5)] * 30 + [(None, "z", None), (None, None, 7)]
    found = mixing.mix(spark.createDataFrame(rows, UNITS), n_shards=7).collect()
    assert len(found) == len(rows)
    taken, due = Counter(), {}
    for r in found:
        assert r["taken"] == len(r["placements"]) * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        due[r["source"]] = r["target"]
    assert all(abs(taken[s] - due[s]) <= 5 for s in due), (taken, due)
    spots = [(p["shard"], p["position"]) for r in found for p in r["placements"]]
    per_shard = Counter(s for s, _ in spots)
    assert len(set(spots)) == len(spots) and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert all(p < per_shard[s] for s, p in spots)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    again = mixing.mix(spark.createDataFrame(shuffled, UNITS), n_shards=7).collect()
    assert Counter(str(r) for r in found) == Counter(str(r) for r in again)


def test_mix_takes_columns_of_any_name(spark):
    names = ["sid", "rest", "copies_", "pick", "pick2", "slice", "inside", "unit", "full", "rank", "block", "miss", "a.b"]
    units = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 7) for i in range(60)], UNITS)
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(units, n_shards=3).collect()}
    wide = mixing.mix(units.withColumns({n: F.lit(5) for n in names}), n_shards=3)
    assert set(names) < set(wide.columns) and len(plain) == 60
    found = wide.collect()
    assert len(found) == 60 and all(r["sid"] == r["slice"] == r["a.b"] == 5 for r in found)
    assert sum(r["copies"] for r in found) == sum(len(r["placements"]) for r in found) > 0
    for name in ("taken", "Twin", "placements"):
        with pytest.raises(ValueError, match="columns of the result"):
            mixing.mix(units.withColumn(name, F.lit(1)))


def test_rows_of_the_driver_start_no_python_workers(spark):
    units = spark.range(60).selectExpr("id", "'a' AS source", "1 + id % 7 AS size")
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('one two three ', int(id % 9)) AS text")
    for df in (mixing.mix(units, n_shards=3), packing.pack(docs, tokens.tokenizer_path(), window=16)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "LogicalRDD" not in plan
    rows = [(1, None, [1, 2], 0.5), (2, "é", [], None)]
    schema = "a int, b string, c array<long>, d double"
    for part in (rows, rows[:1], []):
        assert [tuple(r) for r in common.local(spark, part, schema).collect()] == part
        assert common.local(spark, part, schema).schema.simpleString() == "struct<a:int,b:string,c:array<bigint>,d:double>"


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], UNITS)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, None)], UNITS)).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, f"w{i} " * (i % 30), "ab"[i % 5 == 0], i) for i in range(300)] + [(7, "w7 " * 7, "a", 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mixed = Counter(tuple(r) for r in mixing.mixed_documents(docs, 4).collect())
    assert set(mixed) <= set(rows)
    words = Counter()
    for r, n in mixed.items():
        words[r[2]] += n * len(r[1].split())
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in "ab"]
    for s, target in zip("ab", mixing.targets(sizes)):
        assert abs(words[s] - target) <= 10


# --- packing -------------------------------------------------------------------------
def best_sum(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach = {x + k * length for x in reach for k in range(n + 1) if x + k * length <= room}
    return max(reach)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), max_size=5), st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(counts, room):
    used = packing.fullest(Counter(counts), room)
    assert sum(k * n for k, n in used.items()) == best_sum(counts, room)
    assert all(n <= counts[k] for k, n in used.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 30), max_size=8))
def test_windows_hold_every_id_once(histogram):
    intervals, windows = packing.plan_windows(histogram, 32)
    pieces, spots = defaultdict(list), defaultdict(list)
    for x in intervals:
        for k in range(x.n):
            pieces[x.rem, x.first + k].append((x.start, x.length))
            spots[x.sequence + k].append((x.offset, x.length))
    assert set(pieces) == {(r, k) for r, n in histogram.items() for k in range(n)}
    for runs, end in [(p, key[0]) for key, p in pieces.items()] + [(s, None) for s in spots.values()]:
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
        assert at == end if end else at <= 32
    assert sorted(spots) == list(range(windows))
    total = sum(r * n for r, n in histogram.items())
    assert windows == -(-total // 32)  # cutting fills every window but the last


def test_packed_pieces_carry_the_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "zebra", "ütf", "<|endoftext|>", "42"]) for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(500, None), (500, ""), (501, "same text again")] + [(501, "same text again")] * 9 + [(None, "no id")]
    path = tokens.tokenizer_path()
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, window=64).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    want, got = Counter(), Counter()
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc_id] += len(ids)
    by_seq = defaultdict(list)
    ids_of = {d: np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in rows}
    for r in found:
        got[r["doc_id"]] += r["length"]
        piece = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids_of[r["doc_id"]])
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for runs in by_seq.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_seq) <= -(-sum(want.values()) // 64) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


# --- archive -------------------------------------------------------------------------
def test_archive_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a/x", "<p>é</p>"), (3, "http://b\r\nX-Page-Id: 99", "<p>é</p>"), (9, None, ""), (4, "u", None), (3, "http://b", "<p>é</p>"),
        (None, "n", "<p>é</p>"), (None, "m", "only"), (8, "long", "x" * 300_000),
    ]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows) and all(r["verified"] for r in back)
    seen = []
    for r in back:
        head = dict(x.split(": ", 1) for x in bytes(r["header"]).decode().split("\r\n")[1:] if x)
        payload = bytes(r["payload"])
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert head["WARC-Payload-Digest"] == f"sha1:{digest}" and r["payload_bytes"] == len(payload)
        body = payload if head["WARC-Type"] == "response" else b""
        assert int(head["Content-Length"]) == len(body) and bytes(r["record"]) == bytes(r["header"]) + body + b"\r\n\r\n"
        seen.append((head.get("X-Page-Id"), payload.decode(), head["WARC-Type"], head.get("X-Refers-To-Page-Id")))
    assert sorted(seen, key=str) == sorted(
        [
            ("5", "<p>é</p>", "revisit", "3"), ("3", "<p>é</p>", "response", None), ("3", "<p>é</p>", "response", None), (None, "<p>é</p>", "revisit", "3"),
            ("9", "", "revisit", "4"), ("4", "", "response", None), (None, "only", "response", None), ("8", "x" * 300_000, "response", None),
        ],
        key=str,
    )


def test_payload_of_many_records_is_dealt_out(spark, tmp_path):
    pages = spark.range(2, 3_002).selectExpr("id AS page_id", "concat('u', id) AS url", "if(id % 3 = 0, 'own ' || id, 'shared by many') AS html")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    back = warc.op8_warc(spark, str(tmp_path)).collect()
    shared = [r for r in back if r["page_id"] % 3]
    assert len(back) == 3_000 and all(r["verified"] for r in back) and len(shared) == 2_000
    assert {(r["payload_bytes"], r["refers_to"]) for r in shared if r["page_id"] != 2} == {(14, 2)}
    assert sum(r["record_type"] == "response" for r in back) == 1_001
    path = str(tmp_path / "archive")
    warc.write_archive(pages.cache(), path)
    stored = spark.read.parquet(f"{path}/payloads").count()
    records = warc.read_archive(spark, path)
    assert stored == 1_001 and records.where("record IS NULL OR payload IS NULL").count() == 0
    assert records.selectExpr("sum(octet_length(record) - octet_length(header) - 4)").first()[0] == 14 + sum(len(f"own {i}") for i in range(2, 3_002) if i % 3 == 0)


def test_short_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"), min_bytes=3)
    types = {r[0]: r[1] for r in warc.read_archive(spark, str(tmp_path / "a")).select(
        warc.header_field(warc.F.col("header").cast("string"), "X-Page-Id"), warc.header_field(warc.F.col("header").cast("string"), "WARC-Type")).collect()}
    assert types == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "c")
    warc.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "cd")], "page_id long, url string, html string"), path)
    broken = spark.read.parquet(f"{path}/payloads").select("address", warc.F.lit(b"cd").alias("payload")).collect()
    spark.createDataFrame(broken, "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert sorted(r["verified"] for r in warc.read_archive(spark, path).collect()) == [False, True]


# --- token counts ----------------------------------------------------------------------
ODD = [
    "", " ", "  two  spaces ", "tabs\tand\nlines \r\n x", "it's we'll I'VE", "<|endoftext|> in <|endoftext|>text", "naïve café ʼn ǅ", "漢字かな交じり",
    "🙂👩‍👩‍👧 emoji", "１２３ ٣ Ⅷ ½", "a" * 5000, " " * 3000 + "x", " nbsp em​zero", "\x00\x01ctl", "x" + "\n" * 500, "é combining",
]


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t\r\n", "a", "é"])
def test_very_long_runs_equal_the_library(run):
    n = 1_200_000 // len(run)
    texts = [run * n, "word" + run * n + "word"]
    encode, _ = tokens.load_encoder(tokens.tokenizer_path())
    for text, ids in zip(texts, encode(texts)):
        assert list(ids) == tokens.library_encoder(tokens.tokenizer_path())([text])[0]


def test_batches_and_parts_are_bounded_by_bytes(monkeypatch):
    path, sizes = tokens.tokenizer_path(), []
    encode, cuttable = tokens.load_encoder(path)
    monkeypatch.setattr(tokens, "load_encoder", lambda p: ((lambda texts: sizes.append(sum(len(t.encode()) for t in texts)) or encode(texts)), cuttable))
    texts = ["漢字 " * 2000, "漢字かな" * 30, "short", "é à " * 3000] * 3
    ours = [sum(map(len, parts)) for parts in tokens.encode_all(path, texts, 4096)]
    assert ours == [len(encode([t])[0]) for t in texts]
    assert max(len(p.encode()) for t in texts for p in tokens.safe_parts(t, 4096)) <= 4096 + 16
    assert max(sizes[1:]) <= 18_000 + 4096


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_fast_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    own = Tokenizer.from_file(path)
    for x in (text, *(ODD if not text else [])):
        parts = next(tokens.encode_all(path, [x]))
        assert [i for p in parts for i in p] == own.encode(x, add_special_tokens=False).ids


def test_fast_encoder_equals_the_library_on_odd_texts_and_documents(spark):
    from conftest import SF_DIR
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    own = Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    for x, parts in zip(texts, tokens.encode_all(path, texts)):
        assert [i for p in parts for i in p] == own.encode(x, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,.\n'sé", max_size=60), st.integers(1, 9))
def test_cuts_change_no_token(text, limit):
    path = tokens.tokenizer_path()
    parts = tokens.safe_parts(text, limit)
    assert "".join(parts) == text
    whole = [i for p in next(tokens.encode_all(path, [text], 1 << 20)) for i in p]
    assert [i for p in next(tokens.encode_all(path, [text], limit)) for i in p] == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_of_files(spark, name):
    docs = spark.createDataFrame([(1, "Hello  wörld <s> <|endoftext|>"), (2, None), (None, "x y")], "doc_id long, text string")
    path = tokens.tokenizer_path(name)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs, path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    assert found == {i: (len((t or "").encode()), count(t or "")) for i, t in [(1, "Hello  wörld <s> <|endoftext|>"), (2, None), (None, "x y")]}


def test_count_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en")], "doc_id long, text string, lang string")
    found = tokens.count_tokens(docs, tokens.tokenizer_path()).collect()
    assert [tuple(r) for r in found] == [(1, "en", 3, 2)] * 2
    with pytest.raises(ValueError):
        tokens.count_tokens(docs.withColumn("n_tokens", docs.doc_id), tokens.tokenizer_path())
