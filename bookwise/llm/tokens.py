"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise.llm.common import table

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text encoded together, and the length beyond which a text is cut at safe boundaries.
BATCH_BYTES = 1 << 20
#: tiktoken's pattern search gives up on some longer runs of white space; texts that have one go to the tokenizers library.
LONGEST_BLANK = 100_000
_LONG_BLANK = re.compile(rf"\s{{{LONGEST_BLANK}}}")
#: The split pattern of byte-level BPE files that do not state their own (a fixed value of that format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _as_ranks(spec: dict):
    """The vocabulary as (bytes -> id) if the file is plain byte-level BPE whose ids follow its merges, else None."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not model.get("dropout") and not model.get("unk_token") and not model.get("ignore_merges")
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    )
    if not plain:
        return None
    code, vocab, specials = _byte_characters(), model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocab.get(a + b) for a, b in pairs]
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:])) or not set(code) <= set(vocab):
        return None
    ranks = {bytes(code[c] for c in word): i for word, i in vocab.items() if word not in specials}
    return ranks, specials


@functools.lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from a list of texts to a list of id sequences, and whether a text may be cut before a lone space.

    ``.model`` files are read by sentencepiece, ``.json`` files by tokenizers. The
    common kind of ``.json``, byte-level BPE whose ids follow its merge order, is
    run by tiktoken's encoder over the vocabulary of that same file: it applies
    the same merges four times faster (the tests hold both against each other).
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if found := _as_ranks(spec):
        import tiktoken

        ranks, specials = found
        encoding = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=specials)

        def encode(text: str):
            if len(text) >= LONGEST_BLANK and _LONG_BLANK.search(text):
                return library_encoder(path)([text])[0]
            return encoding.encode_to_numpy(text, allowed_special="all")

        return (lambda texts: [encode(t) for t in texts]), True
    return library_encoder(path), False


@functools.lru_cache(maxsize=2)
def library_encoder(path: str):
    """The tokenizers library over its own file: a function from a list of texts to a list of id lists."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def byte_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def safe_parts(text: str, limit: int = BATCH_BYTES) -> list[str]:
    """``text`` in parts of about ``limit`` bytes, cut only before a space between two other characters.

    Byte-level BPE starts a new word at such a space whatever stands around it, so
    the parts' tokens are the text's tokens. Without such a space there is no cut.
    """
    step = limit if text.isascii() else max(1, limit // 4)  # characters that surely have no more bytes
    parts, start, at = [], 0, step
    while 0 < (at := text.find(" ", at)) < len(text) - 1:
        if text[at - 1].isspace() or text[at + 1].isspace():
            at += 1
            continue
        parts.append(text[start:at])
        start, at = at, at + step
    return [*parts, text[start:]]


def encode_all(path: str, texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list]:
    """The id sequences of each text's parts, encoded in batches of about ``limit`` bytes."""
    encode, cuttable = load_encoder(path)
    waiting, size, owners = [], 0, []
    done: list[list] = []

    def flush():
        for owner, ids in zip(owners, encode(waiting)):
            while len(done) <= owner:
                done.append([])
            done[owner].append(ids)

    first = 0
    for i, text in enumerate(texts):
        for part in safe_parts(text, limit) if cuttable and byte_length(text) > limit else [text]:
            waiting.append(part)
            owners.append(i - first)
            size += byte_length(part)
        if size >= limit or i == len(texts) - 1:
            flush()
            yield from done
            waiting, size, owners, done = [], 0, [], []
            first = i + 1


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    No begin, end or other special tokens are added; their strings inside a text
    are read as the library does by default; nothing is truncated or padded. A
    null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each
    for itself. Only lengths leave the Arrow function. ``path`` must exist on
    every executor.
    """
    others = [c for c in docs.columns if c != text_col]
    clash = {"n_bytes", "n_tokens"} & set(others)
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    schema = docs.select(*others).schema.add("n_bytes", "long").add("n_tokens", "long")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            texts = [t or "" for t in table_.column(text_col).to_pylist()]
            tokens = [sum(map(len, parts)) for parts in encode_all(path, texts, batch_bytes)]
            sizes = [byte_length(t) for t in texts]
            out = table_.select(others)
            out = out.append_column("n_bytes", pa.array(sizes, pa.int64())).append_column("n_tokens", pa.array(tokens, pa.int64()))
            yield from out.to_batches()

    return docs.mapInArrow(lengths, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counts = count_tokens(docs, tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
