"""Token counts, packing and byte-level BPE against the libraries themselves."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from conftest import ODD  # noqa: F401

from semid.llm import bpe_words
from semid.llm.bpe_words import encode
from semid.llm.packing import best_pattern, pack, padding, plan
from semid.llm.token_counts import token_counts

TRICKY = [
    " a", "a ", "  a  b", "a\n b", "a \n b\n\n  c\t d", "x<|endoftext|>y <s> </s>", "Привет мир 你好 ①ﬁ", "it's we're 123 456abc  ", "\x1c a\x1cb \x1c", " nbsp\xa0  x y", "a\t \nb ́e \U0001f600 ok", "▁a ▁ ▁▁b", "a" * 5000, "foo   bar    baz", " \n ", "é è\n\nà !?",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return dict(enumerate(rows + TRICKY + [t for _, t in ODD]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_counts_equal_the_library(docs, texts, odd, none):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in token_counts(docs, model).collect():
        t = texts[r["doc_id"]] or ""
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096), t[:80]
    assert token_counts(odd, model).count() == len(ODD) and token_counts(none, model).count() == 0


def test_words_encode_and_decode_as_the_library(docs, texts, odd, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = encode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = lib.encode_ordinary(t)
        assert r["ids"] == ids and bytes(r["decoded"]) == t.encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert encode(odd, path, public_tokenizers.PATTERN).count() == len(ODD) and encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_buckets_in_shares_and_inputs_of_no_order_give_the_same(spark, docs, texts, monkeypatch):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted(encode(docs, *args).collect())
    monkeypatch.setattr(bpe_words, "MOST_BUCKETS", 5)
    monkeypatch.setattr(bpe_words, "BLOCK_CHARS", 20_000)
    assert sorted(encode(docs.repartition(7), *args).collect()) == want and len(want) == len(texts)


def _read(texts, pattern, monkeypatch, block_chars=10**6):
    """The blocks of a task with these texts, and the strings that were split for them."""
    import pyarrow as pa
    import pyspark
    import regex

    seen = []

    class Task:
        partitionId = staticmethod(lambda: 3)

    def splitter(pattern):
        return lambda text: seen.append(text) or regex.findall(pattern, text)

    monkeypatch.setattr(pyspark, "TaskContext", type("Context", (), {"get": staticmethod(Task)}))
    monkeypatch.setattr(bpe_words, "splitter", splitter)
    monkeypatch.setattr(bpe_words, "BLOCK_CHARS", block_chars)
    rows = pa.record_batch({"id": range(len(texts)), "text": pa.array(texts, pa.string())})
    return list(bpe_words._blocks([rows.slice(0, 5), rows.slice(5)], pattern)), seen


def test_distinct_chunks_are_split_many_at_once(monkeypatch):
    texts = ["first " + " ".join(f"w{k},{k % 7}" for k in range(j, 4000)) for j in range(8)]
    _, seen = _read(texts, public_tokenizers.PATTERN, monkeypatch)
    # Before, each of 4,000 distinct chunks had a call of its own.
    assert len(seen) <= len(texts) + 1 and sum(map(len, seen)) < 1.1 * len(texts[0])


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+|,", r" \p{L}+|\p{N}"])
@pytest.mark.parametrize("together", [3, 50_000])
def test_places_of_a_block_give_the_pattern_s_words(pattern, together, monkeypatch):
    import random

    import regex

    monkeypatch.setattr(bpe_words, "TOGETHER", together)
    draw = random.Random(5)
    texts = TRICKY + [t or "" for _, t in ODD] + ["".join(draw.choice(["a", "bc", " ", " ", "  ", "\n", "\t", "'s", ",", "7", "\xa0", "\x1c", "é", "你", "\u3000"]) for _ in range(draw.randrange(30))) for _ in range(300)]
    for block_chars in (1, 40, 10**6):
        blocks, _ = _read(texts, pattern, monkeypatch, block_chars)
        got = {}
        for _, block, ids in blocks:
            words = block.words.to_pylist()
            assert len(words) == len(set(words))
            got |= {i: [words[k] for (k,) in struct.iter_unpack("<I", raw)] for i, raw in zip(ids.to_pylist(), block.places(), strict=True)}
        assert got == {i: regex.findall(pattern, t) for i, t in enumerate(texts)}
    assert len(blocks) == 1 and len({name for name, _, _ in _read(["a b", "b a", "c d"], pattern, monkeypatch, 1)[0]}) == 3


def test_texts_without_words_only(spark):
    rows = encode(spark.createDataFrame([(1, ""), (2, None), (None, "")], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, *r[1:]) for r in rows) == [(i, 0, empty, empty) for i in range(3)]


def _check_pieces(rows, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = {}, {}
    for p in rows:
        by.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for i, t in texts.items():
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(packed(ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    wasted = 0
    for ps in sequences.values():
        fill = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == fill
            fill += p["length"]
        assert fill <= 2048
        wasted += padding(fill, 2048)
    return wasted, sum(p["length"] for p in rows)


def test_packing_is_gapless_and_tight(docs, texts, none):
    args = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    wasted, total = _check_pieces(pack(docs, *args).collect(), texts)
    assert wasted < max(4096, 0.01 * total)
    assert pack(none, *args).count() == 0


def test_packing_counts_odd_rows_each(odd):
    rows = pack(odd, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD) and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_patterns_are_the_best_by_brute_force():
    from itertools import product

    for counts in ({5: 2, 3: 3, 7: 1}, {6: 1, 6 + 1: 2, 11: 1, 2: 1}, {9: 3}, {1: 40}):
        window, longest = 20, max(counts)
        sums = [sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in product(*[range(c + 1) for c in counts.values()]) if dict(zip(counts, ks, strict=True))[longest]]
        least = min(padding(s, window) for s in sums if s <= window)
        pattern = best_pattern(counts, window)
        assert padding(sum(n * k for n, k in pattern.items()), window) == least and all(k <= counts[n] for n, k in pattern.items()) and pattern[longest]
        rows = plan(counts, window)
        assert {n: sum(hi - lo for m, lo, hi, *_ in rows if m == n) for n in counts} == counts
    assert plan({}, 20) == []
