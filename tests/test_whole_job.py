"""Queries over whole tables and whole rows, against brute force in Python."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from semid.plans.quantize_queries import assigned
from semid.queries import QUERIES


def _number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def _texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def _wide(spark, sf_dir, path):
    """Embeddings with ids up to 2495."""
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("vec_id", F.col("vec_id") * 5).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_contiguous_subsequences_of_whole_histories(spark, sf_dir):
    got = {(r["user_id"], r["start"], r["length"]): r["sub"] for r in QUERIES["contiguous_subsequences"](spark, sf_dir).collect()}
    want = {}
    for r in QUERIES["user_sequences"](spark, sf_dir).collect():
        seq = r["seq"].split(",")
        want |= {(r["user_id"], i + 1, j - i): ",".join(seq[i:j]) for i in range(len(seq)) for j in range(i + 2, len(seq) + 1)}
    assert got == want and max(n for _, _, n in got) > 12


def test_mask_tokens_of_whole_texts(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    got = {r["doc_id"]: r["places"] for r in QUERIES["mask_tokens"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        n = len(text.split(" "))
        k = n * (300_000 + 400 * (_number(f"{d}|42r") % 1000)) // 1_000_000
        drawn = sorted(range(n), key=lambda i: (hashlib.md5(f"{d}|{i}|42".encode()).hexdigest(), i))[:k]
        assert got[d] == ",".join(map(str, sorted(drawn)))


def test_sampled_negatives_come_from_the_whole_vocabulary(spark, sf_dir, tmp_path):
    got = {(r["query_id"], r["j"]): r["key_id"] for r in QUERIES["sampled_negatives_eval"](spark, _wide(spark, sf_dir, tmp_path)).collect()}
    assert got == {(q, j): 1 + _number(f"{q}|{j}|42") % 2495 if j else q for q in range(0, 2500, 50) for j in range(21)}


def test_dense_matrix_holds_every_item(spark, sf_dir, tmp_path):
    path = _wide(spark, sf_dir, tmp_path)
    codes = {r["id"]: ",".join(map(str, r["codes"])) for r in assigned(spark, path).collect()}
    got = {r["id"]: r["codes"] for r in QUERIES["sid_dense_matrix"](spark, path).collect()}
    assert len(codes) == 500 and got == {i: codes.get(i, "0,0") for i in range(2496)}
    assert {r["id"] for r in QUERIES["sid_dense_matrix"](spark, sf_dir).collect()} == set(range(2000))


def test_hash_embed_of_all_documents(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    got = {r["doc_id"]: (r["top"], r["used"], r["places"]) for r in QUERIES["hash_embed"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        ws = text.split()
        n = Counter(int(hashlib.md5(" ".join(ws[i : i + 3]).encode()).hexdigest()[-2:], 16) for i in range(len(ws)))
        top = max(n.values(), default=0) / max(sum(c * c for c in n.values()) ** 0.5, 1e-8)
        assert abs(got[d][0] - top) < 1e-6 and got[d][1:] == (len(n), "".join("1" if i in n else "0" for i in range(256)))


def test_learned_codes_by_plain_clustering(spark, sf_dir):
    """Two levels of eight codes, three updates each, seed 7: seeds drawn by squared distance, means weighed by all items a code has had."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, left = [r["vec_id"] for r in rows], np.asarray([r["embedding"] for r in rows], dtype=float)
    codes = []
    for seed in (7, 8):
        left = left / np.maximum(np.linalg.norm(left, axis=1, keepdims=True), 1e-12)
        near = lambda book, x=left: ((x[:, None, :] - book[None]) ** 2).sum(2).argmin(1)
        order, rng = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[i]}|{seed}".encode()).hexdigest()), np.random.default_rng(seed)
        pool = left[order]
        book = pool[[rng.integers(len(pool))]]
        while len(book) < 8:
            least = ((pool[:, None, :] - book[None]) ** 2).sum(2).min(1)
            book = np.vstack([book, pool[rng.choice(len(pool), p=least / least.sum())]])
        had = np.zeros(8)
        for _ in range(3):
            code = near(book)
            for k in set(code.tolist()):
                mine = left[code == k]
                had[k] += len(mine)
                book[k] += (mine.mean(0) - book[k]) * len(mine) / had[k]
        codes.append(near(book).tolist())
        left = left - book[codes[-1]]
    got = {r["vec_id"]: (r["c1"], r["c2"]) for r in QUERIES["kmeans_learned_codes"](spark, sf_dir).collect()}
    assert got == dict(zip(ids, zip(*codes, strict=True), strict=True))
    assert all(len(set(level)) > 4 for level in codes)
