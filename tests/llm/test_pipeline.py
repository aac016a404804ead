"""The whole pipeline against its stages' definitions, on rows with nulls, repeats, empty texts and clashing column names."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p string, only string, quality_score double, node long, copy int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["w%d" % i for i in range(300)]


def prose(n, seed):
    return ". ".join(" ".join(np.random.default_rng(seed + k).choice(VOCAB, 9)).capitalize() for k in range(n)) + "."


def rows():
    texts = [prose(12, 100 * i) for i in range(40)]
    texts += [texts[3], texts[3], texts[4] + " end", None, "", "a b"]
    out = [(i, t, "en", ("s1", "s2", None)[i % 3], 1, "p", "o", 0.1, 7, 1) for i, t in enumerate(texts)]
    return out + [out[5], (None, prose(9, 9999), None, None, None, None, None, None, None, None), (None,) * 10]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        docs = cp.staged(docs, "test")
        seen.append([r.asDict() for r in docs.collect()])
    quality, exact, near, mixed, encoded = seen
    assert {r["quality_score"] for r in quality} <= {0.1, None}  # an input column, kept
    # exact: one row per text, the largest id
    best = {}
    for r in quality:
        key = r["text"] or ""
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(best.items()) == sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in exact)
    # near: the smallest id of every group of similar texts
    sets = {r["doc_id"]: shingles(r["text"]) for r in exact if r["doc_id"] is not None}
    head = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    head[a] = head[b] = min(head[a], head[b])
    want = sorted(i for i in head if head[i] == i)
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == want
    # mixing: copies by the document's draw
    sizes = {}
    for r in near:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    whole, weight = sum(sizes.values()), sum(n ** 0.5 for n in sizes.values())
    for r in near:
        rate = whole / weight * sizes[r["source"]] ** -0.5
        name = "null" if r["doc_id"] is None else str(r["doc_id"])
        u = int(hashlib.sha256(f"{name}|2024|0".encode()).hexdigest()[:13], 16) / 2.0**52
        n, p, c = 0, np.exp(-rate), np.exp(-rate)
        while c <= u and n < 80:
            n, p = n + 1, p * rate / (n + 1)
            c += p
        if r["doc_id"] is not None:
            assert sum(m["doc_id"] == r["doc_id"] for m in mixed) == n, r["doc_id"]
    # encoding: as the library does
    import public_tokenizers
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.TOKENIZER))
    texts = {r["doc_id"]: r["text"] or "" for r in mixed if r["doc_id"] is not None}
    assert len(encoded) == len(mixed)
    for r in encoded:
        if r["doc_id"] is not None:
            assert list(r["ids"]) == lib.encode(texts[r["doc_id"]])


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
