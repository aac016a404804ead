"""Ranked lexical search against brute force over whole texts, and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from txnrisk.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, term string, place int, block long, score long, item string"
ITEMS = "item_id long, text string, bundle int, slot int, df long"


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(items, docs, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            length, score = sum(c.values()), 0
            for t, times in terms.items():
                if c[t]:
                    m = 25 + 75 * length * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, items, docs, **how):
    a = spark.createDataFrame([(*r, 1, 2, 3) for r in items], ITEMS)
    b = spark.createDataFrame([(*r, "t", 1, 2, 3, "i") for r in docs], DOCS)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ls.search(a, b, **how).collect()), key=str)


VOCAB = ["Wort%d" % i for i in range(80)] + ["été", "日本", "a1", "İx", "ÀB"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(VOCAB) + 1)
    return [(int(i), rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choice(VOCAB, rng.integers(1, 90), p=weights / weights.sum()))) for i in range(n)]


EXTRA = [(1000, None), (1001, ""), (1002, " .,;\x00"), (1003, "Wort1 " * 5000), (1004, "x"), (None, "Wort3 Wort4 été"), (None, None)]
ITEMS_ROWS = [(1, "Wort1 wort2 WORT2, İx"), (2, "ÉTÉ été 日本"), (3, "nothing here is known"), (4, None), (5, ""), (None, "a1 wort9"), (1, "Wort30"),
              (7, "x"), (8, " ".join(VOCAB))]


@pytest.mark.parametrize("owners", [1, 4])
def test_against_brute_force(spark, owners, monkeypatch):
    docs = corpus(400, 1) + EXTRA
    docs += [(2000 + i, docs[3][1]) for i in range(50)] + [docs[5], docs[5]]  # ties, and repeated rows
    monkeypatch.setattr(ls, "BUNDLE_TERMS", 64)
    got = found(spark, ITEMS_ROWS, docs, owners=owners)
    assert got == brute(ITEMS_ROWS, docs) and {r[0] for r in got} == {1, 2, 7, 8, None}


def test_empty_tables(spark):
    assert found(spark, [], corpus(5, 2)) == found(spark, ITEMS_ROWS, []) == found(spark, ITEMS_ROWS, [(1, None)]) == []
    assert found(spark, [(3, "unknown")], corpus(5, 2)) == []


def test_several_blocks(spark, monkeypatch):
    docs = corpus(900, 4)
    monkeypatch.setattr(ls, "BLOCK_DOCS", 256)
    assert found(spark, ITEMS_ROWS, docs, k=3) == brute(ITEMS_ROWS, docs, k=3)


def test_terms_of_bytes():
    texts = [t for _, t in corpus(30, 6)] + [None, "A-Z a_z 09 \x80é{}~", "", "end"]
    data = pa.array(texts, pa.string())
    (_, buf, offsets), = ls.text_chunks(data)
    lowered, starts, ends, first = ls._terms(buf, offsets)
    words = [lowered[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == [split(t) for t in texts]
