"""Context-triggered fingerprints: a slow row-by-row twin, pieces of long texts, and the order of documents."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from txnrisk.llm import fuzzy_fingerprint as ff
from txnrisk.llm.common import byte_codes, mix

SCHEMA = "doc_id long, text string, kind string, range int, next_text string, tie long, fingerprint string"
rng = np.random.default_rng(3)
WORDS = ["w%d" % i for i in range(900)]
LONG = " ".join(rng.choice(WORDS, 40000))


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def slow_print(text):
    """The definition, a byte at a time."""
    data = (text or "").encode()
    codes, total, ends = [int(x) for x in byte_codes(29)], 0, []
    for i in range(len(data)):
        h = sum(codes[data[i - j]] * pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(min(ff.WINDOW, i + 1))) % 2**64
        h = int(mix(np.array([h], np.uint64))[0])
        total = (total + h) % 2**64
        ends.append(((h & -h).bit_length() - 1 if h else 63, total))
    level = 2
    while sum(k >= level for k, _ in ends) > 63:
        level += 1
    out = []
    for k in (level, level + 1):
        sums = [s for e, (lv, s) in enumerate(ends) if lv >= k or e == len(ends) - 1]
        marks = [int(mix(np.array([(b - a) % 2**64], np.uint64))[0]) >> 58 for a, b in zip([0, *sums], sums)]
        out.append("".join(chr(ff.ALPHABET[m]) for m in marks))
    return f"{1 << level}:{out[0]}:{out[1]}"


def slow_likeness(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, d in enumerate(y, 1):
                row.append(old[j - 1] if c == d else 1 + min(old[j], row[j - 1]))
        return row[-1]

    if a == b:
        return 1.0
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    best = 0.0
    for i, x in enumerate(sa):
        for j, y in enumerate(sb):
            run = min(4, (min(len(x), len(y)) + 1) // 2)
            shared = run and any(x[p:p + run] in y for p in range(len(x) - run + 1))
            if int(ka) << i == int(kb) << j and shared and (i, j) in ((0, 0), (1, 1), (0, 1), (1, 0)):
                if not (i == j and ka != kb):
                    best = max(best, 1 - distance(x, y) / (len(x) + len(y)))
    return best


TEXTS = [None, "", "a", "ab cd", "one two three", "éé 日本 😀 x" * 3, prose(40, 1), prose(40, 1), prose(400, 2), prose(400, 2) + " end", "o" * 5000,
         prose(3000, 4), LONG[:30000]]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_definition(text):
    assert ff.fingerprints(pa.array([text], pa.string())) == [slow_print(text)]


def test_batch_equals_single_texts_and_pieces(monkeypatch):
    column = pa.array(TEXTS + [LONG], pa.string())
    together = ff.fingerprints(column)
    assert together == [ff.fingerprints(pa.array([t], pa.string()))[0] for t in TEXTS + [LONG]]
    monkeypatch.setattr(ff, "PIECE", 997)
    assert ff.fingerprints(pa.array([LONG], pa.string())) == together[-1:]
    assert all(len(s) <= ff.MOST_CHUNKS for f in together for s in f.split(":")[1:])


def test_likeness_twin():
    prints = ff.fingerprints(pa.array([t or "" for t in TEXTS] + [ff.edited(t or "", LONG) for t in TEXTS], pa.string()))
    for a in prints:
        for b in prints:
            assert ff.likeness(a, b) == pytest.approx(slow_likeness(a, b)) == pytest.approx(ff.likeness(b, a))
    assert ff.likeness(prints[8], prints[9]) > 0.9 and ff.likeness(prints[8], prints[11]) == 0


def expected(rows):
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        new = text[:len(text) - cut] + following[:cut]
        fp, fe, fn = slow_print(text), slow_print(new), slow_print(following)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fp, fe, round(slow_likeness(fp, fe), 9),
                    round(slow_likeness(fp, fn), 9)))
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_next_documents(spark, partitions):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)]
    full = [(i, t, "done", 1, "n", 5, "f") for i, t in rows]
    out = ff.next_likeness(spark.createDataFrame(full[::-1], SCHEMA).repartition(partitions))
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                  round(r.near_next, 9)) for r in out.collect())
    assert got == expected(rows)


def test_edges(spark):
    assert ff.next_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = ff.next_likeness(spark.createDataFrame([(5, prose(60, 9), *[None] * 5)], SCHEMA)).first()
    assert one.near_next == 1.0 and one.n_chars == len(prose(60, 9))
    twins = [(1, prose(60, 9)), (1, prose(60, 9)), (1, prose(60, 8)), (None, "x"), (None, "x"), (None, None)]
    out = ff.next_likeness(spark.createDataFrame([(*r, *[None] * 5) for r in twins], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in out) == sorted((i or -1, slow_print(t)) for i, t in twins)
    named = ff.fingerprint_documents(spark.createDataFrame([(1, "one two", *["x"] * 1, 2, "n", 3, "old")], SCHEMA)).first()
    assert named.fingerprint == slow_print("one two") and named.kind == "x"
