"""Context-triggered piecewise hashing of documents.

A rolling hash over the last 7 bytes decides, from the text alone, where a
chunk ends: a position whose hash has ``k`` trailing zero bits ends a chunk of
size level ``k``, so the ends of level k+1 are some of those of level k.  A
text takes the smallest level (2 at least) at which it has at most 64 chunks;
its fingerprint is ``block:signature:signature``, one letter per chunk at that
level and at the next.  An edit changes the letters it touches and no others.
Two fingerprints are compared where they hold signatures of the same block
size, by insert/delete edit distance, once they share a run of 4 letters
(half of a signature shorter than 8).

Memory is bounded by a batch of texts, or a few pieces of one long text; the
signatures read every byte.

``next_likeness`` also edits each text with the beginning of the next document
in order of ids.  Documents are dealt by ranges of ids and streamed in order,
with one document looked ahead; the last of a range meets the first of the
next through a table of two rows a range.

Defined cases: a null text is empty; an empty text has the fingerprint ``4::``,
equal to itself and unlike any other; rows without an id come after those with
one; rows that share an id are documents of their own, ordered by a hash of
their text and following one another; a table of one document has itself as
the next; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from txnrisk.llm.common import byte_codes, mix, powers, staged, text_chunks

WINDOW = 7
LEAST_LEVEL = 2
MOST_CHUNKS = 64
#: Letters in a row that two signatures must share before they count as alike (half of a signature shorter than 8).
COMMON_RUN = 4
#: Bytes of one long text hashed at a time.
PIECE = 4 << 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_CODES = byte_codes(29)
_BASE = powers(0x9E3779B97F4A7C15, WINDOW)


def _rolling(data: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Hash of the up to 7 bytes ending at each position; ``depth`` is the position's distance from its text's start."""
    codes = _CODES[data]
    out = codes.copy()
    for j in range(1, min(WINDOW, len(data))):
        out[j:] += codes[:-j] * _BASE[j] * (depth[j:] >= j)
    return mix(out)


def _levels(hashes: np.ndarray) -> np.ndarray:
    """Trailing zero bits of each hash."""
    low = hashes & (~hashes + np.uint64(1))
    return np.where(low == 0, 63, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)


def _letters(sums: np.ndarray) -> np.ndarray:
    """A letter per chunk, from the running sums of hashes at the chunks' ends (the first chunk starts at sum 0)."""
    return ALPHABET[(mix(np.diff(sums, prepend=np.uint64(0))) >> np.uint64(58)).astype(np.int64)]


def _long_text(data: np.ndarray) -> str:
    """Fingerprint of one long text, piece by piece; only ends that can still matter are held."""
    ends, levels, sums = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    total, least = np.uint64(0), LEAST_LEVEL
    for lo in range(0, len(data), PIECE):
        back = min(lo, WINDOW - 1)
        part = data[lo - back:lo + PIECE]
        hashes = _rolling(part, np.arange(lo - back, lo - back + len(part)))[back:]
        running = np.cumsum(hashes) + total
        total = running[-1]
        at = np.flatnonzero(hashes & np.uint64((1 << least) - 1) == 0)
        ends, levels = np.concatenate([ends, at + lo]), np.concatenate([levels, _levels(hashes[at])])
        sums = np.concatenate([sums, running[at]])
        while (levels >= least).sum() > MOST_CHUNKS - 1:
            least += 1
        held = levels >= least
        ends, levels, sums = ends[held], levels[held], sums[held]

    def signature(level: int) -> str:
        own = levels >= level
        tail = [] if own.any() and ends[own][-1] == len(data) - 1 else [total]
        return _letters(np.concatenate([sums[own], np.array(tail, np.uint64)])).tobytes().decode()

    return f"{1 << least}:{signature(least)}:{signature(least + 1)}"


def _short_texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    n, lengths = len(offsets) - 1, np.diff(offsets)
    if not len(data):
        return [f"{1 << LEAST_LEVEL}::"] * n
    hashes = _rolling(data, np.arange(len(data)) - np.repeat(offsets[:-1], lengths))
    running = np.cumsum(hashes)
    at = np.flatnonzero(hashes & np.uint64((1 << LEAST_LEVEL) - 1) == 0)
    level, row = _levels(hashes[at]), np.searchsorted(offsets, at, side="right") - 1
    counts = np.bincount(row * 64 + level, minlength=n * 64).reshape(n, 64)
    reach = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # ends of this level or a higher one
    own = (reach[:, LEAST_LEVEL:] <= MOST_CHUNKS - 1).argmax(axis=1) + LEAST_LEVEL
    last = offsets[1:][lengths > 0] - 1
    signatures = []
    for add in (0, 1):
        ends = np.union1d(at[level >= own[row] + add], last)
        letters = _letters(running[ends]).tobytes().decode()
        cut = np.searchsorted(ends, offsets)
        signatures.append([letters[a:b] for a, b in zip(cut[:-1], cut[1:])])
    return [f"{1 << k}:{a}:{b}" for k, a, b in zip(own, *signatures)]


def fingerprints(column) -> list[str]:
    """Fingerprint of every text of an Arrow column."""
    out = []
    for _, data, offsets in text_chunks(column):
        out += [_long_text(data)] if len(offsets) == 2 and len(data) > PIECE else _short_texts(data, offsets)
    return out


# ------------------------------------------------------------------ comparison
def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    run = min(COMMON_RUN, (min(len(a), len(b)) + 1) // 2)
    if not run:
        return 0.0
    grams = {a[i:i + run] for i in range(len(a) - run + 1)}
    if not any(b[i:i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _common_length(a, b) / (len(a) + len(b))  # 1 - edit distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints; equal ones give 1, sizes that differ by more than a factor of 2 give 0."""
    if a == b:
        return 1.0
    (ka, a0, a1), (kb, b0, b1) = a.split(":"), b.split(":")
    ka, kb = int(ka), int(kb)
    if ka == kb:
        return max(_alike(a0, b0), _alike(a1, b1))
    if ka == 2 * kb:
        return _alike(a0, b1)
    return _alike(a1, b0) if kb == 2 * ka else 0.0


# ------------------------------------------------------------------- operators
def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a further column (a column of that name is replaced)."""
    kept = docs.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(batch.column(text_col)), pa.string())],
                                             names=schema.fieldNames())

    return kept.mapInArrow(add, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _compared(rows: list[tuple]) -> dict:
    """Columns for rows (doc_id, text, fingerprint, next text, next fingerprint)."""
    changed = [edited(t, following) for _, t, _, following, _ in rows]
    prints = fingerprints(pa.array(changed, pa.large_string()))
    return {"doc_id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [r[2] for r in rows], "edited_fingerprint": prints,
            "near_edited": [likeness(r[2], p) for r, p in zip(rows, prints)],
            "near_next": [likeness(r[2], r[4]) for r in rows]}


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _batch(columns: dict, kind: str, where: int, text: list) -> pa.RecordBatch:
    n, types = len(columns["doc_id"]), dict(n_chars=pa.int64(), doc_id=pa.int64(), near_edited=pa.float64(), near_next=pa.float64())
    full = {"kind": [kind] * n, "range": pa.array([where] * n, pa.int32()), "text": pa.array(text, pa.string())}
    for c in (x.split()[0] for x in RESULT.split(", ")):
        full[c] = pa.array(columns.get(c, [None] * n), types.get(c, pa.string()))
    return pa.record_batch(full)


_STAGED = "kind string, range int, text string, " + RESULT


def _stream(batches):
    """One range of documents in order: every document but the last is compared with its next one."""
    where, held = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, lo = batch.column("doc_id").to_pylist(), 0
        sizes = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIECE, side="right")))
            part = batch.column("text").slice(lo, hi - lo)
            rows = [(i, t, f) for i, t, f in zip(ids[lo:hi], part.to_pylist(), fingerprints(part))]
            if held is None:
                yield _batch({"doc_id": [rows[0][0]], "fingerprint": [rows[0][2]]}, "head", where, [rows[0][1]])
            else:
                rows.insert(0, held)
            if len(rows) > 1:
                yield _batch(_compared([(*a, *b[1:]) for a, b in zip(rows, rows[1:])]), "done", where, [None] * (len(rows) - 1))
            held, lo = rows[-1], hi
    if held is not None:
        yield _batch({"doc_id": [held[0]], "fingerprint": [held[2]]}, "open", where, [held[1]])


def _close(batches):
    for batch in batches:
        for r in batch.to_pylist():  # one row per range, each with two whole texts
            one = _compared([(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_print"])])
            yield _batch(one, "done", r["range"], [None])


def next_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # The hash orders rows of one id; the row number only spreads equal rows over several ranges.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("spread")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = staged(ranged.mapInArrow(_stream, _STAGED), "fingerprints")
    heads = found.where("kind = 'head'")
    # One narrow row per range of documents.
    nexts = heads.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")),
                                             F.min("range").over(Window.partitionBy(F.lit(0)))).alias("after"))
    ends = (found.where("kind = 'open'").select("range", "doc_id", "text", "fingerprint").join(nexts, "range")
            .join(heads.select(F.col("range").alias("after"), F.col("text").alias("next_text"),
                               F.col("fingerprint").alias("next_print")), "after"))
    closed = ends.select("range", "doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_close, _STAGED)
    columns = [x.split()[0] for x in RESULT.split(", ")]
    return found.where("kind = 'done'").select(*columns).unionByName(closed.select(*columns))
