"""Substring deduplication behind a count-min prefilter.

A window is ``window`` consecutive words.  A word is removed when it lies in a
window whose word sequence also starts in a document with a smaller doc_id.

1. Every window is represented by the smallest hash among its ``gram``-word
   grams.  Equal windows have equal representatives, so a representative
   occurs at least as often as any window it stands for, and neighbouring
   windows mostly share one (about 1 position in 18 is picked).
2. Each task sketches its representatives (count-min, two rows); the sketches
   are merged by block, and the cells that reached two make two bitmaps of
   fixed size (``2 * 2 ** CELL_BITS / 8`` bytes, the only thing broadcast).
3. A second pass keeps only runs of windows whose representative is estimated
   to repeat and groups them exactly: whole runs first (one row per run, with
   map-side combining), then, among different runs that share a
   representative, window by window.

The sketch only overestimates, so no repeated window is lost.  When a corpus
outgrows the cells more runs pass the prefilter; the exact grouping then does
more of the work, up to one row per representative, with the same result.

Defined cases: null or empty text has no words; texts under ``window`` words
stay whole; rows with a null doc_id stay whole and are no source; rows
repeated under one doc_id are one document, cut alike; ties cannot arise (the
smallest doc_id is unique); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm import common, countmin
from txnrisk.llm.common import staged

CELL_BITS = 27
SKETCH_ROWS = 2


def _runs(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of windows with one representative: (document, first window,
    windows, representative's position, its hash).  ``first`` has each
    document's first word (documents + 1 entries)."""
    grams = common.gram_hashes(words, gram, seed=31)
    span = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    picked = np.empty(n, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for lo in range(0, n, 1 << 17):
        part = view[lo:lo + (1 << 17)]
        picked[lo:lo + len(part)] = part.argmin(axis=1) + np.arange(lo, lo + len(part))
    doc = np.searchsorted(first, np.arange(n), side="right") - 1
    whole = np.arange(n) + window <= first[doc + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    change = np.ones(len(at), dtype=bool)
    change[1:] = (picked[at[1:]] != picked[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    head = np.flatnonzero(change)
    size = np.diff(np.append(head, len(at)))
    start = at[head]
    return doc[start], start, size, picked[start], grams[picked[start]]


def _documents(batch, window: int, gram: int):
    """Per chunk of a batch: (first row, words' hashes, words' row starts, runs)."""
    for lo, data, offsets in common.text_chunks(batch.column("text")):
        starts, ends, first = common.word_bounds(data, offsets)
        words = common.word_hashes(data, starts, ends)
        yield lo, words, first, _runs(words, first, window, gram)


def sketch(docs: DataFrame, window: int, gram: int) -> list[np.ndarray]:
    """Per sketch row the bitmap of the cells counted at least twice."""

    def count(batches):
        keys = (run[4] for batch in batches for _, _, _, run in _documents(batch, window, gram))
        yield from countmin.sketch_batches(keys, SKETCH_ROWS, CELL_BITS)

    return countmin.merged_bitmaps(docs.select("text").mapInArrow(count, countmin.SCHEMA), SKETCH_ROWS, CELL_BITS)


def repeated_runs(docs: DataFrame, bitmaps, window: int, gram: int) -> DataFrame:
    """Runs whose representative is estimated to repeat: doc_id, rep, span,
    start, and the hash of each of the run's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def pick(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, words, _first, (doc, start, size, at, rep) in _documents(batch, window, gram):
                if not len(rep):
                    continue
                hit = np.flatnonzero(countmin.estimated_twice(shared.value, rep, CELL_BITS))
                if not len(hit):
                    continue
                grams = common.gram_hashes(words, window, seed=37)
                doc, start, size, at, rep = (x[hit] for x in (doc, start, size, at, rep))
                wins = [grams[s:s + n] for s, n in zip(start, size)]
                where = common.mix((at - start).astype(np.uint64) * np.uint64(1 << 32) + size.astype(np.uint64))
                order = common.mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
                span = common.mix(np.array([np.bitwise_xor.reduce(common.mix(w + order[:len(w)])) for w in wins],
                                           dtype=np.uint64) ^ where)
                yield pa.record_batch({
                    "doc_id": ids.take(pa.array(doc + lo)),
                    "rep": pa.array(common.signed(rep)), "span": pa.array(common.signed(span)),
                    "start": pa.array((start - _first[doc]).astype(np.int32)), "n": pa.array(size.astype(np.int32)),
                    "wins": pa.array([w.tobytes() for w in wins], pa.binary())})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        pick, "doc_id long, rep long, span long, start int, n int, wins binary")


def later_windows(runs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): word ranges that earlier documents hold too."""
    kinds = staged(runs.groupBy("rep", "span").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                   F.min("wins").alias("wins")), "run_kinds")
    several = kinds.groupBy("rep").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("rep")

    def unpack(batches):
        for batch in batches:
            blobs = batch.column("wins").to_pylist()
            n = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
            row = np.repeat(np.arange(len(n)), n)
            take = pa.array(row)
            yield pa.record_batch({
                "rep": batch.column("rep").take(take), "span": batch.column("span").take(take),
                "first": batch.column("first").take(take),
                "k": pa.array((np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)),
                "win": pa.array(np.frombuffer(b"".join(blobs), dtype=np.int64))})

    windows = (kinds.join(several, "rep", "left_semi").select("rep", "span", "first", "wins")
               .mapInArrow(unpack, "rep long, span long, first long, k int, win long"))
    windows = staged(windows, "windows")
    least = windows.groupBy("rep", "win").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    earlier = (windows.join(least, ["rep", "win"]).where("least < first")
               .groupBy("rep", "span").agg(F.collect_list(F.struct("k", "least")).alias("earlier")))
    # whole runs that an earlier document has, and single windows that one has
    verdict = (kinds.join(earlier, ["rep", "span"], "left").where("first < last OR earlier IS NOT NULL")
               .select("rep", "span", "first", "earlier"))
    verdict = staged(verdict, "verdict")  # so that the join below can split a hot run's rows
    found = runs.drop("wins").join(verdict, ["rep", "span"])
    whole = F.when(F.col("first") < F.col("doc_id"), F.array(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("stop"))))
    single = F.transform(F.filter(F.coalesce("earlier", F.array().cast("array<struct<k:int,least:bigint>>")),
                                  lambda e: e["least"] < F.col("doc_id")),
                         lambda e: F.struct((F.col("start") + e["k"]).alias("start"), (F.col("start") + e["k"] + 1).alias("stop")))
    return (found.select("doc_id", F.explode(F.coalesce(whole, single)).alias("r"))
            .select("doc_id", "r.start", "r.stop"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = 50, gram: int = 16) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bitmaps = sketch(rows, window, gram)
    runs = repeated_runs(rows, bitmaps, window, gram)
    cuts = (later_windows(runs).groupBy("doc_id")
            .agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))

    def cut(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_text": []}
            cuts = batch.column("cuts").to_pylist()
            for lo, data, offsets in common.text_chunks(batch.column("text")):
                starts, ends, first = common.word_bounds(data, offsets)
                raw = data.tobytes()
                for d in range(len(offsets) - 1):
                    a, b = first[d], first[d + 1]
                    gone = np.zeros(b - a + 1, dtype=np.int32)
                    for c in cuts[lo + d] or ():
                        gone[c["start"]] += 1
                        gone[c["stop"] + window - 1] -= 1
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    out["n_words"].append(int(b - a))
                    out["n_removed"].append(int(b - a - len(keep)))
                    out["kept_text"].append(b" ".join([raw[s:e] for s, e in zip(starts[keep], ends[keep])]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()),
                                   "n_removed": pa.array(out["n_removed"], pa.int64()),
                                   "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string())})

    return rows.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string")
