"""Line-run deduplication by winnowing (DataFrame functions only).

A run is ``min_run`` or more consecutive non-blank lines of one document.  A
line goes when it lies in a run whose line sequence also starts earlier: in a
document with a smaller doc_id, or in the same document further up.

Winnowing picks, in every window of ``min_run`` line hashes, the smallest
one; equal windows pick the same line, so a repeated run is sure to share a
fingerprint.  Every window is staged with its hashes; fingerprints at more than
one position only narrow the windows down (a semi-join).  Repeats are then
found by grouping whole windows, which stands in for joining fingerprint
positions and extending each match: a run of any length is made up of its
overlapping windows, each of which repeats an earlier one.

Defined cases: null or empty text has no lines; blank lines are never matched
and stay; a document without ``min_run`` lines stays whole; rows with a null
doc_id stay whole and are no source; rows repeated under one doc_id are one
document and both are cut alike; other columns are returned unchanged by
``remove_repeated_runs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.common import staged

NEWLINE = "\n"


def _windows(docs: DataFrame, id_col: str, text_col: str, min_run: int) -> DataFrame:
    """(doc_id, at, run, lines): per window its first line's rank, the line
    hashes, and the line numbers it covers."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), NEWLINE, -1),
                             lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))),
                 lambda p: p["x"] != "").alias("p"))
    lines = lines.where(F.size("p") >= min_run).select(
        "doc_id", F.transform("p", lambda p: p["i"]).alias("at_line"),
        F.transform("p", lambda p: F.xxhash64(p["x"])).alias("h"))
    return (lines.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("h") - (min_run - 1))))
            .select("doc_id", "at", F.slice("h", F.col("at"), min_run).alias("run"),
                    F.slice("at_line", F.col("at"), min_run).alias("lines"))
            # the window's minimum; of equal ones the rightmost
            .withColumn("fp", F.array_min("run"))
            .withColumn("fp_at", F.col("at") + min_run - F.array_position(F.reverse("run"), F.col("fp")).cast("int")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_run: int = 3) -> DataFrame:
    """(doc_id, line): the line numbers (from 0) that repeat an earlier run."""
    windows = staged(_windows(docs, id_col, text_col, min_run), "windows")
    place = F.struct("doc_id", "fp_at")
    shared = (windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a <> b").select("fp"))
    near = windows.join(shared, "fp", "left_semi")
    first = (near.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("first"),
                                     F.max(F.struct("doc_id", "at")).alias("last"))
             .where("first <> last").select("run", "first"))
    later = near.join(first, "run").where(F.struct("doc_id", "at") > F.col("first"))
    return later.select("doc_id", F.explode("lines").alias("line")).distinct()


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_run: int = 3) -> DataFrame:
    """``docs`` with later repeated runs cut from the text, plus n_lines and
    n_removed (lines without the blank ones)."""
    cut = (repeated_lines(docs, id_col, text_col, min_run)
           .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__cut")))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), NEWLINE, -1)
    gone = F.coalesce(F.col("__cut"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return (docs.join(cut, docs[id_col].cast("long") == F.col("__id"), "left")
            .withColumns({
                "n_lines": F.size(F.filter(lines, lambda x: F.trim(x) != "")),
                "n_removed": F.size(gone),
                text_col: F.when(F.col(text_col).isNotNull(), F.when(F.size(gone) == 0, F.col(text_col)).otherwise(
                    F.array_join(F.transform(kept, lambda i: F.get(lines, i)), NEWLINE)))})
            .drop("__id", "__cut"))
