"""Language identification by nearest clustered centroid.

A text is the TF-IDF vector of its byte 1- to 3-grams (lower-cased, runs of
bytes that belong to no letter count as one space), hashed into ``DIMS``
dimensions, with logarithmic term frequencies and unit length.  Document
frequencies come from all training texts.  Each language's training vectors
are clustered by spherical k-means, and a text goes to the language of its
nearest centroid by cosine.  Each centroid has a rejection radius, a high
quantile of its own training distances; a text outside the radius of its
nearest centroid is marked ``rejected``.

The clusters are fitted on at most ``fit_rows`` texts of a language, those of
the smallest hashed ids; everything else covers all texts.

Defined cases: null text and text without a letter are ``und`` with score 0;
rows without a language are not learnt from; with nothing to learn every text
is ``und``; repeated rows are predicted each; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm import common

DIMS = 4096
GRAMS = (1, 2, 3)
BATCH_ROWS = 256
#: Divides the cosine gaps in the score's softmax.
TEMPERATURE = 0.05
UNKNOWN = "und"
LETTER = r"\p{L}"

#: Lower-cased ASCII letters and bytes of longer characters as they are, all else a space.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by DIMS counts of the hashed n-grams of each row of a chunk."""
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    code = FOLD[data]
    inner = np.ones(len(code), dtype=bool)  # drop a space after a space
    inner[1:] = (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1])
    code, doc = code[inner].astype(np.uint64), doc[inner]
    out = np.zeros(rows * DIMS, dtype=np.int64)
    for n in GRAMS:
        if len(code) < n:
            break
        value = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            value = value * np.uint64(257) + code[j:len(code) - n + 1 + j]
        whole = doc[n - 1:] == doc[:len(doc) - n + 1]
        cell = (common.mix(value[whole]) % np.uint64(DIMS)).astype(np.int64)
        out += np.bincount(doc[:len(doc) - n + 1][whole] * DIMS + cell, minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each dimension, over all rows, and their number."""

    def count(batches):
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for _, data, offsets in common.text_chunks(batch.column("text"), max_rows=BATCH_ROWS):
                df += (gram_counts(data, offsets) > 0).sum(axis=0)
                n += len(offsets) - 1
        yield pa.record_batch({"dim": pa.array(np.arange(-1, DIMS)), "df": pa.array(np.append(n, df))})

    total = {r.dim: r.df for r in texts.select("text").mapInArrow(count, "dim long, df long")
             .groupBy("dim").agg(F.sum("df").alias("df")).toLocalIterator()}  # DIMS + 1 rows
    return np.array([total.get(d, 0) for d in range(DIMS)]), total.get(-1, 0)


def _clusters(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and each row's cosine to its own."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        total = np.stack([x[own == c].sum(axis=0) for c in range(len(centre))])
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre).astype(np.float32)
    return centre, x @ centre.T


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4,
          fit_rows: int = 2000, radius_quantile: float = 0.999, rounds: int = 12, seed: int = 5) -> dict:
    """Model: languages, centroids, their language and radius, idf."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # a bounded, hash-ordered sample per language, dealt by hash before it is cut
    rank = F.xxhash64("doc_id", F.lit(seed))
    sizes = known.groupBy("lang").count()
    part = (known.select("doc_id", "lang").join(sizes, "lang")
            .where((F.pmod(rank, F.lit(1 << 30)) / F.lit(float(1 << 30))) * F.col("count") < 0.9 * fit_rows)
            .select("doc_id", "lang"))
    # one row per id, so a repeated id takes no more than its place
    sample = (known.join(F.broadcast(part.select("doc_id").distinct()), "doc_id", "left_semi")
              .groupBy("lang", "doc_id").agg(F.min("text").alias("text")).withColumn("rank", rank))

    def fit(key, table):
        table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending")])
        column = table.column("text").combine_chunks()[:fit_rows]
        x = np.concatenate([vectors(gram_counts(data, offsets), idf)
                            for _, data, offsets in common.text_chunks(column, max_rows=BATCH_ROWS)])
        centre, cosine = _clusters(x, clusters, rounds, seed)
        own, best = cosine.argmax(axis=1), cosine.max(axis=1)
        radius = [float(np.quantile(1 - best[own == c], radius_quantile)) if (own == c).any() else 0.0 for c in range(len(centre))]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centre)),
                         "centre": pa.array([c.astype(np.float32).tobytes() for c in centre], pa.binary()),
                         "radius": pa.array(radius, pa.float64())})

    fitted = sample.groupBy("lang").applyInArrow(fit, "lang string, centre binary, radius double").collect()
    fitted.sort(key=lambda r: (r.lang, r.centre))
    return {"idf": idf, "langs": [r.lang for r in fitted], "radius": np.array([r.radius for r in fitted]),
            "centres": np.array([np.frombuffer(r.centre, np.float32) for r in fitted]).reshape(-1, DIMS)}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus lang_pred, score, rejected, distance."""
    names = sorted(set(model["langs"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "rejected", "distance")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
                       + ["lang_pred string, score double, rejected boolean, distance double"])

    def label(batches):
        m = shared.value
        lang = np.array([names.index(x) for x in m["langs"]], dtype=np.int64)
        for batch in batches:
            pred, score, far, dist = [], [], [], []
            lettered = batch.column("__lettered").to_pylist()
            for lo, data, offsets in common.text_chunks(batch.column(text_col), max_rows=BATCH_ROWS):
                rows = len(offsets) - 1
                if not names:
                    best = np.full((rows, 1), -1.0)
                    own = np.zeros(rows, dtype=np.int64)
                else:
                    cosine = vectors(gram_counts(data, offsets), m["idf"]) @ m["centres"].T
                    own = cosine.argmax(axis=1)
                    best = np.stack([cosine[:, lang == i].max(axis=1) for i in range(len(names))], axis=1).astype(np.float64)
                weight = np.exp((best - best.max(axis=1, keepdims=True)) / TEMPERATURE)
                for i in range(rows):
                    if not names or not lettered[lo + i]:
                        pred.append(UNKNOWN), score.append(0.0), far.append(True), dist.append(1.0)
                        continue
                    top, d = lang[own[i]], float(1 - best[i].max())
                    pred.append(names[top]), score.append(float(weight[i, top] / weight[i].sum()))
                    dist.append(d), far.append(bool(d > m["radius"][own[i]]))
            yield pa.record_batch([batch.column(c) for c in carried]
                                  + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_()), pa.array(dist, pa.float64())],
                                  names=[*carried, "lang_pred", "score", "rejected", "distance"])

    text = F.col(text_col)
    return (docs.select(*carried, text, F.coalesce(text.rlike(LETTER), F.lit(False)).alias("__lettered"))
            .mapInArrow(label, schema))
