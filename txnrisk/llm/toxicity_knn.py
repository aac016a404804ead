"""Toxicity by the nearest labelled examples, by TF-IDF cosine over selected terms.

Terms are words and word beginnings.  The vocabulary holds only the terms that
the labelled examples associate with either class (chi-square of 20 at least,
``max_terms`` at most), so the neighbours are not those by the texts' whole
TF-IDF vectors, and a text of toxic words too rare among the examples gets the
prior; the README has figures against the whole vocabulary.  Document
frequencies of the terms are counted over the whole corpus.  The examples
form an inverted index cut into blocks of documents, and every term stores its
largest weight in each block.  A text's products with those maxima bound its
cosine to any example of a block; blocks are scored in falling order of their
bound until the next bound cannot enter the k nearest, so the k nearest over
these terms are exact.  Each neighbour votes with its similarity (one less its distance)
against a prior weight, and the vote is calibrated on the examples' own
leave-one-out votes.  The neighbours and the terms that matched are the
evidence.

At most ``fit_rows`` labelled examples, those of the smallest hashed ids, are
indexed; the corpus statistics and the scores cover all texts in full.

Defined cases: null or empty text, and text without a vocabulary term, have no
neighbours and get the calibrated prior; ties between neighbours go to the
smaller example number; with no labelled examples every score is 0; repeated
rows are scored each; other columns are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"\w+")
#: Beginnings of words that count as terms, by length.
STEMS = (4, 5)
BLOCK = 64


def terms_of(text: str | None, vocabulary=None) -> dict[str, int]:
    """Term counts; with a vocabulary only its terms."""
    if not text:
        return {}
    words: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        words[w] = words.get(w, 0) + 1
    out: dict[str, int] = {}
    for w, c in words.items():
        for t in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
            if vocabulary is None or t in vocabulary:
                out[t] = out.get(t, 0) + c
    return out


def sample_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, seed: int) -> list:
    """At most ``fit_rows`` (text, label) rows, of the smallest hashed ids."""
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
           .orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(fit_rows))
    return (docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(ids), id_col)
            .orderBy(F.xxhash64(id_col, F.lit(seed)), id_col, "text").limit(fit_rows).select(id_col, "text", "y").collect())


def choose_terms(counts: list[dict], y: np.ndarray, max_terms: int, least_chi2: float = 20.0) -> list[str]:
    """Terms by chi-square with the label, most telling first."""
    seen: dict[str, list[int]] = {}
    for c, label in zip(counts, y):
        for t in c:
            seen.setdefault(t, [0, 0])[int(label)] += 1
    n, pos = len(y), int(y.sum())
    scored = []
    for t, (neg_df, pos_df) in seen.items():
        df = neg_df + pos_df
        spread = df * (n - df) * pos * (n - pos)
        if df > 1 and spread:
            scored.append((-n * (pos_df * n - df * pos) ** 2 / spread, t))
    return [t for x, t in sorted(scored)[:max_terms] if -x >= least_chi2]


def corpus_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Texts holding each vocabulary term, over all rows, and their number."""
    index = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches):
        df, n = np.zeros(len(index.value), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                for t in terms_of(text.as_py(), index.value):
                    df[index.value[t]] += 1
                n += 1
        yield pa.record_batch({"term": pa.array(np.arange(-1, len(df))), "df": pa.array(np.append(n, df))})

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator())  # one row per vocabulary term
    total = {r.term: r.df for r in rows}
    return np.array([total.get(i, 0) for i in range(len(vocabulary))], dtype=np.int64), total.get(-1, 0)


def weigh(counts: dict[str, int], index: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit-length TF-IDF weights of one text."""
    at = np.array(sorted(index[t] for t in counts), dtype=np.int64)
    if not len(at):
        return at, np.zeros(0)
    by_number = {index[t]: c for t, c in counts.items()}
    w = np.array([1 + np.log(by_number[i]) for i in at]) * idf[at]
    return at, w / np.sqrt(w @ w)


class BlockIndex:
    """Postings by term and block of examples, with each block's largest weight."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(examples)
        self.blocks = -(-self.n // BLOCK)
        self.top = np.zeros((n_terms, self.blocks))
        postings: dict[tuple[int, int], list] = {}
        for e, (at, w) in enumerate(examples):
            b = e // BLOCK
            for t, x in zip(at, w):
                postings.setdefault((int(t), b), []).append((e % BLOCK, x))
                self.top[t, b] = max(self.top[t, b], x)
        self.postings = {k: (np.array([e for e, _ in v]), np.array([x for _, x in v])) for k, v in postings.items()}

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, number)."""
        best: list[tuple[float, int]] = []
        if not len(at):
            return best
        bound = w @ self.top[at]
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] * (1 - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, x in zip(at, w):
                if (hit := self.postings.get((int(t), int(b)))) is not None:
                    score[hit[0]] += x * hit[1]
            for e in np.flatnonzero(score > 0):
                if (number := int(b) * BLOCK + int(e)) != skip:
                    best.append((float(score[e]), number))
            best = sorted(best, key=lambda p: (-p[0], p[1]))[:k]
        return best


def vote(near: list[tuple[float, int]], y: np.ndarray, prior: float, strength: float) -> float:
    weight = sum(s for s, _ in near)
    return (sum(s * y[e] for s, e in near) + strength * prior) / (weight + strength)


def calibrate(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the votes (Platt), by Newton steps."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / np.clip(1 - votes, 1e-6, 1))
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0])
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          corpus: DataFrame | None = None, fit_rows: int = 4000, max_terms: int = 2000, k: int = 9,
          strength: float = 0.5, seed: int = 3) -> dict:
    """Index of labelled examples.  ``labels`` are the rows that may be learnt
    from; ``corpus`` (``docs`` by default) gives the document frequencies."""
    rows = sample_examples(docs, labels, id_col, text_col, label_col, fit_rows, seed)
    y = np.array([r.y for r in rows], dtype=np.int64)
    counts = [terms_of(r.text) for r in rows]
    vocabulary = choose_terms(counts, y, max_terms) if len(y) else []
    index = {t: i for i, t in enumerate(vocabulary)}
    df, n = corpus_frequencies(docs if corpus is None else corpus, text_col, vocabulary) if vocabulary else (np.zeros(0), 0)
    idf = np.log((1 + n) / (1 + df)) + 1
    examples = [weigh({t: c for t, c in x.items() if t in index}, index, idf) for x in counts]
    postings = BlockIndex(examples, len(vocabulary))
    prior = float(y.mean()) if len(y) else 0.0
    own = np.array([vote(postings.nearest(at, w, k, skip=e), y, prior, strength) for e, (at, w) in enumerate(examples)])
    slope, offset = calibrate(own, y) if 0 < prior < 1 else (1.0, 0.0)
    return {"index": index, "idf": idf, "postings": postings, "y": y, "prior": prior, "k": k, "strength": strength,
            "slope": slope, "offset": offset, "ids": [r[0] for r in rows]}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus score, neighbours (example ids) and
    terms (matched vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("score", "neighbours", "terms")
    carried = [c for c in docs.columns if c not in (text_col, *added)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
                       + ["score double, neighbours array<bigint>, terms array<string>"])

    def label(batches):
        m = shared.value
        known: dict = {}  # texts with the same term counts get the same verdict
        for batch in batches:
            out = []
            for text in batch.column(text_col):
                counts = terms_of(text.as_py(), m["index"])
                key = tuple(sorted(counts.items()))
                if key not in known:
                    if len(known) > 20000:
                        known.clear()
                    near = m["postings"].nearest(*weigh(counts, m["index"], m["idf"]), m["k"])
                    p = vote(near, m["y"], m["prior"], m["strength"])
                    if 0 < m["prior"] < 1:
                        p = 1 / (1 + np.exp(-(m["slope"] * np.log(max(p, 1e-6) / max(1 - p, 1e-6)) + m["offset"])))
                    known[key] = float(p), [int(m["ids"][e]) for _, e in near], sorted(counts)
                out.append(known[key])
            yield pa.record_batch([batch.column(c) for c in carried]
                                  + [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                                     pa.array([o[2] for o in out], pa.list_(pa.string()))], names=[*carried, *added])

    return docs.select(*carried, text_col).mapInArrow(label, schema)
