"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled web text with
the non-negative risk: the unlabelled rows' loss as negatives, less the
positives' share of it, is held at zero or above.  The class prior is
estimated from scores alone: the share of all unlabelled rows above a score
divided by the positives' share, at its least over all scores, with a
margin for their numbers, each half scored by a network fitted on the other.  Inputs are style measurements of the whole text
(character classes, word repetition, line shapes); labels, language, source
and ids are never inputs.

At most ``fit_rows`` positives and ``fit_rows`` unlabelled rows, those of the
smallest hashed ids and one for an id, are fitted on.  The centring of the
measurements and the unlabelled shares behind the prior come from all rows, by
one pass each; every text is scored in full.

Defined cases: null and empty text get the score of a text whose every
measurement is 0; without positives or unlabelled rows every score is 1 (no
ground to reject); repeated rows are scored each; other columns are kept.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm import common

#: Byte classes that shares are taken of.
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "beyond": range(128, 256),
    "stop": b".!?", "comma": b",;:", "bar": b"|", "quote": b"'\"()[]{}", "symbol": b"#$%&*+-/<=>@\\^_`~", "newline": b"\n",
}
FEATURES = [*CLASSES, "log_words", "word_length", "long_words", "same_as_last", "same_as_last_but_one", "distinct",
            "commonest", "marked_words", "ended_words", "bare_words", "log_line_words", "same_lines"]


def measurements(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by FEATURES style measurements of a text chunk."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    size = np.maximum(np.diff(offsets), 1)
    kind = np.full(256, len(CLASSES), dtype=np.uint8)
    for i, members in enumerate(CLASSES.values()):
        kind[list(members)] = i
    codes = kind[data]
    starts, ends, first = common.word_bounds(data, offsets)
    words = common.word_hashes(data, starts, ends)
    length = ends - starts
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbol = np.isin(tail, list(CLASSES["symbol"]))
    alone = (length == 1) & (kind[tail] >= 4) if len(tail) else np.zeros(0, bool)
    stop = np.isin(tail, list(b".!?,;:"))
    for r in range(rows):
        a, b = first[r], first[r + 1]
        n = b - a
        out[r, :len(CLASSES)] = np.bincount(codes[offsets[r]:offsets[r + 1]], minlength=len(CLASSES) + 1)[:len(CLASSES)] / size[r]
        if not n:
            continue
        w = words[a:b]
        _, times = np.unique(w, return_counts=True)
        lines = data[offsets[r]:offsets[r + 1]].tobytes().split(b"\n")
        out[r, len(CLASSES):] = (
            np.log1p(n), length[a:b].mean(), (length[a:b] > 12).mean(), (w[1:] == w[:-1]).sum() / n, (w[2:] == w[:-2]).sum() / n,
            len(times) / n, times.max() / n, symbol[a:b].mean(), stop[a:b].mean(), alone[a:b].mean(),
            np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines))
    return out


def _hidden(x, p):
    return np.maximum(x @ p["w1"] + p["b1"], 0)


def logits(x: np.ndarray, p: dict) -> np.ndarray:
    return _hidden(x, p) @ p["w2"] + p["b2"]


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 8, steps: int = 400, rate: float = 0.01,
             decay: float = 1e-2, seed: int = 1) -> dict:
    """Minimise the non-negative risk with logistic loss (Adam, full batches).

    Where the negative part falls below zero, the step ascends it instead."""
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), "b1": np.zeros(hidden),
         "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}

    def backward(x, dz):
        h = _hidden(x, p)
        dh = np.outer(dz, p["w2"]) * (h > 0)
        return {"w2": h.T @ dz, "b2": np.array([dz.sum()]), "w1": x.T @ dh, "b1": dh.sum(axis=0)}

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = logits(pos, p), logits(unl, p)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            grad_p, grad_u = prior * (sig(zp) - 1) / len(zp) - prior * sig(zp) / len(zp), sig(zu) / len(zu)
        else:
            grad_p, grad_u = prior * sig(zp) / len(zp), -sig(zu) / len(zu)
        gp, gu = backward(pos, grad_p), backward(unl, grad_u)
        for k in p:
            g = gp[k] + gu[k] + decay * p[k] * k.startswith("w")
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from both samples' scores: the
    least ratio of tail masses, where both tails' sampling margins are small."""
    cuts = np.unique(np.concatenate([pos, unl]))
    return prior_from_tails(tails(cuts, pos), 1 - np.searchsorted(np.sort(unl), cuts) / len(unl), len(pos), len(unl), delta)


def tails(cuts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Share of ``scores`` at or above each cut."""
    return 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)


def prior_from_tails(tail_p: np.ndarray, tail_u: np.ndarray, n_pos: int, n_unl: int, delta: float = 0.1) -> float:
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_pos) + 1 / np.sqrt(n_unl))
    ok = tail_p > 0
    at = np.argmin((tail_u[ok] + margin) / tail_p[ok])
    # the lower end of the estimate: a prior that is too high makes accepting everything the least risk
    share = tail_u[ok][at] / tail_p[ok][at] * (1 - 0.5 * (1 / np.sqrt(n_pos) + 1 / np.sqrt(n_unl)))
    return float(np.clip(share, 0.05, 0.95))


def corpus_moments(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every measurement over all rows."""
    def sums(batches):
        n, total, squares = 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for batch in batches:
            for _, data, offsets in common.text_chunks(batch.column(0)):
                x = measurements(data, offsets)
                n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.record_batch({"k": pa.array(np.arange(len(FEATURES))), "n": pa.array(np.full(len(FEATURES), n)),
                               "s": pa.array(total), "q": pa.array(squares)})

    rows = (docs.select(F.col(text_col).cast("string")).mapInArrow(common.tidied(sums), "k long, n long, s double, q double")
            .groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect())  # one row per measurement
    n = np.array([max(r.n, 1) for r in rows], dtype=float)
    mean = np.array([r.s for r in rows]) / n
    return mean, np.sqrt(np.maximum(np.array([r.q for r in rows]) / n - mean * mean, 0)) + 1e-6


def corpus_tails(docs: DataFrame, half, nets: dict, cuts: dict, centre, scale, text_col: str = "text") -> dict:
    """By half: the share of all its rows with a score at or above each cut,
    and their number, scored by that half's net."""
    shared = docs.sparkSession.sparkContext.broadcast((nets, cuts, centre, scale))

    def count(batches):
        nets, cuts, centre, scale = shared.value
        bins = {h: np.zeros(len(c) + 1, dtype=np.int64) for h, c in cuts.items()}
        for batch in batches:
            halves = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, offsets in common.text_chunks(batch.column(0)):
                z = np.clip((measurements(data, offsets) - centre) / scale, -8, 8)
                for h, c in cuts.items():
                    own = halves[lo:lo + len(z)] == h
                    if own.any():
                        at = np.searchsorted(c, logits(z[own], nets[h]), side="right")
                        bins[h] += np.bincount(at, minlength=len(c) + 1)
        for h, b in bins.items():
            yield pa.record_batch({"half": pa.array(np.full(len(b), h, dtype=np.int32)), "bin": pa.array(np.arange(len(b))), "n": pa.array(b)})

    rows = (docs.select(F.col(text_col).cast("string"), half.cast("int")).mapInArrow(common.tidied(count), "half int, bin long, n long")
            .groupBy("half", "bin").agg(F.sum("n").alias("n")).collect())  # one row per half and cut
    out = {}
    for h, c in cuts.items():
        bins = np.zeros(len(c) + 1)
        for row in rows:
            if row.half == h:
                bins[row.bin] = row.n
        out[h] = np.cumsum(bins[::-1])[::-1][1:] / max(bins.sum(), 1), int(bins.sum())
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          fit_rows: int = 6000, seed: int = 17) -> dict:
    """Model from ``labels`` (positives only) and ``docs`` (the unlabelled)."""
    rank = [F.xxhash64(id_col, F.lit(seed)), F.col(id_col)]
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(*rank).limit(fit_rows)
    unlabelled = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(*rank).limit(fit_rows)
    picked = (trusted.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
              .groupBy(id_col).agg(F.max("positive").alias("p"), F.min("positive").alias("only")))

    def measure(batches):
        for batch in batches:
            for lo, data, offsets in common.text_chunks(batch.column("text")):
                n = len(offsets) - 1
                yield pa.record_batch({"id": batch.column("id").slice(lo, n), "p": batch.column("p").slice(lo, n), "u": batch.column("u").slice(lo, n), "half": batch.column("half").slice(lo, n),
                                       "x": pa.array(list(measurements(data, offsets)), pa.list_(pa.float64()))})

    half = F.pmod(F.xxhash64(id_col, F.lit(seed + 1)), F.lit(2))
    rows = (docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # other columns may be named like these
            .groupBy(F.col(id_col)).agg(F.min(F.col(text_col).cast("string")).alias("text"), F.first("p").alias("p"), F.first("only").alias("only"))
            .select(F.col(id_col).cast("long").alias("id"), "text", "p", (~F.col("only")).alias("u"), half.cast("int").alias("half"))
            .mapInArrow(common.tidied(measure), "id long, p boolean, u boolean, half int, x array<double>").collect())  # 2 * fit_rows rows at most
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    is_pos, is_unl = np.array([r.p for r in rows], dtype=bool), np.array([r.u for r in rows], dtype=bool)
    if not is_pos.any() or not is_unl.any():
        return {"net": None, "prior": None}
    centre, scale = corpus_moments(docs, text_col)
    z = np.clip((x - centre) / scale, -8, 8)
    own = {h: np.array([r.half for r in rows]) == h for h in (0, 1)}
    prior = 0.5
    if all((part & o).any() for part in (is_pos, is_unl) for o in own.values()):
        nets = {h: fit_nnpu(z[is_pos & own[1 - h]], z[is_unl & own[1 - h]], 0.5) for h in own}
        found = {h: logits(z[is_pos & o], nets[h]) for h, o in own.items()}
        cuts = {h: np.unique(np.concatenate([found[h], logits(z[is_unl & o], nets[h])])) for h, o in own.items()}
        shares = corpus_tails(docs, half, nets, cuts, centre, scale, text_col)
        prior = float(np.mean([prior_from_tails(tails(cuts[h], found[h]), shares[h][0], len(found[h]), shares[h][1]) for h in own]))
    return {"net": fit_nnpu(z[is_pos], z[is_unl], prior), "prior": prior, "centre": centre, "scale": scale}


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` plus ``out_col`` (0 to 1, higher: quality likelier); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in columns:
            parts = []
            for _, data, offsets in common.text_chunks(texts):
                if m["net"] is None:
                    parts.append(np.ones(len(offsets) - 1))
                else:
                    z = np.clip((measurements(data, offsets) - m["centre"]) / m["scale"], -8, 8)
                    parts.append(1 / (1 + np.exp(-np.clip(logits(z, m["net"]), -30, 30))))
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn(out_col, F.arrow_udf(common.tidied(rate), "double")(F.col(text_col)))
