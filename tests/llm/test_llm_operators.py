"""Edge cases of every training-data operator, and brute-force twins."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import (embedding_dedup, exact_dedup, jaccard_join, language_id, line_dedup, quality_pu, sentencepiece_codec,
                         source_mix, substring_dedup, toxicity_knn)
from txnrisk.llm.countmin import pack_gaps, unpack_gaps

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, token string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(4)
VOCAB = ["w%d" % i for i in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


LONG = prose(30000, 1)
BASE = prose(120, 2)
EDIT = BASE.replace(BASE.split()[60], "zz", 1)
PASSAGE = prose(70, 3)
TEXTS = [None, "", "  \n\t ", "one two", "One TWO", BASE, BASE, EDIT, LONG, prose(80, 5) + " " + PASSAGE, PASSAGE + "\n" + prose(80, 6),
         "a\nb\nc\nd\nx", "q\na\nb\nc\nd\nq", "\n".join(["same"] * 6), "é日本 😀 ▁x <s>", LONG, prose(60, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], 1, "n", "t") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, BASE, None, "s1", 1, "n", "t"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(docs, empty):
    out = jaccard_join.jaccard_components(docs)
    assert out.count() == docs.count()
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    head = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    head[a] = min(head[a], head[b])
    got = by_id(out)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), head[i]) for i in sets}
    nulls = sorted((r.n_shingles, r.component_id) for r in out.where("doc_id IS NULL").collect() if r.n_shingles)
    assert nulls == [(len(sets[5]), 5)]
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in head if head[i] == i} | {None}


def test_near_cluster_without_losing_links(spark):
    """A crowd of edited copies of one text, close and far: brute-force components."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(150):
        w = BASE.split()
        for at in r.choice(len(w), r.integers(0, 7), replace=False):
            w[at] = "e%d" % r.integers(0, 30)
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i].component_id for i in sets} == head
    assert 1 < len(set(head.values())) < 150


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_members_apart_from_their_head(spark, seed):
    """Copies with cut, dropped, added and replaced words at few places: links
    to members of a group that do not link to its head, brute-force components."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        w = (BASE + " " + " ".join("t%d" % k for k in range(20))).split()
        w = w[r.integers(0, 4) * 6:len(w) - r.integers(0, 4) * 6]
        for at in r.choice([15, 30, 45, 60, 75, 90], r.integers(0, 4), replace=False):
            w[at:at + r.integers(0, 4)] = ["e%d" % k for k in range(r.integers(0, 4))]
        if r.integers(0, 3) == 0:
            w += ["own%d-%d" % (i, k) for k in range(r.integers(0, 12))]
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i].component_id for i in sets} == head
    assert len(set(head.values())) < 120


def test_candidates_by_differences(spark):
    """Every link of a set that is not close to the head is among the candidates, which are far from all pairs."""
    r = np.random.default_rng(11)
    words = BASE.split()

    def copy(edits):
        w = list(words)
        for at in r.choice(len(w) // 4, edits, replace=False):
            w[4 * at] = "e%d" % r.integers(0, 3)
        return w

    texts = [words] + [copy(k) for k in [1] * 20 + [2] * 20 + [3] * 40]
    sets = [np.unique([hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)]) for w in texts]
    table = spark.createDataFrame([(i, len(t), bytearray(t.astype(np.int64).tobytes())) for i, t in enumerate(sets)],
                                  "node long, n long, tokens binary")
    pairs = spark.createDataFrame([(i, 0, 10**6, 0) for i in range(1, len(sets))], "a long, g long, most long, b long")
    apart = jaccard_join.apart_from_head(pairs, table, 80)
    asking = apart.where("NOT linked AND NOT close")
    got = {(x.a, x.b) for x in jaccard_join.member_pairs(asking, apart, 80).collect()}
    ask = [x.a for x in asking.collect()]
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for a in ask for b in range(1, len(sets)) if 180 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert ask and {x for x in links if x[0] != x[1]} and links <= got
    assert 5 * len(got) <= len(ask) * (len(sets) - 1)


def test_substring_dedup(docs, empty):
    out = substring_dedup.substring_dedup(docs)
    assert out.count() == docs.count()
    first, words = {}, [WORDS.findall(t or "") for t in TEXTS]
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    got = by_id(out)
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < d for j in range(i, i + 50)}
        assert (got[d].n_words, got[d].n_removed, got[d].kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert any(r.n_removed for r in got.values())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_exact_dedup(docs, empty):
    out = exact_dedup.exact_dedup(docs)
    assert out.count() == docs.count()
    got = by_id(out)
    assert (got[6].keep_id, got[6].group_size, got[6].kept) == (6, 4, True)
    assert (got[5].keep_id, got[5].kept) == (6, False)
    assert (got[0].keep_id, got[0].group_size) == (1, 3)
    assert got[15].kept and not got[8].kept
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for t in TEXTS})


def test_kept_documents_by_id_and_text(spark):
    """Different texts without an id, or under one id, all stay; copies do not."""
    rows = [(None, "only here"), (None, "only there"), (None, "only there"), (None, "numbered"), (1, "numbered"),
            (2, "first"), (2, "second"), (3, "second"), (4, ""), (4, None)]
    kept = exact_dedup.keep_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(None, "only here"), (None, "only there"), (1, "numbered"), (2, "first"), (3, "second"), (4, "")], key=str)


def test_exact_dedup_checks_bytes(spark):
    """A digest that collides: texts of one length and first letter."""
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")]
    weak = lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")
    got = by_id(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak))
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {
        1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


def test_exact_dedup_goes_on(spark):
    """A later batch meets the state that an earlier one left."""
    state = exact_dedup.ExactDedup(spark)
    for rows in ([(1, "a"), (2, "b")], [(3, "a")]):
        state.add(spark.createDataFrame(rows, "doc_id long, text string"))
        state.advance()
    assert sorted((r.keep_id, r.n) for r in state.groups().collect()) == [(2, 1), (3, 2)]


def test_language_model_does_not_depend_on_arrival(spark):
    """The same rows in other partitions and orders, and one id on many rows, give the same model."""
    rows = [(i, f"{'the cat sat on' if i % 2 else 'der hund und die'} {prose(8, i)}", ("de", "en")[i % 2]) for i in range(300)]
    rows += [(7, f"one id, many rows {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = (language_id.train(d, fit_rows=100) for d in (docs.repartition(2, "text"), docs.orderBy(F.desc("text")).repartition(5)))
    assert one["langs"] == other["langs"] and np.array_equal(one["centres"], other["centres"])
    assert np.array_equal(one["radius"], other["radius"])


@pytest.mark.parametrize("from_files", [False, True])
def test_exact_dedup_follows_locators(spark, tmp_path, from_files):
    """A digest that collides with rows of earlier batches: their texts are read again from where they lie."""
    weak = lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")
    state = exact_dedup.ExactDedup(spark, digest=weak)
    batches = [[(1, "ab"), (None, "xy")], [(2, "ac"), (3, "xy")], [(4, "ab"), (5, "ac"), (6, "ac"), (None, "xy")], [(7, "xy"), (8, None)]]
    want = [{(1, 1, 1, True), (None, None, 1, True)}, {(2, 2, 1, True), (3, 3, 2, True)},
            {(4, 4, 2, True), (5, 6, 3, False), (6, 6, 3, True), (None, 3, 3, False)}, {(7, 7, 4, True), (8, 8, 1, True)}]
    for k, (rows, decisions) in enumerate(zip(batches, want)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        if from_files:
            docs.write.parquet(str(tmp_path / f"in {k}"))
            docs = spark.read.parquet(str(tmp_path / f"in {k}"))
        state.add(docs)
        state.advance()
        got = exact_dedup.resolve(state, docs)
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == decisions, k


def test_exact_dedup_wants_each_batch_resolved(spark):
    state = exact_dedup.ExactDedup(spark)
    for rows in ([(1, "a")], [(2, "a")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        state.add(docs)
    state.advance()
    with pytest.raises(ValueError):
        exact_dedup.resolve(state, docs)


def test_line_dedup(docs, empty):
    out = by_id(line_dedup.remove_repeated_runs(docs))
    assert out[11].text == TEXTS[11] and out[12].text == "q\nq"
    assert (out[13].n_lines, out[13].n_removed, out[13].text) == (6, 5, "same")
    assert out[0].text is None and out[1].text == "" and out[5].node == "n"
    assert line_dedup.remove_repeated_runs(empty).count() == 0


def test_source_mix(docs, empty):
    mixed = source_mix.mix_sources(docs, {"s1": 3.0, None: 1.0}, seed=3)
    again = source_mix.mix_sources(docs.repartition(3), {"s1": 3.0, None: 1.0}, seed=3)
    key = ["doc_id", "source", "__copy", "__order"]
    assert sorted(map(str, mixed.select(*key).collect())) == sorted(map(str, again.select(*key).collect()))
    assert mixed.where("source = 's2'").count() == 0
    assert source_mix.mix_sources(empty).count() == 0


def test_source_mix_rates(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19990, "big").otherwise("small").alias("source"))
    got = {r.source: r.n for r in source_mix.mix_sources(many, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 10000) < 500 and abs(got["small"] - 10000) < 500  # rates 0.5 and 1000


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    cols = ("ids", "starts", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    out = sentencepiece_codec.encode_documents(docs, path, columns=cols)
    got = by_id(out)
    for d, t in enumerate(TEXTS):
        ids, r = lib.encode(t or ""), got[d]
        assert (r.ids, r.decoded, r.n_tokens) == (ids, lib.decode(ids), len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert list(zip(r.starts, r.ends)) == [(p.begin, p.end) for p in lib.encode(t or "", return_type="proto").pieces]
    light = by_id(sentencepiece_codec.encode_documents(docs, path, columns=("ids",)))
    assert all(light[d].ids == got[d].ids for d in light)
    assert sentencepiece_codec.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    m = proto.ModelProto()
    m.ParseFromString(lib.serialized_model_proto())
    codec = sentencepiece_codec.Codec({"pieces": ["<unk>"], "scores": [0.0], "types": [2], "charsmap": m.normalizer_spec.precompiled_charsmap,
                                       "dummy": True, "squeeze": squeeze, "escape": True, "suffix": False, "unk_surface": " "})
    for text in ["", "  ", " a  b ", "ﬁ ① Ａｂｃ  ｶﾞ", "Straße ẞ é", "x　y\n\tz", "▁ ▁", LONG[:2000]]:
        out, origin = codec.normalise(text)
        assert out == lib.normalize(text)
        assert not out or (len(origin) == len(out.encode()) + 1 and origin == sorted(origin) and origin[-1] <= len(text.encode()))


def labelled(spark, label):
    bad = ["zap the " + prose(20, 100 + i) + " zap" for i in range(40)]
    good = [prose(22, 200 + i) for i in range(60)]
    noisy = [" | ".join(prose(20, 300 + i).split()) for i in range(40)]
    texts = good + (bad if label == "toxic" else noisy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = [(i, int((i < 60) == (label == "quality"))) for i in range(len(texts))]
    return docs, spark.createDataFrame(y, f"doc_id long, {label} int")


def test_toxicity(spark, docs, empty):
    known, labels = labelled(spark, "toxic")
    model = toxicity_knn.train(known, labels.where("doc_id % 2 = 0"))
    got = by_id(toxicity_knn.score(known, model))
    assert all((got[i].score >= 0.5) == (i >= 60) for i in got)
    assert got[61].neighbours and "zap" in got[61].terms
    out = toxicity_knn.score(docs, model)
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    none = toxicity_knn.train(empty, labels.limit(0))
    assert {r.score for r in toxicity_knn.score(docs, none).collect()} == {0.0}
    # block-max search against every cosine
    ix, examples = model["postings"], [toxicity_knn.weigh(toxicity_knn.terms_of(r.text, model["index"]), model["index"], model["idf"])
                                       for r in known.where("doc_id % 2 = 0").orderBy("doc_id").collect()]
    own = toxicity_knn.BlockIndex(examples, len(model["index"]))
    for at, w in examples[::7]:
        dense = np.zeros(len(model["index"]))
        dense[at] = w
        all_cos = sorted((-float(sum(dense[a] * x for a, x in zip(*e))), i) for i, e in enumerate(examples))
        want = [(-c, i) for c, i in all_cos if c < 0][:9]
        assert np.allclose([s for s, _ in own.nearest(at, w, 9)], [s for s, _ in want]) and ix.n


def test_quality(spark, docs, empty):
    known, labels = labelled(spark, "quality")
    model = quality_pu.train(known, labels.where("doc_id % 2 = 0"))
    got = by_id(quality_pu.score(known, model))
    assert np.mean([(got[i].quality_score >= 0.3) == (i < 60) for i in got]) > 0.95
    out = quality_pu.score(docs, model)
    assert out.count() == docs.count() and out.columns[:-1] == docs.columns
    assert {r.quality_score for r in quality_pu.score(docs, quality_pu.train(empty, labels)).collect()} == {1.0}
    assert abs(quality_pu.estimate_prior(np.linspace(0, 1, 4000), np.r_[np.linspace(0, 1, 2800), np.full(1200, -1.0)]) - 0.7) < 0.06


def test_quality_statistics_of_all_rows(spark):
    """Centring counts every row, and the fit takes one row of an id however often it is repeated."""
    texts = [prose(22, 200 + i) if i % 2 else " | ".join(prose(20, 300 + i).split()) for i in range(60)]
    rows = list(enumerate(texts)) + [(1000, "one | two | three !!!")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40, 2)], "doc_id long, quality int")
    x = np.concatenate([quality_pu.measurements(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in rows])
    models = [quality_pu.train(docs, labels, fit_rows=n) for n in (20, 100)]
    for m in models:
        assert np.allclose(m["centre"], x.mean(axis=0)) and np.allclose(m["scale"], x.std(axis=0) + 1e-6, atol=1e-6)
    nets = {h: models[0]["net"] for h in (0, 1)}
    half, cuts = F.col("doc_id") % 2, {h: np.array([-1.0, 0.0, 0.5]) for h in (0, 1)}
    got = quality_pu.corpus_tails(docs, half, nets, cuts, models[0]["centre"], models[0]["scale"])
    scores = quality_pu.logits(np.clip((x - models[0]["centre"]) / models[0]["scale"], -8, 8), nets[0])
    for h in (0, 1):
        own = scores[[i % 2 == h for i, _ in rows]]
        assert got[h][1] == len(own) and np.allclose(got[h][0], [(own >= c).mean() for c in cuts[h]])


def test_language(spark, docs, empty):
    import glob
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(known.where("doc_id % 3 <> 0"))
    held = language_id.predict(known.where("doc_id % 3 = 0"), model)
    assert held.where("lang = lang_pred").count() >= 0.95 * held.where("lang IS NOT NULL").count() and glob
    got = by_id(language_id.predict(docs, model))
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_embeddings(spark):
    x = rng.standard_normal((60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100 + i, [float(v) for v in x[i] * 2 + 0.01]) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, [1.0] * 7), (None, rows[1][1])]
    out = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999)
    assert out.count() == len(rows)
    good = dict(r for r in rows if r[0] is not None and r[0] < 300)
    m = np.array(list(good.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, near = list(good), m @ m.T >= 0.95
    head = {i: i for i in good}
    for _ in ids:
        for a in range(len(ids)):
            for b in np.flatnonzero(near[a]):
                head[ids[a]] = min(head[ids[a]], head[ids[b]])
    got = by_id(out, "vec_id")
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(near[k].sum()) - 1, head[i]) for k, i in enumerate(ids)}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 306))
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_gaps():
    x = np.unique(rng.integers(0, 1 << 19, 5000)).astype(np.uint64)
    assert (unpack_gaps(pack_gaps(x)) == x).all() and pack_gaps(x[:0]) == b""
