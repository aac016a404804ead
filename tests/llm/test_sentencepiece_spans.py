"""op5 and the pipeline project every id back to its bytes: the queries' span digests are the library's."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as cp
from txnrisk.llm import queries, sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")
rng = np.random.default_rng(11)
TEXTS = [None, "", " ", "   ", " a", "a ", "▁", "▁▁ ▁x▁", "\n\n \n", " " * 70, "日本é😀 😀\U000e0001x", "\x00a\x01", "a\tb\r\nc", "ab" * 700, "été " * 300,
         "<s> </s> <unk> <0x41>"] + [" ".join("".join(w) for w in rng.choice([*"ab é▁\n日😀q"], (30, 6))) for _ in range(12)]


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def spans(lib, text):
    return [(p.begin, p.end) for p in lib.encode(text or "", return_type="proto").pieces]


def digest(lib, text):
    return hashlib.sha256(",".join(f"{a}-{b}" for a, b in spans(lib, text)).encode()).hexdigest()


def test_rows_are_projected_together(lib):
    texts = [t or "" for t in TEXTS]
    ids, starts, ends = (codec := sc.Codec(sc.load_model(PATH))).encode_rows(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert [[*zip(a.tolist(), b.tolist())] for a, b in zip(starts, ends)] == [spans(lib, t) for t in texts]
    assert codec.span_digests(starts, ends) == [digest(lib, t) for t in texts]
    assert codec.encode_rows([]) == ([], [], []) and codec.span_digests([], []) == []
    assert codec.span_digests(*codec.encode_rows(["", ""])[1:]) == [digest(lib, "")] * 2


@pytest.mark.parametrize("how", [{}, {"suffix": True}, {"dummy": False}, {"squeeze": True}, {"squeeze": True, "suffix": True}, {"charsmap": True},
                                 {"charsmap": True, "squeeze": True}, {"user": True}, {"bytes": False}, {"bytes": False, "squeeze": True}])
def test_any_model_as_text_by_text(how):
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    normal = [*"ab▁fi", "ab", "▁a", "fi", "é"]
    pieces = ["<unk>", *normal, *(["bab"] if "user" in how else []), *([f"<0x{b:02X}>" for b in range(256)] if how.get("bytes", True) else [])]
    codec = sc.Codec({"pieces": pieces, "scores": [-float(k) for k in range(len(pieces))],
                      "types": [sc.UNKNOWN, *[sc.NORMAL] * len(normal), *[sc.USER] * ("user" in how), *[sc.BYTE] * 256][:len(pieces)],
                      "charsmap": m.normalizer_spec.precompiled_charsmap if "charsmap" in how else b"", "dummy": how.get("dummy", True),
                      "squeeze": how.get("squeeze", False), "escape": True, "suffix": how.get("suffix", False), "unk_surface": " "})
    texts = ["", "  ", " ab  ba ", "ﬁ ① é日bab", "x　y\n\tz", "▁ ▁", "ﬁab" * 40, "", "babbab é"]
    rows = [*zip(*([x.tolist() for x in column] for column in codec.encode_rows(texts)))]
    assert rows == [tuple(codec.encode(t)) for t in texts]


def test_query_and_pipeline_give_the_spans(spark, lib, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: digest(lib, t) for d, t in enumerate(TEXTS)}
    assert {r.doc_id: r.spans_sha256 for r in queries.op5_sentencepiece(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.spans_sha256 for r in cp.encode(spark, docs, str(tmp_path)).collect()} == want
