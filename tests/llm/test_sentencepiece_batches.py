"""Units that are new in a run of rows are merged together, with the library's ids."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from txnrisk.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")
rng = np.random.default_rng(8)


@pytest.fixture(scope="module")
def model():
    return sc.load_model(PATH)


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def words(n, size, alphabet="abcdefghijklmnopqrstuvwxyzéèç.,"):
    return ["".join(w) for w in rng.choice([*alphabet], (n, size))]


def test_new_words_are_not_merged_one_by_one(model, lib, monkeypatch):
    def alone(self, unit):
        raise AssertionError("merged alone: " + unit)

    monkeypatch.setattr(sc.Codec, "merge", alone)
    texts = [" ".join(words(200, size)) for size in (1, 2, 5, 9, 20, 45)]
    codec = sc.Codec(model)
    for text in texts:
        assert codec.encode_ids(text).tolist() == lib.encode(text)


ODD = ["", " ", "   ", "\n", "\n\n \n", " a", "a ", "▁", "▁▁ ▁x▁", " " * 70, "\n  \n" + " " * 17 + "b", "日本é😀 😀\U000e0001x", "\x00a\x01", "a\tb\r\nc",
       "x" * 49, "ab" * 700, "<s> </s> <unk> <0x41>", "été " * 300, "á", "", "z"]


def test_odd_texts_together(model, lib):
    texts = ODD + [" ".join(words(30, 6, "ab é▁\n日\U0001f600q")) for _ in range(20)]
    codec = sc.Codec(model)
    ids = codec.encode_all(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert codec.decode_all(ids) == [lib.decode(x.tolist()) for x in ids]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n, labels, decoded = codec.digests(ids)
    assert n == [*map(len, ids)]
    assert labels == [sha(",".join(map(str, x.tolist()))) for x in ids] and decoded == [sha(lib.decode(x.tolist())) for x in ids]
    units, counts = codec.cut([codec.normalise(t)[0] for t in texts])
    assert units.to_pylist() == [u for t in texts for u in codec.units.findall(codec.normalise(t)[0])]
    assert counts.tolist() == [len(codec.units.findall(codec.normalise(t)[0])) for t in texts]


def test_byte_pieces_that_make_no_character(model, lib):
    codec = sc.Codec(model)
    bad = [codec.byte_id[b] for b in (0xE2, 0x96, 0x41, 0xFF)] + lib.encode("on") + [codec.byte_id[0xC3]]
    assert codec.decode_all([np.array(bad, np.int32), np.array([], np.int32)]) == [lib.decode(bad), ""]


@pytest.mark.parametrize("scores", [lambda k: -float(k), lambda k: -float(rng.integers(0, 4)), lambda k: 0.0])
@pytest.mark.parametrize("seed", range(4))
def test_any_scores_and_ties(scores, seed):
    own = np.random.default_rng(seed)
    pieces = sorted({"".join(own.choice([*"abc▁"[:3 + seed % 2]], size)) for size in (2, 2, 3, 4, 5) * 12} | {*"ab▁"})
    pieces = [pieces[i] for i in own.permutation(len(pieces))]
    codec = sc.Codec({"pieces": ["<unk>", *pieces], "scores": [0.0, *map(scores, range(len(pieces)))], "types": [2] + [1] * len(pieces),
                      "charsmap": b"", "dummy": True, "squeeze": False, "escape": True, "suffix": False, "unk_surface": " "})
    units = [u for size in (1, 2, 3, 7, 30, 48) for u in words(50, size, "abc▁")] + ["d", "adb"]
    assert codec.pack_all(units) == [codec.pack(u) for u in units]


def test_units_learned_together_are_bounded_and_right(model, lib, monkeypatch):
    monkeypatch.setattr(sc, "MEMORY", 2_000)
    monkeypatch.setattr(sc, "TOGETHER", 50)
    codec, texts = sc.Codec(model), [" ".join(words(120, 7)) for _ in range(12)]
    for _ in range(2):
        assert [x.tolist() for x in codec.encode_all(texts + texts[:3])] == lib.encode(texts + texts[:3])
        for held in (codec.packed, codec.packed.older):
            assert sum(map(len, held)) <= 2_000 + 50 * sc.SHORT


def test_runs_cover_all_rows(monkeypatch):
    monkeypatch.setattr(sc, "CHARACTERS", 10)
    monkeypatch.setattr(sc, "ROWS", 4)
    texts = pa.array(["a" * 25, None, "b" * 4, "c" * 6, "d", *[""] * 9, "e" * 11, "f" * 10, "g" * 10])
    got = [*sc.runs(texts)]
    assert [i for lo, hi in got for i in range(lo, hi)] == [*range(len(texts))]
    assert all(hi - lo <= 4 and (hi == lo + 1 or sum(len(t or "") for t in texts[lo:hi].to_pylist()) <= 10) for lo, hi in got)
    assert not [*sc.runs(texts[:0])]
