"""What a task's Python worker holds beside its rows stays small, whatever the texts are."""

import ctypes
import gc
import inspect
import re
import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pytest

from txnrisk.llm import common, countmin, jaccard_join, quality_pu, sentencepiece_codec as sc

LETTERS = np.array([*"abcdefghijklmnopqrstuvwxyz"])


@pytest.fixture(scope="module")
def model():
    return sc.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def words(n, size, seed):
    return ["".join(w) for w in np.random.default_rng(seed).choice(LETTERS, (n, size))]


def held(work):
    """Bytes that are still allocated after ``work``, and at most meanwhile."""
    gc.collect()
    tracemalloc.start()
    try:
        kept = work()
        return (*tracemalloc.get_traced_memory(), kept)
    finally:
        tracemalloc.stop()


def test_remembered_units_are_small(model):
    codec, texts = sc.Codec(model), [" ".join(words(500, 8, k)) for k in range(20)]
    now, _, out = held(lambda: [codec.encode_ids(t) for t in texts])
    assert now - sum(x.nbytes for x in out) < 10_000 * 350


def test_long_units_do_not_add_up(model):
    codec, texts = sc.Codec(model), words(60, 20_000, 1)  # no space in them
    now, _, out = held(lambda: sum(len(codec.encode_ids(t)) for t in texts))
    assert out > 60 * 5_000 and now < 1 << 20


def test_generations_are_bounded_by_their_symbols(monkeypatch):
    monkeypatch.setattr(sc, "MEMORY", 5_000)
    seen = sc.Remembered(str.upper)
    for w in words(300, 100, 2) + words(300, 3, 3):
        assert seen[w] == seen[w] == w.upper()
        assert max(sum(map(len, seen)), sum(map(len, seen.older))) <= 5_100


def test_codec_goes_with_its_task(model):
    codec = sc.Codec(model)
    codec.encode_ids("one two three")
    there = weakref.ref(codec)
    gc.disable()
    try:
        codec.close()
        del codec
        assert there() is None
    finally:
        gc.enable()


def test_units_are_merged_in_small_steps(model):
    codec, texts = sc.Codec(model), [" ".join(words(500, 40, k)) for k in range(20)]
    _, most, out = held(lambda: codec.pack_all([u for t in texts for u in t.split()[:100]]))
    assert len(out) == 2_000 and most < 16 << 20


def test_word_hashes_are_made_in_small_steps():
    data = np.frombuffer(" ".join(words(500_000, 7, 4)).encode(), np.uint8)
    starts, ends, _ = common.word_bounds(data, np.array([0, len(data)]))
    _, most, out = held(lambda: common.word_hashes(data, starts, ends))
    assert most < 60 << 20
    assert (out == common.word_hashes(data, starts, ends, step=1 << 19)).all()


def anonymous_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library cannot give memory back")
def test_free_memory_goes_with_the_task():
    kept = []

    def task(batches):
        blocks = [bytes([1]) * 100_000 for _ in range(1_500)]
        kept.append(blocks[-1])  # at the end of the heap, so that what is free below it stays
        yield from batches

    def group(key, rows):
        return [*task(rows)]

    common.give_back()
    before = anonymous_mb()
    assert [*common.tidied(task)(iter([1, 2]))] == [1, 2] and anonymous_mb() < before + 50
    assert common.tidied(group)(1, iter([3])) == [3] and anonymous_mb() < before + 50
    assert inspect.getfullargspec(common.tidied(group)).args and len(inspect.getfullargspec(common.tidied(task)).args) == 1


@pytest.mark.parametrize("module", [jaccard_join, quality_pu, sc])
def test_steps_of_the_pipeline_give_memory_back(module):
    steps = re.findall(r"\.(?:mapInArrow|applyInArrow|arrow_udf|pandas_udf)\(\s*([\w.]+)", inspect.getsource(module))
    assert steps and {*steps} == {"common.tidied"}


def test_sketches_are_made_in_little_memory():
    keys = np.random.default_rng(5).integers(0, 2**63, countmin.FLUSH_KEYS, dtype=np.uint64)
    _, most, n = held(lambda: sum(b.num_rows for b in countmin.sketch_batches(np.split(keys, 8), 1, 28)))
    assert n == 1 << 28 - countmin.BLOCK_BITS and most < 120 << 20


def test_sketch_counts_keys_across_arrays():
    keys = np.array([3, 9, 3, 7, 7, 7, 5], np.uint64)
    found = {}
    for b in countmin.sketch_batches([keys[:2], keys[2:]], 1, 40):
        for block, blob in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            found |= {(block << countmin.BLOCK_BITS) + int(x >> 1): int(x & 1) for x in countmin.unpack_gaps(blob)}
    assert found == {int(countmin.cells(np.array([k], np.uint64), 0, 40)[0]): int(k in (3, 7)) for k in (3, 5, 7, 9)}
