"""What lies in the sender's records and what lies in map state gives the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from txnrisk.streaming import sender_state

HOUR = 3_600_000_000
COLUMNS = {"txn_id": T.LongType(), "event_us": T.LongType(), "amount": T.DoubleType(), "device_id": T.StringType(),
           "location": T.StringType(), "receiver_id": T.StringType()}


class Value:
    def __init__(self):
        self.row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Map(dict):
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.states, self.timer = {}, None

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):
        assert self.timer is None
        self.timer = at

    def deleteTimer(self, at):
        assert self.timer == at
        self.timer = None


class At:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def _run(batches, idle_hours=None, delay_hours=24):
    """Rows of one sender's batches as the processor returns them, the state left, and the map calls."""
    kept = [T.StructField(n, t) for n, t in COLUMNS.items()]
    out = T.StructType([T.StructField("sender_id", T.StringType()), *kept, *[T.StructField(n, t) for n, t in sender_state.FOLD_FIELDS],
                        T.StructField("late", T.BooleanType()), T.StructField("refused", T.StringType())])
    fold = sender_state.SenderFeatures("sender_id", "txn_id", T.StructType(kept), out, delay_hours * HOUR,
                                       None if idle_hours is None else idle_hours * HOUR, True)
    handle, mark, rows = Handle(), 0, []
    fold.init(handle)
    for pdf in [*batches, None, None]:
        if pdf is not None:
            rows += list(fold.handleInputRows(("A",), iter([pdf.assign(sender_id="A")]), At(mark)))
        if handle.timer is not None and handle.timer <= mark // 1000:
            handle.timer = None
            rows += list(fold.handleExpiredTimer(("A",), At(mark), None))
        top = mark + 90 * 24 * HOUR if pdf is None else max(mark, int(pdf["event_us"].max()) - delay_hours * HOUR)
        mark = top // 1000 * 1000
    got = pd.concat([r.astype(object) for r in rows], ignore_index=True)
    return got, handle, sum(m.calls for m in handle.states.values() if isinstance(m, Map))


def _batches(seed, n=12):
    rng, batches, sent = np.random.default_rng(seed), [], []
    for k in range(n):
        m = int(rng.integers(1, 30))
        us = 1_700_000_000_000_000 + (k * 20 + rng.integers(0, 60, m)) * HOUR + rng.integers(0, 3, m) * 1_000_000
        pdf = pd.DataFrame({"txn_id": np.arange(m) + 1000 * k, "event_us": us, "amount": rng.random(m) * 100,
                            "device_id": rng.choice(["D1", "D2", None], m), "location": "12.9, 77.5",
                            "receiver_id": rng.choice([f"R{i}" for i in range(20)], m)})
        if sent:  # rows of the batch before come again
            pdf = pd.concat([pdf, sent[-1].iloc[:5]], ignore_index=True)
        sent.append(pdf)
        batches.append(pdf)
    return batches


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("idle_hours", [None, 30])
def test_same_rows_wherever_the_state_lies(monkeypatch, seed, idle_hours):
    results = []
    for near in (10_000, 8, 0):
        monkeypatch.setattr(sender_state, "NEAR", near)
        got, handle, _ = _run(_batches(seed), idle_hours)
        results.append(got)
        # nothing waits and no id is held once the watermark has gone far ahead
        assert not any(handle.states[m] for m in ("waiting", "ids", "done")) and handle.states["agenda"].get() is None
        if idle_hours:
            assert handle.states["history"].get() is None and not handle.states["receivers"] and not handle.states["devices"]
    for other in results[1:]:
        pd.testing.assert_frame_equal(results[0], other)
    refused = results[0]["refused"].value_counts()
    assert refused["duplicate"] > 0 and results[0]["refused"].isna().sum() > 50


def test_small_senders_need_no_map_state():
    assert _run(_batches(1, n=2))[2] == 0


def test_ids_are_held_as_long_in_both_places(monkeypatch):
    """An id keeps others out for the watermark's delay behind the watermark, then no longer."""
    def row(i, hour, receiver="R"):
        return pd.DataFrame({"txn_id": [i], "event_us": [hour * HOUR], "amount": [1.0], "device_id": ["D"], "location": [None],
                             "receiver_id": [receiver]})
    for near in (128, 0):
        monkeypatch.setattr(sender_state, "NEAR", near)
        got, _, _ = _run([row(1, 1000), row(2, 1047), row(1, 1047), row(3, 1100), row(1, 1101)])
        assert got.groupby("txn_id")["refused"].apply(list).to_dict() == {1: ["duplicate", None, None], 2: [None], 3: [None]}, near
