"""The stream folds plain rows: no data frame per sender, and the same results as the fold over data frames."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, types as T

from tests.test_state_tiers import COLUMNS, At, Handle, _batches, _run
from txnrisk.streaming import sender_state


def _stream(batches, delay_hours=24):
    kept = [T.StructField(n, t) for n, t in COLUMNS.items()]
    out = T.StructType([T.StructField("sender_id", T.StringType()), *kept, *[T.StructField(n, t) for n, t in sender_state.FOLD_FIELDS],
                        T.StructField("late", T.BooleanType()), T.StructField("refused", T.StringType())])
    hour = 3_600_000_000
    fold = sender_state.SenderStream("sender_id", "txn_id", T.StructType(kept), out, delay_hours * hour, None, True)
    handle, mark, packed = Handle(), 0, []
    fold.init(handle)
    for rows in [*batches, None, None]:
        if rows is not None:
            packed += list(fold.handleInputRows(("A",), iter(rows), At(mark)))
        if handle.timer is not None and handle.timer <= mark // 1000:
            handle.timer = None
            packed += list(fold.handleExpiredTimer(("A",), At(mark), None))
        top = mark + 90 * 24 * hour if rows is None else max(mark, max(r["event_us"] for r in rows) - delay_hours * hour)
        mark = top // 1000 * 1000
    return packed, out


def test_rows_equal_frames_without_making_any(monkeypatch):
    frames = _batches(3)
    want = _run(frames)[0]
    rows = [[Row(sender_id="A", **{c: None if pd.isna(v) else v for c, v in r.items()}) for r in f.astype(object).to_dict("records")]
            for f in frames]

    def no_frame(*_, **__):
        raise AssertionError("a data frame for a sender")

    with monkeypatch.context() as m:
        m.setattr(sender_state.pd, "DataFrame", no_frame)
        packed, out = _stream(rows)
    batches = [pa.RecordBatch.from_pylist([{"packed": bytes(p["packed"])} for p in packed])]
    got = pa.Table.from_batches(list(sender_state.unpacked(out)(batches)))
    assert got.schema.names == out.fieldNames() == list(want.columns)
    expected = want.astype(object).where(want.notna(), None).to_dict("records")
    assert got.to_pylist() == expected and len(expected) == sum(len(f) for f in frames)
