"""Point-in-time sender features for a transaction stream, in event-time order.

Rows wait in their sender's state until the watermark has passed them and are
then folded in (time, id) order, so rows that arrive out of order within the
watermark get the same features as in a batch over the sorted table.  What
waits lies in map state by time slot; one event-time timer per sender wakes it
for its next due row.  A sender's history is a small record plus two maps,
receiver -> count and device -> count, of which a micro-batch reads and writes
only the entries it meets.  A state call costs far more than the work on a row,
so whatever has up to ``NEAR`` entries (receivers, devices, waiting rows, ids)
lies within the sender's records, and moves to map state when it outgrows them.
A data frame per sender and micro-batch costs more still, so a stream's rows stay
plain tuples (``SenderStream``) until they are columns of many senders (``unpacked``).

Every row comes out once.  ``refused`` says why a row has no features and left
no trace in the state:

* ``late``: older than the watermark when it arrived (``late`` is then true);
* ``duplicate``: its id is one of an earlier row of the sender whose time slot
  is less than the watermark's delay behind the watermark, or one of the same batch;
* ``invalid``: ``validation_message`` is not null (where there is such a column);
* ``no time``, ``no amount``: null time; null or non-finite amount.

With ``idle_seconds`` a sender's first event after so much event time without
one starts a fresh history, and a timer clears the history of a sender that
stays away; by default histories are kept for good.

At the end of a finite replay the last rows still wait for the watermark;
``scoring.seal_source`` adds a marker that moves it past them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from txnrisk.functions import geo
from txnrisk.schema import (FIRST_GAP_HOURS, FIRST_GAP_MINUTES, GAP_COUNT_HOURS, RAPID_GAP_HOURS, ROLLING_ROWS,
                            VELOCITY_WINDOW_SECONDS)
from txnrisk.session import workers_find_package

FEATURE_FIELDS = [
    ("Time_Since_Last_Txn", T.DoubleType()), ("Time_Diff_Hours", T.DoubleType()),
    ("Txn_Count_Total", T.LongType()), ("Txn_Count_Last_1H", T.LongType()),
    ("Txn_Count_Last_6H", T.LongType()), ("Txn_Count_Last_24H", T.LongType()),
    ("Rapid_Txn_Count_Last_1H", T.LongType()), ("Amount_Rolling_Mean_10", T.DoubleType()),
    ("Amount_Rolling_Std_10", T.DoubleType()), ("Is_New_Device", T.LongType()),
    ("Location_Distance_Km", T.DoubleType()), ("Is_Unusual_Location", T.LongType()),
    ("Location_Speed_Kmh", T.DoubleType()), ("Is_High_Speed", T.LongType()),
    ("Receiver_Frequency", T.LongType()), ("Is_First_Time_Receiver", T.LongType()),
    ("Txn_Count_Last_10_Min", T.LongType()), ("device_count_so_far", T.LongType()),
    ("receiver_diversity_so_far", T.LongType()), ("sender_mean_so_far", T.DoubleType()),
]
#: What the fold leaves to column expressions (``functions/geo.py``).
LOCATION_FIELDS = ["Location_Distance_Km", "Is_Unusual_Location", "Location_Speed_Kmh", "Is_High_Speed"]
FOLD_FIELDS = [(f, t) for f, t in FEATURE_FIELDS if f not in LOCATION_FIELDS] + [("prev_location", T.StringType())]

#: Columns of the events that ride along.
PASSTHROUGH = ["amount", "device_id", "location", "receiver_id", "txn_type", "merchant_type", "is_fraud", "validation_message"]
#: Sender of the marker row that ends a finite replay.
CLOSING_SENDER = "\u0000closing"
#: Time slots of the waiting rows within the watermark's delay.
SLOTS = 288
#: Most entries of each kind within a sender's records.
NEAR = 128
#: Rows of an Arrow batch that leaves the stream's fold.
BATCH_ROWS = 10_000


def _struct(**fields) -> T.StructType:
    """Workers have no session to parse a type's text."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _TEXT, _BYTES = T.LongType(), T.StringType(), T.BinaryType()


class History:
    """What a sender's next event needs, besides its receivers and devices."""

    FIELDS = ("last_us", "last_device", "last_location", "n", "gap_counts", "amounts", "rapid", "recent_us", "amount_sum",
              "n_receivers", "n_devices")

    def __init__(self, row=None):
        values = row or (None, None, None, 0, [0] * len(GAP_COUNT_HOURS), [], [], [], 0.0, 0, 0)
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def to_row(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)


class Agenda:
    """What waits and which ids are held.

    Near: ids (null: far), the waiting rows' parts, number and first time.
    Far: slots with waiting rows (their parts and first time) and slots whose ids are still held.  And the next timer."""

    def __init__(self, row=None):
        self.waiting, self.done, self.wake, self.ids, self.rows, self.n_rows, self.first = row or ({}, [], None, {}, [], 0, None)

    @property
    def near(self) -> bool:
        return self.ids is not None

    def to_row(self) -> tuple:
        return self.waiting, self.done, self.wake, self.ids, self.rows, self.n_rows, self.first


def _stored(values: tuple) -> tuple:
    """The row of a state that holds ``values``."""
    return (pickle.dumps(values, pickle.HIGHEST_PROTOCOL),)


def _loaded(row):
    return None if row is None else pickle.loads(row[0])


def _counted(values: list, counts) -> list[int]:
    """How often each value has been met, itself included; reads and writes one entry of ``counts`` per distinct value."""
    met, now = [], {}
    for value in values:
        name = "" if value is None else str(value)
        now[name] = (now[name] if name in now else counts.get(name)) + 1
        met.append(now[name])
    for name, n in now.items():
        counts.put(name, n)
    return met


def advance_rows(st: History, rows: list[tuple], receivers, devices) -> list[tuple]:
    """Events (event_us, amount, device, location, receiver) of one sender in (time, id) order, none older than the
    state: moves the state on and returns what each event needs of it, as ``FOLD_FIELDS``.  However the events are cut
    into calls, the rows are the same: each rolling window is summed on its own, oldest value first."""
    frequencies, sightings = _counted([r[4] for r in rows], receivers), _counted([r[2] for r in rows], devices)
    amounts, rapid, recent, gap_counts = st.amounts, st.rapid, st.recent_us, st.gap_counts
    out, begin = [], 0
    for (us, amount, device, location, _), frequency, sighting in zip(rows, frequencies, sightings):
        amount, prev_location = float(amount), st.last_location
        if st.last_us is None:
            gap, gap_minutes = FIRST_GAP_HOURS, FIRST_GAP_MINUTES
        else:
            gap = float(us - st.last_us) / 1e6 / 3600.0
            gap_minutes = float(us - st.last_us) / 1e6 / 60.0
        new_device = int(device is None or device != st.last_device)
        st.last_us, st.last_device, st.last_location, st.n = us, device, location, st.n + 1
        gap_counts = [n + (gap <= h) for n, h in zip(gap_counts, GAP_COUNT_HOURS)]
        amounts, rapid = [*amounts[1 - ROLLING_ROWS:], amount], [*rapid[1 - ROLLING_ROWS:], int(gap <= RAPID_GAP_HOURS)]
        total = squares = 0.0
        for x in amounts:
            total += x
        mean = total / len(amounts)
        for x in amounts:
            squares += (x - mean) * (x - mean)
        recent.append(us)
        while recent[begin] <= us - VELOCITY_WINDOW_SECONDS * 1_000_000:
            begin += 1
        st.n_receivers, st.n_devices = st.n_receivers + (frequency == 1), st.n_devices + (sighting == 1)
        st.amount_sum += amount
        out.append((gap_minutes, gap, st.n, *gap_counts, sum(rapid), mean, math.sqrt(squares / max(len(amounts) - 1, 1)), new_device,
                    frequency, int(frequency == 1), len(recent) - begin, st.n_devices, st.n_receivers, st.amount_sum / st.n,
                    prev_location))
    st.gap_counts, st.amounts, st.rapid, st.recent_us = gap_counts, amounts, rapid, recent[begin:]
    return out


def _values(column: pd.Series) -> list:
    """Plain values, nulls as None."""
    return [None if pd.isna(x) else x for x in column.tolist()]


def advance(st: History, pdf: pd.DataFrame, receivers, devices) -> pd.DataFrame:
    """``advance_rows`` for a data frame of events."""
    rows = list(zip(*(_values(pdf[c]) for c in ("event_us", "amount", "device_id", "location", "receiver_id"))))
    return pd.DataFrame(advance_rows(st, rows, receivers, devices), columns=[f for f, _ in FOLD_FIELDS])


class NamedCounts:
    """Name -> count: up to ``NEAR`` names as lists of the sender's record, more in map state (the lists are null then)."""

    def __init__(self, state, names: list | None, counts: list | None):
        self.state, self.near = state, None if names is None else dict(zip(names, counts))

    def get(self, name: str) -> int:
        if self.near is not None:
            return int(self.near.get(name, 0))
        row = self.state.getValue((name,))
        return 0 if row is None else int(row[0])

    def put(self, name: str, n: int) -> None:
        if self.near is None:
            self.state.updateValue((name,), (n,))
            return
        self.near[name] = n
        if len(self.near) > NEAR:
            for held in self.near.items():
                self.state.updateValue((held[0],), (int(held[1]),))
            self.near = None

    def clear(self) -> None:
        if self.near is None:
            self.state.clear()
        self.near = {}

    def to_lists(self) -> tuple:
        return (None, None) if self.near is None else ([*self.near], [*self.near.values()])


class SenderFold(StatefulProcessor):
    """Keeps a sender's rows until the watermark has passed them, then folds them in order.

    Rows are tuples of ``names`` (the id, the time, what rides along); results are tuples of the output's columns."""

    def __init__(self, key: str, tie: str, row_schema: T.StructType, out_schema: T.StructType, delay_us: int,
                 idle_us: int | None, ordered: bool):
        self.key, self.tie, self.names, self.out = key, tie, row_schema.fieldNames(), out_schema.fieldNames()
        self.delay_us, self.idle_us, self.ordered = delay_us, idle_us, ordered
        self.slot_us = max(delay_us // SLOTS, 1_000_000)
        at = {name: i for i, name in enumerate(self.names)}
        self.id_at, self.us_at, self.message_at = at[tie], at["event_us"], at.get("validation_message")
        self.fold_at = [at[c] for c in ("event_us", "amount", "device_id", "location", "receiver_id")]

    def init(self, handle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", _struct(packed=_BYTES))
        self.agenda = handle.getValueState("agenda", _struct(packed=_BYTES))
        self.receivers = handle.getMapState("receivers", _struct(name=_TEXT), _struct(n=_LONG))
        self.devices = handle.getMapState("devices", _struct(name=_TEXT), _struct(n=_LONG))
        self.waiting = handle.getMapState("waiting", _struct(slot=_LONG, part=_LONG), _struct(rows=_BYTES))
        self.ids = handle.getMapState("ids", _struct(id=_TEXT), _struct(us=_LONG))
        self.done = handle.getMapState("done", _struct(slot=_LONG), _struct(ids=T.ArrayType(_TEXT)))

    # -------------------------------------------------------------- arrivals
    def arrive(self, key, rows: list[tuple], mark: int) -> Iterator[list[tuple]]:
        """Rows of a micro-batch, ``mark`` the watermark in microseconds."""
        if key[0] == CLOSING_SENDER:
            return
        agenda = Agenda(_loaded(self.agenda.get())) if self.ordered else None
        why = [self._refusal(row, mark) for row in rows]
        good = sorted((i for i, reason in enumerate(why) if reason is None), key=lambda i: self._order(rows[i]))
        ids = {}
        for i in good:
            text = self._text(rows[i])
            if text is not None and (text in ids or self.ordered and self._held(agenda, text, mark)):
                why[i] = "duplicate"
            elif text is not None:
                ids[text] = rows[i][self.us_at]
        refused = [i for i, reason in enumerate(why) if reason is not None]
        if refused:
            yield [self._shown(key, rows[i], None, why[i]) for i in refused]
        good = [rows[i] for i in good if why[i] is None]
        if not good:
            return
        if not self.ordered:
            yield from self._fold(key, good)
            return
        if agenda.near and max(len(agenda.ids) + len(ids), agenda.n_rows + len(good)) <= NEAR:
            agenda.ids.update(ids)
            self._wait_near(agenda, good)
        else:
            if agenda.near:
                self._move_far(agenda)
            self._wait_far(agenda, good, ids)
        self._rest(agenda, None)

    # ---------------------------------------------------------------- timers
    def wake(self, key, mark: int) -> Iterator[list[tuple]]:
        """The sender's timer has fired."""
        agenda = Agenda(_loaded(self.agenda.get()))
        agenda.wake = None  # the timer that fired
        due = self._due_near(agenda, mark) if agenda.near else self._due_far(agenda, mark)
        if due:
            yield from self._fold(key, sorted(due, key=self._order))
        if agenda.near:
            agenda.ids = {t: us for t, us in agenda.ids.items() if self._expiry(us // self.slot_us) > mark}
        else:  # ids are held for the watermark's delay after their rows
            while agenda.done and self._expiry(agenda.done[0]) <= mark:
                slot = agenda.done.pop(0)
                for text in self.done.getValue((slot,))[0]:
                    found = self.ids.getValue((text,))
                    if found is not None and int(found[0]) // self.slot_us == slot:  # not taken anew since
                        self.ids.removeKey((text,))
                self.done.removeKey((slot,))
            if not agenda.waiting and not agenda.done:
                agenda.ids = {}
        last_us = None
        if self.idle_us is not None:
            st, receivers, devices = self._record()
            last_us = st.last_us
            if last_us is not None and not agenda.waiting and not agenda.n_rows and last_us + self.idle_us <= mark:
                receivers.clear(), devices.clear(), self.history.clear()
                last_us = None
        self._rest(agenda, last_us)

    # ----------------------------------------------------- what waits, and ids
    def _refusal(self, row: tuple, mark: int) -> str | None:
        us, amount = row[self.us_at], row[self.fold_at[1]]
        if self.message_at is not None and row[self.message_at] is not None:
            return "invalid"
        if us is None:
            return "no time"
        if amount is None or not math.isfinite(amount):
            return "no amount"
        return "late" if 0 < mark and us < mark else None

    def _held(self, agenda: Agenda, text: str, mark: int) -> bool:
        """Whether an earlier row with this id keeps others out."""
        if agenda.near:
            us = agenda.ids.get(text)
        else:
            found = self.ids.getValue((text,))
            us = None if found is None else found[0]
        return us is not None and self._expiry(int(us) // self.slot_us) > mark

    def _wait_near(self, agenda: Agenda, rows: list[tuple]) -> None:
        agenda.rows.append(_stored(rows)[0])
        first = min(row[self.us_at] for row in rows)
        agenda.n_rows, agenda.first = agenda.n_rows + len(rows), first if agenda.first is None else min(agenda.first, first)

    def _due_near(self, agenda: Agenda, mark: int) -> list[tuple]:
        if not agenda.n_rows or agenda.first >= mark:
            return []
        held = [row for part in agenda.rows for row in pickle.loads(part)]
        agenda.rows, agenda.n_rows, agenda.first = [], 0, None
        rest = [row for row in held if row[self.us_at] >= mark]
        if rest:
            self._wait_near(agenda, rest)
        return [row for row in held if row[self.us_at] < mark]

    def _move_far(self, agenda: Agenda) -> None:
        """From the sender's record to map state: ids by themselves and, once folded, by slot; waiting rows by slot."""
        ids, agenda.ids = agenda.ids, None
        waiting = [pickle.loads(part) for part in agenda.rows]
        agenda.rows, agenda.n_rows, agenda.first = [], 0, None
        folded = ids.keys() - {self._text(row) for part in waiting for row in part}
        by_slot = {}
        for text in folded:
            by_slot.setdefault(int(ids[text]) // self.slot_us, []).append(text)
        for slot, texts in by_slot.items():
            self.done.updateValue((slot,), (texts,))
        agenda.done = sorted(by_slot)
        for text in folded:
            self.ids.updateValue((text,), (int(ids[text]),))
        for part in waiting:
            self._wait_far(agenda, part, {t: ids[t] for t in map(self._text, part) if t is not None})

    def _wait_far(self, agenda: Agenda, rows: list[tuple], ids: dict) -> None:
        for text, us in ids.items():
            self.ids.updateValue((text,), (int(us),))
        by_slot = {}
        for row in rows:
            by_slot.setdefault(row[self.us_at] // self.slot_us, []).append(row)
        for slot, part in sorted(by_slot.items()):
            earliest = min(row[self.us_at] for row in part)
            parts, first = agenda.waiting.get(slot, (0, earliest))
            self.waiting.updateValue((slot, parts), _stored(part))
            agenda.waiting[slot] = (parts + 1, min(first, earliest))

    def _due_far(self, agenda: Agenda, mark: int) -> list[tuple]:
        due = []
        for slot in sorted(s for s, (_, first) in agenda.waiting.items() if first < mark):
            parts, _ = agenda.waiting.pop(slot)
            held = [row for part in range(parts) for row in pickle.loads(self.waiting.getValue((slot, part))[0])]
            for part in range(parts):
                self.waiting.removeKey((slot, part))
            ready, rest = [row for row in held if row[self.us_at] < mark], [row for row in held if row[self.us_at] >= mark]
            due += ready
            if rest:
                self._wait_far(agenda, rest, {})
            known = self.done.getValue((slot,)) if slot in agenda.done else None
            texts = [t for t in map(self._text, ready) if t is not None]
            self.done.updateValue((slot,), ([*(known[0] if known else []), *texts],))
            agenda.done = sorted({*agenda.done, slot})
        return due

    # --------------------------------------------------------------- helpers
    def _order(self, row: tuple) -> tuple:
        """By time, then id; rows without an id come last, as they came."""
        tie = row[self.id_at]
        return (row[self.us_at], 1) if tie is None else (row[self.us_at], 0, tie)

    def _text(self, row: tuple) -> str | None:
        tie = row[self.id_at]
        return None if tie is None else str(int(tie)) if isinstance(tie, float) and tie.is_integer() else str(tie)

    def _expiry(self, slot: int) -> int:
        return (slot + 1) * self.slot_us + self.delay_us

    def _record(self) -> tuple[History, NamedCounts, NamedCounts]:
        row, own = _loaded(self.history.get()), len(History.FIELDS)
        near = ([], [], [], []) if row is None else row[own:]
        return History(None if row is None else row[:own]), NamedCounts(self.receivers, *near[:2]), NamedCounts(self.devices, *near[2:])

    def _rest(self, agenda: Agenda, last_us: int | None) -> None:
        """Store the agenda and set the one timer of the sender, whose latest folded event, if it can go idle, is ``last_us``."""
        times = [first for _, first in agenda.waiting.values()] + [self._expiry(s) for s in agenda.done[:1]]
        if agenda.n_rows:
            times.append(agenda.first)
        elif agenda.ids:  # near ids are cleared together
            times.append(self._expiry(max(agenda.ids.values()) // self.slot_us))
        if last_us is not None:
            times.append(last_us + self.idle_us)
        wake = min(times) // 1000 + 1 if times else None
        if wake != agenda.wake:
            if agenda.wake is not None:
                self.handle.deleteTimer(agenda.wake)
            if wake is not None:
                self.handle.registerTimer(wake)
            agenda.wake = wake
        if wake is None:
            self.agenda.clear()
        else:
            self.agenda.update(_stored(agenda.to_row()))

    def _fold(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        st, receivers, devices = self._record()
        runs = [rows]
        if self.idle_us is not None:  # a gap of ``idle_us`` starts a fresh history
            before, runs = st.last_us, [[]]
            for row in rows:
                if before is not None and row[self.us_at] - before >= self.idle_us:
                    runs.append([])
                runs[-1].append(row)
                before = row[self.us_at]
        for k, run in enumerate(runs):
            if k:
                st = History()
                receivers.clear(), devices.clear()
            if run:
                found = advance_rows(st, [tuple(row[i] for i in self.fold_at) for row in run], receivers, devices)
                yield [self._shown(key, row, more, None) for row, more in zip(run, found)]
        self.history.update(_stored((*st.to_row(), *receivers.to_lists(), *devices.to_lists())))

    def _shown(self, key, row: tuple, found: tuple | None, refused: str | None) -> tuple:
        """A row of the result: the sender, ``row``, what the fold ``found`` for it, and why it was refused."""
        return (key[0], *row, *(found or (None,) * len(FOLD_FIELDS)), refused == "late", refused)

    def close(self) -> None:
        pass


class SenderFeatures(SenderFold):
    """Data frames in and out, for the whole history of a sender at once."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [row for pdf in rows for row in zip(*(_values(pdf[c]) for c in self.names))]
        yield from map(self._frame, self.arrive(key, self._whole(held), self._mark(timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from map(self._frame, self.wake(key, self._mark(timerValues)))

    def _mark(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() * 1000 if self.ordered else 0

    def _whole(self, rows: list[tuple]) -> list[tuple]:
        # pandas holds whole numbers as floats where some are null
        return [(*row[:self.us_at], None if row[self.us_at] is None else int(row[self.us_at]), *row[self.us_at + 1:]) for row in rows]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(self.out, zip(*rows))}).astype({"late": bool})


class SenderStream(SenderFold):
    """Rows of a stream in; each call's results come out packed, as one value (see ``unpacked``)."""

    PACKED = _struct(packed=_BYTES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = ((row[c] for c in self.names) for row in rows)
        held = [tuple(None if x != x else x for x in row) for row in own]  # NaN is null
        yield from map(self._packed, self.arrive(key, held, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from map(self._packed, self.wake(key, timerValues.getCurrentWatermarkInMs() * 1000))

    def _packed(self, rows: list[tuple]) -> Row:
        return Row(packed=_stored(rows)[0])


def unpacked(schema: T.StructType):
    """For ``mapInArrow``: the rows of ``SenderStream``'s results as columns of many senders."""
    arrow = to_arrow_schema(schema)

    def columns(batches):
        rows = (row for batch in batches for part in batch.column(0) for row in pickle.loads(part.as_py()))
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some), arrow)], schema=arrow)

    return columns


STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def delay_micros(watermark: str) -> int:
    """Microseconds of a delay such as ``24 hours``."""
    n, unit = watermark.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


def sender_state_features(events: DataFrame, key: str = "sender_id", tie: str = "txn_id",
                          watermark: str = "24 hours", idle_seconds: int | None = None) -> DataFrame:
    """Streaming DataFrame of events -> events with point-in-time features.

    Start the query with ``STATE_CONF`` set (``scoring.stream_to_parquet`` does).
    A batch DataFrame is folded as a whole, sorted by (time, id).
    """
    workers_find_package(events.sparkSession)
    passthrough = [c for c in PASSTHROUGH if c in events.columns]
    fields = {f.name: f for f in events.schema.fields}
    kept = [T.StructField(tie, fields[tie].dataType), T.StructField("event_us", T.LongType())] + [
        T.StructField(c, fields[c].dataType) for c in passthrough]
    out_schema = T.StructType([T.StructField(key, T.StringType()), *kept, *[T.StructField(n, t) for n, t in FOLD_FIELDS],
                               T.StructField("late", T.BooleanType()), T.StructField("refused", T.StringType())])
    ev = events.withColumn("_at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ev = ev.withWatermark("_at", watermark)
    # The state sees the time as a number: Spark would drop late rows by the watermarked column itself.
    ev = ev.select(F.col(key).cast("string").alias(key), tie, F.unix_micros("_at").alias("event_us"), *passthrough)
    settings = (key, tie, T.StructType(kept), out_schema, delay_micros(watermark), None if idle_seconds is None else idle_seconds * 1_000_000)
    if events.isStreaming:
        packed = ev.groupBy(key).transformWithState(SenderStream(*settings, True), SenderStream.PACKED, "Append", "EventTime")
        out = packed.mapInArrow(unpacked(out_schema), out_schema)
    else:
        out = ev.groupBy(key).transformWithStateInPandas(SenderFeatures(*settings, False), out_schema, "Append", "None")
    gap, known = F.col("Time_Diff_Hours"), F.col("refused").isNull()
    out = out.withColumn("Location_Distance_Km", geo.location_distance_km(F.col("location"), F.col("prev_location")))
    out = out.withColumn("Location_Speed_Kmh", geo.speed_kmh(F.col("Location_Distance_Km"), gap))
    out = (out.withColumn("Is_Unusual_Location", geo.is_unusual_location(F.col("Location_Distance_Km"), gap).cast("long"))
           .withColumn("Is_High_Speed", geo.is_high_speed(F.col("Location_Speed_Kmh")).cast("long")))
    shown = [F.when(known, F.col(f)).alias(f) if f in LOCATION_FIELDS else F.col(f) for f, _ in FEATURE_FIELDS]
    return out.select(key, tie, F.timestamp_micros("event_us").alias("ts"), *passthrough, *shown, "late", "refused")
