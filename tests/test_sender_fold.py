"""The fold of a sender's rows equals row-by-row steps, with the state carried from call to call."""

import random

import pandas as pd
import pytest

from tests.sender_steps import Counts, Steps
from txnrisk.streaming.sender_state import FOLD_FIELDS, History, advance


def _events(seed, n):
    rnd = random.Random(seed)
    t = 1_700_000_000_000_000
    rows = []
    for i in range(n):
        t += rnd.choice([0, 1_000_000, 60_000_000, 400_000_000, 3_600_000_000, 90_000_000_000])
        rows.append({"event_us": t, "txn_id": i, "amount": rnd.choice([1.0, 50.0, 7000.0, 0.0]),
                     "device_id": rnd.choice(["D1", "D2", None]),
                     "location": rnd.choice(["12.9716, 77.5946", "28.6139, 77.2090", "n/a", None]),
                     "receiver_id": rnd.choice(["R1", "R2", "R3", None])})
    return pd.DataFrame(rows)


@pytest.mark.parametrize("seed", range(6))
def test_fold_equals_steps(seed):
    ev = _events(seed, 60)
    cuts = sorted(random.Random(seed + 100).sample(range(1, 60), 4))
    state, receivers, devices, steps, start = History(), Counts(), Counts(), Steps(), 0
    names = [f for f, _ in FOLD_FIELDS if f != "prev_location"]
    for end in cuts + [60]:
        batch = ev.iloc[start:end].reset_index(drop=True)
        got = advance(state, batch, receivers, devices)
        want = pd.DataFrame([steps.step(int(u), float(a), d, loc, r) for u, a, d, loc, r in
                             zip(batch["event_us"], batch["amount"], batch["device_id"], batch["location"], batch["receiver_id"])])
        for c in names:
            assert got[c].to_numpy().tolist() == pytest.approx(want[c].to_numpy().tolist(), rel=1e-9, abs=1e-9), c
        state = History(state.to_row())  # as stored
        start = end


def test_a_batch_costs_what_it_meets():
    """Receivers met before cost a later batch nothing unless they come up again."""
    rows = pd.DataFrame({"event_us": range(3), "amount": 1.0, "device_id": "D1", "location": None, "receiver_id": ["a", "b", "a"]})
    calls = []
    for known in (0, 100_000):
        receivers, devices = Counts({f"r{i}": 1 for i in range(known)}), Counts()
        advance(History(), rows, receivers, devices)
        calls.append(receivers.calls)
    assert calls == [4, 4]  # two receivers read and written


def test_the_record_does_not_grow_with_receivers():
    state, receivers, devices = History(), Counts(), Counts()
    sizes = []
    for n in (10, 1000, 5000):
        rows = pd.DataFrame({"event_us": [state.last_us or 0 + i * 3_600_000_000 for i in range(n)], "amount": 1.0, "device_id": "D1",
                             "location": None, "receiver_id": [f"{n}-{i}" for i in range(n)]})
        rows["event_us"] = (state.last_us or 0) + (rows.index + 1) * 3_600_000_000
        advance(state, rows, receivers, devices)
        sizes.append(len(repr(state.to_row())))
    assert max(sizes) < sizes[0] + 60 and state.n_receivers == 6010
