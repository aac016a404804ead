"""The sender fold gives the same features however its rows are batched."""

import numpy as np
import pandas as pd
import pytest

from tests.sender_steps import Counts
from txnrisk.streaming.sender_state import History, advance


def _fold(ev, size):
    st, receivers, devices, out = History(), Counts(), Counts(), []
    for lo in range(0, len(ev), size):
        out.append(advance(st, ev.iloc[lo:lo + size].reset_index(drop=True), receivers, devices))
        st = History(st.to_row())
    return pd.concat(out, ignore_index=True)


def _events(n):
    rng = np.random.default_rng(5)
    return pd.DataFrame({"event_us": 1_700_000_000_000_000 + np.cumsum(rng.integers(0, 400, n)) * 1_000_000,
                         "amount": np.where(np.arange(n) % 40 == 3, 1e9, rng.random(n) + 0.1), "device_id": "D1",
                         "location": "12.9, 77.5", "receiver_id": rng.choice(["R1", "R2", None], n)})


@pytest.mark.parametrize("size", [1, 7, 255, 256, 600])
def test_features_do_not_depend_on_batch_size(size):
    ev = _events(600)
    got = _fold(ev, size)
    pd.testing.assert_frame_equal(got, _fold(ev, 13), check_exact=True, check_dtype=False)
    for i in range(600):
        window = ev["amount"].to_numpy()[max(0, i - 9):i + 1]
        assert got["Amount_Rolling_Std_10"][i] == pytest.approx(window.std(ddof=1) if i else 0.0, rel=1e-9), i
