"""The sender features row by row: the definition that tests compare the fold with."""

import math

import numpy as np

from txnrisk.schema import (EARTH_RADIUS_KM, FIRST_GAP_HOURS, FIRST_GAP_MINUTES, GAP_COUNT_HOURS, HIGH_SPEED_KMH, MISSING_DISTANCE_KM,
                            RAPID_GAP_HOURS, ROLLING_ROWS, UNUSUAL_DISTANCE_KM, UNUSUAL_GAP_HOURS, VELOCITY_WINDOW_SECONDS,
                            ZERO_GAP_HOURS)


class Counts(dict):
    """In place of a map state; counts the calls."""

    calls = 0

    def get(self, name):
        self.calls += 1
        return super().get(name, 0)

    def put(self, name, n):
        self.calls += 1
        self[name] = n


def parse(loc):
    parts = [] if loc is None else str(loc).split(",")
    try:
        return (float(parts[0].strip()), float(parts[1].strip())) if len(parts) == 2 else None
    except ValueError:
        return None


def haversine(a, b):
    if a is None or b is None:
        return MISSING_DISTANCE_KM
    s_lat, s_lon = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    h = s_lat * s_lat + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * s_lon * s_lon
    return EARTH_RADIUS_KM * (2 * math.asin(min(math.sqrt(h), 1.0)))


class Steps:
    def __init__(self):
        self.rows, self.receivers, self.devices = [], [], []

    def step(self, us, amount, device, location, receiver):
        last = self.rows[-1] if self.rows else None
        tdh = FIRST_GAP_HOURS if last is None else (us - last[0]) / 1e6 / 3600.0
        tsl = FIRST_GAP_MINUTES if last is None else (us - last[0]) / 1e6 / 60.0
        self.rows.append((us, amount, device, location, tdh))
        self.receivers.append(str(receiver or ""))
        self.devices.append(str(device or ""))
        gaps, recent = [r[4] for r in self.rows], np.array([r[1] for r in self.rows[-ROLLING_ROWS:]])
        dist = haversine(parse(location), parse(last[3]) if last else None)
        speed = dist / (ZERO_GAP_HOURS if tdh == 0 else tdh)
        freq = self.receivers.count(self.receivers[-1])
        return {"Time_Since_Last_Txn": tsl, "Time_Diff_Hours": tdh, "Txn_Count_Total": len(self.rows),
                **{f"Txn_Count_Last_{h}H": sum(g <= h for g in gaps) for h in GAP_COUNT_HOURS},
                "Rapid_Txn_Count_Last_1H": sum(g <= RAPID_GAP_HOURS for g in gaps[-ROLLING_ROWS:]),
                "Amount_Rolling_Mean_10": recent.mean(), "Amount_Rolling_Std_10": recent.std(ddof=1) if len(recent) > 1 else 0.0,
                "Is_New_Device": 0 if last and device is not None and device == last[2] else 1, "Location_Distance_Km": dist,
                "Is_Unusual_Location": int(dist > UNUSUAL_DISTANCE_KM and tdh < UNUSUAL_GAP_HOURS), "Location_Speed_Kmh": speed,
                "Is_High_Speed": int(speed > HIGH_SPEED_KMH), "Receiver_Frequency": freq, "Is_First_Time_Receiver": int(freq == 1),
                "Txn_Count_Last_10_Min": sum(r[0] > us - VELOCITY_WINDOW_SECONDS * 1_000_000 for r in self.rows),
                "device_count_so_far": len(set(self.devices)), "receiver_diversity_so_far": len(set(self.receivers)),
                "sender_mean_so_far": sum(r[1] for r in self.rows) / len(self.rows)}
