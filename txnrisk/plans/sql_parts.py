"""Shared DuckDB SQL fragments for the oracle queries."""

from __future__ import annotations

from txnrisk.schema import FRAUD_TYPES_BY_PAYMENT, FRAUD_TYPES_OTHER, FRAUD_WEIGHTS, CITIES

# Plain per-sender windows over the fixture view: the reference definition
# each distributed feature is checked against.
HIST0 = """
SELECT *,
 (epoch_us(ts) - epoch_us(lag(ts) OVER w))/1e6/3600.0 AS gh,
 (epoch_us(ts) - epoch_us(lag(ts) OVER w))/1e6/60.0 AS gm,
 lag(device_id) OVER w AS prev_device, lag(location) OVER w AS prev_location,
 CAST(row_number() OVER w AS BIGINT) AS Txn_Count_Total,
 avg(amount) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS Amount_Rolling_Mean_10,
 coalesce(stddev_samp(amount) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0.0) AS Amount_Rolling_Std_10,
 CAST(count(*) OVER (PARTITION BY sender_id ORDER BY ts RANGE BETWEEN INTERVAL '599999999 microseconds' PRECEDING
      AND INTERVAL '1 microseconds' PRECEDING) + row_number() OVER (PARTITION BY sender_id, ts ORDER BY txn_id) AS BIGINT)
   AS Txn_Count_Last_10_Min,
 CAST(row_number() OVER (PARTITION BY sender_id, receiver_id ORDER BY ts, txn_id) AS BIGINT) AS Receiver_Frequency,
 avg(amount) OVER (PARTITION BY sender_id) AS avg_amount,
 CAST(count(DISTINCT device_id) OVER (PARTITION BY sender_id) AS BIGINT) AS Device_Count,
 CAST(count(DISTINCT receiver_id) OVER (PARTITION BY sender_id) AS BIGINT) AS Receiver_Diversity
FROM txn WINDOW w AS (PARTITION BY sender_id ORDER BY ts, txn_id)
"""


def _dist(loc_a: str, loc_b: str) -> str:
    def part(loc, i):
        return (f"CASE WHEN len(string_split({loc}, ',')) = 2 THEN "
                f"TRY_CAST(trim(string_split({loc}, ',')[{i}]) AS DOUBLE) END")
    la1, lo1, la2, lo2 = part(loc_a, 1), part(loc_a, 2), part(loc_b, 1), part(loc_b, 2)
    a = (f"sin(radians(({la2}) - ({la1}))/2)*sin(radians(({la2}) - ({la1}))/2) + "
         f"cos(radians({la1}))*cos(radians({la2}))*sin(radians(({lo2}) - ({lo1}))/2)"
         f"*sin(radians(({lo2}) - ({lo1}))/2)")
    return (f"coalesce(6371.0e0 * (2 * asin(CASE WHEN sqrt({a}) > 1.0e0 THEN 1.0e0 ELSE sqrt({a}) END)), "
            f"10000.0e0)")


DIST = _dist("location", "prev_location")

HIST = f"""
SELECT *,
 CAST(sum(CASE WHEN Time_Diff_Hours <= 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS Txn_Count_Last_1H,
 CAST(sum(CASE WHEN Time_Diff_Hours <= 6 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS Txn_Count_Last_6H,
 CAST(sum(CASE WHEN Time_Diff_Hours <= 24 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS Txn_Count_Last_24H,
 CAST(sum(CASE WHEN Time_Diff_Hours <= 0.1 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT)
   AS Rapid_Txn_Count_Last_1H,
 CASE WHEN device_id = prev_device THEN 0 ELSE 1 END AS Is_New_Device,
 CASE WHEN Receiver_Frequency = 1 THEN 1 ELSE 0 END AS Is_First_Time_Receiver,
 CASE WHEN Location_Distance_Km > 500 AND Time_Diff_Hours < 24 THEN 1 ELSE 0 END AS Is_Unusual_Location,
 Location_Distance_Km / CASE WHEN Time_Diff_Hours = 0 THEN 0.01e0 ELSE Time_Diff_Hours END AS Location_Speed_Kmh
FROM (SELECT *, coalesce(gh, 24.0e0) AS Time_Diff_Hours, coalesce(gm, 10000.0e0) AS Time_Since_Last_Txn,
        {DIST} AS Location_Distance_Km FROM hist0)
WINDOW w AS (PARTITION BY sender_id ORDER BY ts, txn_id)
"""

ROW_FEATURES = """
 CAST(hour(ts) AS BIGINT) AS Hour, CAST(isodow(ts) - 1 AS BIGINT) AS Day_of_Week,
 CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS Is_Weekend,
 CASE WHEN hour(ts) >= 22 OR hour(ts) <= 5 THEN 1 ELSE 0 END AS Is_Night,
 sin(6.283185307179586e0 * hour(ts) / 24.0e0) AS Hour_Sin, cos(6.283185307179586e0 * hour(ts) / 24.0e0) AS Hour_Cos,
 sin(6.283185307179586e0 * (isodow(ts) - 1) / 7.0e0) AS Day_Sin, cos(6.283185307179586e0 * (isodow(ts) - 1) / 7.0e0) AS Day_Cos
"""


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rule_scores_sql(amount="amount", merchant="merchant_type", device="device_id",
                    unusual="Is_Unusual_Location", count10="Txn_Count_Last_10_Min",
                    receiver="receiver_id") -> dict[str, str]:
    """Per type score expression, terms added in the fixed order."""
    terms = {
        "amount": lambda w: (f"CASE WHEN {amount} > 5000 THEN {dbl(w)} WHEN {amount} < 10 THEN {dbl(w * 0.8)} "
                             f"ELSE 0.0e0 END"),
        "merchant": lambda w: f"CASE WHEN {merchant} = 'Unknown' THEN {dbl(w)} ELSE 0.0e0 END",
        "device": lambda w: (f"CASE WHEN contains(coalesce({device}, ''), 'New_Device') OR "
                             f"contains(coalesce({device}, ''), 'Unknown_Device') THEN {dbl(w)} ELSE 0.0e0 END"),
        "location": lambda w: f"CASE WHEN coalesce({unusual}, 0) <> 0 THEN {dbl(w)} ELSE 0.0e0 END",
        "count10": lambda w: f"CASE WHEN coalesce({count10}, 0) > 5 THEN {dbl(w)} ELSE 0.0e0 END",
        "txn_type": lambda w: dbl(w * 0.5),
        "receiver": lambda w: f"CASE WHEN contains(coalesce({receiver}, ''), 'Suspicious') THEN {dbl(w)} ELSE 0.0e0 END",
    }
    out = {}
    for t, weights in FRAUD_WEIGHTS:
        expr = "0.0e0"
        for sig, w in weights:
            expr = f"({expr} + {terms[sig](w)})"
        out[t] = expr
    return out


def score_col(t: str) -> str:
    return "score_" + t.lower().replace(" ", "_")


def pick_type_sql(txn_type: str = "txn_type") -> str:
    def first_max(names):
        g = "greatest(" + ", ".join(score_col(n) for n in names) + ")"
        return "CASE " + " ".join(f"WHEN {score_col(n)} = {g} THEN '{n}'" for n in names) + " END"
    return (f"CASE WHEN {txn_type} = 'UPI' THEN {first_max(FRAUD_TYPES_BY_PAYMENT['UPI'])} "
            f"WHEN {txn_type} = 'Card' THEN {first_max(FRAUD_TYPES_BY_PAYMENT['Card'])} "
            f"ELSE {first_max(FRAUD_TYPES_OTHER)} END")


def scores_select(**kw) -> str:
    return ", ".join(f"{e} AS {score_col(t)}" for t, e in rule_scores_sql(**kw).items())


CITIES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS city, {dbl(lat)} AS city_lat, {dbl(lon)} AS city_lon, {i} AS city_pos"
    for i, (n, lat, lon) in enumerate(CITIES))
