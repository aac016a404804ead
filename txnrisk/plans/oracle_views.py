"""DuckDB forms of the fixture views, for the oracle SQL of each query.

Only the base test tables are registered in the oracle engine, so each
oracle query inlines the views it needs as common table expressions.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["txn"] = """
SELECT event_id AS txn_id, ts, user_id, k, value*value*4 AS amount,
 concat('User_', CAST(user_id AS VARCHAR)) AS sender_id,
 CASE WHEN k<5 THEN concat('Suspicious_',CAST(k AS VARCHAR))
      WHEN k<10 THEN concat('Test_Merchant_',CAST(k AS VARCHAR))
      ELSE concat('Merchant_',CAST(k AS VARCHAR)) END AS receiver_id,
 CASE event_type WHEN 'purchase' THEN 'UPI' WHEN 'click' THEN 'UPI'
      WHEN 'view' THEN 'Card' WHEN 'signup' THEN 'Card' ELSE 'Netbanking' END AS txn_type,
 CASE k % 7 WHEN 0 THEN 'Online_Retail' WHEN 1 THEN 'Food' WHEN 2 THEN 'Travel'
      WHEN 3 THEN 'Entertainment' WHEN 4 THEN 'Utilities' WHEN 5 THEN 'Unknown'
      ELSE 'Retail_Physical' END AS merchant_type,
 CASE WHEN k % 20 = 0 THEN concat('Unknown_Device_',CAST(k AS VARCHAR))
      WHEN k % 20 = 1 THEN concat('New_Device_',CAST(k AS VARCHAR))
      ELSE concat('Device_',CAST(user_id AS VARCHAR)) END AS device_id,
 CASE WHEN k=77 THEN '-34.6037, -58.3816' WHEN k=78 THEN '35.6762, 139.6503' WHEN k=79 THEN 'n/a' ELSE
  CASE (user_id + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END) % 8
   WHEN 0 THEN '28.6139, 77.2090' WHEN 1 THEN '19.0760, 72.8777' WHEN 2 THEN '12.9716, 77.5946'
   WHEN 3 THEN '13.0827, 80.2707' WHEN 4 THEN '22.5726, 88.3639' WHEN 5 THEN '17.3850, 78.4867'
   WHEN 6 THEN '18.5204, 73.8567' ELSE '23.0225, 72.5714' END END AS location,
 CASE WHEN (k<8 AND event_id % 10 <> 0) OR (k>=92 AND event_id % 13 = 0) THEN 1 ELSE 0 END AS is_fraud
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events) e
"""

VIEWS["req"] = """
SELECT txn_id, k, amount, txn_type,
 CASE WHEN k % 17 = 0 THEN concat('40000', lpad(CAST(txn_id*7919 % 10000000000 AS VARCHAR),10,'0'))
      ELSE concat('400000', lpad(CAST(txn_id*7919 % 10000000000 AS VARCHAR),10,'0')) END AS card_number,
 CASE WHEN k % 9 = 0 THEN '12' WHEN k % 11 = 0 THEN '12a'
      ELSE lpad(CAST(txn_id % 1000 AS VARCHAR),3,'0') END AS cvv,
 concat(lpad(CAST(k % 14 AS VARCHAR),2,'0'),'/',lpad(CAST(20 + k % 10 AS VARCHAR),2,'0')) AS expiry,
 CASE WHEN k % 6 = 0 THEN concat(sender_id,'@bank') WHEN k % 6 = 1 THEN sender_id
      ELSE concat('user', CAST(user_id AS VARCHAR), '@bank.com') END AS upi_id
FROM txn
"""

VIEWS["feedback"] = """
SELECT txn_id, k % 2 = 0 AS is_fraud, ts + INTERVAL '1' HOUR AS feedback_ts FROM txn WHERE txn_id % 50 = 0
UNION ALL SELECT txn_id, k % 3 = 0, ts + INTERVAL '2' HOUR FROM txn WHERE txn_id % 500 = 0
UNION ALL SELECT txn_id + 1000000, k % 2 = 1, ts + INTERVAL '1' HOUR FROM txn WHERE txn_id % 1000 = 7
"""

VIEWS["ledger"] = """
SELECT txn_id, ts, amount, sender_id, receiver_id, txn_type, merchant_type, device_id, location, is_fraud,
 CASE WHEN is_fraud=1 THEN CASE txn_id % 4 WHEN 0 THEN 'SIM Swap' WHEN 1 THEN 'Small Testing'
      WHEN 2 THEN 'CNP Fraud' ELSE '' END ELSE '-' END AS fraud_type,
 (txn_id*7919 % 1000)/1000.0e0 AS fraud_probability,
 CASE WHEN is_fraud=1 THEN 'BLOCKED' ELSE 'COMPLETED' END AS status FROM txn
"""

VIEWS["otxn"] = """
SELECT o_orderkey AS txn_id, o_orderdate AS ts, concat('Cust_', CAST(o_custkey AS VARCHAR)) AS sender_id,
 o_totalprice AS amount FROM orders
"""

# Views other views depend on (emitted first).
_DEPENDS = {"req": ["txn"], "feedback": ["txn"], "ledger": ["txn"]}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with ``WITH`` clauses for the named views (+ extras)."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body
