"""The given star schema bound to the library's domain tables, as SQL that both Spark and an oracle can run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kestrel.session import reachable

#: view -> SQL over the given tables and earlier views. {sec x} stands for whole seconds of a timestamp since 1970.
VIEWS = {
    "tx": """
        SELECT CASE WHEN l_returnflag = 'R' THEN 'S' || CAST(l_suppkey AS STRING) ELSE 'C' || CAST(o_custkey AS STRING) END AS source,
               CASE WHEN l_returnflag = 'R' THEN 'C' || CAST(o_custkey AS STRING) ELSE 'S' || CAST(l_suppkey AS STRING) END AS target,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, {sec l_shipdate} AS t
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "accounts": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS account_id, n_name AS district, c_acctbal < 0 AS is_illicit
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 'S' || CAST(s_suppkey AS STRING), n_name, s_acctbal < 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "p2p": """
        SELECT event_id AS tx_id, 'U' || CAST(user_id AS STRING) AS source,
               'U' || CAST((user_id * 31 + event_id * 7) % (SELECT max(user_id) + 1 FROM events) AS STRING) AS target,
               CAST(round(value * 100, 2) AS DECIMAL(18,2)) AS amount, {sec ts} AS t
        FROM events""",
    "wallet_tx": """
        SELECT l_orderkey * 8 + l_linenumber AS tx_id,
               CASE WHEN l_returnflag = 'R' THEN 'P' || CAST(l_partkey AS STRING) ELSE 'C' || CAST(o_custkey AS STRING) END AS source,
               CASE WHEN l_returnflag = 'R' THEN 'C' || CAST(o_custkey AS STRING) ELSE 'P' || CAST(l_partkey AS STRING) END AS target,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "wallets": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS account_id, c_acctbal < 0 AS is_illicit FROM customer
        UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), p_size = 1 FROM part""",
    "members": """
        SELECT DISTINCT 'U' || CAST(user_id AS STRING) AS account_id, n_name AS district, (user_id * 37 % 100) / 100.0e0 AS score,
               user_id % 11 = 0 AS is_illicit
        FROM events JOIN customer ON c_custkey = user_id JOIN nation ON c_nationkey = n_nationkey""",
    "points": """
        SELECT event_id, event_type, {sec ts} AS t, user_id, n_name AS district, n_nationkey, n_regionkey,
               CAST(8 AS DOUBLE) + (n_nationkey * 37 % 25) * CAST(1.1 AS DOUBLE) + (user_id % 10) * CAST(0.02 AS DOUBLE) AS lat,
               CAST(70 AS DOUBLE) + (n_nationkey * 17 % 25) * CAST(0.9 AS DOUBLE) + (user_id % 7) * CAST(0.02 AS DOUBLE) AS lon,
               value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
        FROM events JOIN customer ON c_custkey = user_id JOIN nation ON c_nationkey = n_nationkey""",
    "scams": """
        SELECT event_id, t, user_id, district, lat, lon, value / (SELECT max(value) FROM events) AS risk_score,
               CAST(round(value * 100, 2) AS DECIMAL(18,2)) AS paid,
               CASE WHEN value / (SELECT max(value) FROM events) >= 0.5 THEN 'scam'
                    WHEN value / (SELECT max(value) FROM events) >= 0.2 THEN 'suspicious' ELSE 'legit' END AS verdict,
               CASE k % 4 WHEN 0 THEN 'digital_arrest' WHEN 1 THEN 'phishing' WHEN 2 THEN 'lottery' ELSE 'kyc' END AS scam_type, k
        FROM points WHERE event_type = 'error'""",
    "notes": """
        SELECT event_id, t, user_id, district, lat, lon, k, CASE k % 3 WHEN 0 THEN '100' WHEN 1 THEN '200' ELSE '500' END AS denomination,
               CASE WHEN k > 0 THEN 'fake' ELSE 'genuine' END AS verdict
        FROM points WHERE event_type = 'signup'""",
    "serials": """
        SELECT event_id, {sec ts} AS t, user_id,
               CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 AS STRING) || 'AB' ||
               lpad(CAST(event_id * 37 % 2000 AS STRING), 6, '0') AS serial
        FROM events""",
    "messages": """
        SELECT doc_id, coalesce(text, '') || CASE doc_id % 8
          WHEN 0 THEN ' This is Inspector Rao calling from CBI, an FIR has been registered, stay on the video call.'
          WHEN 1 THEN ' Your KYC has expired, update your PAN details at http://bit.ly/kyc1 immediately.'
          WHEN 2 THEN ' You won a lottery prize, pay the processing fee now to claim your prize.'
          WHEN 3 THEN ' Transfer the refundable security deposit to the safe custody account and do not tell anyone.'
          WHEN 4 THEN ' Pay me at rahul@okaxis or call 9876543210, IFSC SBIN0001234.'
          WHEN 5 THEN ' Visit http://paytn.com/login and share your OTP right now.'
          WHEN 6 THEN ' See you at dinner tomorrow.' ELSE '' END AS text
        FROM documents""",
    "reports": """
        SELECT points.event_id, messages.text, points.t, points.district, nullif(regexp_extract(messages.text, '([6-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9])', 1), '') AS phone,
               CASE points.k % 4 WHEN 0 THEN 'digital_arrest' WHEN 1 THEN 'phishing' WHEN 2 THEN 'lottery' ELSE 'kyc' END AS scam_type,
               CASE WHEN messages.doc_id % 8 >= 6 THEN 'legit' ELSE 'scam' END AS verdict
        FROM messages JOIN points ON points.event_id = messages.doc_id""",
    "labelled": """
        SELECT labels.doc_id, quality AS label, ((n_chars * 7 + labels.doc_id * 13) % 1000) / 1000.0e0 AS score, source
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "boundary": """
        SELECT vec_id, vec_id % 4 AS bank_id, 'A' || CAST(vec_id % 97 AS STRING) AS account_id, embedding,
               CASE WHEN (vec_id - vec_id % 4) / 4 % 2 = 0 THEN 'out' ELSE 'in' END AS direction,
               CAST((vec_id * 7919) % 1000 + 100000 AS BIGINT) AS amount_cents, CAST((vec_id * 104729) % 500 AS BIGINT) AS time_sec
        FROM embeddings""",
}
SECONDS = re.compile(r"\{sec (\w+)\}")
NEEDS = {"scams": ["points"], "notes": ["points"], "reports": ["points", "messages"]}


def needed(names: tuple[str, ...]) -> list[str]:
    wanted = {*names, *(n for v in names for n in NEEDS.get(v, ()))}
    return [v for v in VIEWS if v in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the given Parquet files; Catalyst pushes what a query needs down to their scans."""
    reachable(spark)
    body = SECONDS.sub(r"unix_timestamp(CAST(\1 AS TIMESTAMP))", VIEWS[name])
    tables = set(re.findall(r"\b(lineitem|orders|customer|supplier|part|nation|events|documents|labels|embeddings)\b", body))
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    inputs |= {v: view(spark, sf_dir, v) for v in NEEDS.get(name, ())}
    for t in inputs:
        body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", body)
    return spark.sql(body, **inputs)


def oracle(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` after the definitions of the views it names, in the oracle's dialect."""
    parts = [f"{v} AS ({SECONDS.sub(r'CAST(floor(epoch(\1)) AS BIGINT)', VIEWS[v])})" for v in needed(names)]
    body = sql.strip()
    if parts:
        head = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts)
        body = f"{head}, {re.sub(r'^WITH (RECURSIVE )?', '', body)}" if body.startswith("WITH") else f"{head} {body}"
    return body
