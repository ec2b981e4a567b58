"""Pieces of the comparison SQL: the same domain views as ``domain.py``, and the hash functions."""

from __future__ import annotations

from ..functions.hashing import ADD, C1, C2, FIN1, FIN2, murmur3_seed

LOG = """log AS (
  SELECT event_id, user_id AS "user", CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS track,
    value / (value + 50) AS "time", epoch_us(ts) // 1000 AS "timestamp",
    CASE WHEN event_type = 'purchase' THEN 'last' ELSE 'next' END AS message,
    value / 1000 AS latency,
    CASE WHEN event_type <> 'purchase'
      THEN (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + event_id) % 100 END AS recommendation
  FROM events)"""

INTER = """inter AS (
  SELECT o_custkey AS "user", l_partkey AS track, l_quantity / 50 AS "time", epoch_us(o_orderdate) // 1000 AS "timestamp",
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS "row"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CATALOG = """catalog AS (
  SELECT p_partkey AS track, p_name AS title, p_brand AS artist, p_type AS genre, p_retailprice AS pop,
    CAST(p_size AS BIGINT) AS size FROM part)"""

VEC = """vec AS (SELECT vec_id AS id, embedding AS vector, label FROM embeddings)"""

PAIRS = """pairs AS (SELECT "user", track, avg("time") AS "time" FROM inter GROUP BY 1, 2)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def uniform_sql(*values: str, seed: int = 0) -> str:
    text = ", ".join([f"CAST({v} AS VARCHAR)" for v in values] + [f"'{seed}'"])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _bind(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _mul(value: str, factor: int) -> str:
    return f"((({value}) * {factor}::UBIGINT) & 4294967295::UBIGINT)"


def _scramble(value: str, n: str) -> str:
    first = _mul(value, C1)
    rot = _bind(first, f"v_{n}", f"(((v_{n} << 15) & 4294967295::UBIGINT) | (v_{n} >> 17))")
    return _mul(rot, C2)


def murmur_sql(text: str, seed: int) -> str:
    """Unsigned murmur3_32 of an ASCII text expression."""

    def byte(at: str) -> str:
        return f"ascii(substr({text}, ({at})::BIGINT + 1, 1))::UBIGINT"

    size = f"length({text})"
    block = f"({byte('b * 4')} + ({byte('b * 4 + 1')} << 8) + ({byte('b * 4 + 2')} << 16) + ({byte('b * 4 + 3')} << 24))"
    blocks = f"list_transform(range(0, {size} // 4), lambda b: {block})"
    step = _bind(f"xor(h, {_scramble('k', 's')})", "x", "(((x << 13) & 4294967295::UBIGINT) | (x >> 19))")
    body = (
        f"list_reduce({blocks}, lambda h, k: (({step}) * 5 + {ADD}::UBIGINT) & 4294967295::UBIGINT, {seed}::UBIGINT)"
    )
    base = f"({size} // 4) * 4"
    tail = "(" + " + ".join(
        f"CASE WHEN {size} % 4 >= {i + 1} THEN {byte(f'{base} + {i}')} << {8 * i} ELSE 0::UBIGINT END" for i in range(3)
    ) + ")"
    mixed = f"xor(xor({body}, {_scramble(tail, 't')}), {size}::UBIGINT)"
    mixed = _bind(mixed, "p", "xor(p, p >> 16)")
    mixed = _bind(_mul(mixed, FIN1), "q", "xor(q, q >> 13)")
    return _bind(_mul(mixed, FIN2), "r", "xor(r, r >> 16)")


def assign_sql(user: str, experiment: str, ways: int) -> str:
    arm = f"({murmur_sql(f'CAST({user} AS VARCHAR)', murmur3_seed(experiment))} % {ways}::UBIGINT)"
    return f"CASE WHEN {arm} = 0 THEN 'C' ELSE 'T' || CAST({arm} AS VARCHAR) END"


def arms(experiment: str, ways: int) -> str:
    """CTE: treatment of every user of the log."""
    return f"""arms AS (SELECT u AS "user", {assign_sql('u', experiment, ways)} AS treatment
  FROM (SELECT DISTINCT user_id AS u FROM events))"""


TREATED = """tlog AS (SELECT log.*, arms.treatment FROM log JOIN arms USING ("user"))"""

SESSIONS = """numbered AS (
  SELECT *, coalesce(sum(CASE WHEN message = 'last' THEN 1 ELSE 0 END) OVER (PARTITION BY "user", treatment
    ORDER BY "timestamp", message, "time", track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM tlog),
sessions AS (
  SELECT "user", treatment, sid, min("timestamp") AS "timestamp", max("timestamp") AS last_ts, count(*) AS tracks,
    sum("time") AS "time", sum(latency * 1000) AS latency
  FROM numbered GROUP BY 1, 2, 3 HAVING max(CASE WHEN message = 'last' THEN 1 ELSE 0 END) = 1)"""

USERS = """users AS (
  SELECT "user", treatment, count(*) AS sessions, CAST(sum(tracks) AS BIGINT) AS tracks, sum("time") AS "time",
    sum(latency) AS latency, sum(latency) / sum(tracks) AS mean_request_latency,
    CAST(sum(tracks) AS DOUBLE) / count(*) AS mean_tracks_per_session,
    sum("time") / count(*) AS mean_time_per_session
  FROM sessions GROUP BY 1, 2)"""
