"""Registry of queries and the SQL fixtures that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

CELL = """
cell0 AS (
  SELECT (vec_id // 50)::INT AS tid, (vec_id % 50 + 1)::INT AS r, i::INT AS c, embedding[i]::DOUBLE AS v, label AS veg_class
  FROM embeddings, range(1, 65) t(i)
), cell AS (
  SELECT *, 1500e0 + 12e0 * c + 40e0 * v AS elev,
    CASE WHEN v > (c - 32.5e0) / 80e0 AND abs(v) < (c - 3e0) / 60e0 THEN 1 END AS veg1,
    CASE WHEN v < (c - 32.5e0) / 80e0 - 0.02e0 AND abs(v) < (63e0 - c) / 60e0 THEN 1 END AS veg2,
    CASE WHEN v > 0.3e0 THEN 1 END AS excl
  FROM cell0
)"""
PATH = """
line_point AS (
  SELECT user_id AS tid, seq::INT AS seq, seq * 30e0 AS dist_m, value AS elev, event_type AS veg_class
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
)"""
POINT = """
raw_point AS (
  SELECT (l_partkey % 64)::INT AS c, l_suppkey::INT AS r, l_quantity::DOUBLE AS value, l_returnflag AS flag,
         nullif(l_linenumber, 7)::INT AS class, l_linestatus AS tile
  FROM lineitem
)"""
DENSITY = CELL + """,
dens AS (
  SELECT tid, veg, c, d FROM (
    SELECT tid, c, count(veg1) / 50e0 AS d1, count(veg2) / 50e0 AS d2 FROM cell GROUP BY tid, c
  ) CROSS JOIN LATERAL (VALUES ('veg1', d1), ('veg2', d2)) x(veg, d)
)"""


def smooth(source: str = "dens", out: str = "sm") -> str:
    return f"""
{out}_3 AS (
  SELECT *, avg(d) OVER (PARTITION BY tid, veg ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m,
    lag(c) OVER w IS NULL AS is_first, lead(c) OVER w IS NULL AS is_last
  FROM {source} WINDOW w AS (PARTITION BY tid, veg ORDER BY c)
), {out} AS (
  SELECT tid, veg, c, d, CASE WHEN is_first AND is_last THEN d WHEN is_first THEN lead(m) OVER w WHEN is_last THEN lag(m) OVER w ELSE m END AS s
  FROM {out}_3 WINDOW w AS (PARTITION BY tid, veg ORDER BY c)
)"""


def zone(source: str = "sm", prefix: str = "z") -> str:
    """From a smoothed profile to prefix_out(tid, start_c, end_c)."""
    p = prefix
    return f"""
{p}_f AS (
  SELECT tid, veg, c, k >= 75 AS hi, k >= 50 AS mn, k <= 5 AS lo FROM (SELECT *, round_even(s * 100, 0) AS k FROM {source})
), {p}_run AS (
  SELECT kind, tid, veg, min(c) AS a, max(c) AS b FROM (
    SELECT kind, tid, veg, c, c - row_number() OVER (PARTITION BY kind, tid, veg ORDER BY c) AS g
    FROM (SELECT 'hi' AS kind, tid, veg, c FROM {p}_f WHERE hi UNION ALL SELECT 'mn', tid, veg, c FROM {p}_f WHERE mn UNION ALL SELECT 'lo', tid, veg, c FROM {p}_f WHERE lo)
  ) GROUP BY kind, tid, veg, g
), {p}_v1s AS (SELECT tid, max(a) AS a, max(b) AS b FROM {p}_run WHERE kind = 'hi' AND veg = 'veg1' GROUP BY tid),
{p}_v1e AS (SELECT x.tid, max(x.a) AS a, max(x.b) AS b FROM {p}_run x JOIN {p}_v1s s ON x.tid = s.tid AND x.a > s.b WHERE kind = 'lo' AND veg = 'veg1' GROUP BY x.tid),
{p}_v2s AS (SELECT tid, min(a) AS a, min(b) AS b FROM {p}_run WHERE kind = 'lo' AND veg = 'veg2' GROUP BY tid),
{p}_v2e AS (SELECT x.tid, min(x.a) AS a, min(x.b) AS b FROM {p}_run x JOIN {p}_v2s s ON x.tid = s.tid AND x.a > s.b WHERE kind = 'hi' AND veg = 'veg2' GROUP BY x.tid),
{p}_begin AS (
  SELECT v1s.tid, greatest(v2s.a, m.a) AS start_c
  FROM {p}_v1s v1s JOIN {p}_run m ON m.tid = v1s.tid AND m.kind = 'mn' AND m.veg = 'veg1' AND v1s.b BETWEEN m.a AND m.b
  JOIN {p}_v2s v2s ON v2s.tid = v1s.tid WHERE greatest(v2s.a, m.a) <= least(v2s.b, v1s.b)
), {p}_far AS (
  SELECT b.tid, start_c, greatest(v2e.a, start_c + 1) AS f FROM {p}_begin b JOIN {p}_v2e v2e ON v2e.tid = b.tid WHERE v2e.b > start_c
), {p}_out AS (
  SELECT f.tid, f.start_c, least(v1e.b, m.b) AS end_c
  FROM {p}_far f JOIN {p}_run m ON m.tid = f.tid AND m.kind = 'mn' AND m.veg = 'veg2' AND f.f BETWEEN m.a AND m.b
  JOIN {p}_v1e v1e ON v1e.tid = f.tid WHERE greatest(v1e.a, f.f) <= least(v1e.b, m.b)
)"""


def R(expression: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"round({expression}, {digits}) + 0e0"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded, as in the SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
