"""Planted geometry over the driver's tables, as one SQL text for both engines.

``{lineitem}``, ``{supplier}``, ``{orders}`` and ``{part}`` stand for the tables;
``{id60}`` turns the hexadecimal text ``h`` into a 60-bit number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.session import read_table

_DIRECTION = "CASE {k} % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0.6e0 ELSE 0.8e0 END AS ux, CASE {k} % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0.8e0 ELSE -0.6e0 END AS uy"
_PIPE = "(({k} * 37) % 50) * 2e0 AS ax, (({k} * 61) % 47) * 2e0 AS ay, ({k} % 8) * 0.25e0 + 0.1e0 AS az, 4e0 + {k} % 9 AS len, " + _DIRECTION

POINTS = f"""
SELECT {{id60}} AS point_id, ax + t * len * ux - off * uy AS x, ay + t * len * uy + off * ux AS y, az + dz AS z, class, k AS supplier
FROM (
  SELECT l_suppkey AS k, {_PIPE.replace("{k}", "l_suppkey")},
    CASE WHEN l_linenumber = 7 THEN 0.25e0 + 0.5e0 * (l_orderkey % 2) + ((l_orderkey * 31) % 41 - 20) / 10000e0
      ELSE ((l_orderkey * 7919 + l_linenumber * 104729) % 10007) / 10007e0 END AS t,
    ((l_partkey * 31 + l_linenumber * 17) % 201 - 100) / 1000e0 AS off,
    ((l_orderkey * 13 + l_partkey * 7) % 101 - 50) / 1000e0 AS dz,
    CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS class,
    substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18, 2)))), 1, 15) AS h
  FROM {{lineitem}}
)
"""

GT = f"SELECT k AS id, ax AS x0, ay AS y0, az AS z0, ax + len * ux AS x1, ay + len * uy AS y1, az AS z1 FROM (SELECT s_suppkey AS k, {_PIPE.replace('{k}', 's_suppkey')} FROM {{supplier}})"

DET = f"""
SELECT k * 10 + part AS id, ax + t0 * len * ux + dx AS x0, ay + t0 * len * uy + dy AS y0, az + 0.05e0 AS z0,
  ax + t1 * len * ux + dx AS x1, ay + t1 * len * uy + dy AS y1, az + 0.05e0 AS z1
FROM (
  SELECT *, 0.1e0 * ((k * 13) % 9 - 4) AS s FROM (SELECT s_suppkey AS k, {_PIPE.replace("{k}", "s_suppkey")} FROM {{supplier}})
) CROSS JOIN (SELECT 0 AS part, 0e0 AS t0, 1e0 AS t1 UNION ALL SELECT 1, 0e0, 0.45e0 UNION ALL SELECT 2, 0.55e0, 1e0 UNION ALL SELECT 3, 0e0, 1e0)
CROSS JOIN LATERAL (SELECT CASE part WHEN 0 THEN -s * uy WHEN 3 THEN 5.03e0 ELSE 0e0 END AS dx, CASE part WHEN 0 THEN s * ux WHEN 3 THEN 5.07e0 ELSE 0e0 END AS dy)
WHERE CASE part WHEN 0 THEN k % 7 <> 0 AND k % 5 <> 0 WHEN 3 THEN k % 6 = 0 ELSE k % 7 <> 0 AND k % 5 = 0 END
"""

_SEGMENTS = """
SELECT {key} AS seg_id, CAST(({key} * 31) % 40 AS INT) AS slice_id, x0, y0, z0, x0 + (({key} * 13) % 41 - 20) / 10e0 + 0.05e0 AS x1, y0 + (({key} * 17) % 37 - 18) / 10e0 AS y1, z0 AS z1
FROM (SELECT {key}, (({key} * 7919) % 10007) / 100e0 AS x0, (({other} * 104729) % 10009) / 100e0 AS y0, (({key} * 31) % 40) / 10e0 AS z0 FROM {table})
"""
#: Random line fragments, many and fewer.
FRAGMENTS = _SEGMENTS.replace("{key}", "o_orderkey").replace("{other}", "o_custkey").replace("SELECT o_orderkey, (", "SELECT o_orderkey, o_custkey, (").replace("{table}", "{orders}")
FEW_FRAGMENTS = _SEGMENTS.replace("{key}", "p_partkey").replace("{other}", "p_partkey").replace("{table}", "{part}")

#: Planted fittings: the two places of every pipe where class 2 points lie, and detections near three quarters of them.
GT_COMP = "SELECT id * 2 + j AS id, x0 + t * (x1 - x0) AS cx, y0 + t * (y1 - y0) AS cy, z0 + t * (z1 - z0) AS cz FROM ({gt}) CROSS JOIN (SELECT 0 AS j, 0.25e0 AS t UNION ALL SELECT 1, 0.75e0)"
DET_COMP = "SELECT id, cx + ((id * 7) % 5 - 2) * 0.11e0 AS cx, cy + ((id * 11) % 5 - 2) * 0.13e0 + CASE WHEN id % 9 = 0 THEN 3.01e0 ELSE 0e0 END AS cy, cz + ((id * 3) % 4) * 0.02e0 AS cz FROM ({gt_comp}) WHERE id % 4 <> 3"

#: One-dimensional intervals by supplier, and heights by user.
INTERVALS = "SELECT {id60} AS row_id, grp, lo, hi, z FROM (SELECT l_suppkey AS grp, ((l_orderkey * 37) % 5000) / 10e0 AS lo, ((l_orderkey * 37) % 5000) / 10e0 + l_quantity / 10e0 AS hi, CAST(l_discount AS DOUBLE) AS z, substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18, 2)))), 1, 15) AS h FROM {lineitem})"
CHAIN = "SELECT k AS chain_id, CAST(seq AS INT) AS seq, seq * 0.5e0 + k * 0.01e0 AS x, ((seq * 7 + k) % 5 - 2) * 0.02e0 + CASE WHEN (seq * 13 + k * 5) % 17 = 0 THEN 0.4e0 ELSE 0e0 END AS y, 1e0 + 0.01e0 * ((seq * 3 + k) % 4) + CASE WHEN seq > 8 + k % 5 THEN 0.45e0 ELSE 0e0 END + CASE WHEN seq > 15 + k % 3 THEN 0.03e0 * (seq - 15) ELSE 0e0 END AS z FROM (SELECT s_suppkey AS k FROM {supplier}) CROSS JOIN ({seqs})"

_NAMES = ("lineitem", "supplier", "orders", "part")


def _text(name: str) -> str:
    text = globals()[name]
    if name in ("GT_COMP", "DET_COMP"):
        text = text.replace("{gt_comp}", GT_COMP).replace("{gt}", GT)
    return text


def duck(name: str) -> str:
    """DuckDB text of a planted view."""
    text = _text(name).replace("{id60}", "CAST('0x' || h AS BIGINT)").replace("{seqs}", "SELECT CAST(range AS BIGINT) AS seq FROM range(24)")
    for t in _NAMES:
        text = text.replace(f"{{{t}}}", t)
    return text


def planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A planted view as a frame."""
    text = _text(name).replace("{id60}", "CAST(conv(h, 16, 10) AS BIGINT)").replace("{seqs}", "SELECT id AS seq FROM range(24)")
    used = {t: read_table(spark, sf_dir, t) for t in _NAMES if f"{{{t}}}" in text}
    return spark.sql(text, **used)
