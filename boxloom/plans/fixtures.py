"""Derived tables of boxes over the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}
VIEWS["fx_gts"] = """
SELECT g AS gt_id, CAST(floor(g/CAST(12 AS DOUBLE)) AS BIGINT) AS image_id, 1+g%5 AS label,
  (g%11=0) AS is_ignore, (g%23=0) AS is_crowd,
  CAST((g*37)%400 AS DOUBLE) AS x1, CAST((g*53)%300 AS DOUBLE) AS y1,
  CAST((g*37)%400+23+(g*17)%80 AS DOUBLE) AS x2, CAST((g*53)%300+19+(g*29)%70 AS DOUBLE) AS y2
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey/CAST(3 AS DOUBLE)) AS BIGINT) AS g FROM orders) q WHERE k%3=0"""
VIEWS["fx_dets"] = """
SELECT k AS det_id, CAST(floor(g/CAST(12 AS DOUBLE)) AS BIGINT) AS image_id,
  CASE WHEN k%10=9 THEN 1+(g+1)%5 ELSE 1+g%5 END AS label,
  CAST(CAST(floor(p*CAST(100 AS DOUBLE)) AS BIGINT)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE) AS score,
  CAST((g*37)%400 + ((k*7)%13-6)*m AS DOUBLE) AS x1, CAST((g*53)%300 + ((k*11)%13-6)*m AS DOUBLE) AS y1,
  CAST((g*37)%400+23+(g*17)%80 + ((k*7)%13-6)*m + (k*5)%9-4 AS DOUBLE) AS x2,
  CAST((g*53)%300+19+(g*29)%70 + ((k*11)%13-6)*m + (k*3)%9-4 AS DOUBLE) AS y2
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey/CAST(3 AS DOUBLE)) AS BIGINT) AS g, o_totalprice AS p,
  CASE WHEN o_orderkey%3=2 THEN 3 ELSE 1 END AS m FROM orders) q"""
VIEWS["fx_slides"] = """
SELECT c_custkey AS image_id, 300+(c_custkey*911)%4700 AS width, 300+(c_custkey*577)%3900 AS height FROM customer"""
VIEWS["fx_dense"] = """
SELECT l_suppkey AS image_id, ((l_orderkey*100000+l_partkey)*10000+l_suppkey)*10+l_linenumber AS det_id,
  CAST((l_partkey*37+l_orderkey*11)%2000 AS DOUBLE) AS x1, CAST((l_partkey*53+l_orderkey*7)%2000 AS DOUBLE) AS y1,
  CAST((l_partkey*37+l_orderkey*11)%2000+20+(l_orderkey*17)%90 AS DOUBLE) AS x2,
  CAST((l_partkey*53+l_orderkey*7)%2000+20+(l_orderkey*29)%90 AS DOUBLE) AS y2,
  CAST((l_orderkey*7919+l_partkey*104729+l_linenumber*1299709)%1000003 AS DOUBLE)/CAST(1000003 AS DOUBLE) AS score
FROM lineitem"""
VIEWS["fx_raw_preds"] = """
SELECT o_orderkey AS pred_id, CAST(floor(o_orderkey/CAST(200 AS DOUBLE)) AS BIGINT) AS image_id, 800*(o_orderkey%2) AS tile_x,
  800*(CAST(floor(o_orderkey/CAST(2 AS DOUBLE)) AS BIGINT)%2) AS tile_y, (o_orderkey*7919)%120087 AS anchor_idx,
  CAST((o_orderkey*31)%201-100 AS DOUBLE)/CAST(200 AS DOUBLE) AS dx, CAST((o_orderkey*43)%201-100 AS DOUBLE)/CAST(200 AS DOUBLE) AS dy,
  CAST((o_orderkey*59)%201-100 AS DOUBLE)/CAST(100 AS DOUBLE) AS dw, CAST((o_orderkey*67)%201-100 AS DOUBLE)/CAST(100 AS DOUBLE) AS dh,
  CAST((o_orderkey*101)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS s1, CAST((o_orderkey*103)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS s2
FROM orders"""
VIEWS["fx_logs"] = """
SELECT event_id, event_id%4 AS run_id, 1+CAST(floor(s/CAST(50 AS DOUBLE)) AS BIGINT) AS epoch, 50*(1+s%50) AS iter,
  CASE WHEN s%50=49 THEN 'val' ELSE 'train' END AS mode, v/CAST(100 AS DOUBLE) AS time, ts
FROM (SELECT event_id, CAST(floor(event_id/CAST(4 AS DOUBLE)) AS BIGINT) AS s, value AS v, ts FROM events) q"""
VIEWS["fx_corruption"] = """
SELECT event_id%19 AS corruption, CAST(floor(event_id/CAST(19 AS DOUBLE)) AS BIGINT)%6 AS severity, round(avg(value)/CAST(500 AS DOUBLE),6) AS ap
FROM events GROUP BY 1, 2"""
VIEWS["fx_roi_json"] = """
SELECT image_id, concat('{"x":10,"y":20,"w":600,"h":400,"pos_list":[{"x":', CAST(CAST(x1 AS BIGINT) AS VARCHAR(20)), ',"y":', CAST(CAST(y1 AS BIGINT) AS VARCHAR(20)),
  ',"w":', CAST(CAST(x2-x1+1 AS BIGINT) AS VARCHAR(20)), ',"h":', CAST(CAST(y2-y1+1 AS BIGINT) AS VARCHAR(20)), ',"class":"pos"}]}') AS json FROM fx_gts"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for v in VIEWS:
        sql = re.sub(rf"\bFROM {v}\b", f"FROM ({VIEWS[v]}) {v}", sql)
    for t in TABLES:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, led by the derived views that it names."""
    need = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if "fx_roi_json" in need and "fx_gts" not in need:
        need.insert(0, "fx_gts")
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :]
        return f"WITH {recursive}{ctes}{',' if ctes else ''}{body}"
    return f"WITH {ctes}\n{body}" if ctes else body
