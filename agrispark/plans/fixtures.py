"""Views over the given tables that the field-survey queries read; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Each view reads one table; all numbers of boxes are dyadic, so arithmetic is exact in both engines.
VIEWS: dict[str, str] = {
    "v_pixels": """
SELECT event_id AS pix_id,
       CAST(event_id % 100 AS INT) AS x, CAST(floor(event_id / 100.0) AS INT) AS y,
       CAST(floor((event_id % 100) / 20.0) AS INT) AS tile_col,
       CAST(floor(event_id / 100.0 / 20.0) AS INT) AS tile_row,
       blob, noise,
       CAST(CASE WHEN blob = 1 THEN 9000 ELSE 16000 END + (noise * 7) % 1500 AS INT) AS red,
       CAST(CASE WHEN blob = 1 THEN 15000 ELSE 14000 END + (noise * 11) % 1500 AS INT) AS green,
       CAST(8000 + (noise * 13) % 1500 AS INT) AS blue,
       CAST(CASE WHEN blob = 1 THEN 5200 ELSE 5000 END + (noise * 17) % 300 AS INT) AS ext_green,
       CAST(CASE WHEN blob = 1 THEN 3000 ELSE 6400 END + (noise * 19) % 300 AS INT) AS ext_red,
       CAST(CASE WHEN blob = 1 THEN 9000 ELSE 7000 END + (noise * 23) % 900 AS INT) AS rededge,
       CAST(CASE WHEN blob = 1 THEN 16000 ELSE 8000 END + (noise * 29) % 1200 AS INT) AS nir,
       CAST(CASE WHEN event_id % 100 >= 90 THEN 0 ELSE 65535 END AS INT) AS alpha
FROM (SELECT event_id,
             CAST(round(value * 100) AS BIGINT) % 9973 AS noise,
             CASE WHEN (event_id % 100) % 20 BETWEEN 4 AND 12
                   AND CAST(floor(event_id / 100.0) AS BIGINT) % 20 BETWEEN 5 AND 13 THEN 1 ELSE 0 END AS blob
      FROM events) e
""",
    "v_gt": """
SELECT c_custkey AS gt_id, 0 AS class_id,
       cx - w / 2 AS minx, cy - h / 2 AS miny, cx + w / 2 AS maxx, cy + h / 2 AS maxy,
       CAST(floor(cx / 10.0) AS INT) AS tile_col, CAST(floor(cy / 10.0) AS INT) AS tile_row
FROM (SELECT c_custkey, (c_custkey % 50) + CAST(0.5 AS DOUBLE) AS cx, floor(c_custkey / 50.0) + CAST(0.5 AS DOUBLE) AS cy,
             CAST(0.40625 AS DOUBLE) + (c_custkey * 7 % 16) / CAST(64 AS DOUBLE) AS w, CAST(0.40625 AS DOUBLE) + (c_custkey * 11 % 16) / CAST(64 AS DOUBLE) AS h
      FROM customer) g
""",
    "v_pred": """
SELECT o_orderkey AS pred_id, 0 AS class_id, conf, margin,
       cx - w / 2 AS minx, cy - h / 2 AS miny, cx + w / 2 AS maxx, cy + h / 2 AS maxy,
       CAST(floor(cx / 10.0) AS INT) AS tile_col, CAST(floor(cy / 10.0) AS INT) AS tile_row
FROM (SELECT o_orderkey,
             (o_custkey % 50) + 50 * (o_orderkey % 5) + CAST(0.5 AS DOUBLE) + ((o_orderkey * 37 % 129) - 64) / CAST(256 AS DOUBLE) AS cx,
             floor(o_custkey / 50.0) + CAST(0.5 AS DOUBLE) + ((o_orderkey * 53 % 129) - 64) / CAST(256 AS DOUBLE) AS cy,
             CAST(0.40625 AS DOUBLE) + (o_orderkey * 5 % 16) / CAST(64 AS DOUBLE) AS w, CAST(0.40625 AS DOUBLE) + (o_orderkey * 3 % 16) / CAST(64 AS DOUBLE) AS h,
             (CAST(round(o_totalprice * 100) AS BIGINT) % 1024) / CAST(1024 AS DOUBLE) AS conf,
             ((CAST(round(o_totalprice * 100) AS BIGINT) % 8192) - 2048) / CAST(1024 AS DOUBLE) AS margin
      FROM orders) p
""",
    "v_label_lines": """
SELECT CASE WHEN k % 10 < 7 THEN 'train' WHEN k % 10 < 9 THEN 'val' ELSE 'test' END AS split,
       concat(CASE k % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END, '_tile_',
              CAST(r AS STRING), '_', CAST(c AS STRING), '__original') AS stem,
       k AS line_no,
       CASE WHEN k % 97 = 5 THEN concat('0 ', x1, ' ', y1, ' ', x2)
            WHEN k % 89 = 3 THEN ''
            WHEN k % 7 = 0 THEN concat('0 ', cx, ' ', cy, ' ', w, ' ', h)
            WHEN k % 7 = 1 THEN concat('0 ', conf, ' ', cx, ' ', cy, ' ', w, ' ', h)
            WHEN k % 7 = 2 THEN concat('0 ', conf, ' ', x1, ' ', y1, ' ', x2, ' ', y1, ' ', x2, ' ', y2, ' ', x1, ' ', y2)
            ELSE concat(CAST(k % 4 AS STRING), ' ', x1, ' ', y1, ' ', x2, ' ', y1, ' ', x2, ' ', y2, ' ', x1, ' ', y2) END AS line
FROM (SELECT k, r, c,
             concat('0.', lpad(CAST(mx AS STRING), 6, '0')) AS cx, concat('0.', lpad(CAST(my AS STRING), 6, '0')) AS cy,
             concat('0.', lpad(CAST(2 * mw AS STRING), 6, '0')) AS w, concat('0.', lpad(CAST(2 * mh AS STRING), 6, '0')) AS h,
             concat('0.', lpad(CAST(mx - mw AS STRING), 6, '0')) AS x1, concat('0.', lpad(CAST(mx + mw AS STRING), 6, '0')) AS x2,
             concat('0.', lpad(CAST(my - mh AS STRING), 6, '0')) AS y1, concat('0.', lpad(CAST(my + mh AS STRING), 6, '0')) AS y2,
             concat('0.', lpad(CAST(k * 7919 % 10000 AS STRING), 4, '0')) AS conf
      FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 500.0) AS INT) AS r, CAST(floor((c_custkey % 50) / 10.0) AS INT) AS c,
                   (c_custkey % 10) * 100000 + 50000 AS mx,
                   (CAST(floor(c_custkey / 50.0) AS BIGINT) % 10) * 100000 + 50000 AS my,
                   20000 + (c_custkey * 7 % 16) * 1000 AS mw, 20000 + (c_custkey * 11 % 16) * 1000 AS mh
            FROM customer) a) b
""",
    "v_files": """
SELECT c_custkey AS file_id,
       concat('Base_TestFlight_2_', CASE c_custkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'bigger' END,
              CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '_obb' END, '_tile_', CAST(c_custkey % 40 AS STRING), '_', CAST(CAST(floor(c_custkey / 40.0) AS BIGINT) AS STRING),
              '_NEN_png.rf.', md5(CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 2 = 0 THEN '.jpg' ELSE '.txt' END) AS name
FROM customer
""",
    "v_points": """
SELECT s_suppkey AS fid, CAST(s_suppkey % 4 AS INT) AS zone,
       (s_suppkey * 7919 % 4096) / CAST(64 AS DOUBLE) AS x, (s_suppkey * 104729 % 4096) / CAST(64 AS DOUBLE) AS y,
       CAST(9 AS DOUBLE) + (s_suppkey * 7919 % 4096) / CAST(4096 AS DOUBLE) AS lon, CAST(55 AS DOUBLE) + (s_suppkey * 104729 % 4096) / CAST(4096 AS DOUBLE) AS lat
FROM supplier
""",
    "v_times": """
SELECT l_orderkey AS image_id, l_quantity AS pre_ms, l_extendedprice / 1000 AS infer_ms, l_discount * 10 AS post_ms FROM lineitem
""",
}
DESC = {
    "spark": "SELECT vec_id AS desc_id, vec_id % 25 AS image_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS vec FROM embeddings",
    "duckdb": "SELECT vec_id AS desc_id, vec_id % 25 AS image_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
}
TABLES = ("events", "customer", "orders", "supplier", "lineitem", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows; its table is read from ``sf_dir``."""
    sql = DESC["spark"] if name == "v_desc" else VIEWS[name]
    used = [t for t in TABLES if re.search(rf"FROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as WITH clauses."""
    parts = [f"{n} AS ({DESC['duckdb'] if n == 'v_desc' else VIEWS[n]})" for n in (*VIEWS, "v_desc") if re.search(rf"\b{n}\b", sql)]
    head, tail = ("WITH RECURSIVE ", sql.strip().removeprefix("WITH RECURSIVE ")) if sql.strip().startswith("WITH RECURSIVE") else ("WITH ", sql.strip().removeprefix("WITH "))
    return head + ", ".join(parts) + (", " if sql.strip().startswith("WITH") else " ") + tail
