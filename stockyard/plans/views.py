"""Views of the driver's tables that stand for landed inventory, logs and replies.

Each is one SQL text that Spark and DuckDB both accept; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["identifiers"] = """
SELECT page_id AS row_no, 'pages' AS source_file, split(split(url, '://')[{first}], '/')[{zero}] AS value FROM {pages}
UNION ALL SELECT p_partkey + 1000000000 AS row_no, 'part' AS source_file, CAST(p_partkey + 300000000 AS STRING) AS value FROM {part}
UNION ALL SELECT p_partkey + 1500000000 AS row_no, 'part' AS source_file, concat('  ', CAST(p_partkey + 300000000 AS STRING), '.0 ') AS value FROM {part} WHERE p_partkey % 5 = 0
UNION ALL SELECT s_suppkey + 2000000000 AS row_no, 'supplier' AS source_file,
  CASE s_suppkey % 7 WHEN 0 THEN concat('com.vendor', CAST(s_suppkey AS STRING), '.app') WHEN 1 THEN concat('gizmo.android.v', CAST(s_suppkey AS STRING))
    WHEN 2 THEN concat('io.vendor', CAST(s_suppkey AS STRING), '.dev') WHEN 3 THEN concat('lamp.q.w.z', CAST(s_suppkey AS STRING), '.news')
    WHEN 4 THEN concat('shop-', CAST(s_suppkey AS STRING), '.com') WHEN 5 THEN concat('co.firm', CAST(s_suppkey AS STRING), '.app') ELSE 'N/A' END AS value FROM {supplier}
UNION ALL SELECT n_nationkey + 3000000000 AS row_no, 'nation' AS source_file, concat(lower(replace(n_name, ' ', '')), '.tv') AS value FROM {nation}
"""
VIEWS["tlds"] = """
SELECT tld FROM (VALUES ('com'), ('org'), ('net'), ('tv'), ('app'), ('news'), ('games'), ('dev'), ('io'), ('de'), ('player'), ('shop')) AS t(tld)
"""
VIEWS["ctv_list"] = """
SELECT p_partkey AS row_no, CASE WHEN p_partkey % 11 = 0 THEN 'nan' ELSE concat('App ', CAST(p_partkey % 400 AS STRING)) END AS app_name,
  CASE p_partkey % 9 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat('B0', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('com.tv', CAST(p_partkey AS STRING))
    WHEN 3 THEN concat('vizio.', CAST(p_partkey AS STRING)) WHEN 4 THEN concat('tv.x', CAST(p_partkey AS STRING)) WHEN 5 THEN concat('G', CAST(p_partkey AS STRING))
    WHEN 6 THEN concat('9w', CAST(p_partkey AS STRING)) WHEN 7 THEN concat('abc', CAST(p_partkey AS STRING), '.roku') ELSE '' END AS bundle_id,
  p_brand AS ssp, p_type AS publisher FROM {part}
"""
VIEWS["attempts"] = """
SELECT user_id % 7 AS run_id, user_id AS item, CASE user_id % 3 WHEN 0 THEN 'ios_app' ELSE 'website' END AS type, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'direct' WHEN 'purchase' THEN 'deep' WHEN 'signup' THEN 'deep' ELSE 'research' END AS rung,
  CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'retry_pending' WHEN 2 THEN 'retry_pending' ELSE 'error' END AS status,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'Received HTTP status 403' WHEN event_id % 4 = 2 THEN 'timeout' WHEN event_id % 4 = 3 THEN 'Connection reset. Peer went away' ELSE 'Anti-bot page' END AS error,
  CAST(value AS DECIMAL(18,2)) AS seconds FROM {events}
"""
VIEWS["work_items"] = """
SELECT c_custkey AS row_no, c_custkey AS item, CASE c_custkey % 3 WHEN 0 THEN 'ios_app' ELSE 'website' END AS type FROM {customer}
"""
VIEWS["runs"] = """
SELECT o_custkey % 7 AS run_id, CASE o_custkey % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status,
  min(o_orderdate) AS created_at, TIMESTAMP '2023-12-31 23:00:00' AS started_at, 2000 + count(*) AS total FROM {orders} GROUP BY o_custkey % 7
"""
VIEWS["many_runs"] = """
SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at FROM {orders}
"""
VIEWS["results"] = """
SELECT d.doc_id AS seq, concat('site', CAST(d.doc_id % 300 AS STRING), '.com') AS Domain, CASE d.doc_id % 3 WHEN 0 THEN 'WEBSITE' WHEN 1 THEN 'IOS' ELSE ' ' END AS Type,
  CASE WHEN l.quality IS NULL THEN 'Failed' WHEN l.toxic = 1 THEN 'Long Tail' WHEN l.quality = 1 THEN 'Premium' ELSE 'Standard' END AS Quality,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE concat('Tier ', d.lang, ' ', d.source) END AS `IAB Tier 1`, d.text AS Description, d.n_chars AS Content_Length
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
VIEWS["model_calls"] = """
SELECT user_id % 7 AS run_id, user_id AS item, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS model,
  CASE WHEN event_id % 7 = 0 OR value IS NULL THEN NULL ELSE CAST(CAST(CAST(value AS DECIMAL(18,4)) / 10000 AS DECIMAL(18,9)) AS STRING) END AS usage_cost,
  event_id % 900 AS tokens, event_id AS seq FROM {events}
"""
VIEWS["vertical_labels"] = """
SELECT doc_id AS item, CASE doc_id % 12 WHEN 0 THEN 'Automotive' WHEN 1 THEN 'bars and restaurants' WHEN 2 THEN 'Bars & Restaurants' WHEN 3 THEN 'Sports > Soccer > Cups > Old'
  WHEN 4 THEN 'auto' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'description: x' WHEN 7 THEN 'Quantum Basketry, Soccer' WHEN 8 THEN 'Zebra; Yak' WHEN 9 THEN 'World Soccer Games (fan pages)'
  WHEN 10 THEN 'N/A' ELSE concat('Label ', CAST(doc_id % 40 AS STRING), ' news') END AS vertical FROM {documents}
"""
VIEWS["taxonomy"] = """
SELECT line_no, name, tier1, tier2, tier3, tier4 FROM (VALUES
 (3, 'Automotive', 'Automotive', '', '', ''), (4, 'Auto Parts', 'Automotive', 'Auto Parts', '', ''), (5, 'Auto Type', 'Automotive', 'Auto Type', '', ''),
 (6, 'Food', 'Food', '', '', ''), (7, 'Bars & Restaurants', 'Food', 'Dining Out', 'Bars & Restaurants', ''), (8, 'Sports', 'Sports', '', '', ''),
 (9, 'Soccer', 'Sports', 'Soccer', '', ''), (10, 'Soccer', 'Games', 'Video Games', 'Soccer', ''), (11, 'News', 'News', '', '', ''), (12, 'Local News', 'News', 'Local News', '', ''),
 (13, 'Games', 'Games', '', '', ''), (14, 'Label 7', 'Misc', 'Label 7', '', ''), (15, 'Label 8', 'Misc', 'Label 8', '', '')) AS t(line_no, name, tier1, tier2, tier3, tier4)
"""
VIEWS["replies"] = """
SELECT o_orderkey AS item, o_orderkey AS seq, CASE o_orderkey % 8
  WHEN 0 THEN concat('{"choices":[{"message":{"content":null,"tool_calls":[{"function":{"name":"classify","arguments":"{\\\\"quality\\\\":\\\\"Premium\\\\",\\\\"vertical\\\\":\\\\"Sports\\\\",\\\\"confidence\\\\":\\\\"High\\\\"}"}}]},"finish_reason":"stop"}],"usage":{"total_tokens":', CAST(o_orderkey % 500 AS STRING), '}}')
  WHEN 1 THEN '{"choices":[{"message":{"content":"Sure: {\\\\"quality\\\\":\\\\"Long Tail\\\\",\\\\"language\\\\":\\\\"French\\\\"} done"},"finish_reason":"stop"}]}'
  WHEN 2 THEN '{"choices":null}'
  WHEN 3 THEN '{"choices":[{"message":{"content":"{\\\\"quality\\\\":\\\\"Superb\\\\",\\\\"confidence\\\\":\\\\"Sky\\\\",\\\\"description\\\\":\\\\"N/A\\\\"}"}}],"usage":{"total_tokens":77}}'
  WHEN 4 THEN '{"choices":[{"message":{"content":"{\\\\"quality\\\\":\\\\"Prem"},"finish_reason":"length"}]}'
  WHEN 5 THEN '{"choices":[{"message":{"content":"","tool_calls":[{"function":{"name":"c","arguments":{"quality":"Standard","justification":""}}}]},"finish_reason":"tool_calls"}]}'
  WHEN 6 THEN 'not json at all'
  ELSE '{"choices":[{"message":{"content":"no object"},"finish_reason":"stop"}],"usage":{"total_tokens":-5}}' END AS json FROM {orders}
"""
VIEWS["research"] = """
SELECT conv_id AS item, turn, CASE conv_id % 6 WHEN 0 THEN ' insufficient information ' WHEN 1 THEN '' WHEN 2 THEN 'Short note' ELSE text END AS research,
  CASE conv_id % 5 WHEN 0 THEN 'Local Weather Now' WHEN 1 THEN 'CNN' WHEN 2 THEN 'Movie Box' WHEN 3 THEN 'Court TV News' ELSE 'Ballot Watch News' END AS app_name,
  CASE conv_id % 4 WHEN 0 THEN 'News' ELSE 'Mixed Content' END AS content_type FROM {conversations}
"""
VIEWS["fetches"] = """
SELECT doc_id AS item, CASE doc_id % 9 WHEN 0 THEN false ELSE true END AS success, CASE WHEN doc_id % 18 = 0 THEN 'timeout' ELSE '' END AS error,
  CASE doc_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 0 ELSE 200 END AS status_code,
  CASE doc_id % 8 WHEN 0 THEN concat('Just a Moment ', text) WHEN 1 THEN '  ' ELSE text END AS content, 0 AS content_length,
  concat('https://www.h', CAST(doc_id % 50 AS STRING), '.co.uk/a') AS url,
  CASE doc_id % 4 WHEN 0 THEN concat('http://m.h', CAST(doc_id % 50 AS STRING), '.co.uk/b') WHEN 1 THEN 'https://other.co.uk:8080/' WHEN 2 THEN concat('https://H', CAST(doc_id % 50 AS STRING), '.CO.UK/') ELSE 'https://co.uk/' END AS final_url FROM {documents}
"""
VIEWS["store_lookups"] = """
SELECT p_partkey AS app_id, CASE p_partkey % 4 WHEN 0 THEN '{"resultCount":0,"results":[]}'
  ELSE concat('{"resultCount":1,"results":[{"trackName":"', p_name, '","artistName":"', p_brand, '","primaryGenreName":"Games","genres":["Games","', p_type, '"],"averageUserRating":4.5,"userRatingCount":', CAST(p_partkey * 37 AS STRING), ',"price":', CAST(p_size AS STRING), ',"fileSizeBytes":"', CAST(p_partkey * 1048576 AS STRING), '"}]}') END AS json FROM {part}
"""
VIEWS["decision_replies"] = """
SELECT p_partkey AS item, CASE p_partkey % 6
  WHEN 0 THEN '{"model":"m/1","provider":"Prov","answers":{"c0":{"type":"noul","noul":0.75},"c1":{"type":"choice","choice":"Red","probabilities":{"Red":0.5,"Blue":0.5},"confidence":0.25}}}'
  WHEN 1 THEN '{"model":"m/1","answers":{"c0":{"type":"noul","noul":0.25},"c1":{"type":"choice","choice":"Blue"}}}'
  WHEN 2 THEN '{"model":"m/1","answers":{"c0":{"type":"noul","noul":0.25},"c1":{"type":"choice","choice":"Blue","probabilities":{"Red":0.5,"Blue":0.75}}}}'
  WHEN 3 THEN '{"model":"m/1","answers":{"c0":{"type":"noul","noul":0.25},"c1":{"type":"choice","choice":"Green"}}}'
  WHEN 4 THEN '{"model":"m/1","answers":{"c1":{"type":"choice","choice":"Blue"}}}'
  ELSE '{"model":"m/1","answers":{"c0":{"type":"noul","noul":1.5},"c1":{"type":"choice","choice":"Blue"}}}' END AS json FROM {part}
"""


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("{zero}", "0").replace("{first}", "1")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{([a-z_]+)\}", text))}
    for t in tables:
        text = text.replace("{" + t + "}", f"stockyard_in_{t}")
        tables[t].createOrReplaceTempView(f"stockyard_in_{t}")
    return spark.sql(text)


def duck_view(name: str) -> str:
    text = VIEWS[name].replace("{zero}", "1").replace("{first}", "2")
    text = re.sub(r"\{([a-z_]+)\}", r"\1", text).replace("`", '"')
    return re.sub(r"\\(.)", r"\1", text)  # Spark's string literals have escapes, DuckDB's do not


def duck_sql(views: list[str], body: str) -> str:
    if not views:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({duck_view(v)})" for v in views) + "\n" + body


VIEWS["catalog_taxonomy"] = """
SELECT p_partkey AS line_no, p_name AS name, p_brand AS tier1, p_type AS tier2, CASE WHEN p_partkey % 3 = 0 THEN concat('Size ', CAST(p_size AS STRING)) ELSE '' END AS tier3, '' AS tier4 FROM {part}
"""
