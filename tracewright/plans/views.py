"""Derived views over the given tables, one text for Spark and for the check SQL.

`{name}` stands for a base table. Every view reads its whole base table.
"""

from __future__ import annotations

import re

IMG = "CAST(floor(event_id/8) AS BIGINT)"
_JITTER = "(event_id*37)%700"
_JITTERY = "(event_id*53)%500"
_SIZE = "20+(event_id*7)%60 AS w, 20+(event_id*11)%40 AS h"

VIEWS: dict[str, str] = {
    "fx_images": """SELECT image_id,
  concat(CASE image_id%4 WHEN 0 THEN 'schematic_' WHEN 1 THEN 'synthetic_' ELSE 'scan_' END, CAST(image_id AS VARCHAR(20)), '.png') AS file_name,
  800+100*(image_id%3) AS width, 600+100*(image_id%2) AS height
  FROM (SELECT DISTINCT CAST(floor(event_id/8) AS BIGINT) AS image_id FROM {events}) q""",
    "fx_categories": """SELECT CAST(category_id AS BIGINT) AS category_id, name
  FROM (VALUES (1,'resistor'),(2,'capacitor'),(3,'inductor'),(4,'diode'),(5,'op_amp'),(6,'ignore_region')) AS t(category_id, name)""",
    # three annotation files: images dealt out by number, category ids shifted per file
    # the classes that the annotations of a file use, with the names that the file gives them
    "fx_file_categories": f"""SELECT CAST(t.f AS BIGINT) AS file_idx, CAST(t.category_id+10*t.f AS BIGINT) AS old_id, CAST(t.category_id AS BIGINT) AS pos, t.name
  FROM (VALUES (0,1,'resistor'),(0,2,'capacitor'),(0,3,'inductor'),(0,4,'diode'),(0,5,'op_amp'),(1,1,'resistor'),(1,2,'capacitor'),(1,3,'coil'),(1,4,'diode'),(1,5,'op_amp'),(2,1,'lamp'),(2,2,'capacitor'),(2,3,'inductor'),(2,4,'relay')) AS t(f, category_id, name)
  JOIN (SELECT DISTINCT {IMG}%3 AS f, 1+event_id%5 AS category_id FROM {{events}}) u ON u.f=t.f AND u.category_id=t.category_id""",
    "fx_file_images": """SELECT image_id%3 AS file_idx, image_id AS old_id, image_id AS pos, concat('schematic_', CAST(image_id%500 AS VARCHAR(20)), '.png') AS file_name
  FROM (SELECT DISTINCT CAST(floor(event_id/8) AS BIGINT) AS image_id FROM {events}) q""",
    "fx_file_annotations": f"""SELECT {IMG}%3 AS file_idx, event_id AS pos, {IMG}+CASE WHEN event_id%31=0 THEN 100000000 ELSE 0 END AS image_id, 1+event_id%5+10*({IMG}%3) AS category_id,
  {_JITTER} AS x, {_JITTERY} AS y, {_SIZE} FROM {{events}}""",
    "fx_annotations": f"""SELECT event_id AS ann_id, {IMG} AS image_id, 1+event_id%5 AS category_id,
  {_JITTER} AS x, {_JITTERY} AS y, {_SIZE}, (event_id%4)*15 AS rotation FROM {{events}}""",
    # saved detector output: model a with near copies and misplaced boxes, model b coarser
    "fx_predictions": f"""SELECT 'a' AS model, event_id AS pred_id, {IMG} AS image_id,
  1+(event_id + CASE WHEN event_id%19=0 THEN 1 ELSE 0 END)%5 AS category_id,
  CAST((event_id*97)%1000 AS DOUBLE)/1000 AS score,
  {_JITTER}+(event_id*13)%17-8+CASE WHEN event_id%11=0 THEN 300 ELSE 0 END AS x, {_JITTERY}+(event_id*29)%13-6 AS y, {_SIZE} FROM {{events}}
  UNION ALL SELECT 'a', 1000000000+event_id, {IMG}, 1+event_id%5, CAST((event_id*61)%1000 AS DOUBLE)/1000,
  {_JITTER}+5+9*(event_id%7), {_JITTERY}+3, {_SIZE} FROM {{events}}
  UNION ALL SELECT 'b', event_id, {IMG}, 1+event_id%5, CAST((event_id*31)%1000 AS DOUBLE)/1000,
  {_JITTER}+(event_id*17)%31-15+CASE WHEN event_id%5=0 THEN 250 ELSE 0 END, {_JITTERY}+(event_id*23)%21-10, {_SIZE} FROM {{events}}""",
    # label text lines: class and four corners as fractions, some lines cut short
    "fx_labels": f"""SELECT event_id AS line_id, {IMG} AS image_id, CASE WHEN event_id%23=0 THEN '3 0.5' ELSE concat(CAST(event_id%6 AS VARCHAR(20)),
  x1, y1, x2, y1, x2, y2, x1, y2) END AS line FROM (SELECT event_id, concat(' 0.', lpad(CAST((event_id*37)%700 AS VARCHAR(20)), 3, '0')) AS x1, concat(' 0.', lpad(CAST((event_id*53)%500 AS VARCHAR(20)), 3, '0')) AS y1,
  concat(' 0.', lpad(CAST((event_id*37)%700+20+(event_id*7)%60 AS VARCHAR(20)), 3, '0')) AS x2, concat(' 0.', lpad(CAST((event_id*53)%500+20+(event_id*11)%40 AS VARCHAR(20)), 3, '0')) AS y2 FROM {{events}}) q""",
    "fx_regions": f"""SELECT e AS region_id, CAST(floor(e/8) AS BIGINT) AS image_id, (e*37)%700-10 AS x, (e*53)%500-10 AS y, CAST(80 AS BIGINT) AS w, CAST(50 AS BIGINT) AS h
  FROM (SELECT CAST(floor(event_id/16) AS BIGINT) AS g, min(event_id)+3 AS e FROM {{events}} GROUP BY 1) q""",
    "fx_segments": """SELECT CAST(floor(o_orderkey/10) AS BIGINT) AS sheet_id, o_orderkey%10 AS seg, concat('edge-', CAST(o_orderkey%10 AS VARCHAR(20))) AS segment_id,
  o_custkey%12 AS a, CAST(floor(o_totalprice) AS BIGINT)%12 AS b,
  concat('node-', CAST(o_custkey%12 AS VARCHAR(20))) AS node_a, concat('node-', CAST(CAST(floor(o_totalprice) AS BIGINT)%12 AS VARCHAR(20))) AS node_b,
  CAST(5+CAST(floor(o_totalprice) AS BIGINT)%90 AS DOUBLE) AS length FROM {orders}""",
    "fx_nodes": """SELECT sheet_id, n, concat('node-', CAST(n AS VARCHAR(20))) AS node_id, 60*(n%4) AS x, 60*CAST(floor(n/4) AS BIGINT) AS y
  FROM (SELECT CAST(floor(o_orderkey/10) AS BIGINT) AS sheet_id, o_custkey%12 AS n FROM {orders}
  UNION SELECT CAST(floor(o_orderkey/10) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT)%12 FROM {orders}) q""",
    "fx_tokens": """SELECT CAST(floor(p_partkey/10) AS BIGINT) AS page_id, p_partkey%10 AS tok,
  CASE p_partkey%10 WHEN 0 THEN concat('R', CAST(100+p_partkey%800 AS VARCHAR(20))) WHEN 1 THEN concat(CAST(p_size AS VARCHAR(20)), 'K')
  WHEN 2 THEN concat('C', CAST(100+p_partkey%800 AS VARCHAR(20))) WHEN 3 THEN concat(CAST(p_size AS VARCHAR(20)), ',5uF')
  WHEN 4 THEN concat('Q', CAST(100+p_partkey%800 AS VARCHAR(20))) WHEN 5 THEN concat('25C', CAST(1000+p_size AS VARCHAR(20)))
  WHEN 6 THEN concat('R', CAST(10+p_size AS VARCHAR(20)), '=22K') WHEN 7 THEN '12345678' WHEN 8 THEN concat('IC', CAST(40+p_size AS VARCHAR(20)), 'B')
  ELSE CASE WHEN p_partkey%20=9 THEN '777' ELSE 'OUT' END END AS text,
  CAST(20+(p_partkey*7)%80 AS DOUBLE) AS confidence, CAST(100*CAST(floor((p_partkey%10)/2) AS BIGINT) + (p_partkey*3)%7 AS DOUBLE) AS x,
  CAST(30*(p_partkey%2) + (p_partkey*5)%6 AS DOUBLE) AS y, 40.0E0 AS w, 20.0E0 AS h FROM {part}""",
    # raw recognised texts in forty shapes of typical misreadings, laid out in rows of eight
    "fx_raw_tokens": """SELECT page_id, ord, text, confidence, CAST(40*(ord%8)+(page_id*3+ord*5)%7 AS DOUBLE) AS x, CAST(28*CAST(floor(ord/8) AS BIGINT)+(ord*3)%6 AS DOUBLE) AS y, CAST(8*length(text) AS DOUBLE) AS w, CAST(14+ord%3 AS DOUBLE) AS h
  FROM (SELECT CAST(floor(p_partkey/40) AS BIGINT) AS page_id, p_partkey%40 AS ord, CAST(10+(p_partkey*13)%90 AS DOUBLE) AS confidence,
  CASE p_partkey%40 WHEN 0 THEN concat('R', n) WHEN 1 THEN concat(n, 'K') WHEN 2 THEN concat(n, ',', n, 'uF') WHEN 3 THEN concat('R', n, '=22K') WHEN 4 THEN concat('R1', n, '15K') WHEN 5 THEN '12345678910' WHEN 6 THEN concat(n, ' 12') WHEN 7 THEN concat('25C17', n) WHEN 8 THEN concat('ISS1', n) WHEN 9 THEN concat('04', n) WHEN 10 THEN concat('RB', n) WHEN 11 THEN concat('QBO', n) WHEN 12 THEN concat('LI', n) WHEN 13 THEN concat('m', n, 'K') WHEN 14 THEN '/' WHEN 15 THEN concat(n, ',') WHEN 16 THEN n WHEN 17 THEN 'K' WHEN 18 THEN concat(n, 'Pm') WHEN 19 THEN concat(n, '.00') WHEN 20 THEN concat(n, 'kQ') WHEN 21 THEN concat(n, '52') WHEN 22 THEN '2S' WHEN 23 THEN concat('C17', n) WHEN 24 THEN 'speaker' WHEN 25 THEN 'out-put' WHEN 26 THEN 'Q' WHEN 27 THEN concat(n, '/') WHEN 28 THEN 'Amplif-' WHEN 29 THEN concat('C4', n) WHEN 30 THEN '1' WHEN 31 THEN '.2K' WHEN 32 THEN concat('IC4', n, 'B') WHEN 33 THEN '777' WHEN 34 THEN 'I' WHEN 35 THEN '25V' WHEN 36 THEN 'iers on' WHEN 37 THEN '5' WHEN 38 THEN concat(substr(n, 1, 1), '0') WHEN 39 THEN concat(n, '...', n, 'pF') END AS text
  FROM (SELECT p_partkey, CAST(10+p_size%90 AS VARCHAR(20)) AS n FROM {part}) a) q""",
    "fx_comments": """SELECT p_partkey AS region_id, CAST(floor(p_partkey/25) AS BIGINT) AS task_id,
  CASE p_partkey%5 WHEN 0 THEN 'resistor' WHEN 1 THEN 'capacitor' WHEN 2 THEN 'inductor' WHEN 3 THEN 'diode' ELSE 'mystery' END AS category,
  CASE WHEN p_partkey%9=0 THEN NULL ELSE concat(CASE WHEN p_partkey%7=0 THEN '' ELSE concat('designator=X', CAST(p_partkey%300 AS VARCHAR(20)), ' ') END, 'type=',
  CASE p_partkey%5 WHEN 0 THEN 'resistor' WHEN 1 THEN 'capacitor' WHEN 2 THEN 'inductor' WHEN 3 THEN 'diode' ELSE 'mystery' END,
  CASE WHEN p_partkey%4=0 THEN '' WHEN p_partkey%4=1 THEN concat(' value=', CAST(p_size AS VARCHAR(20)), 'K')
  WHEN p_partkey%4=2 THEN concat(' value=', CAST(p_size AS VARCHAR(20)), ',7n') ELSE concat(' value=', CAST(p_size AS VARCHAR(20)), 'u') END) END AS region_comment FROM {part}""",
    "fx_notes": """SELECT p_partkey AS note_id, CASE WHEN p_partkey%13=0 THEN NULL ELSE concat('in ', CASE WHEN p_partkey%2=0 THEN 'sector ' ELSE '' END, substr('ABCDabcd', CAST(1+p_partkey%8 AS INTEGER), 1), CAST(p_partkey%5 AS VARCHAR(20)), CASE WHEN p_partkey%7=0 THEN '7' ELSE ' ok' END) END AS comment FROM {part}""",
    # region comments of page-edge connectors and broken lines, some with faults
    "fx_edge_comments": """SELECT c_custkey AS region_id, CASE c_custkey%3 WHEN 0 THEN concat('type=edge_connector edge_id=', CASE c_nationkey%5 WHEN 4 THEN 'Z' ELSE 'B' END, CASE WHEN c_custkey%90<10 THEN '0' ELSE '' END, CAST(c_custkey%90 AS VARCHAR(20)), CASE WHEN c_custkey%4=0 THEN '' ELSE concat(' page=', CAST(1+c_custkey%1100 AS VARCHAR(20))) END, CASE WHEN c_custkey%5=0 THEN ' note=ab' ELSE '' END)
  WHEN 1 THEN concat('type=broken_line reason=', CASE WHEN c_custkey%2=0 THEN 'gap' ELSE 'washed-out' END, CASE c_custkey%5 WHEN 0 THEN '' WHEN 1 THEN ' severity=Major' WHEN 2 THEN ' severity=huge' ELSE ' severity=minor' END)
  ELSE concat('type=resistor designator=R', CAST(c_custkey AS VARCHAR(20)), CASE c_custkey%4 WHEN 0 THEN ' power=0.25W' WHEN 1 THEN ' power=big' ELSE '' END, CASE WHEN c_custkey%5=0 THEN ' value=about' ELSE ' value=1 value=4.7K' END) END AS region_comment FROM {customer}""",
    # chat messages that name wires, spelled in several ways
    "fx_messages": """SELECT p_partkey AS msg_id, CAST(floor(p_partkey/2) AS BIGINT) AS sheet_id, concat('please check ', CASE p_partkey%4 WHEN 0 THEN 'edge ' WHEN 1 THEN 'Edge-' WHEN 2 THEN 'EDGE_' ELSE 'punkt nr ' END,
  CAST(p_size%14 AS VARCHAR(20)), ' and edge', CAST(p_partkey%11 AS VARCHAR(20)), CASE WHEN p_partkey%3=0 THEN ' soon' ELSE '?' END) AS text FROM {part}""",
    # a log text per row with dated headings in mixed order
    "fx_logs": """SELECT p_partkey AS log_id, concat('intro ', p_brand, chr(10), '## 2024-0', CAST(1+p_size%9 AS VARCHAR(20)), '-1', CAST(p_partkey%10 AS VARCHAR(20)), ' second', chr(10), 'body', chr(10),
  '### 2023-1', CAST(p_size%3 AS VARCHAR(20)), '-0', CAST(1+p_partkey%9 AS VARCHAR(20)), ' first', chr(10), '## 2025-01-01 ', p_type, chr(10)) AS text FROM {part}""",
    "fx_entries": """SELECT event_id AS seq, user_id AS entry_id, event_type AS entry_type, ts AS updated_at, concat('f', CAST(user_id AS VARCHAR(20)), '.json') AS filename,
  event_type='error' AS is_delete FROM {events}""",
    "fx_epochs": """SELECT event_id%20 AS run, CAST(floor(event_id/20) AS BIGINT) AS epoch,
  CAST(30*CAST(floor(event_id/20) AS BIGINT)+(event_id*7)%13 AS DOUBLE) AS time_s, CAST((event_id*41)%1000 AS DOUBLE)/1000 AS map50 FROM {events}""",
    "fx_sweep": """SELECT o_orderkey AS task_id, o_custkey AS image, CASE o_orderkey%2 WHEN 0 THEN 15 ELSE 30 END AS angle, CASE WHEN o_orderkey%4<2 THEN 40 ELSE 60 END AS overlap_pct,
  CASE WHEN o_orderkey%8<4 THEN 10 ELSE 50 END AS max_joins, o_orderstatus='P' AS timeout,
  CASE WHEN o_orderstatus='P' THEN NULL ELSE CASE WHEN o_orderkey%13=0 THEN 1 ELSE 0 END END AS returncode,
  CAST(1+CAST(floor(o_totalprice) AS BIGINT)%3500 AS DOUBLE)/100 AS elapsed_s,
  CASE WHEN o_orderkey%3=0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT)%41-20 END AS pixel_delta FROM {orders}""",
    "fx_corrections": """SELECT p_partkey AS line, CAST(floor(p_partkey/4) AS BIGINT) AS request_id,
  CASE WHEN p_partkey%10=0 THEN '' ELSE concat('R', CAST(p_partkey%37 AS VARCHAR(20))) END AS component,
  CASE WHEN p_partkey%6=0 THEN ' ' ELSE concat(CAST(p_size AS VARCHAR(20)), 'k') END AS value FROM {part}""",
    "fx_connectors": """SELECT c_custkey AS connector_id, concat(CASE c_nationkey%5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'Z' END,
  CASE WHEN c_custkey%90<10 THEN '0' ELSE '' END, CAST(c_custkey%90 AS VARCHAR(20))) AS edge_id, CAST(1+c_custkey%1100 AS VARCHAR(20)) AS page,
  concat(' Lines-', CAST(c_custkey%200 AS VARCHAR(20)), ' ') AS history_id, c_mktsegment AS net_name FROM {customer}""",
    "fx_pins": """SELECT DISTINCT CAST(l_orderkey%1500 AS BIGINT) AS deck_id, CAST(l_linenumber AS BIGINT) AS comp,
  CASE l_linenumber%4 WHEN 0 THEN 'resistor' WHEN 1 THEN 'capacitor' WHEN 2 THEN 'diode' ELSE 'gizmo' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'GND' WHEN 'N' THEN concat('node-', CAST(l_partkey%14 AS VARCHAR(20))) ELSE concat('node-', CAST(l_suppkey%12 AS VARCHAR(20))) END AS pin FROM {lineitem}""",
    "fx_pixels": """SELECT DISTINCT CAST(l_orderkey%150 AS BIGINT) AS sheet_id, l_partkey%200 AS px, l_suppkey%140 AS py FROM {lineitem}""",
}

_NAME = re.compile(r"\bfx_\w+\b")


def spark_text(view: str, sf_dir: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", VIEWS[view])


def check_text(sql: str) -> str:
    """Put the views a check query names in front of it as CTEs."""
    names = [v for v in VIEWS if v in set(_NAME.findall(sql))]
    ctes = [f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v])})" for v in names]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return "WITH RECURSIVE " + ",\n".join([*ctes, body[len(head):]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
