"""Token-table queries: text rules, splits, repairs, pairing, values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import metadata as M
from tracewright.functions import tokens as K
from tracewright.functions import values as V
from tracewright.operators import pairing as P
from tracewright.operators import tokens as O
from tracewright.plans.registry import query


def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


_STEPS = [
    r"regexp_replace({}, '[\"'']+$', '')", r"regexp_replace({}, '(?i),(LF|UF|Lit)$', 'µF')", r"regexp_replace({}, '^([0-9]+)\s+[uU]F$', '\1µF')",
    r"regexp_replace({}, '^([0-9]+)\s+([KkMRPNFGpnΩ])$', '\1\2')", r"regexp_replace({}, '([0-9]),([0-9])', '\1.\2', 'g')", r"regexp_replace({}, '^0([0-9])$', '\1')",
    r"regexp_replace({}, '^[O0](\p{{Lu}})$', '\1')", r"regexp_replace({}, '^[Oo](\+[A-Za-z])', '\1')",
    r"CASE WHEN translate({0},'IO','10')<>{0} AND regexp_matches(translate({0},'IO','10'),'^[0-9]+[.]?[0-9]*[PNFUKRMGpnfukrmgΩ]$') THEN upper(translate({0},'IO','10')) ELSE {0} END",
    r"CASE WHEN translate({0},'Ss','55')<>{0} AND regexp_matches(translate({0},'Ss','55'),'^[0-9]+[.]?[0-9]*[PNFUKRMGpnfukrmgΩ]$') THEN translate({0},'Ss','55') ELSE {0} END",
    r"regexp_replace({}, '^25([A-Z][0-9]{{3,4}})$', '2S\1')",
    r"CASE WHEN regexp_matches({0},'^2S[A-Z][0-9IOlo]+$') THEN concat(substr({0},1,3), translate(substr({0},4),'IOlo','1010')) ELSE {0} END",
    r"regexp_replace({}, '^I((SS|N)[0-9]{{3,5}})$', '1\1')", r"regexp_replace({}, '^0([1-9][0-9]{{2}})$', 'D\1')", r"regexp_replace({}, '^RB([0-9]{{2,4}})$', 'R8\1')",
    r"regexp_replace({}, '^Q[B8][O0]([0-9]{{1,3}})$', 'Q80\1')", r"regexp_replace({}, '([0-9]\.)B', '\18', 'g')", r"regexp_replace({}, '^LI([0-9]{{2,3}})$', 'L1\1')",
    r"regexp_replace({}, '^m([0-9]+\.?[0-9]*[KkMRPNFUGpnfuΩ])$', '\1')", r"regexp_replace({}, '^/$', '7')", r"regexp_replace({}, '^([0-9]{{1,3}})[,.]$', '\1')", r"regexp_replace({}, '^1C([0-9]{{2,4}})', 'IC\1')",
]
_ENDS = [
    (r"(?i)^([0-9][0-9.]*[PNFUKRΩ])M$", ""), (r"(?i)^([A-Z]{1,3}[0-9]*)=", ""), (r"(?i)^((?:IC|[RCLQ])[0-9]{2,3})[0-9]+[KMPRNUF]", ""), (r"^([0-9]{2,})\.00$", "Ω"),
    (r"^([0-9][0-9.]*[kKM]?)[goQ]$", "Ω"), (r"^([0-9]{2,3})52$", "Ω"), (r"^([0-9][0-9.]*[kKmMGg]?)[sS][23]?$", "Ω"),
]


def _clean_sql(source, id_cols, text, out):
    """CTEs that clean column `text` of `source` step by step."""
    ctes = [f"{out}0 AS (SELECT {id_cols}, {text} AS c FROM {source})"]
    for i, step in enumerate(_STEPS):
        ctes.append(f"{out}{i + 1} AS MATERIALIZED (SELECT {id_cols}, {step.format('c')} AS c FROM {out}{i})")
    ends = " ".join(
        f"WHEN {'c<>' + chr(39) + '2S' + chr(39) + ' AND ' if k == 6 else ''}regexp_matches(c,'{p}') THEN concat(regexp_extract(c,'{p}',1),'{tail}')" for k, (p, tail) in enumerate(_ENDS))
    ctes.append(f"{out} AS MATERIALIZED (SELECT {id_cols}, CASE {ends} ELSE regexp_replace(c, '[.]{{2,4}}', '~', 'g') END AS t FROM {out}{len(_STEPS)})")
    return ", ".join(ctes)


def _category_sql(t):
    up, tr = f"upper(trim({t}))", f"trim({t})"
    value = (f"CASE WHEN regexp_matches({tr},'(?i)^(2S[ABCD]|1S[SN]|B[CDFRU]|MA)[0-9]{{2,5}}[A-Z]{{0,2}}$') OR regexp_matches({tr},'(?i)^(UL|TDA|TL|LM|NE|UA|UPC|MC|TA|AN|AD|OP|MAX|LF|CA)[0-9]{{2,5}}[A-Z]{{0,2}}$') THEN true "
             f"WHEN regexp_matches({tr},'^[A-Za-z]{{2}}[\\pL\\pN]*$') AND NOT regexp_matches({tr},'^[A-Za-z]+[0-9]+$') THEN false ELSE regexp_matches({tr},'[KMRΩUNPFV.,/]|OHM') OR regexp_matches({tr},'[0-9].*[0-9]') END")
    return (f"CASE WHEN {tr}='' THEN 'other' WHEN regexp_matches({up},'^IC[0-9]+$') OR regexp_matches({tr},'^[RCLQDMT]p[LP]$') OR regexp_matches({up},'^[RCLQDMTS][0-9]+[A-Z]?$') OR regexp_matches({up},'^SF[0-9]{{2,4}}$') THEN 'component' "
            f"WHEN regexp_matches({up},'^[+-]?[0-9]+V$') THEN 'net_label' WHEN regexp_matches({tr},'[0-9]') AND ({value}) THEN 'value' WHEN regexp_matches(regexp_replace({up},'[_-]','','g'),'^[\\pL\\pN]+$') AND length({up})<=6 THEN 'net_label' "
            f"WHEN regexp_matches({tr},'(?i)^[LR]\\s+ch$') THEN 'net_label' WHEN regexp_matches(regexp_replace({up},'[+/_-]','','g'),'^[\\pL\\pN]+$') AND length({up}) BETWEEN 2 AND 6 THEN 'net_label' ELSE 'other' END")


def _noise_sql(t, w, h, conf, floor):
    area, side = f"({w}*{h})", f"greatest({w},{h})"
    rescued = f"(({conf}>=25 AND regexp_matches({t},'^[0-9]+[.]?[0-9]*[KkMRPNFUGpnfuΩ]{{1,2}}$')) OR ({conf}>=15 AND regexp_matches({t},'^[0-9]+[.]?[0-9]*µF$')) OR ({conf}>=40 AND regexp_matches({t},'^[0-9]{{1,2}}$')) OR ({conf}>=40 AND regexp_matches({t},'^[0-9]{{1,3}}\\s+[0-9]{{1,3}}$')))"
    runs = "('123456','1234567','12345678','123456789','12345678910','1234567891011','123456789101112','12345678910111213','1234567891011121314')"
    return (f"(({conf}<{floor} AND NOT {rescued}) OR {t} IN ('+','-','~','m','M','=',':','00','#') OR upper({t}) IN ('THE','AND','FOR','NOT','BUT','ARE','HAS','HAD','77','777') OR ({t}='+/-' AND {area}<0.02*{side}*{side}) OR {area}<1 "
            f"OR (length({t})<=2 AND NOT regexp_matches({t},'[\\pL\\pN]') AND {area}<0.05*{side}*{side}) OR (regexp_matches(upper({t}),'^[7MW]{{1,3}}$') AND {area}<0.002*{side}*{side}) OR regexp_matches({t},'^[IlT|]{{2,4}}$') OR ({t}='1' AND {conf}<45) "
            f"OR ({t} IN ('O','0','o','C','c') AND {conf}<55) OR ({t} IN ('W','Y') AND {conf}<80) OR ({t}='MA' AND {conf}<55) OR regexp_matches({t},'^[*]*$') OR (regexp_matches({t},'^[0-9]{{6,}}$') AND {t} NOT IN {runs}))")


_CLEAN = _clean_sql("fx_raw_tokens", "page_id, ord", "text", "cl")


@query("clean_text_p16", f"WITH {_CLEAN} SELECT page_id, ord, t AS text FROM cl")
def _(t):
    return t("fx_raw_tokens").select("page_id", "ord", K.clean(F.col("text")).alias("text"))


@query("category_p17", f"WITH {_CLEAN} SELECT page_id, ord, {_category_sql('t')} AS category FROM cl")
def _(t):
    return t("fx_raw_tokens").select("page_id", "ord", K.category(K.clean(F.col("text"))).alias("category"))


@query("noise_f01", f"SELECT page_id, ord, text FROM fx_raw_tokens WHERE NOT {_noise_sql('text', 'w', 'h', 'confidence', '30')}")
def _(t):
    return t("fx_raw_tokens").where(~K.is_noise(F.col("text"), F.col("w"), F.col("h"), F.col("confidence"), 30.0)).select("page_id", "ord", "text")


@query("compound_split_o02", f"""WITH raw AS (SELECT *, regexp_extract(text,'(?i)^([A-Z]{{1,3}}[0-9]*)=',0) AS eq, CASE WHEN regexp_matches(text,'(?i)^([A-Z]{{1,3}}[0-9]*)=') THEN '' ELSE regexp_extract(text,'(?i)^((?:IC|[RCLQ])[0-9]{{2,3}})[0-9]+[KMPRNUF]',1) END AS ne FROM fx_raw_tokens),
rs AS (SELECT *, substr(text, length(concat(eq,ne))+1) AS rest FROM raw), {_CLEAN}, {_clean_sql('rs', 'page_id, ord', 'rest', 'cr')},
j AS (SELECT rs.*, cl.t AS t1, cr.t AS t2, eq<>'' OR ne<>'' AS sp, CASE WHEN eq<>'' THEN 25 ELSE 30 END AS lim, CASE WHEN (eq<>'' OR ne<>'') AND length(cl.t)<length(rs.text) THEN w*length(cl.t)/length(rs.text) ELSE w END AS w1, w*length(concat(eq,ne))/length(rs.text) AS cut
  FROM rs JOIN cl ON cl.page_id=rs.page_id AND cl.ord=rs.ord JOIN cr ON cr.page_id=rs.page_id AND cr.ord=rs.ord),
k AS (SELECT * FROM j WHERE NOT {_noise_sql('t1', 'w1', 'h', 'confidence', 'lim')})
SELECT page_id, ord, 0 AS part, t1 AS text, round(x,6) AS x, round(w1,6) AS w, {_category_sql('t1')} AS category FROM k
UNION ALL SELECT page_id, ord, 1, t2, round(x+cut,6), round(w-cut,6), {_category_sql('t2')} FROM k WHERE sp AND t2<>'' AND NOT {_noise_sql('t2', 'w', 'h', 'confidence', 'lim')}""")
def _(t):
    s = O.clean_and_split(t("fx_raw_tokens"))
    o = F.col("ord")
    return s.select("page_id", F.get(o, F.lit(0)).alias("ord"), F.get(o, F.lit(1)).cast("int").alias("part"), "text", _r("x", "x"), _r("w", "w"), "category")


def _tokens(t):
    """Unsplit tokens with a category from their raw text."""
    raw = t("fx_raw_tokens").withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2, "category": K.category(F.col("text"))})
    return raw.withColumn("ord", F.array(F.col("ord").cast("bigint"))).select(O.COLUMNS)


@query("pin_runs_o03", """SELECT page_id, ord, i AS pin, round(x+i*w/10,6) AS x, round(w/10,6) AS w FROM fx_raw_tokens, range(0,10) r(i) WHERE text='12345678910'""")
def _(t):
    s = O.split_pin_runs(_tokens(t)).where(F.size("ord") == 2)
    return s.select("page_id", F.get("ord", F.lit(0)).alias("ord"), F.get("ord", F.lit(1)).alias("pin"), _r("x", "x"), _r("w", "w"))


@query("spaced_pins_o04", f"""WITH v AS (SELECT *, regexp_extract(text,'^([0-9]{{1,3}})\\s+([0-9]{{1,3}})$',1) AS a, regexp_extract(text,'^([0-9]{{1,3}})\\s+([0-9]{{1,3}})$',2) AS b FROM fx_raw_tokens WHERE {_category_sql('text')}='value'), s AS (SELECT * FROM v WHERE a<>'')
SELECT page_id, ord, a AS text, round(x,6) AS x, round(w*length(a)/(length(a)+1+length(b)),6) AS w FROM s UNION ALL SELECT page_id, ord, b, round(x+w*(length(a)+1)/(length(a)+1+length(b)),6), round(w*length(b)/(length(a)+1+length(b)),6) FROM s""")
def _(t):
    s = O.split_spaced_pins(_tokens(t)).where(F.size("ord") == 2)
    return s.select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text", _r("x", "x"), _r("w", "w"))


_TOK = f"tk AS (SELECT *, x+w/2 AS cx, y+h/2 AS cy, {_category_sql('text')} AS category FROM fx_raw_tokens)"


@query("overlines_o05", f"""WITH {_TOK} SELECT page_id, ord, CASE WHEN category='net_label' AND text IN ('I','-','|','—') AND EXISTS (SELECT 1 FROM tk q WHERE q.page_id=t.page_id AND q.category='net_label' AND q.text='Q' AND abs(q.cx-t.cx)<greatest(20,t.h*1.5) AND t.cy-q.cy>0 AND t.cy-q.cy<t.h*10) THEN '-Q' ELSE text END AS text FROM tk t""")
def _(t):
    return O.fix_overlines(_tokens(t)).select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text")


@query("endpoint_digits_o06", f"""WITH {_TOK}, f AS (SELECT t.*, category='value' AND regexp_matches(text,'^[1-9]0$') AND confidence<85 AND EXISTS (SELECT 1 FROM tk q WHERE q.page_id=t.page_id AND q.category='net_label' AND regexp_matches(q.text,'^[0-9]$') AND sqrt((q.cx-t.cx)*(q.cx-t.cx)+(q.cy-t.cy)*(q.cy-t.cy))<=50) AS hit FROM tk t)
SELECT page_id, ord, CASE WHEN hit THEN substr(text,1,1) ELSE text END AS text, CASE WHEN hit THEN w/2 ELSE w END AS w, CASE WHEN hit THEN 'net_label' ELSE category END AS category FROM f""")
def _(t):
    return O.fix_endpoint_digits(_tokens(t)).select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text", "w", "category")


@query("ic_letters_o07", f"""WITH {_TOK} SELECT page_id, ord, CASE WHEN regexp_matches(upper(text),'^IC[0-9]+[BOSIZGD]$') THEN concat('IC', translate(substr(upper(text),3),'BOSIZGD','8051260')) ELSE text END AS text,
CASE WHEN regexp_matches(upper(text),'^IC[0-9]+[BOSIZGD]$') THEN 'component' ELSE category END AS category FROM tk""")
def _(t):
    return O.fix_ic_letters(_tokens(t)).select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text", "category")


@query("truncated_ics_o08", f"""WITH {_TOK}, known AS (SELECT DISTINCT page_id, CAST(floor(CAST(regexp_extract(text,'(?i)IC([0-9]{{2,4}})',1) AS INTEGER)/100) AS INTEGER) AS hd FROM tk WHERE regexp_matches(text,'(?i)IC[0-9]{{2,4}}')),
paired AS (SELECT DISTINCT page_id, text FROM tk WHERE ord%3=0)
SELECT t.page_id, t.ord, CASE WHEN regexp_matches(t.text,'^C[0-9]{{3,4}}$') AND k.hd IS NOT NULL AND p.text IS NULL THEN concat('I', t.text) ELSE t.text END AS text FROM tk t
LEFT JOIN known k ON k.page_id=t.page_id AND k.hd=CASE WHEN regexp_matches(t.text,'^C[0-9]{{3,4}}$') THEN CAST(floor(CAST(substr(t.text,2) AS INTEGER)/100) AS INTEGER) END LEFT JOIN paired p ON p.page_id=t.page_id AND p.text=t.text""")
def _(t):
    tk = _tokens(t)
    pairs = tk.where(F.get("ord", F.lit(0)) % 3 == 0).select("page_id", F.col("text").alias("component"))
    return P.restore_ics(tk, pairs).select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text")


@query("engine_rows_o09", f"""SELECT page_id, ord, text, round(c,6) AS confidence, x, y, w, h, {_category_sql('text')} AS category FROM (SELECT page_id, ord, trim(concat(' ', text, ' ')) AS text, confidence/100*100 AS c, x, y, w, h FROM fx_raw_tokens) q WHERE c>=30""")
def _(t):
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")
    quad = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    raw = t("fx_raw_tokens").select(
        "page_id", F.array(F.col("ord").cast("bigint")).alias("ord"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), (F.col("confidence") / 100).alias("score"),
        F.when(F.col("ord") % 2 == 0, quad).alias("quad"), F.array(x, y, x + w, y + h).alias("rect"))
    return O.from_ocr(raw, 30.0).select("page_id", F.get("ord", F.lit(0)).alias("ord"), "text", _r("confidence", "confidence"), "x", "y", _r("w", "w"), _r("h", "h"), "category")


_FLAT = ["page_id", "text", "category"]


def _show(df):
    return df.select("page_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), "text", "category",
                     _r("confidence", "confidence"), *[_r(c, c) for c in "xywh"])


_TK = f"tk AS (SELECT page_id, ord, text, {_category_sql('text')} AS category, confidence, x, y, w, h, x+w/2 AS cx, y+h/2 AS cy FROM fx_raw_tokens)"
_SHOWN = "page_id, CAST(ord AS VARCHAR) AS ord, text, category, round(confidence,6) AS confidence, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h"
_NEAR = "r.page_id=l.page_id AND r.ord<>l.ord"
_IN_BOX = "l.cx BETWEEN r.x AND r.x+r.w AND l.cy BETWEEN r.y AND r.y+r.h"
_CLOSE = "abs(l.cx-r.cx)<80 AND abs(l.cy-r.cy)<80"
_UNION = "least(l.x,r.x) AS x, least(l.y,r.y) AS y, greatest(l.x+l.w,r.x+r.w)-least(l.x,r.x) AS w, greatest(l.y+l.h,r.y+r.h)-least(l.y,r.y) AS h"
_ROUND = "round(confidence,6) AS confidence, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h"


def _pairing_sql(pairs: str, rank: str) -> str:
    """CTEs that go through the seekers of `pairs` in order; each that is not used takes its best unused target (got)."""
    return f"""lists AS (SELECT page_id, i, list(j ORDER BY {rank}) AS js, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM {pairs} GROUP BY page_id, i),
walk AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j FROM lists
  UNION ALL SELECT page_id, k, CASE WHEN pick IS NULL THEN used ELSE list_concat(used, [i, pick]) END, i, pick FROM (
    SELECT w.page_id, l.k, w.used, l.i, CASE WHEN NOT list_contains(w.used, l.i) THEN list_filter(l.js, lambda x: NOT list_contains(w.used, x))[1] END AS pick FROM walk w JOIN lists l ON l.page_id=w.page_id AND l.k=w.k+1) q),
got AS (SELECT page_id, i, j FROM walk WHERE j IS NOT NULL),
pair AS (SELECT g.page_id, g.i, g.j FROM got g), used AS (SELECT page_id, i AS ord FROM got UNION SELECT page_id, j FROM got)"""


_PAIR_ROWS = "FROM pair p JOIN tk l ON l.page_id=p.page_id AND l.ord=p.i JOIN tk r ON r.page_id=p.page_id AND r.ord=p.j"
_UNUSED = "FROM tk LEFT JOIN used u ON u.page_id=tk.page_id AND u.ord=tk.ord WHERE u.ord IS NULL"


_UNITS = "('" + "','".join(O.UNITS) + "')"
_BESIDE = "(regexp_matches(r.text,'^[0-9]+[.]?[0-9]*$') AND abs(l.cy-r.cy)<=greatest(l.h,r.h)*0.7 AND l.x-(r.x+r.w) BETWEEN 0 AND 30)"
_ABOVE = "(abs(l.cx-r.cx)<=greatest(l.w,r.w)*1.5 AND l.cy-r.cy>0 AND l.cy-r.cy<=greatest(l.h,r.h)*3)"


@query("unit_merge_g10", rf"""WITH RECURSIVE {_TK},
rel AS (SELECT l.page_id, l.ord AS i, r.ord AS j, CASE WHEN {_BESIDE} THEN 0 ELSE 1 END AS way, CASE WHEN {_BESIDE} THEN l.x-(r.x+r.w) ELSE l.cy-r.cy END AS d FROM tk l JOIN tk r ON r.page_id=l.page_id
  WHERE l.text IN {_UNITS} AND regexp_matches(r.text,'^[0-9]+[.,]?[0-9]*$') AND ({_BESIDE} OR {_ABOVE})),
{_pairing_sql("rel", "way, d, j")},
m0 AS (SELECT p.page_id, p.i AS ord, concat(r.text, l.text) AS raw, (l.confidence+r.confidence)/2 AS confidence, {_UNION} {_PAIR_ROWS}), {_clean_sql("m0", "page_id, ord", "raw", "um")},
one AS (SELECT tk.page_id, 0 AS lead, tk.ord, text, category, confidence, x, y, w, h {_UNUSED} UNION ALL SELECT m0.page_id, 1, m0.ord, um.t, 'value', confidence, x, y, w, h FROM m0 JOIN um ON um.page_id=m0.page_id AND um.ord=m0.ord),
seq AS (SELECT *, x+w/2 AS cx, y+h/2 AS cy, row_number() OVER (PARTITION BY page_id ORDER BY lead, ord) AS k FROM one),
n0 AS (SELECT l.page_id, l.k, l.lead, l.ord, concat(l.text, r.text) AS raw, (l.confidence+r.confidence)/2 AS confidence, {_UNION} FROM seq l JOIN seq r ON r.page_id=l.page_id AND r.k=l.k+1
  WHERE regexp_matches(l.text,'^[0-9]$') AND regexp_matches(r.text,'^[.][0-9]+') AND r.cx-l.cx>0 AND r.cx-l.cx<80 AND abs(r.cy-l.cy)<greatest(l.h,r.h)*0.6), {_clean_sql("n0", "page_id, k", "raw", "un")},
fin AS (SELECT s.page_id, s.lead, s.ord, s.text, s.category, s.confidence, s.x, s.y, s.w, s.h FROM seq s LEFT JOIN n0 a ON a.page_id=s.page_id AND a.k=s.k LEFT JOIN n0 b ON b.page_id=s.page_id AND b.k+1=s.k WHERE a.k IS NULL AND b.k IS NULL
  UNION ALL SELECT n0.page_id, lead, ord, un.t, 'value', confidence, x, y, w, h FROM n0 JOIN un ON un.page_id=n0.page_id AND un.k=n0.k)
SELECT page_id, concat(CAST(lead AS VARCHAR), '.', CAST(ord AS VARCHAR)) AS ord, text, category, {_ROUND} FROM fin""")
def _(t):
    return _show(O.merge_units(_tokens(t)))


@query("contained_tokens_j10", rf"""WITH RECURSIVE {_TK},
rel AS (SELECT l.page_id, l.ord AS n, list(r.ord) AS os FROM tk l JOIN tk r ON {_NEAR} WHERE length(l.text)>=2 AND NOT l.text LIKE '.%' AND length(r.text)>length(l.text) AND contains(r.text, l.text) AND {_CLOSE}
  AND (NOT (regexp_matches(l.text, '^[0-9]{{1,3}}$') AND r.category='value') OR ({_IN_BOX})) GROUP BY 1,2),
walk AS (SELECT DISTINCT page_id, CAST(-1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM tk
  UNION ALL SELECT w.page_id, w.k+1, CASE WHEN len(list_filter(rel.os, lambda o: NOT list_contains(w.gone, o)))>0 THEN list_append(w.gone, w.k+1) ELSE w.gone END
  FROM walk w LEFT JOIN rel ON rel.page_id=w.page_id AND rel.n=w.k+1 WHERE w.k<40),
a AS (SELECT tk.* FROM tk JOIN walk w ON w.page_id=tk.page_id AND w.k=40 WHERE NOT list_contains(w.gone, tk.ord)),
b AS (SELECT l.* FROM a l WHERE NOT (length(l.text)=1 AND NOT regexp_matches(l.text,'^[0-9]$') AND EXISTS (SELECT 1 FROM a r WHERE {_NEAR} AND length(r.text)>1 AND r.category='component' AND {_IN_BOX}))),
c AS (SELECT l.* FROM b l WHERE NOT (regexp_matches(l.text,'^[0-9]$') AND EXISTS (SELECT 1 FROM b r WHERE {_NEAR} AND length(r.text)>1 AND contains(r.text, l.text) AND {_IN_BOX}))),
d AS (SELECT l.* FROM c l WHERE NOT (l.text='0' AND EXISTS (SELECT 1 FROM c r WHERE {_NEAR} AND r.category='component' AND regexp_matches(r.text,'^L[0-9]') AND {_CLOSE})))
SELECT {_SHOWN} FROM d""")
def _(t):
    return _show(O.drop_contained(_tokens(t)))


@query("line_merge_g11", rf"""WITH RECURSIVE {_TK},
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cx, ord) AS k FROM tk WHERE category='other'),
chains AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ends, CAST([] AS BIGINT[]) AS own FROM o
  UNION ALL SELECT page_id, k, CASE WHEN spot IS NULL THEN list_append(ends, k) ELSE list_transform(ends, lambda e, i: CASE WHEN i=spot THEN k ELSE e END) END, list_append(own, coalesce(spot, len(ends)+1))
  FROM (SELECT c.page_id, t.k, c.ends, c.own, (SELECT min(u.i) FROM (SELECT unnest(c.ends) AS e, generate_subscripts(c.ends, 1) AS i) u JOIN o p ON p.page_id=c.page_id AND p.k=u.e
    WHERE abs(p.cy-t.cy)<=0.5*least(p.h,t.h) AND t.x-(p.x+p.w)<=3*least(p.h,t.h)) AS spot FROM chains c JOIN o t ON t.page_id=c.page_id AND t.k=c.k+1) q),
last AS (SELECT page_id, own FROM chains c WHERE k=(SELECT max(k) FROM o WHERE o.page_id=c.page_id)),
g AS (SELECT o.*, l.own[o.k] AS chain FROM o JOIN last l ON l.page_id=o.page_id),
m AS (SELECT page_id, chain, string_agg(text, ' ' ORDER BY k) AS text, avg(confidence) AS confidence, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM g GROUP BY 1,2 HAVING count(*)>1),
kept AS (SELECT concat('0.', CAST(tk.ord AS VARCHAR)) AS o2, tk.* FROM tk LEFT JOIN (SELECT g.page_id, g.ord FROM g JOIN m ON m.page_id=g.page_id AND m.chain=g.chain) u ON u.page_id=tk.page_id AND u.ord=tk.ord WHERE u.ord IS NULL)
SELECT page_id, o2 AS ord, text, category, round(confidence,6) AS confidence, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h FROM kept
UNION ALL SELECT page_id, concat('1.', CAST(row_number() OVER (PARTITION BY page_id ORDER BY chain) AS VARCHAR)), text, 'other', round(confidence,6), round(x,6), round(y,6), round(w,6), round(h,6) FROM m""")
def _(t):
    return _show(O.merge_lines(_tokens(t), "other", False, True))


# the text of the characters `col` from top to bottom
_SPELT = "array_to_string(list_transform(list_sort(list_transform(col, lambda k, i: struct_pack(cy := toks[k].cy, i := i, t := toks[k].text))), lambda e: e.t), '')"
_SPELLED = rf"(NOT list_contains(used, hd) AND len(col)>=3 AND (regexp_matches(upper({_SPELT}), '{O._DESIGNATOR}') OR regexp_matches({_SPELT}, '^[RCLQDMT]p[LP]$')))"


@query("column_merge_g11", rf"""WITH RECURSIVE {_TK},
ones AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cx, cy, ord) AS k FROM tk WHERE length(text)=1 AND trim(text)<>''),
lists AS (SELECT page_id, count(*) AS n, list(struct_pack(cx := cx, cy := cy, y := y, w := w, h := h, text := text) ORDER BY k) AS toks FROM ones GROUP BY 1),
walk AS (SELECT page_id, n, toks, CAST(1 AS BIGINT) AS hd, CAST(2 AS BIGINT) AS at_, CAST([] AS BIGINT[]) AS used, CAST([1] AS BIGINT[]) AS col FROM lists
  UNION ALL SELECT page_id, n, toks, CASE WHEN at_>n THEN hd+1 ELSE hd END, CASE WHEN at_>n THEN hd+2 ELSE at_+1 END, CASE WHEN at_>n AND {_SPELLED} THEN list_concat(used, col) ELSE used END,
    CASE WHEN at_>n THEN [hd+1] WHEN NOT list_contains(used, at_) AND abs(toks[at_].cx-toks[hd].cx)<=greatest(toks[hd].w*1.2, 15)
      AND toks[at_].y-(toks[col[-1]].y+toks[col[-1]].h) BETWEEN -0.5*toks[hd].h AND greatest(toks[hd].h*2, 25) THEN list_append(col, at_) ELSE col END FROM walk WHERE hd<=n),
found AS (SELECT page_id, hd, {_SPELT} AS text, unnest(col) AS k FROM walk WHERE hd<=n AND at_>n AND {_SPELLED}),
m AS (SELECT f.page_id, f.hd, any_value(f.text) AS text, avg(confidence) AS confidence, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM found f JOIN ones o ON o.page_id=f.page_id AND o.k=f.k GROUP BY 1,2),
kept AS (SELECT tk.* FROM tk LEFT JOIN (SELECT o.page_id, o.ord FROM found f JOIN ones o ON o.page_id=f.page_id AND o.k=f.k) u ON u.page_id=tk.page_id AND u.ord=tk.ord WHERE u.ord IS NULL)
SELECT page_id, concat('0.', CAST(ord AS VARCHAR)) AS ord, text, category, {_ROUND} FROM kept
UNION ALL SELECT page_id, concat('1.', CAST(row_number() OVER (PARTITION BY page_id ORDER BY hd) AS VARCHAR)), text, 'component', confidence, x, y, w, h FROM (SELECT page_id, hd, text, {_ROUND} FROM m) q""")
def _(t):
    return _show(O.merge_columns(_tokens(t)))


_ENDS_IN_SLASH, _STARTS_WITH_SLASH = "l.text LIKE '%/' AND l.category='value' AND r.cy-l.cy>0", "l.text LIKE '/%' AND length(l.text)>1 AND r.cy-l.cy<0 AND r.category IN ('value','net_label')"


@query("slash_merge_g10", rf"""WITH RECURSIVE {_TK},
rel AS (SELECT l.page_id, l.ord AS i, r.ord AS j, CASE WHEN {_ENDS_IN_SLASH} THEN 0 ELSE 1 END AS way, abs(r.cy-l.cy) AS d FROM tk l JOIN tk r ON {_NEAR}
  WHERE abs(r.cx-l.cx)<=greatest(l.w,40) AND abs(r.cy-l.cy)<=l.h*4 AND (({_ENDS_IN_SLASH}) OR ({_STARTS_WITH_SLASH}))),
{_pairing_sql("rel", "way, d, j")},
m AS (SELECT p.page_id, p.i AS ord, CASE WHEN r.cy>l.cy THEN l.text ELSE r.text END AS up, CASE WHEN r.cy>l.cy THEN r.text ELSE l.text END AS low, least(l.confidence,r.confidence) AS confidence, {_UNION} {_PAIR_ROWS})
SELECT page_id, concat('0.', CAST(ord AS VARCHAR)) AS ord, CASE WHEN up LIKE '%/' AND low LIKE '/%' THEN concat(up, substr(low,2)) ELSE concat(up, low) END AS text, 'value' AS category, {_ROUND} FROM m
UNION ALL SELECT tk.page_id, concat('1.', CAST(tk.ord AS VARCHAR)), text, category, {_ROUND.replace(" AS confidence", "").replace(" AS x", "").replace(" AS y", "").replace(" AS w", "").replace(" AS h", "")} {_UNUSED}""")
def _(t):
    return _show(O.merge_slashes(_tokens(t)))


@query("hyphen_merge_g10", rf"""WITH RECURSIVE {_TK},
rel AS (SELECT l.page_id, l.ord AS i, r.ord AS j, r.cy-l.cy AS d FROM tk l JOIN tk r ON r.page_id=l.page_id
  WHERE l.text LIKE '%-' AND length(l.text)>=3 AND l.category<>'net_label' AND r.category<>'component' AND r.cy-l.cy>0 AND r.cy-l.cy<=l.h*4 AND abs(r.cx-l.cx)<=greatest(l.w,80)),
{_pairing_sql("rel", "d, j")},
m AS (SELECT p.page_id, p.i AS ord, concat(left(l.text, length(l.text)-1), r.text) AS text, 'other' AS category, (l.confidence+r.confidence)/2 AS confidence, {_UNION} {_PAIR_ROWS}),
gone AS (SELECT page_id, i AS ord FROM got UNION SELECT page_id, j FROM got WHERE j>i),
kept AS (SELECT tk.page_id, tk.ord, text, category, confidence, x, y, w, h FROM tk LEFT JOIN gone u ON u.page_id=tk.page_id AND u.ord=tk.ord WHERE u.ord IS NULL)
SELECT {_SHOWN} FROM (SELECT * FROM kept UNION ALL SELECT * FROM m) q""")
def _(t):
    return _show(O.merge_hyphens(_tokens(t)))


_PREFIXES = "('" + "','".join(O.PREFIX_FRAGMENTS) + "')"
_FAR = "sqrt((l.cx-r.cx)*(l.cx-r.cx)+(l.cy-r.cy)*(l.cy-r.cy))"


@query("model_repair_g10", rf"""WITH RECURSIVE {_TK},
rel AS (SELECT l.page_id, l.ord AS i, r.ord AS j, {_FAR} AS d FROM tk l JOIN tk r ON {_NEAR}
  WHERE upper(l.text) IN {_PREFIXES} AND regexp_matches(r.text, '{O.MODEL_BODY}') AND {_FAR}<=greatest(l.w,l.h)*6 AND regexp_matches(concat(l.text,r.text), '{K.SEMI_MODEL}')),
{_pairing_sql("rel", "d, j")},
m AS (SELECT p.page_id, p.i AS ord, concat(l.text, r.text) AS text, (l.confidence+r.confidence)/2 AS confidence, {_UNION} {_PAIR_ROWS}),
one AS (SELECT tk.page_id, concat('0.', CAST(tk.ord AS VARCHAR)) AS ord, text, category, confidence, x, y, w, h {_UNUSED} UNION ALL SELECT page_id, concat('1.', CAST(ord AS VARCHAR)), text, 'value', confidence, x, y, w, h FROM m),
c AS (SELECT *, x+w/2 AS cx, y+h/2 AS cy FROM one),
lost AS (SELECT DISTINCT l.page_id, l.ord FROM c l JOIN c r ON r.page_id=l.page_id WHERE l.category='component' AND regexp_matches(l.text,'(?i)^[ABCDJK][0-9]{{4,}}$') AND regexp_matches(concat('2S',l.text),'{K.SEMI_MODEL}')
  AND r.category='component' AND regexp_matches(upper(r.text),'^[QD]') AND {_FAR}<=greatest(l.w,l.h)*5)
SELECT c.page_id, c.ord, CASE WHEN lost.ord IS NOT NULL THEN concat('2S', text) ELSE text END AS text, CASE WHEN lost.ord IS NOT NULL THEN 'value' ELSE category END AS category, {_ROUND}
FROM c LEFT JOIN lost ON lost.page_id=c.page_id AND lost.ord=c.ord""")
def _(t):
    return _show(O.fix_models(_tokens(t)))


_CHAR = "(l.h/greatest(length(l.text),1))"


@query("designator_repair_g10", rf"""WITH RECURSIVE {_TK},
near AS (SELECT l.page_id, l.ord AS i, r.ord AS j, concat(l.text, r.text) AS lt FROM tk l JOIN tk r ON r.page_id=l.page_id
  WHERE l.category='component' AND regexp_matches(l.text,'(?i)^[A-Z]{{1,2}}[0-9]+$') AND NOT upper(l.text) LIKE 'IC%' AND regexp_matches(r.text,'^[0-9]$')
  AND abs(r.cx-l.cx)<=greatest(l.w*1.5,20) AND r.y-(l.y+l.h) BETWEEN -{_CHAR}*0.5 AND {_CHAR}*2.5),
rel AS (SELECT page_id, i, j FROM near WHERE {_category_sql('lt')}='component'),
{_pairing_sql("rel", "j")},
m AS (SELECT p.page_id, p.i AS ord, concat(l.text, r.text) AS text, l.category, l.confidence, {_UNION} {_PAIR_ROWS})
SELECT {_SHOWN} FROM (SELECT tk.page_id, tk.ord, text, category, confidence, x, y, w, h {_UNUSED} UNION ALL SELECT * FROM m) q""")
def _(t):
    return _show(O.extend_designators(_tokens(t)))


@query("token_repairs_o01")
def _(t):
    return _show(O.repair(t("fx_raw_tokens")))


def _ids(df, *cols):
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ".").alias(c) if c in ("comp", "val") else F.col(c) for c in cols])


_IC = "upper(l.text) LIKE 'IC%'"
_FIELDS = "struct_pack(ord := o, text := t, d := d)"


def _nearest_sql(name: str, cond: str, by: str) -> str:
    return f"first({_FIELDS} ORDER BY {by}, extra, o) FILTER (WHERE {cond}) AS {name}"


_PRIMARY = rf"""{_TK},
near AS (SELECT l.page_id, l.ord AS comp, {_IC} AS ic, substr(upper(l.text),1,1) AS head, r.ord AS o, r.text AS t, {_FAR} AS d, r.category<>'value' AS extra, r.cx-l.cx AS dx, r.cy-l.cy AS dy,
  l.w AS lw, l.h AS lh, greatest(l.w,l.h) AS side, r.cy>=l.cy-l.h*0.5 AS level, NOT ({_IC} AND (regexp_matches(r.text,'{P.SHORT_NUMBER}') OR regexp_matches(r.text,'{O.PASSIVE}'))) AS usable,
  regexp_matches(r.text,'{P.SHORT_NUMBER}') AS short, regexp_matches(r.text,'{K.SEMI_MODEL}') AS model_text
  FROM tk l JOIN tk r ON r.page_id=l.page_id AND l.category='component' AND r.category IN ('value','net_label','other') WHERE {_FAR}<=greatest(l.w,l.h)*3.5 AND (r.category='value' OR ({_IC} AND length(r.text)>=3))),
cond AS (SELECT *, usable AND dy>=0 AND abs(dx)<=lw*0.5 AND dy<=side*2 AS down, usable AND dx>=0 AND abs(dy)<=lh*0.5 AND dx<=side*3 AS rgt, NOT short AND regexp_matches(t,'\p{{L}}') AND NOT (model_text AND head IN ('C','R','L','T')) AND level AS richer FROM near),
per AS (SELECT page_id, comp, any_value(ic) AS ic, any_value(head) AS head, {_nearest_sql("a_down", "down", "dy")}, {_nearest_sql("a_rich_down", "down AND NOT short", "dy")}, {_nearest_sql("a_right", "rgt", "abs(dx)")},
  {_nearest_sql("a_rich", "richer", "d")}, {_nearest_sql("a_any", "usable AND level", "d")}, {_nearest_sql("a_semi", "model_text AND level", "d")}, {_nearest_sql("a_passive", "NOT model_text AND level", "d")} FROM cond GROUP BY 1,2),
s1 AS (SELECT *, CASE WHEN a_down IS NOT NULL THEN CASE WHEN regexp_matches(a_down.text,'{P.SHORT_NUMBER}') THEN coalesce(a_rich_down, a_down) ELSE a_down END ELSE a_right END AS c FROM per),
s2 AS (SELECT * EXCLUDE (c), coalesce(CASE WHEN coalesce(NOT ic AND regexp_matches(c.text,'{P.SHORT_NUMBER}') AND a_rich.d<=c.d*2.5, false) THEN a_rich ELSE c END, a_any) AS c FROM s1),
s3 AS (SELECT *, regexp_matches(c.text,'{K.SEMI_MODEL}') AS is_semi, regexp_matches(c.text,'{P.PLAIN_NUMBER}') AS plain FROM s2),
s4 AS (SELECT page_id, comp, CASE WHEN head IN ('Q','D') AND NOT is_semi AND a_semi IS NOT NULL THEN CASE WHEN a_semi.d<c.d*(CASE WHEN plain THEN 1.5 ELSE 0.75 END) THEN a_semi ELSE c END
  WHEN head IN ('Q','D') AND NOT is_semi AND plain THEN NULL WHEN head IN ('C','R','L','T') AND is_semi AND a_passive.d<c.d*0.75 THEN a_passive ELSE c END AS c FROM s3),
prim AS (SELECT page_id, comp, c.ord AS val, c.d AS d FROM s4 WHERE c IS NOT NULL)"""


@query("primary_values_j09", f"WITH {_PRIMARY} SELECT page_id, CAST(comp AS VARCHAR) AS comp, CAST(val AS VARCHAR) AS val, round(d,6) AS d FROM prim")
def _(t):
    return _ids(P.primary_values(_tokens(t)).withColumn("d", F.round("d", 6)), "page_id", "comp", "val", "d")


_EXCLUSIVE = rf"""{_PRIMARY},
hold AS (SELECT page_id, val, first(comp ORDER BY d, comp) AS comp FROM prim GROUP BY 1,2),
lost AS (SELECT p.page_id, p.comp FROM prim p LEFT JOIN hold h ON h.page_id=p.page_id AND h.val=p.val AND h.comp=p.comp WHERE h.comp IS NULL),
rel AS (SELECT l.page_id, l.ord AS i, r.ord AS j, {_FAR} AS d FROM tk l JOIN lost ON lost.page_id=l.page_id AND lost.comp=l.ord JOIN tk r ON r.page_id=l.page_id AND r.category='value' LEFT JOIN hold h ON h.page_id=r.page_id AND h.val=r.ord
  WHERE h.val IS NULL AND {_FAR}<=greatest(l.w,l.h)*3.5 AND r.cy>=l.cy-l.h*0.5 AND NOT ({_IC} AND regexp_matches(r.text,'{O.PASSIVE}'))),
{_pairing_sql("rel", "d, j")},
ex AS (SELECT page_id, comp, val FROM hold UNION ALL SELECT page_id, i, j FROM got)"""


@query("exclusive_values_g09", f"WITH RECURSIVE {_EXCLUSIVE} SELECT page_id, CAST(comp AS VARCHAR) AS comp, CAST(val AS VARCHAR) AS val FROM ex")
def _(t):
    tk = _tokens(t)
    return _ids(P.exclusive_values(tk, P.primary_values(tk)), "page_id", "comp", "val")


_SHORT, _DIGITS = f"'{P.SHORT_NUMBER}'", "'^[0-9]+$'"
_DIGIT_BELOW = f"(cap AND regexp_matches(vt,{_DIGITS}) AND r.cy-vcy>0 AND r.cy-vcy<=vh*3 AND abs(r.cx-vcx)<=greatest(vw,lw)*1.5)"
_FIRST_FIT = "coalesce(list_position(list_transform({rest}, lambda e: e.y-{low}<=step), true), 0)"


@query("value_pairs_g12", rf"""WITH RECURSIVE {_EXCLUSIVE},
pv AS (SELECT ex.page_id, comp, val, l.text AS lt, {_IC} AS ic, upper(l.text) LIKE 'C%' AS cap, l.cx AS lcx, l.cy AS lcy, l.w AS lw, l.h AS lh, r.text AS vt, r.x AS vx, r.y AS vy, r.w AS vw, r.h AS vh, r.cx AS vcx, r.cy AS vcy
  FROM ex JOIN tk l ON l.page_id=ex.page_id AND l.ord=comp JOIN tk r ON r.page_id=ex.page_id AND r.ord=val),
sp AS (SELECT *, greatest(lw,vw)*(CASE WHEN ic THEN 0.6 ELSE 1 END) AS tol, greatest(lw,lh)*(CASE WHEN ic THEN 0.5 WHEN cap THEN 1.5 ELSE 1 END) AS span, greatest(vh,lh)*(CASE WHEN ic THEN 0.5 ELSE 1 END) AS step,
  struct_pack(y := vy, x := vx, o := CAST(-1 AS BIGINT), text := vt, w := vw, h := vh) AS main FROM pv),
un AS (SELECT sp.page_id, sp.comp, list(struct_pack(y := r.y, x := r.x, o := r.ord, text := r.text, w := r.w, h := r.h) ORDER BY r.y, r.x, r.ord) AS below FROM sp JOIN tk r ON r.page_id=sp.page_id AND r.category IN ('value','net_label','other')
  LEFT JOIN ex t ON t.page_id=r.page_id AND t.val=r.ord WHERE t.val IS NULL AND (NOT ic OR r.category<>'value') AND NOT (substr(upper(lt),1,1) IN ('Q','D') AND regexp_matches(r.text,'{P.PLAIN_NUMBER}'))
  AND (NOT regexp_matches(r.text,{_SHORT}) OR {_DIGIT_BELOW}) AND NOT regexp_matches(upper(r.text),'^(IC|[RCLQ])[0-9]{{2,4}}$') AND r.cy-lcy BETWEEN 0 AND span AND abs(r.cx-lcx)<=tol GROUP BY 1,2),
j1 AS (SELECT sp.*, coalesce(un.below, []) AS below FROM sp LEFT JOIN un ON un.page_id=sp.page_id AND un.comp=sp.comp),
j2 AS (SELECT *, {_FIRST_FIT.format(rest="below", low="(vy+vh)")} AS i1 FROM j1),
j3 AS (SELECT *, CASE WHEN i1>0 THEN below[i1] END AS e1, CASE WHEN i1>0 AND NOT ic THEN below[i1+1:] ELSE [] END AS rest FROM j2),
j4 AS (SELECT *, {_FIRST_FIT.format(rest="rest", low="(e1.y+e1.h)")} AS i2 FROM j3),
j5 AS (SELECT *, list_sort(list_concat([main], list_concat(CASE WHEN i1>0 THEN [e1] ELSE [] END, CASE WHEN i2>0 THEN [rest[i2]] ELSE [] END))) AS parts FROM j4),
j6 AS (SELECT *, list_transform(parts, lambda e: CASE WHEN cap AND regexp_matches(e.text,'^0?1/([0-9]{{2}})$') THEN concat(regexp_extract(e.text,'^0?1/([0-9]{{2}})$',1),'/10') ELSE e.text END) AS texts,
  list_min(list_transform(parts, lambda e: e.x)) AS bx, list_min(list_transform(parts, lambda e: e.y)) AS by_ FROM j5)
SELECT page_id, CAST(comp AS VARCHAR) AS comp, lt AS component, CASE WHEN cap AND len(texts)=2 AND len(list_filter(texts, lambda x: NOT regexp_matches(x,{_DIGITS})))=0 THEN array_to_string(texts, '/') ELSE array_to_string(texts, ' ') END AS value, bx AS x, by_ AS y,
  list_max(list_transform(parts, lambda e: e.x+e.w))-bx AS w, list_max(list_transform(parts, lambda e: e.y+e.h))-by_ AS h FROM j6""")
def _(t):
    return _ids(P.pair(_tokens(t)), "page_id", "comp", "component", "value", "x", "y", "w", "h")


_COMP = "c AS (SELECT ann_id, image_id, x, y, w, h, concat('R', CAST(ann_id%30 AS VARCHAR)) AS name, CASE WHEN ann_id%4=0 THEN '' ELSE concat(CAST(ann_id%20 AS VARCHAR), 'k') END AS value FROM fx_annotations)"
_DET = "d AS (SELECT model, image_id, x, y, w, h, lower(concat('*R', CAST(pred_id%30 AS VARCHAR), ' ', CAST(pred_id%10 AS VARCHAR), 'K')) AS text FROM fx_predictions)"
_HITS = f"""{_COMP}, {_DET}, hits AS (SELECT d.model, c.image_id, c.ann_id, max(contains(replace(d.text,'*',''), lower(c.name))) AS n, max(c.value<>'' AND contains(replace(d.text,'*',''), c.value)) AS v
FROM d JOIN c ON c.image_id=d.image_id AND least(c.x+c.w,d.x+d.w)>greatest(c.x,d.x) AND least(c.y+c.h,d.y+d.h)>greatest(c.y,d.y) GROUP BY 1,2,3)"""


def _read(t):
    k, p = F.col("ann_id"), F.col("pred_id")
    c = t("fx_annotations").select("image_id", k.alias("comp_id"), *"xywh", F.concat(F.lit("R"), (k % 30).cast("string")).alias("name"),
                                   F.when(k % 4 == 0, "").otherwise(F.concat((k % 20).cast("string"), F.lit("k"))).alias("value"))
    d = t("fx_predictions").select("model", "image_id", *"xywh", F.concat(F.lit("*R"), (p % 30).cast("string"), F.lit(" "), (p % 10).cast("string"), F.lit("K")).alias("text"))
    return c, d


@query("component_hits_j07", f"WITH {_HITS} SELECT model, image_id, ann_id AS comp_id, n AS name_hit, v AS value_hit FROM hits")
def _(t):
    return P.component_hits(*_read(t))


@query("ocr_coverage_a08", f"""WITH {_HITS}, s AS (SELECT count(*) AS n, count(*) FILTER (value<>'') AS v, count(DISTINCT image_id) AS i FROM c), f AS (SELECT model, count(*) AS found FROM d GROUP BY 1)
SELECT f.model, round((SELECT count(*) FROM hits WHERE hits.model=f.model AND n)/CAST(s.n AS DOUBLE),6) AS name_rate, round((SELECT count(*) FROM hits WHERE hits.model=f.model AND v)/CAST(s.v AS DOUBLE),6) AS value_rate, round(f.found/CAST(s.i AS DOUBLE),6) AS per_image FROM f, s""")
def _(t):
    c = P.coverage(*_read(t))
    return c.select("model", *[_r(x, x) for x in ("name_rate", "value_rate", "per_image")])


_PV = """v AS (SELECT region_id, category, regexp_extract(region_comment,' value=(\\S+)',1) AS raw FROM (SELECT region_id, category, concat(' ', regexp_replace(region_comment,'([0-9]),([0-9])','\\1.\\2','g')) AS region_comment FROM fx_comments) q),
p AS (SELECT region_id, category, raw, CAST(regexp_extract(raw,'^([0-9.]+)',1) AS DOUBLE) AS num, regexp_extract(raw,'([a-zA-Z]*)$',1) AS u FROM v WHERE raw<>''),
m AS (SELECT *, CASE WHEN category='resistor' THEN CASE u WHEN 'K' THEN 3 END WHEN category IN ('capacitor','inductor') THEN CASE u WHEN 'n' THEN -9 WHEN 'u' THEN -6 END END AS e FROM p)"""


def _parsed(t):
    text = M.entry(M.comment_map(M.without_decimal_commas(F.col("region_comment"))), "value")
    return t("fx_comments").withColumn("p", V.parse_value(text, F.col("category"))).where("p IS NOT NULL")


@query("component_values_p14", f"WITH {_PV} SELECT region_id, CASE category WHEN 'capacitor' THEN 'F' WHEN 'inductor' THEN 'H' ELSE 'Ω' END AS unit, num AS number, e AS exponent FROM m WHERE e IS NOT NULL")
def _(t):
    return _parsed(t).select("region_id", F.col("p.base").alias("unit"), F.col("p.number").cast("double").alias("number"), F.col("p.exponent").alias("exponent"))


@query("value_texts_p15", f"""WITH {_PV} SELECT region_id, concat(CASE WHEN num=floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END, CASE u WHEN 'K' THEN 'K' ELSE u END) AS deck,
concat(CASE WHEN num=floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END, CASE u WHEN 'K' THEN 'k' WHEN 'u' THEN 'µ' ELSE 'n' END, CASE category WHEN 'capacitor' THEN 'F' WHEN 'inductor' THEN 'H' ELSE 'Ω' END) AS display FROM m WHERE e IS NOT NULL""")
def _(t):
    return _parsed(t).select("region_id", V.deck_value(F.col("p")).alias("deck"), V.display_value(F.col("p")).alias("display"))
