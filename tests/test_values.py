"""Literal cases of the row rules."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import labels as L
from tracewright.functions import metadata as M
from tracewright.functions import regions as R
from tracewright.functions import tokens as K
from tracewright.functions import values as V

CLEAN = {
    "R46115K": "R461", "25C1740": "2SC1740", "10,5UF": "10.5UF", "47 uF": "47µF", "OA": "A", "O+UCC": "+UCC", "1O0K": "100K", "S6K": "56K",
    "2SCI74O": "2SC1740", "ISS133": "1SS133", "IN4148": "1N4148", "0413": "D413", "RB13": "R813", "QBO6": "Q806", "6.BC": "6.8C", "LI02": "L102",
    "m5K": "5K", "/": "7", "19,": "19", "1C408": "IC408", "470Pm": "470P", "R1=22K": "R1", "100.00": "100Ω", "47kQ": "47kΩ", "1052": "10Ω",
    "680Ks": "680KΩ", "2S": "2S", "10...30pF": "10~30pF", "01": "1", "3 K": "3K", "ОАВ": "OAB",
}
CATEGORY = {
    "IC408": "component", "R12": "component", "RpL": "component", "SF402": "component", "+5V": "net_label", "10K": "value", "2SC1740": "value",
    "TDA2030": "value", "OUT": "net_label", "FE0F": "net_label", "L ch": "net_label", "IN-": "net_label", "": "other", "loudspeaker": "other", "12": "value", "7": "net_label",
}
VALUES = [
    ("100n", "capacitor", 1e-7, "100n", "100nF"), ("0.1u", "capacitor", 1e-7, "0.1u", "100nF"), ("4.7K", "resistor", 4700.0, "4.7K", "4.7kΩ"),
    ("470", "resistor", 470.0, "470", "470Ω"), ("10", "capacitor", 1e-5, "10u", "10µF"), ("1M", "resistor", 1e6, "1Meg", "1MΩ"),
    ("2.2MΩ", "resistor", 2.2e6, "2.2Meg", "2.2MΩ"), ("1mH", "inductor", 1e-3, "1m", "1mH"), ("0.039uF", "capacitor", 3.9e-8, "0.039u", "39nF"),
    ("x", "resistor", None, None, None), ("5Kx", "resistor", None, None, None), ("1", "diode", None, None, None), ("unknown", "resistor", None, None, None),
]


def _one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean(spark):
    got = dict(_one(spark, "a string", [(k,) for k in CLEAN], F.col("a"), K.clean(F.col("a"))))
    assert got == CLEAN


def test_category(spark):
    got = dict(_one(spark, "a string", [(k,) for k in CATEGORY], F.col("a"), K.category(F.col("a"))))
    assert got == CATEGORY


def test_values(spark):
    p = V.parse_value(F.col("a"), F.col("b"))
    got = _one(spark, "a string, b string", [v[:2] for v in VALUES], F.col("a"), F.col("b"), p["si"], V.deck_value(p), V.display_value(p))
    assert got == VALUES


@pytest.mark.parametrize("text, n", [("123", 3), ("12345678910", 10), ("1234567891011", 11), ("12", None), ("124", None), ("1234567891", None)])
def test_pin_count(spark, text, n):
    assert _one(spark, "a string", [(text,)], K.pin_count(F.col("a"))) == [(n,)]


def test_comment_map_last_wins(spark):
    got = _one(spark, "a string", [("type=resistor value=1  junk value=4,7K=x",)], M.comment_map(F.col("a")), M.without_decimal_commas(F.col("a")))
    assert got == [({"type": "resistor", "value": "4,7K=x"}, "type=resistor value=1  junk value=4.7K=x")]


def test_page_range(spark):
    got = _one(spark, "a string", [("1,3-5,7",), ("5-3, x, 2",), ("",)], L.page_range(F.col("a")))
    assert got == [([1, 3, 4, 5, 7],), ([2],), ([],)]


def test_polygon_area_and_inside(spark):
    star = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 5.0, 5.0, 0.0, 10.0]
    rows = [(star, 5.0, 4.0), (star, 5.0, 8.0), (star, 5.0, 5.0), (star, 0.0, 0.0), (star, 11.0, 1.0)]
    got = _one(spark, "p array<double>, x double, y double", rows, G.polygon_area(F.col("p")), G.point_in_polygon(F.col("x"), F.col("y"), F.col("p")))
    assert got == [(75.0, True), (75.0, False), (75.0, True), (75.0, True), (75.0, False)]


def test_clip_roi(spark):
    got = _one(spark, "x long, y long, w long, h long", [(-5, 2, 20, 4), (90, 0, 20, 4), (200, 0, 5, 5), (0, 0, 0, 5)],
               R.clip_roi(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100), F.lit(50)))
    assert [tuple(r[0]) if r[0] else None for r in got] == [(0, 2, 20, 4), (90, 0, 10, 4), None, None]


def test_region_units(spark):
    pts = [[[0.1, 0.1], [0.5, 0.5]], [[10.0, 10.0], [50.0, 50.0]], [[150.0, 150.0], [300.0, 900.0]], [[1.0, 1.0], [1.0, 5.0]]]
    got = _one(spark, "p array<array<double>>", [(p,) for p in pts], R.normalise_region(F.lit("rect"), F.col("p"), F.lit(800), F.lit(600)))
    assert [g[0].unit if g[0] else None for g in got] == ["fraction", "percent", "pixel", None]
    assert got[0][0].points[2] == [400.0, 300.0] and got[2][0].points[2] == [300.0, 600.0]


def test_six_digits_as_printed(spark):
    vals = [0.0, 1.0, 4.7, 0.1, 123456.0, 999999.0, 999999.7, 1e6, 1234567.0, 1e12, 1e-4, 9.99999e-5, 1.5e-5, 3.3e-12, 0.00012345678, -2.5, 22000.0, 47.123456]
    got = [r.x for r in spark.createDataFrame([(v,) for v in vals], "v double").select(V.six_digits(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:.6g}" for v in vals]


def test_fold_drops_every_latin_mark(spark):
    import unicodedata

    from tracewright.functions import text as T

    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).lower() == chr(c)] + ["e\u0301", "łß", "ĳ"]
    want = ["".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x)) for v in letters]
    got = [r.x for r in spark.createDataFrame([(v,) for v in letters], "v string").select(T.fold(F.col("v")).alias("x")).collect()]
    assert got == want
