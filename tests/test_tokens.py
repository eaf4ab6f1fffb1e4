"""Token merges and pairing against plain loops over the list, page by page."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import tokens as K
from tracewright.operators import pairing, tokens

WORDS = ["K", "µF", "10", "4.7", "12", "3", "R1", "C41", "Q2", "IC4", "C408", "2S", "C1740", "2SC1740", "10K", "22µF/", "/25V", "Amplif-", "Preamp-", "ier", "out put",
         "left-right", "Volume", "Tone", "0", "L1", "1", "R", "5", "BC109", "47", "I", "Q", "100n", ".2K"]


def _page(seed, n=44):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w, h = float(rnd.randint(8, 40)), float(rnd.randint(10, 20))
        x, y = float(rnd.randint(0, 220)), float(rnd.randint(0, 160))
        out.append(dict(i=i, text=rnd.choice(WORDS), confidence=float(rnd.randint(30, 99)), x=x, y=y, w=w, h=h))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    data = {s: _page(s) for s in range(8)}
    flat = [(p, [t["i"]], t["text"], t["confidence"], t["x"], t["y"], t["w"], t["h"]) for p, ts in data.items() for t in ts]
    df = spark.createDataFrame(flat, "page_id long, ord array<long>, text string, confidence double, x double, y double, w double, h double")
    df = df.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2, "category": K.category(F.col("text"))})
    df = df.select(tokens.COLUMNS).persist()
    lists = {p: [] for p in data}
    for r in df.collect():
        lists[r.page_id].append(r.asDict())
    for p in lists:
        lists[p].sort(key=lambda t: t["ord"])
    return df, lists


def _boxed(a, b):
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return x, y, max(a["x"] + a["w"], b["x"] + b["w"]) - x, max(a["y"] + a["h"], b["y"] + b["h"]) - y


def _show(df):
    return sorted((r.page_id, r.text, round(r.x, 6), round(r.y, 6), round(r.w, 6), round(r.h, 6), r.category) for r in df.collect())


def _expect(lists, change):
    out = []
    for p, ts in lists.items():
        for t in change([dict(t) for t in ts]):
            out.append((p, t["text"], round(t["x"], 6), round(t["y"], 6), round(t["w"], 6), round(t["h"], 6), t["category"]))
    return sorted(out)


def _merged(a, b, text, category):
    x, y, w, h = _boxed(a, b)
    return dict(a, text=text, x=x, y=y, w=w, h=h, cx=x + w / 2, cy=y + h / 2, category=category)


def test_contained(pages):
    df, lists = pages

    def near(a, b):
        return abs(a["cx"] - b["cx"]) < 80 and abs(a["cy"] - b["cy"]) < 80

    def holds(a, b):
        return b["x"] <= a["cx"] <= b["x"] + b["w"] and b["y"] <= a["cy"] <= b["y"] + b["h"]

    def change(ts):
        gone = set()

        def sweep(subject, related):
            for i, a in enumerate(ts):
                if i not in gone and subject(a) and any(j != i and j not in gone and related(a, b) for j, b in enumerate(ts)):
                    gone.add(i)

        digit = lambda s: s.isdigit() and len(s) <= 3
        sweep(lambda a: len(a["text"]) > 1 and a["text"][0] != ".",
              lambda a, b: len(b["text"]) > len(a["text"]) and a["text"] in b["text"] and near(a, b)
              and (not (digit(a["text"]) and b["category"] == "value") or holds(a, b)))
        sweep(lambda a: len(a["text"]) == 1 and not a["text"].isdigit(), lambda a, b: len(b["text"]) > 1 and b["category"] == "component" and holds(a, b))
        sweep(lambda a: len(a["text"]) == 1 and a["text"].isdigit(), lambda a, b: len(b["text"]) > 1 and a["text"] in b["text"] and holds(a, b))
        sweep(lambda a: a["text"] == "0", lambda a, b: b["category"] == "component" and b["text"][:1] == "L" and b["text"][1:2].isdigit() and near(a, b))
        return [t for i, t in enumerate(ts) if i not in gone]

    want = _expect(lists, change)
    assert len(want) < df.count()
    assert _show(tokens.drop_contained(df)) == want


def test_slashes(pages):
    df, lists = pages

    def change(ts):
        used, made = set(), []
        for i, a in enumerate(ts):
            if i in used:
                continue
            down = a["text"].endswith("/") and a["category"] == "value"
            up = a["text"].startswith("/") and len(a["text"]) > 1
            for way, ok in ((1, down), (-1, up)):
                cand = [
                    ((b["cy"] - a["cy"]) * way, j) for j, b in enumerate(ts)
                    if ok and j != i and j not in used and i not in used and 0 < (b["cy"] - a["cy"]) * way <= a["h"] * 4
                    and abs(b["cx"] - a["cx"]) <= max(a["w"], 40) and (way == 1 or b["category"] in ("value", "net_label"))]
                if cand:
                    j = min(cand)[1]
                    used |= {i, j}
                    hi, lo = (a, ts[j]) if way == 1 else (ts[j], a)
                    text = hi["text"] + (lo["text"][1:] if hi["text"].endswith("/") and lo["text"].startswith("/") else lo["text"])
                    made.append(_merged(hi, lo, text, "value"))
        return made + [t for i, t in enumerate(ts) if i not in used]

    want = _expect(lists, change)
    assert len(want) < df.count()
    assert _show(tokens.merge_slashes(df)) == want


@pytest.mark.parametrize("keep_earlier", [True, False])
def test_hyphens(pages, keep_earlier):
    df, lists = pages

    def change(ts):
        used, made, listed = set(), [], set()
        for i, a in enumerate(ts):
            if i in used or not (a["text"].endswith("-") and len(a["text"]) >= 3) or a["category"] == "net_label":
                continue
            cand = [
                (b["cy"] - a["cy"], j) for j, b in enumerate(ts)
                if j != i and j not in used and 0 < b["cy"] - a["cy"] <= a["h"] * 4 and abs(b["cx"] - a["cx"]) <= max(a["w"], 80) and b["category"] != "component"]
            if cand:
                j = min(cand)[1]
                used |= {i, j}
                listed |= {j} if j < i and keep_earlier else set()
                made.append(_merged(a, ts[j], a["text"][:-1] + ts[j]["text"], "other"))
        return made + [t for i, t in enumerate(ts) if i not in used or i in listed]

    want = _expect(lists, change)
    assert len(want) < df.count()
    assert _show(tokens.merge_hyphens(df, keep_earlier)) == want


def test_lines(pages):
    df, lists = pages

    def change(ts):
        words = sorted((t["cx"], k) for k, t in enumerate(ts) if t["category"] == "other")
        used, made = set(), []
        for n, (_, i) in enumerate(words):
            if i in used:
                continue
            chain = [i]
            for _, j in words[n + 1:]:
                a, b = ts[chain[-1]], ts[j]
                ref = min(a["h"], b["h"])
                if j not in used and abs(a["cy"] - b["cy"]) <= ref / 2 and b["x"] - a["x"] - a["w"] <= 3 * ref:
                    chain.append(j)
            if len(chain) > 1:
                used.update(chain)
                m = ts[chain[0]]
                for j in chain[1:]:
                    m = _merged(m, ts[j], m["text"] + " " + ts[j]["text"], "other")
                made.append(m)
        return [t for i, t in enumerate(ts) if i not in used] + made

    want = _expect(lists, change)
    assert len(want) < df.count()
    assert _show(tokens.merge_lines(df, "other", False, True)) == want


def test_units(pages):
    df, lists = pages
    import re

    def change(ts):
        used, made = set(), []
        for i, u in enumerate(ts):
            if u["text"] not in tokens.UNITS:
                continue
            side, over = [], []
            for j, v in enumerate(ts):
                if j == i or j in used or not re.fullmatch(r"\d+[.,]?\d*", v["text"]):
                    continue
                gap, dy = u["x"] - v["x"] - v["w"], u["cy"] - v["cy"]
                if abs(dy) <= 0.7 * max(u["h"], v["h"]) and 0 <= gap <= 30:
                    side.append((gap, j))
                if abs(u["cx"] - v["cx"]) <= 1.5 * max(u["w"], v["w"]) and 0 < dy <= 3 * max(u["h"], v["h"]):
                    over.append((dy, j))
            best = min(side) if side else min(over, default=None)
            if best:
                used |= {i, best[1]}
                # the joined text is cleaned again: a lone 0 before a capital is a circle
                text = re.sub(r"^0([A-Z])$", r"\1", ts[best[1]]["text"] + u["text"])
                made.append(_merged(ts[best[1]], u, text, "value"))
        return [t for i, t in enumerate(ts) if i not in used] + made

    # leave out the follow-up that joins a digit with a ".2K" next in the list
    plain = df.where("text <> '.2K'")
    kept = {p: [t for t in ts if t["text"] != ".2K"] for p, ts in lists.items()}
    want = _expect(kept, change)
    assert len(want) < plain.count()
    assert _show(tokens.merge_units(plain)) == want


def test_columns(spark):
    rnd = random.Random(9)
    rows, lists = [], {}
    for p in range(5):
        ts = []
        for i in range(30):
            t = dict(page_id=p, ord=[i], text=rnd.choice("RCL1234"), confidence=80.0, x=float(rnd.choice([10, 14, 60, 66, 120]) + rnd.randint(0, 6)),
                     y=float(rnd.randint(0, 200)), w=float(rnd.randint(6, 12)), h=float(rnd.randint(9, 14)))
            t.update(cx=t["x"] + t["w"] / 2, cy=t["y"] + t["h"] / 2, category="net_label")
            ts.append(t)
        lists[p] = ts
        rows += [tuple(t[c] for c in tokens.COLUMNS) for t in ts]
    df = spark.createDataFrame(rows, tokens.SCHEMA)

    import re

    def change(ts):
        order = sorted(range(len(ts)), key=lambda k: (ts[k]["cx"], ts[k]["cy"], k))
        used, made = set(), []
        for n, i in enumerate(order):
            if i in used:
                continue
            a = ts[i]
            col, low = [i], a["y"] + a["h"]
            for j in order[n + 1:]:
                b = ts[j]
                if j in used or abs(b["cx"] - a["cx"]) > max(a["w"] * 1.2, 15):
                    continue
                if -a["h"] / 2 <= b["y"] - low <= max(2 * a["h"], 25):
                    col.append(j)
                    low = b["y"] + b["h"]
            col.sort(key=lambda k: ts[k]["cy"])
            text = "".join(ts[k]["text"] for k in col)
            if len(col) > 2 and re.fullmatch(r"[RCL]\d+[A-Z]?", text):
                used.update(col)
                m = ts[col[0]]
                for k in col[1:]:
                    m = _merged(m, ts[k], m["text"] + ts[k]["text"], "component")
                made.append(m)
        return [t for i, t in enumerate(ts) if i not in used] + made

    want = _expect(lists, change)
    assert len(want) < len(rows)
    assert _show(tokens.merge_columns(df)) == want


def _semi(s):
    import re

    return bool(re.match(K.SEMI_MODEL, s))


def _pairs(ts):
    """Plain version of the value choice and of the contest for values: {component: value} by place."""
    import math
    import re

    dist = lambda a, b: math.dist((a["cx"], a["cy"]), (b["cx"], b["cy"]))
    short = lambda v: bool(re.fullmatch(r"\d{1,2}", v["text"]))
    plain = lambda v: bool(re.fullmatch(r"[\d.,/]+", v["text"]))
    passive = lambda v: bool(re.match(tokens.PASSIVE, v["text"]))
    first = {}
    for c in (t for t in ts if t["category"] == "component"):
        up, size = c["text"].upper(), max(c["w"], c["h"])
        ic, head = up.startswith("IC"), up[0]
        vals = [t for t in ts if t["category"] == "value"]
        if ic:
            vals += [t for t in ts if t["category"] in ("net_label", "other") and len(t["text"]) >= 3]
        vals = [v for v in vals if dist(c, v) <= 3.5 * size]
        usable = [v for v in vals if not (ic and (short(v) or passive(v)))]
        level = lambda v: v["cy"] >= c["cy"] - c["h"] / 2
        nearest = lambda vs: min(vs, key=lambda v: dist(c, v), default=None)
        down = sorted((v for v in usable if v["cy"] >= c["cy"] and abs(v["cx"] - c["cx"]) <= c["w"] / 2 and v["cy"] - c["cy"] <= 2 * size), key=lambda v: v["cy"] - c["cy"])
        right = sorted((v for v in usable if v["cx"] >= c["cx"] and abs(v["cy"] - c["cy"]) <= c["h"] / 2 and v["cx"] - c["cx"] <= 3 * size), key=lambda v: v["cx"] - c["cx"])
        got = None
        if down:
            got = next((v for v in down if not short(v)), down[0]) if short(down[0]) else down[0]
        elif right:
            got = right[0]
        if got and not ic and short(got):
            rich = [v for v in vals if not short(v) and any(ch.isalpha() for ch in v["text"]) and not (_semi(v["text"]) and head in "CRLT") and level(v) and dist(c, v) <= 2.5 * dist(c, got)]
            got = nearest(rich) or got
        got = got or nearest([v for v in usable if level(v)])
        if got and head in "QD" and not _semi(got["text"]):
            s = nearest([v for v in vals if _semi(v["text"]) and level(v)])
            if s:
                got = s if dist(c, s) < dist(c, got) * (1.5 if plain(got) else 0.75) else got
            elif plain(got):
                got = None
        elif got and head in "CRLT" and _semi(got["text"]):
            s = nearest([v for v in vals if not _semi(v["text"]) and level(v)])
            got = s if s and dist(c, s) < dist(c, got) * 0.75 else got
        if got:
            first[c["ord"][0]] = got["ord"][0]
    by = {t["ord"][0]: t for t in ts}
    won = {}
    for v in set(first.values()):
        won[min((c for c in first if first[c] == v), key=lambda c: (dist(by[c], by[v]), c))] = v
    taken = set(won.values())
    for c in (c for c in first if c not in won):
        a = by[c]
        cand = [t for t in ts if t["category"] == "value" and t["ord"][0] not in taken and t["cy"] >= a["cy"] - a["h"] / 2
                and dist(a, t) <= 3.5 * max(a["w"], a["h"]) and not (a["text"].upper().startswith("IC") and passive(t))]
        if cand:
            v = min(cand, key=lambda t: dist(a, t))["ord"][0]
            won[c] = v
            taken.add(v)
    return first, won


def test_values_of_components(pages):
    df, lists = pages
    first = {(p, c, v) for p, ts in lists.items() for c, v in _pairs(ts)[0].items()}
    won = {(p, c, v) for p, ts in lists.items() for c, v in _pairs(ts)[1].items()}
    primary = pairing.primary_values(df)
    assert {(r.page_id, r.comp[0], r.val[0]) for r in primary.collect()} == first
    got = pairing.exclusive_values(df, primary)
    assert {(r.page_id, r.comp[0], r.val[0]) for r in got.collect()} == won
    assert first != won and len(won) > 10


def test_stacked_values(spark):
    row = lambda i, text, x, y, cat: (1, [i], text, 90.0, x, y, 30.0, 10.0, x + 15, y + 5, cat)
    df = spark.createDataFrame([
        row(0, "C12", 100.0, 100.0, "component"), row(1, "47", 100.0, 112.0, "value"), row(2, "16", 100.0, 124.0, "value"),
        row(3, "R5", 300.0, 100.0, "component"), row(4, "10K", 300.0, 112.0, "value"), row(5, "1W", 302.0, 124.0, "net_label")], tokens.SCHEMA)
    got = {r.component: (r.value, r.h) for r in pairing.pair(df).collect()}
    assert got == {"C12": ("47/16", 22.0), "R5": ("10K 1W", 22.0)}


def test_whole_chain_is_independent_of_input_order(spark):
    from tracewright.plans.registry import Tables

    raw = Tables(spark, "/root/testdata/sf0.001")("fx_raw_tokens").where("page_id < 2")
    a = _show(tokens.repair(raw))
    b = _show(tokens.repair(raw.repartition(3, "text")))
    assert a == b and len(a) > 20
