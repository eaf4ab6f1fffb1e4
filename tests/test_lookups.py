"""Lookups against plain loops."""

import random

from pyspark.sql import functions as F

from tracewright.operators import records as R


def test_best_scoring_entry(spark):
    """All entries compared with all lookups; one kind in a third of both, empty and null fields, ties."""
    rnd = random.Random(2)
    one = lambda i, k: (i, rnd.choice([None, "h1", "h2", f"h{rnd.randint(3, 30)}"]), rnd.choice(["Page", "page", "page", "crop", "", None]), rnd.choice([None, "s1", "s2", ""]),
                        rnd.choice([None, "f1", "f2", "f3"]), rnd.choice([None, "u1", "u2"]), *k)
    entries = [one(i, (rnd.randint(0, 9), i)) for i in range(150)]
    lookups = [one(i, ()) for i in range(200)]
    kind = "history string, kind string, source string, filename string, url string"
    got = R.best_scoring(spark.createDataFrame(lookups, f"lookup_id long, {kind}"), spark.createDataFrame(entries, f"entry_id long, {kind}, updated_at long, ord long"))
    low = lambda r: [r[1], None if r[2] is None else r[2].lower(), *r[3:6]]
    want = []
    for lk in lookups:
        best = None
        for e in entries:
            score = sum(p for p, a, b in zip(R.MATCH_POINTS.values(), low(lk), low(e)) if a and a == b)
            if score:
                best = max(best or (0,), (score, e[6], -e[7], e[0]))
        if best:
            want.append((lk[0], best[3], best[0]))
    assert sorted(map(tuple, got.collect())) == want and len(want) < len(lookups)


def test_names_by_their_only_ending(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("ab-_") for _ in range(rnd.randint(1, 6))) + rnd.choice([".png", ".jpg"]) for _ in range(60)] + ["é.png", "same.png", "same.png"]
    refs = [f"up/{rnd.choice(['', 'x1-'])}{rnd.choice(names)[rnd.randint(0, 4):]}" for _ in range(120)] + ["none", "", "up/", "same.png", "ame.png", "é.png", "x-.png"]
    got = R.resolve_names(spark.createDataFrame(list(enumerate(refs)), "ref_id long, ref string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(got) == len(refs)
    for r in got:
        base = r.ref.split("/")[-1]
        cut = base.split("-", 1)[1] if "-" in base else None
        ends = [n for n in names if (base if cut is None else cut) and n.endswith(base if cut is None else cut)]
        want = (base, "exact") if base in names else (cut, "after_dash") if cut in names else (ends[0], "suffix") if len(ends) == 1 else (None, None)
        assert (r.file, r.how) == want, r.ref
    assert {r.how for r in got} == {"exact", "after_dash", "suffix", None}


def test_endings_take_a_row_a_name(spark):
    names = spark.range(300).select(F.concat(F.lit("a" * 2000), F.col("id").cast("string"), F.lit(".png")).alias("name"))
    found = R.only_ending(spark.createDataFrame([("a7.png",), ("7.png",), (".png",), ("x",)], "_t string"), names).collect()
    assert [(r._t, r._u[-7:]) for r in found] == [("a7.png", "aa7.png")]


def test_connector_summary_counts_once_per_history(spark):
    """Owners of one id, of several ids that share pages, and of none; case and edge blanks do not matter."""
    own = spark.createDataFrame([(1, " H1"), (1, "h1 "), (2, "h1"), (2, "H2"), (3, "h3"), (4, " "), (5, None)], "owner_id long, history_id string")
    con = spark.createDataFrame([(10, "H1 ", "p", "a"), (11, "h1", "p", "b"), (12, "h2", "p", "a"), (13, "h2", None, "c"), (14, " ", "q", "d")],
                                "connector_id long, history_id string, page string, edge_id string")
    got = R.connector_summary(own, con)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1, 2), (2, 4, 1, 3)]


def test_best_scoring_counts_without_sorting(spark, monkeypatch):
    """Rows are counted by one whole number in hash tables; of equal dates the first entry wins, a null date is the oldest."""
    plans = []
    plain = R.stage
    monkeypatch.setattr(R, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    kind = "history string, kind string, source string, filename string, url string"
    entries = [(1, "a", "K", "s", None, None, None, 1), (2, "a", "k", None, None, None, 7, 3), (3, "a", "k", "", None, None, 7, 2), (4, "b", None, "s", None, None, None, 1)]
    lookups = [(1, "a", "k", None, None, None), (2, None, None, "s", None, None), (3, "b", "k", "s", None, None), (4, "z", None, None, None, None)]
    got = R.best_scoring(spark.createDataFrame(lookups, f"lookup_id long, {kind}"), spark.createDataFrame(entries, f"entry_id long, {kind}, updated_at long, ord long"))
    assert sorted(map(tuple, got.select("lookup_id", "entry_id", "score").collect())) == [(1, 3, 7), (2, 4, 2), (3, 4, 7)]
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)
