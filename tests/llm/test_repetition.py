import random
import re

import pytest

from tracewright.llm import repetition as R

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(t: bytes, rules=R.Rules()):
    w = WORD.findall(t)
    n, hit = len(w), set()
    k = rules.window
    seen = {}
    for i in range(n - k + 1):
        seen.setdefault(tuple(w[i : i + k]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            for i in v:
                hit.update(range(i, i + k))
    cover, longest = set(), 0
    for i in range(n):
        for j in range(n):
            if i != j:
                c = 0
                while max(i, j) + c < n and w[i + c] == w[j + c]:
                    c += 1
                if c >= rules.least_words:
                    longest = max(longest, c)
                    cover.update(range(i, i + c))
    lines = [x for x in t.split(b"\n") if WORD.search(x)]
    failed = n < rules.fewest_words or 100 * len(hit) > rules.most_repeat_percent * n
    share = sum(len(w[i]) for i in cover) / max(1, sum(map(len, w)))
    return {
        "n_words": n, "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(rb"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": failed, "covered": pytest.approx(share),
        "longest_repeat": longest, "kept": not failed and share <= rules.most_covered and longest <= rules.longest_repeat}


def texts(seed):
    rng = random.Random(seed)
    out = [b"", b"   \n", b"a", b"a " * 60, "é ü x \x1c y".encode()]
    for _ in range(60):
        w = [rng.choice(["a", "b", "the", "é#", "<x>", "zz"] if rng.random() < 0.5 else [f"w{i}" for i in range(60)]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6 and len(w) > 12:
            i = rng.randrange(len(w) - 11)
            w += w[i : i + rng.randint(5, 40)]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for x in w).encode())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_figures_equal_brute_force(seed):
    batch = texts(seed)
    got = R.measure(batch, R.Rules())
    for i, t in enumerate(batch):
        want = plain(t)
        assert {k: got[k][i] for k in want} == want, t
        assert sum(s["end"] - s["start"] for s in got["spans"][i]) <= got["n_words"][i]
    alone = [R.measure([t], R.Rules()) for t in batch]
    assert [list(got["spans"][i]) for i in range(len(batch))] == [list(a["spans"][0]) for a in alone]


@pytest.mark.parametrize("window,least", [(3, 2), (5, 7), (8, 16), (1, 1)])
def test_other_lengths(window, least):
    rules = R.Rules(window=window, least_words=least)
    batch = texts(9)[:40]
    got = R.measure(batch, rules)
    for i, t in enumerate(batch):
        want = plain(t, rules)
        assert {k: got[k][i] for k in want} == want, t


def test_rows(spark):
    good = " ".join(f"w{i}" for i in range(50))
    bad = "one two three four five six seven eight nine ten eleven " * 9
    rows = [(1, good, "x"), (1, good, "x"), (2, bad, "y"), (3, None, None), (None, good, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r.doc_id, r.kept) for r in R.quality_rules(docs).collect()}
    assert got == {(1, True), (2, False), (3, False), (None, True)}
    assert sorted(r.kept for r in R.keep_documents(docs).collect()) == ["x", "x", "z"]
    assert R.quality_rules(docs.limit(0)).count() == 0 == R.keep_documents(docs.limit(0)).count()
