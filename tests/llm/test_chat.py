import hashlib
import random

import pytest

from tracewright.llm import chat
from tracewright.llm import templates as T


def show(source, **values):
    return T.compile_template(source).render(values.pop("messages", []), **values)[0]


@pytest.mark.parametrize("source,want", [
    ("a{{ 1 + 2 }}b", "a3b"), ("{{ 'x' ~ 1 ~ none ~ true }}", "x1true"), ("{% if 1 > 2 %}n{% elif 'a' in 'cab' %}y{% else %}z{% endif %}", "y"),
    ("{{ u.a['b'] }}|{{ u.z }}|{{ u.a.b.c }}", "7||"), ("{{ x|trim|upper }}", "HI"), ("a {#- note -#} b", "ab"), ("{%- if not false -%}  q  {%- endif -%}", "q"),
    ("{% set y = x|length %}{{ y - 1 }}", "3"), ("{% for i in l %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
    ("{{ u|tojson }}", '{"a": {"b": 7}}'), ("{{ none|default('d') }}{{ 'aXb'|replace('X', '-') }}", "da-b"), ("{{ (1 == 1) and 'k' or 'm' }}", "k"),
    ("{{ \"q\\n\" }}{{ -3 }}", "q\n-3"), ("", ""), ("{{ l[0] }}{{ l[9] }}", "p"),
])
def test_language(source, want):
    assert show(source, u={"a": {"b": 7}}, x=" hi ", l=["p", "q"]) == want


@pytest.mark.parametrize("source", [
    "{{ x", "{% if a %}", "{% for a %}", "{% endif %}", "{{ x.__class__ }}", "{{ _x }}", "{{ x() }}", "{{ x|nofilter }}", "{% import os %}", "{{ 1 + 'a' }}", "{{ }}", "{% if a %}{% else %}{% else %}{% endif %}", "{% set a %}"])
def test_refused(source):
    with pytest.raises(T.TemplateError):
        T.compile_template(source)


def test_no_python_attributes():
    assert show("{{ x.upper }}{{ x['strip'] }}{{ l.append }}", x="a", l=[1]) == ""


def test_folding():
    assert T.compile_template("a{{ 'b' ~ 'c' }}{% if true %}d{% else %}{{ x }}{% endif %}e").tree == (T.Text("abcde"),)
    assert T.compile_template("{% if false %}a{% elif x %}b{% endif %}").tree == (T.If(((T.Name("x"), (T.Text("b"),)),), ()),)
    assert T.compile_template("{{ x or ('a' == 'b') }}").tree == (T.Show(T.Op("or", (T.Name("x"), T.Const(False)))),)
    assert T.compile_template(chat.TURNS).lazy and not T.compile_template("{{ messages|length }}{% for m in messages %}{% endfor %}").lazy
    assert not T.compile_template("{% for a in l %}{% for m in messages %}x{% endfor %}{% endfor %}").lazy


def test_spans():
    t = T.compile_template("<{% for m in messages %}{% generation %}{{ m.text }}{% if m.text %}!{% endif %}{% endgeneration %};{% endfor %}>")
    assert t.render(iter([{"text": "ab"}, {"text": ""}, {"text": "c"}])) == ("<ab!;;c!;>", [(1, 4), (6, 8)])


def test_guard_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        s = "".join(rng.choice(["<", "|", "\\", "\n", "n", "p", "im_end", ">", "a"]) for _ in range(rng.randint(0, 12)))
        assert T.unguard(T.guard(s)) == s and "<|" not in T.guard(s)
        line = T.guard_line(s)
        assert T.unguard_line(line) == s and "<|" not in line and "\n" not in line


def digests(turns):
    a, b = hashlib.sha256(), hashlib.sha256()
    for _, role, text in turns:
        a.update(f"{role or ''}\n{text or ''}\n".encode())
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    b.update(loss.encode())
    return len(turns), a.hexdigest(), len(loss), b.hexdigest()


def test_rows(spark, monkeypatch):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant", "\n", "ok", "<", "\\", "|", "é🙂", " "]
    rows = []
    for c in [None, -5, 1, 2, 3, 4]:
        for t in rng.sample(range(90), rng.randint(1, 30)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", None, "a\n<|im_end|>"]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))]), "x"))
    rows += [rows[-1]] * 2 + [(9, i, "assistant", "long " * 9000, "") for i in range(6)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    got = {r.conv_id: r for r in chat.read_turns(chat.format_conversations(conv)).collect()}
    low = lambda v: (v is not None, v or (0 if isinstance(v, int) or v is None else ""))
    text = lambda v: (v is not None, v or "")
    for c in {r[0] for r in rows}:
        own = sorted([r[1:4] for r in rows if r[0] == c], key=lambda r: (low(r[0]), text(r[1]), text(r[2])))
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(own)
    assert not got
    assert chat.read_turns(chat.format_conversations(conv.limit(0))).count() == 0
    parts = [r for r in chat.format_conversations(conv).collect() if r.conv_id == 9]
    whole, spans = T.compile_template(chat.TURNS).render([{"role": "assistant", "text": "long " * 9000}] * 6)
    assert "".join(p.text for p in parts) == whole and [(s.start, s.end) for p in parts for s in p.loss] == spans and len(parts) > 1


def test_reader_refuses_other_text():
    with pytest.raises(ValueError):
        chat.TurnReader().feed("hello<|im_end|>\n", [])
    r = chat.TurnReader()
    r.feed("<|im_start|>user\nhi", [])
    with pytest.raises(ValueError):
        r.close()
