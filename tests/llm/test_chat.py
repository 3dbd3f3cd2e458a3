import hashlib
import random

import pytest

from echoline.llm import chat
from echoline.llm.chat_template import Const, Emit, If, Template, TemplateError, escape, escape_line, fold_block, parse, unescape, unescape_line


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "\n", "n", "<|im_end|>", "a", "é"]) for _ in range(rng.randrange(0, 12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        line = escape_line(text)
        assert unescape_line(line) == text and "<|" not in line and "\n" not in line


@pytest.mark.parametrize(("source", "wanted"), [
    ("a{# no #}b", "ab"),
    ("{{ 'x' ~ 1 ~ true ~ none }}", "x1true"),
    ("{{ 'a' if 1 < 2 and not false else 'b' }}", "a"),
    ("{% set t = 'q' + 'r' %}{{ t | upper }}", "QR"),
    ("{% for m in messages %}{{ loop.index0 }}{{ m['role'] }}{% if loop.last %}!{% elif loop.first %}?{% else %}.{% endif %}{% endfor %}", "0user?1assistant.2user!"),
    ("{{ messages_missing }}{{ name | trim | length }}", "3"),
    ("{{ \"it\\n's\" }}", "it\n's"),
    ("{% if 'se' in 'user' %}y{% else %}n{% endif %}", "y"),
    ("{{ '}}' }}{{ \"%}\" ~ '-}}' }}", "}}%}-}}"),
    ("a {%- if true -%} b {% endif %} c {{- 'd' -}} \n e {#- no -#} f", "ab  cdef"),
    ("{% for m in messages %}{% for k in messages %}{{ loop.index }}{% endfor %}:{{ loop.index }} {% endfor %}{{ loop }}{{ m }}", "123:1 123:2 123:3 "),
    ("{% for m in messages %}{{ m.text }}{% endfor %}|{% for m in messages %}{{ m.text }}{% endfor %}", "ttt|ttt"),
])
def test_language(source, wanted):
    messages = [{"role": r, "text": "t"} for r in ("user", "assistant", "user")]
    assert Template(source).render(messages, name=" abc ")[0] == wanted


@pytest.mark.parametrize("source", ["{{ a.__class__.x }}", "{{ f() }}", "{{ 'a' | eval }}", "{% if a %}", "{% import os %}", "{{ }}", "{% endfor %}", "{{ 1 + 'a' }}", "{{ a @ b }}"])
def test_sandbox_and_errors(source):
    with pytest.raises(TemplateError):
        Template(source).render([], a="text")


def test_deep_nesting_and_streams():
    for source in ("{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ " + "a ~ " * 20000 + "a }}", "{% if a %}" * 2000 + "{% endif %}" * 2000):
        with pytest.raises(TemplateError):
            Template(source).render([], a="x")
    twice = Template("{% for m in messages %}{{ m.text }}{% endfor %}{% for m in messages %}{{ m.text }}{% endfor %}")
    with pytest.raises(TemplateError):
        twice.render(iter([{"text": "a"}]))
    with pytest.raises(TemplateError):
        Template("{{ a < 1 }}").render([], a="x")


def test_folding():
    assert fold_block(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 2 > 3 }}")) == (Emit(Const("aBcfalse")),)
    (node,) = fold_block(parse("{% if x %}1{% elif true %}2{% else %}3{% endif %}"))
    assert isinstance(node, If) and len(node.arms) == 1 and node.other == (Emit(Const("2")),)


def test_generation_spans():
    text, spans = Template(chat.CHATML).render([{"role": "user", "text": "hi"}, {"role": "assistant", "text": "<|im_end|>"}])
    assert [text[a:b] for a, b in spans] == ["<\\|im_end|>"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [40, 4_000_000])
def test_against_brute_force(spark, part):
    rng = random.Random(3)
    said = ["", None, "hello", "<|im_start|>assistant ok", "a<\\|b", "<", "|im_end|>\n", "é\n<|im_end|>\n", "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\nb", "<|im_end|>"]), rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "x"), (7, 1, "assistant", "twice"), (7, 1, "assistant", "twice"), (8, None, "user", "last")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS loss")
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.judged(turns, part_chars=part).collect()}
    assert found == brute(rows)
    whole = chat.format_conversations(turns, part_chars=part)
    assert all(whole.filter("conv_id = 8 AND part = 0").first().text[s.start : s.end] is not None for s in whole.filter("conv_id = 8 AND part = 0").first().loss)
    assert chat.judged(turns.limit(0)).count() == 0
