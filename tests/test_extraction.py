"""The lexer on odd and broken source texts."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import extract
from corpusloom.operators.lexer import Tokens, facts_of
from corpusloom.plans.extraction import _SHAPES

PIECES = ["{", "}", "(", ")", "[", "]", "<", ">", "`", "${", "'", '"', "/", "/*", "*/", "//", "\n", " ", ";", ",", "=>", "=", ":", "@", "class", "function", "type", "func", "import", "from", "export", "default", "const", "interface", "record", "enum", "def", "x", "1", "\\", "#", "日本"]


@pytest.mark.parametrize("language", ["typescript", "java", "go", "python"])
def test_any_text_gives_facts(language):
    draw = random.Random(language)
    shapes = [text for kind, text, _ in _SHAPES if kind[:2] == language[:2] or language == "typescript"]
    for _ in range(400):
        text = "".join(draw.choice(PIECES) + draw.choice(["", " "]) for _ in range(draw.randint(0, 60)))
        whole = draw.choice(shapes)
        cut = draw.randrange(len(whole))
        for source in (text, whole[:cut], whole[cut:], whole[:cut] + text + whole[cut:]):
            facts = facts_of(language, source)
            lines = source.count("\n") + source.count("\r") + 1
            assert all(1 <= s[2] <= s[3] <= lines for s in facts.symbols)


def test_brackets_in_literals_are_no_brackets():
    t = Tokens("a = /[/)]{2}/ + `x${ {b: `(${1}`} }y` + \"}\" // }\n f(1 / 2 / 3)", "js")
    assert t.balanced and [t.text[i] for i in sorted(t.pair)] == ["${", "{", "${", "("]
    assert not Tokens("f(]", "js").balanced and not Tokens("{", "go").balanced


def test_long_text_takes_one_pass():
    text = "export class A {\n" + "  m() { return `${a < b}` }\n" * 20_000 + "}\n"
    assert len(facts_of("typescript", text).symbols) == 20_001


def test_rows_of_files(spark):
    rows = [("r", "a.py", "python", "import os\n"), ("r", "b.go", "go", None), ("r", "c.txt", "text", "x"), (None, "d.ts", "typescript", "}"), ("r", "e.rb", "ruby", "def x")]
    files = spark.createDataFrame(rows, "repo_id string, path string, language string, text string")
    got = {r.path: r for r in extract.parsed(files).collect()}
    assert sorted(got) == ["a.py", "b.go", "d.ts"]
    assert [tuple(i) for i in got["a.py"].imports] == [("os", 1, 0, [])] and got["d.ts"].parse_errors and not got["b.go"].parse_errors
    more = {"ruby": lambda language, text: extract.Facts(symbols=[(text.split()[1], "function", 1, 1, None)])}
    assert [r.name for r in extract.symbols_of(extract.parsed(files, more)).collect()] == ["x"]
    assert extract.file_facts(files.limit(0)).count() == 0
    assert "Exchange" not in extract.parsed(files)._jdf.queryExecution().executedPlan().toString()


def test_json_objects_at_any_depth():
    from corpusloom.operators.tools import objects_in

    deep = '{"a":' * 60 + "1" + "}" * 60
    assert objects_in(f'x {{ {deep} {{"b": "}}{{"}} {{"c": [{{"d": 1}}]}} {{"e"') == [deep, '{"b": "}{"}', '{"c": [{"d": 1}]}']
    assert objects_in("{" * 5000) == [] and objects_in("") == []
