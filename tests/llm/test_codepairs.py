import pytest

from lodestrand.llm import codepairs as P
from tests.conftest import rows

PY = '''"""Module."""
import os

@cached
def plain(a, b):
    """Says
    much more."""
    return a

def split(
    a: int = 3,  # note
    b=")",
):
    r\'\'\'Keeps odd rows.\'\'\'

    def inner():
        """Inner text here."""
        return 1
    return inner

# not a docstring
async def bare(x) -> list:
    s = """
def ghost():
    """
    return x

class Box:
    """A class."""
    def get(self):
        # comment
        """late"""
        return 1

    class Deep:
        def dig(self): return 1
'''
JS = """// header

/** Adds two numbers. */
export async function add(a, b) {
  return "}";
}

// Detached comment.

function lone() { return 1; }

/**
 * Multiplies.
 * @param a first
 */
const mul = (a, b) => {
  if (a) { return 0; }
}

class Shape {
  // Draws it on screen.
  @logged
  draw(x) {
    while (x) { x--; }
    return `}`;
  }
}
"""
JAVA = "public class A {\r\n  /** Finds the root. */\r\n  @Override\r\n  public int find(int x) {\r\n    return x;\r\n  }\r\n\r\n  private void none() {\r\n  }\r\n}\r\n"
GO = "package a\n\n// Open starts it.\nfunc Open(p string) error {\n\treturn nil\n}\n\nfunc (s *Srv) Close() error {\n\treturn nil\n}\n"
RB = "class Dog\n  # Makes a loud noise.\n  def bark\n    if x\n      1\n    end\n  end\nend\n"


def by_name(text, path):
    return {d["name"]: d for d in P.extract(text, path)}


def test_python():
    d = by_name(PY, "a.py")
    assert set(d) == {"plain", "split", "inner", "bare", "Box", "Box.get", "Box.Deep", "Box.Deep.dig"} or set(d) >= {"plain", "split", "bare", "Box", "Box.get"}
    assert d["plain"]["doc"] == "Says\n    much more." and d["plain"]["line_start"] == 5 and d["plain"]["line_end"] == 8
    assert d["split"]["doc"] == "Keeps odd rows." and d["split"]["signature"].startswith("def split(a: int = 3")
    assert d["bare"]["doc"] == "# not a docstring" and d["bare"]["kind"] == "function" and "ghost" not in d
    assert d["Box.get"]["kind"] == "method"
    assert d["Box"]["kind"] == "class" and d["Box"]["doc"] == "A class."


def test_braces():
    d = by_name(JS, "a.js")
    assert {"add", "lone", "mul", "Shape", "Shape.draw"} == set(d)
    assert P.prose_of(d["add"]["doc"]) == "Adds two numbers." and d["add"]["line_end"] == 6
    assert d["lone"]["doc"] is None
    assert P.prose_of(d["mul"]["doc"]) == "Multiplies."
    assert P.prose_of(d["Shape.draw"]["doc"]) == "Draws it on screen."
    j = by_name(JAVA, "A.java")
    assert j["A.find"]["kind"] == "method" and P.prose_of(j["A.find"]["doc"]) == "Finds the root." and j["A.none"]["doc"] is None
    g = by_name(GO, "a.go")
    assert P.prose_of(g["Open"]["doc"]) == "Open starts it." and g["Srv.Close"]["kind"] == "method"
    r = by_name(RB, "a.rb")
    assert r["Dog.bark"]["line_end"] == 7 and P.prose_of(r["Dog.bark"]["doc"]) == "Makes a loud noise."


@pytest.mark.parametrize("text", [None, "", "\n\n", "{" * 50, '"""', "def f(", "class", "/* open", "def f():\n", "\x00" * 20, "function f() {" * 30])
def test_odd_texts(text):
    for path in ("a.py", "a.js", "a.rb", None, "noext"):
        P.extract(text, path)


@pytest.mark.parametrize(
    ("doc", "name", "real"),
    [
        (None, "f", False), ("", "f", False), ("TODO", "f", False), ("// ...", "f", False), ("/** @inheritDoc */", "f", False),
        ("See above.", "f", False), ("The run job function.", "runJob", False), ("Does run job.", "run_job", False), ("run_job", "run_job", False),
        ("Run job.", "A.run_job", False), ("FIXME\n\nArgs:\n    a: a", "f", False), ("/**\n * @param a the a\n */", "f", False),
        ("Parameters: a, b", "f", False), ("待补充", "f", False), ("n/a", "f", False), ("--------", "f", False),
        ("Placeholder text for now.", "f", False), ("Does stuff.", "f", False), ("Misc things", "f", False), ("Not done", "f", False), ("To be implemented later.", "load", False),
        ("缓存合并了旧的记录。", "f", True), ("Run job; raises KeyError when it is late.", "run_job", True), ("runJob rejects old rows.", "runJob", True),
        ("Returns pending rows older than the mark.\n@param a b", "f", True), ("TODO\nKeeps the oldest row.", "f", True),
    ],
)
def test_is_real(doc, name, real):
    assert P.is_real(doc, name) is real


def test_comment_above_python():
    text = "# Keeps the oldest row.\n@cached\n@other(1)\ndef f(a):\n    return a\n\n# Far away.\n\ndef g(a):\n    return a\n\n# Above.\ndef h(a):\n    \"\"\"Inside.\"\"\"\n"
    d = by_name(text, "a.py")
    assert P.prose_of(d["f"]["doc"]) == "Keeps the oldest row." and d["g"]["doc"] is None and d["h"]["doc"] == "Inside."
    assert {x["name"]: x["doc"] for x in P.extract(text, "a.py", distance=2)}["g"] == "# Far away."


@pytest.mark.parametrize(("path", "head", "tail"), [("a.py", "def f(\n", "):\n    \"\"\"Keeps rows.\"\"\"\n"), ("a.js", "// Keeps rows.\nfunction f(\n", ") {\n}\n")])
def test_signatures_of_any_length(path, head, tail):
    args = "".join(f"    arg_{i},\n" for i in range(1500))
    d = by_name(head + args + tail, path)["f"]
    assert d["signature"].count("arg_") == 1500 and P.prose_of(d["doc"]) == "Keeps rows."


@pytest.mark.parametrize(("path", "line"), [("a.py", "def f(a,\n"), ("a.js", "function f(a,\n"), ("a.java", "  public int f(int a,\n"), ("a.c", "int f(int a,\n")])
def test_unclosed_signatures_do_not_stall(path, line):
    import time

    at = time.process_time()
    P.extract(line * 5_000, path)
    assert time.process_time() - at < 20


def test_pairs(spark):
    raw = spark.createDataFrame(
        [
            ("1", "file", PY, ["a.py"], "x"), ("1", "file", PY, ["a.py"], "x"), ("2", "file", JS, ["b.js"], None),
            ("3", "claude_code", "def plain(): pass", ["a.py"], None), ("4", "file", None, ["c.py"], None), ("5", "file", "", None, None), ("6", "file", PY, None, None),
        ],
        "id string, source string, content string, files_mentioned array<string>, name string",
    )
    ent = spark.createDataFrame(
        [
            ("a.py:plain", "plain", "function", "def plain(a, b)", None), ("a.py:plain", "plain", "function", None, None),
            ("a.py:bare", "bare", "function", None, None), ("b.js:add", "add", "function", None, "TODO"), ("b.js:mul", "mul", "function", None, " "),
            ("b.js:Shape", "Shape", "class", None, "Great shapes."), ("gone.py:f", "f", "function", None, "Keeps old rows."), (None, "x", "function", None, "Keeps."),
        ],
        "id string, name string, type string, signature string, docstring string",
    )
    assert rows(P.pairs_found(raw, ent)) == [("a.py:plain",), ("b.js:mul",), ("gone.py:f",)]
    assert {r.entity_id: r.origin for r in P.documented_pairs(raw, ent).collect()} == {"a.py:plain": "file", "b.js:mul": "file", "gone.py:f": "listed"}
    one = {r.entity_id: r for r in P.documented_pairs(raw, ent).collect()}["a.py:plain"]
    assert one.signature == "def plain(a, b)" and one.line_start == 5
    assert rows(P.pairs_found(raw.limit(0), ent.limit(0))) == []
