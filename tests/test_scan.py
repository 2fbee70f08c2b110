"""Scripts and python, where what is open decides: goldens, programs made with and without comments, long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glossmill.functions.comments import AMBIGUOUS, strip_comments
from glossmill.functions.scan import drop_string_statements, strip_script
from glossmill.functions.text import normalise_blank_lines

CASES = [
    ("javascript", r"if (ok) /\/\//.test(u); d();", "if (ok) /\\/\\//.test(u); d();\n"),
    ("typescript", "<p>a // b</p>;", "<p>a // b</p>;\n"),
    ("javascript", "<a href='http://x/y' b={c /* d */}>don't // e {f /* g */} <b/> // h</a>; // i\n", "<a href='http://x/y' b={c }>don't // e {f } <b/> // h</a>;\n"),
    ("javascript", "x = <>a // b</>; // c\n", "x = <>a // b</>;\n"),
    ("javascript", "x = a ? <b c // d\n/> : e // f\n", "x = a ? <b c \n/> : e\n"),
    ("javascript", "a = (b + c) / d; // e / f\n", "a = (b + c) / d;\n"),
    ("javascript", "`a ${b ? `c ${`d // e ${'}'}`}` : 1 /* f */} // g`; // h", "`a ${b ? `c ${`d // e ${'}'}`}` : 1 } // g`;\n"),
    ("javascript", "x = {a: 1} / 2 // b / c\n", "x = {a: 1} / 2\n"),
    ("javascript", "while (x) {} /a\\/\\/b/.test(y) // z\n", "while (x) {} /a\\/\\/b/.test(y)\n"),
    ("javascript", "i++ / 2 // a /\nb.return / 2 // c /\nd - /\\/\\//.e // f", "i++ / 2 \nb.return / 2 \nd - /\\/\\//.e\n"),
    ("javascript", "f(a) /* x */ / b // c/\n", "f(a)  / b\n"),
    ("javascript", "// a\n// b\n\n  // c\nd<br/> // e\n", "\nd<br/>\n"),
    ("javascript", "<br/>\n  /* a */  \r\n  // b\r\ny", "<br/>\r\ny\n"),
    ("typescript", "f = <T,>(x: T) => (x) / 1 // c\ny = <Foo>z / (a as Bar<C>) / 2; // w\n", "f = <T,>(x: T) => (x) / 1 \ny = <Foo>z / (a as Bar<C>) / 2;\n"),
    ("javascript", "(a) / b /* never closed // c", "(a) / b /* never closed // c\n"),
    ("javascript", "(a) / b; see://x // y\n", "(a) / b; see://x\n"),
    ("css", "a { b: url(data:image/svg+xml;/*x*/) } /* c */\n", "a { b: url(data:image/svg+xml;/*x*/) }\n"),
]


def test_what_context_tells(values):
    assert values([c[:2] for c in CASES], "l string, t string", strip_comments(F.col("t"), F.col("l"))) == [c[2] for c in CASES]


STATEMENTS = [
    ('x = {"a":\n """kept"""\n}\n', 'x = {"a":\n """kept"""\n}\n'),
    ('x = (a or\n"""kept"""\n)\n', 'x = (a or\n"""kept"""\n)\n'),
    ('x = (1 if b else\n"""kept""")\n', 'x = (1 if b else\n"""kept""")\n'),
    ('x = (a <\n"""kept""" )\n', 'x = (a <\n"""kept""" )\n'),
    ("def f(a,\n      b=(1,\n         2)):\n    'gone'\n    x\n", "def f(a,\n      b=(1,\n         2)):\n    x\n"),
    ('f"a {b["c"]} d"\n"""gone"""\n', 'f"a {b["c"]} d"\n'),
    ("f'''kept'''\n", "f'''kept'''\n"),
    ("'kept'; x\n", "'kept'; x\n"),
    ('"""never closed\n"a"\n', '"""never closed\n"a"\n'),
    (")\n'gone'\n(\n'kept'\n", ")\n(\n'kept'\n"),
    ("x = [  # (\n'kept'  # ]\n]\r\n'gone'\r\ny\r\n", "x = [  \n'kept'  \n]\r\ny\n"),
    ("if x:\n    'gone'\nelse: 'kept'\n", "if x:\nelse: 'kept'\n"),
    ("'gone'", "\n"),
    ("", "\n"),
]


def test_statements_that_are_strings(values):
    got = values([(t,) for t, _ in STATEMENTS], "t string", strip_comments(F.col("t"), F.lit("python"), docstrings=True))
    assert got == [bare for _, bare in STATEMENTS]


def test_nulls(values):
    rows = [(None, "javascript"), ("a / b // c", None), ("(a) / b // c", None), (None, None), (None, "python")]
    assert values(rows, "t string, l string", strip_comments(F.col("t"), F.col("l"), docstrings=True)) == [None, "a / b // c\n", "(a) / b // c\n", None, None]


def test_bodies_that_hold():
    cases = [
        ('def f():\n    """doc"""\n', "def f():\n    pass\n"),
        ('def f():\n    """doc"""\n    x\n', "def f():\n    x\n"),
        ('class A:\n  "d"\n\nx\n', "class A:\n\n  pass\nx\n"),
        ('def f():\n  "d"\n  "e"\ny\n', "def f():\n  pass\ny\n"),
        ('def f():\n  x\n  "e"\ny\n', "def f():\n  x\ny\n"),
        ('class A:\n  "d"\n  def f():\n    "e"\n', "class A:\n  def f():\n    pass\n"),
    ]
    for text, held in cases:
        assert drop_string_statements(text, hold=True) == held
        assert "pass" not in drop_string_statements(text)


class Program:
    """A random script, and the same without its comments. Comments stand after code, so each leaves its line's end."""

    def __init__(self, rng):
        self.rng, self.text, self.bare = rng, "", ""

    def put(self, part):
        self.text += part
        self.bare += part

    def remark(self):
        kind = self.rng.choice(["", "", " /* ' ` < { // */", " /*\n(*/", " // ` \" ' /* <a> {(\n"])
        self.text += kind
        self.bare += kind[:1] + ("\n" if kind.startswith(" //") else "")

    def operand(self, depth):
        rng = self.rng
        kind = rng.randrange(11) if depth else 0
        if kind < 3:
            self.put(rng.choice(["'a // b'", '"/* c \\" */"', "`d // e`", "x", "y.return", "12", "/[/*]'`/g", '/\\/\\/ "/', "z++"]))
        elif kind in (3, 4, 5):
            opened, closed = [("(", ")"), ("{k: ", "}"), ("[", "]")][kind - 3]
            self.put(opened)
            self.sum(depth - 1)
            self.put(closed)
        elif kind in (6, 7):
            self.put("`f // g ${")
            self.sum(depth - 1)
            self.put("} ' ${")
            self.sum(depth - 1)
            self.put("}`")
        elif kind == 8:
            self.put("<b c='//' d={")
            self.sum(depth - 1)
            self.put("} e/>")
        else:
            self.put('<p q="/*">it\'s // r {')
            self.sum(depth - 1)
            self.put("} /* s */ <i>// t</i> `</p>")

    def sum(self, depth):
        self.remark()
        self.operand(depth)
        for _ in range(self.rng.randrange(3)):
            self.remark()
            self.put(self.rng.choice([" / ", " + ", " && ", " < ", " > ", " ? 1 : ", " - ", ", "]))
            self.remark()
            self.operand(depth)
        self.remark()

    def statement(self):
        self.put("a = ")
        self.sum(3)
        last = self.rng.choice(["; ", ";\nif (b) /\\/\\//.test(", "; while ((c)) {} /[//]/.test("])
        self.put(last)
        if last.endswith("("):
            self.sum(2)
            self.put("); ")


def test_random_scripts():
    for n in range(1500):
        program = Program(random.Random(n))
        for _ in range(3):
            program.statement()
        assert strip_script(program.text) == program.bare, program.text


def test_both_ways_to_read_scripts_agree(values):
    """Where the pattern is trusted, the scanner finds the same."""
    rng = random.Random(3)
    soup = ["a", " ", "\n", " = ", "'b // c'", '"/*"', "`d`", "// e\n", "/* f */", ";", "= /[/]*/ ", "(", ")", "{", "}", "x / y", "\r\n", "http://g "]
    rows = [("".join(rng.choices(soup, k=rng.randrange(40))),) for _ in range(3000)]
    trusted = [r for r, doubt in zip(rows, values(rows, "t string", F.col("t").rlike(AMBIGUOUS))) if not doubt]
    got = values(trusted, "t string", strip_comments(F.col("t"), F.lit("javascript")))
    again = values([(strip_script(t),) for (t,) in trusted], "t string", normalise_blank_lines(F.col("t")))
    assert len(trusted) > 500 and [t for t, a, b in zip(trusted, got, again) if a != b] == []


SCRIPT_UNITS = ["(", "<", "`${", "/", "{", "<a ", "a/", "/*", "\n//a", " /**/", "<a>", 'a:"', "((a) /", "x ++ /", " " * 50 + "/", "</a>", "a" * 50 + "/", "a <b c "]


@pytest.mark.parametrize("unit", SCRIPT_UNITS)
def test_scripts_take_time_in_proportion(unit):
    start = time.perf_counter()
    strip_script(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("unit", ["(", '"""', "'", '"a"\n', "def f():\n 'a'\n", "\\\n", "f'{", "r", " ", "def f():\n \n"])
def test_statements_take_time_in_proportion(unit):
    start = time.perf_counter()
    drop_string_statements(unit * (1_000_000 // len(unit)), hold=True)
    assert time.perf_counter() - start < 20
