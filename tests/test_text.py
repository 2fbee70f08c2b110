"""Clean-up, decoding and comment removal: goldens, quirks and long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossmill.functions.comments import strip_comments
from glossmill.functions.text import (
    JS_WS,
    decode_utf8,
    js_trim,
    leading_space,
    normalise_blank_lines,
    strip_code_fences,
    trailing_space,
    utf16_length,
)


def check(values, column, cases, schema="t string"):
    got = values([c[:-1] for c in cases], schema, column)
    assert got == [c[-1] for c in cases]


def test_white_space_is_the_25_characters():
    assert len(JS_WS) == len(set(JS_WS)) == 25


def test_trim(values):
    check(values, js_trim(F.col("t")), [(JS_WS + "a b" + JS_WS, "a b"), (JS_WS, ""), ("", ""), ("​a", "​a")])


def test_edges(values):
    cases = [(" \n a b\t\n", " \n ", "\t\n"), ("  ", "  ", ""), ("", "", ""), ("x", "", "")]
    texts = [(t,) for t, _, _ in cases]
    assert values(texts, "t string", leading_space(F.col("t"))) == [c[1] for c in cases]
    assert values(texts, "t string", trailing_space(F.col("t"))) == [c[2] for c in cases]


def test_blank_lines(values):
    cases = [
        ("a\n\n\n\nb  \n", "a\n\nb\n"),
        ("", "\n"),
        ("a\n \n \nb", "a\n \n \nb\n"),
        ("a\r\n\r\n\r\nb", "a\n\nb\n"),
        ("a\r\n\n\r\n\nb\r\n", "a\n\nb\n"),
        ("a\n\nb", "a\n\nb\n"),
        ("a\r\r\rb\r", "a\r\r\rb\n"),
        ("a ﻿", "a\n"),
    ]
    check(values, normalise_blank_lines(F.col("t")), cases)
    again = values([(out,) for _, out in cases], "t string", normalise_blank_lines(F.col("t")))
    assert again == [out for _, out in cases]


def test_fences(values):
    check(
        values,
        strip_code_fences(F.col("t")),
        [
            ("```js\nx\n```", "x"),
            ("```c++\nx\n```", "++\nx"),
            ("x\n```\n", "x\n```"),
            ("a\n```\nb\n```js\nc", "a\n```\nb\n```js\nc"),
            ("```", ""),
            ("``````", ""),
            (" ```js\nx\n```", "```js\nx"),
        ],
    )


def test_decode(values):
    check(
        values,
        decode_utf8(F.col("t")),
        [
            (bytearray(b"\xef\xbb\xbfa\xff"), "a�"),
            (bytearray(b"a\xef\xbb\xbfb"), "a﻿b"),
            (bytearray(b"\xe2\x82a"), "�a"),
            (bytearray(b"\xed\xa0\x80"), "���"),
            (bytearray("\U0001f600é".encode()), "\U0001f600é"),
            (bytearray(b""), ""),
        ],
        "t binary",
    )


def test_utf16_length(values):
    check(values, utf16_length(F.col("t")), [("a\U0001f600", 3), ("", 0), ("é　", 2)])


REGEX_CASES = [
    ("javascript", 'u = "http://h"; // c\n', 'u = "http:\n'),
    ("java", "a /* x\n y */ b // z\n", "a  b\n"),
    ("c", "a /* never closed // z", "a /* never closed\n"),
    ("cpp", "/*/ a */ b /* c */", " b\n"),
    ("c", "a / /* x */ / b\n", "a /  / b\n"),
    ("c", "a //* x */ b\n", "a / b\n"),
    ("c", "a /" + "/* x */" + "/ b\n", "a\n"),
    ("python", 's = "a#b"\n', 's = "a\n'),
    ("python", "x = 1  # c\ny = 2\n", "x = 1  \ny = 2\n"),
    ("python", "a\n'''d\n'''\nb \"\"\"c\"\"\" '''open", "a\n\nb  '''open\n"),
    ("scss", "a // b\n/* c */\n", "a // b\n"),
    ("html", "a<!-- x\n -->b<!-- c", "ab<!-- c\n"),
    ("htm", "<!--->-->x", "x\n"),
    ("markdown", "# a // b", "# a // b\n"),
]


def test_regex_mode(values):
    check(values, strip_comments(F.col("t"), F.col("l"), "regex"), REGEX_CASES, "l string, t string")


LEXICAL_CASES = [
    ("javascript", 'u = "http://h"; // c\nv\n', 'u = "http://h"; \nv\n'),
    ("javascript", "a\n  // alone\n  // too\n\tb /* c */ d\n", "a\n\tb  d\n"),
    ("javascript", "// first\n/* second\n */\na\n", "a\n"),
    ("javascript", "  // first\na // last", "a\n"),
    ("javascript", "a\r\n// x\r\nb\r\n", "a\r\nb\n"),
    ("javascript", "a // x\r\nb\r\n", "a \r\nb\n"),
    ("javascript", 'a = /[/*]"/g; // x\nb = c / d; // e\nf', 'a = /[/*]"/g; \nb = c / d; \nf\n'),
    ("javascript", "return /\\/\\*/.test(q) // d\n", "return /\\/\\*/.test(q)\n"),
    ("typescript", "a `x // y ${z}` // c\n'it\\'s // in' // out\n", "a `x // y ${z}` \n'it\\'s // in'\n"),
    ("java", 'String s = """\n // no \\""" \n"""; // yes\n', 'String s = """\n // no \\""" \n""";\n'),
    ("java", "char c = '\"'; // yes\n", "char c = '\"';\n"),
    ("cpp", "int x = 1'000; // a 'b\n", "int x = 1'000;\n"),
    ("cpp", 'auto s = R"x(// no )" )x"; // yes\n', 'auto s = R"x(// no )" )x";\n'),
    ("cpp", "u8'a' u8\"//\" 0x1'f /* y */ 'b'\n", "u8'a' u8\"//\" 0x1'f  'b'\n"),
    ("c", "a // one \\\n still one\nb\n", "a \nb\n"),
    ("c", "a /* open // b\n", "a /* open // b\n"),
    ("c", "a\n/* b */ int x; /* c */\ny\n", "a\n int x; \ny\n"),
    ("c", "/* b */ int x; /* c */\ny\n", " int x; \ny\n"),
    ("c", "a\n /***/ /** b **/\n/**/\nc /*/ d */ e\n", "a\n  \nc  e\n"),
    ("python", 's = "a#b" # c\n', 's = "a#b"\n'),
    ("python", "x = 1  # c\ny = 2\n", "x = 1  \ny = 2\n"),
    ("python", "t = '''a # b\n''' # c\n", "t = '''a # b\n'''\n"),
    ("python", 'a = """ never closed # kept', 'a = """ never closed # kept\n'),
    ("python", 'def f():\n    """doc # no"""\n    g()\n', 'def f():\n    """doc # no"""\n    g()\n'),
    ("css", "a { b: '/* no */' } /* yes */\n", "a { b: '/* no */' }\n"),
    ("scss", "a { b: url(http://x/y) } // c\n", "a { b: url(http://x/y) }\n"),
    ("html", "a<!-- b -->c", "ac\n"),
    ("typescript", "<p>See https://x.y/z</p>; // c\n", "<p>See https://x.y/z</p>;\n"),
    ("javascript", "t = `${b ? `http://x/${c}` : ''}`; // d\n", "t = `${b ? `http://x/${c}` : ''}`;\n"),
    ("javascript", "case /\\/\\//.test(b): d(); // e\n", "case /\\/\\//.test(b): d();\n"),
    ("javascript", "/\\/\\//.test(b); // e\n", "/\\/\\//.test(b);\n"),
    ("python", 'x = f"{d["#k"]}" # c\n', 'x = f"{d["#k"]}"\n'),
    ("c", "#include <a//b.h> // c\n", "#include <a//b.h>\n"),
    *(("javascript", "x =" + " " * n + "/https?:\\/\\//.test(u); // c\n", "x =" + " " * n + "/https?:\\/\\//.test(u);\n") for n in (1, 10, 100, 10_000)),
    *(("cpp", "x = 0x" + "a" * n + "'b + f('/*'); // it's\n", "x = 0x" + "a" * n + "'b + f('/*');\n") for n in (1, 10, 100, 10_000)),
]


def test_lexical_mode(values):
    check(values, strip_comments(F.col("t"), F.col("l")), LEXICAL_CASES, "l string, t string")


def test_docstrings(values):
    cases = [
        ('def f():\n    """doc\n    more"""\n    g()\n', "def f():\n    g()\n"),
        ("'''module''' # note\nx = '''kept'''\n", "x = '''kept'''\n"),
        ('g(  # why\n    """kept"""\n)\n', 'g(  \n    """kept"""\n)\n'),
        ('x = (\n  "a"  # b\n  """c"""\n)\n', 'x = (\n  "a"  \n  """c"""\n)\n'),
        ('x = [1,\n"""a""",\n"""b"""\n]\n', 'x = [1,\n"""a""",\n"""b"""\n]\n'),
        ('x = \\\n"""a"""\n"""gone"""\ny\n', 'x = \\\n"""a"""\ny\n'),
        ("def f(a='k:', b: int = 1) -> \"T\":\n    'one line'\n    g()\n", "def f(a='k:', b: int = 1) -> \"T\":\n    g()\n"),
        ("class A:\n\n    'one' r\"two\"\n    x = 'kept'\n", "class A:\n\n    x = 'kept'\n"),
        ("\n'module' \"too\"\nx\n", "\nx\n"),
        ('"""a""" "b"\ny\n', "y\n"),
        ("def f():\n    'kept' + x\n", "def f():\n    'kept' + x\n"),
        ("def f():\n    'kept' \\\n    'too'\n", "def f():\n    'kept' \\\n    'too'\n"),
        ("x = {1:\n'kept'\n}\n", "x = {1:\n'kept'\n}\n"),
        ("x = a or \\\n  'kept'\n", "x = a or \\\n  'kept'\n"),
        ("async def f(): return\n'gone'\n", "async def f(): return\n"),
        ('s = """\ndef f():\n  "kept"\n"""\n', 's = """\ndef f():\n  "kept"\n"""\n'),
    ]
    python = strip_comments(F.col("t"), F.lit("python"), docstrings=True)
    check(values, python, cases)
    other = strip_comments(F.col("t"), F.lit("java"), docstrings=True)
    assert values([('"""a"""\n',)], "t string", other) == ['"""a"""\n']


def test_literals_survive(values):
    """Random token soups: every literal put in comes out, every comment goes."""
    rng = random.Random(7)
    literals = {
        "javascript": ['"a // b"', "'it\\'s /* x */'", "`t\n// u`"],
        "python": ['"a # b"', "'# c'", '"""d\n# e"""'],
        "cpp": ['"a // b"', "'\"'", 'R"(/* q */)"', "1'000"],
    }
    comments = {
        "javascript": ["// COMMENT\n", "/* COMMENT \n */", "/* COMMENT */\n"],
        "python": ["# COMMENT 'x\n"],
        "cpp": ["// COMMENT\n", "/* COMMENT \" */", "// COMMENT \\\nCOMMENT\n"],
    }
    rows, expected = [], []
    for _ in range(300):
        language = rng.choice(sorted(literals))
        kept, text = [], ""
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.5:
                kept.append(rng.choice(literals[language]))
                text += " x = " + kept[-1] + rng.choice([" ", "\n"])
            else:
                text += " " + rng.choice(comments[language])
        rows.append((language, text))
        expected.append(kept)
    got = values(rows, "l string, t string", strip_comments(F.col("t"), F.col("l")))
    for (language, text), out, kept in zip(rows, got, expected):
        assert "COMMENT" not in out, (language, text, out)
        at = 0
        for literal in kept:
            at = out.index(literal, at) + len(literal)


LONG = [
    ("javascript", "/*" * 200_000),
    ("javascript", "/*" + "x" * 500_000 + "*/"),
    ("javascript", '"' + "\\n" * 200_000 + '"'),
    ("javascript", '"' + "a" * 400_000),
    ("javascript", "\n" * 300_000 + "x"),
    ("javascript", "x" + "\r\n" * 200_000 + "x"),
    ("javascript", "// c\n" * 100_000),
    ("javascript", "= /" + "[a]\\/" * 100_000 + "/ // c"),
    ("javascript", " " * 500_000 + "x"),
    ("javascript", "`" + "/" * 300_001),
    ("python", '"""' + '\\n"' * 100_000 + '"""'),
    ("python", "'''" * 100_001),
    ("python", "(" + " " * 300_000 + "x"),
    ("cpp", "1'000" * 100_000),
    ("cpp", "// a\\\n" * 100_000),
    ("cpp", 'R"(' * 50_000),
    ("c", "'" * 100_001),
    ("html", "<!--" * 100_000),
    ("scss", "url(" * 100_000),
]


@pytest.mark.parametrize("mode", ["regex", "lexical"])
def test_long_texts(spark, mode):
    """No stack overflow, and no time that grows with the square of the length."""
    df = spark.createDataFrame(LONG, "l string, t string").repartition(8)
    start = time.time()
    sizes = df.select(F.length(strip_comments(F.col("t"), F.col("l"), mode, docstrings=True))).collect()
    assert len(sizes) == len(LONG)
    assert time.time() - start < 60


def test_regex_mode_matches_plain_definition(values):
    """Against the definition with Python's regexes on random text."""
    rng = random.Random(3)
    pieces = ["/*", "*/", "//", "\n", "\r\n", "a", " ", "/", "*", "\n\n\n", '"""', "'''", "#", "<!--", "-->", "é"]
    ws = "[" + re.escape(JS_WS) + "]*\\Z"

    def plain(language, text):
        if language in ("javascript", "java"):
            text = re.sub(r"//[^\n]*", "", re.sub(r"/\*[\s\S]*?\*/", "", text))
        elif language == "python":
            for pattern in (r"#[^\n]*", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"):
                text = re.sub(pattern, "", text)
        elif language == "html":
            text = re.sub(r"<!--[\s\S]*?-->", "", text)
        elif language == "css":
            text = re.sub(r"/\*[\s\S]*?\*/", "", text)
        return re.sub(ws, "", re.sub(r"(\r?\n){3,}", "\n\n", text)) + "\n"

    rows = [
        (rng.choice(["javascript", "java", "python", "html", "css", "text"]), "".join(rng.choices(pieces, k=rng.randrange(40))))
        for _ in range(500)
    ]
    got = values(rows, "l string, t string", strip_comments(F.col("t"), F.col("l"), "regex"))
    assert got == [plain(*row) for row in rows]


def test_unknown_mode():
    with pytest.raises(ValueError):
        strip_comments(F.lit("a"), F.lit("c"), "ast")
