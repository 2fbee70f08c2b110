r"""Comment removal as column expressions.

``regex`` mode deletes whatever looks like a comment. ``lexical`` mode reads the
text token by token: one alternation in which literals come first and are kept,
so a comment opener inside a string stays. Scripts in which that depends on what
is open around it, and python's docstrings, are scanned instead (``functions.scan``).
Both modes end in the blank-line clean-up.

Every pattern reads the text a bounded number of times. Two things would break
that: an opener without a closer, met again and again (each would scan to the end
of the text), and group loops that recurse (see ``functions.text``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.scan import python_without_docstrings, scripts_without_comments
from glossmill.functions.text import normalise_blank_lines

C_LIKE = ("javascript", "typescript", "java", "cpp", "c")
SCRIPTS = ("javascript", "typescript")
STYLESHEETS = ("css", "scss")
MARKUP = ("html", "htm")

# String literals. TRIPLE_* know escapes; *_OPEN is a literal that never closes.
DOUBLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
BACKTICK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
TRIPLE_DOUBLE = r'"""[^"\\]*+(?:(?:\\(?s:.)|"(?!""))[^"\\]*+)*+"""'
TRIPLE_SINGLE = r"'''[^'\\]*+(?:(?:\\(?s:.)|'(?!''))[^'\\]*+)*+'''"
TRIPLE_DOUBLE_OPEN = r'"""(?s:.)*+'
TRIPLE_SINGLE_OPEN = r"'''(?s:.)*+"
# Templates, with templates inside their holes and holes inside those.
_PLAIN = r"`[^`\\$]*+(?:(?:\\(?s:.)|\$(?!\{))[^`\\$]*+)*+`"


def _hole(inner: str) -> str:
    return rf"\$\{{(?:[^{{}}`\"']++|{DOUBLE}|{SINGLE}|{inner}|\{{[^{{}}]*+\}})*+\}}"


def _template(inner: str) -> str:
    return rf"`(?:[^`\\$]++|\\(?s:.)|{_hole(inner)}|\$)*+`"


TEMPLATE = _template(_template(_PLAIN))
# Python f-strings, whose holes may hold the quote that they stand in.
_FIELD = rf"\{{(?:[^{{}}\"'\n\\]++|{DOUBLE}|{SINGLE}|\{{[^{{}}\n]*+\}})*+\}}"
F_MARK = r"(?<=(?<!\w)(?:[fF]|[rR][fF]|[fF][rR]))"
F_DOUBLE = rf'{F_MARK}"(?:[^"\\{{\n]++|\\(?s:.)|\{{\{{|{_FIELD})*+"'
F_SINGLE = rf"{F_MARK}'(?:[^'\\{{\n]++|\\(?s:.)|\{{\{{|{_FIELD})*+'"
# C++ raw strings, closed and not; numbers, which may hold quotes; names of headers.
RAW_STRING = r'"(?<=(?<!\w)(?:u8|[uUL])?R")(?<mark>[^()\\\s"]{0,16})\((?s:.)*?\)\k<mark>"'
RAW_STRING_OPEN = r'"(?<=(?<!\w)(?:u8|[uUL])?R")[^()\\\s"]{0,16}\((?s:.)*+'
NUMBER = r"(?<!\w)[0-9][\w.]*+(?:'[\w.]++)*+"
INCLUDE = r"#[ \t]*+include[ \t]*+<[^>\n]*+>"
# A slash after an opening or joining sign, or a word that an operand follows, starts
# a regex literal, not a division; after a closing brace it may be either, and is kept.
_REGEX = (
    r"/(?![*/])[^/\\\[\n]*+"
    r"(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/"
)
REGEX = rf"(?:[>(,=:\[!&|?;{{}}]|(?<!\w)(?:return|case|typeof|throw|await|yield)|\A)\s*+{_REGEX}"
# An address in the text between tags.
ADDRESS = r"(?<=\w)://[^\s<>\"'`]*+"
# An unquoted address holds slashes that open no comment.
URL = r"(?<=[uU][rR][lL])\([^()\"'\n]*+\)"

# Ends at the first closer whatever follows it: a shortest match would reach on,
# over code, to a closer at the end of a line.
BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
LINE = r"//[^\r\n]*+"
# A backslash at the end of a line carries a C line comment over to the next.
SPLICED_LINE = r"//[^\\\r\n]*+(?:\\(?:\r\n|(?s:.))?[^\\\r\n]*+)*+"
HASH = r"#[^\r\n]*+"

# Per language: what a token of interest starts with, the literals, the comments.
LEXICONS = {
    "javascript": (r"\"'`/>(,=:\[!\&|?;{}rctay", (ADDRESS, REGEX, DOUBLE, SINGLE, TEMPLATE, BACKTICK), (BLOCK, LINE)),
    "typescript": (r"\"'`/>(,=:\[!\&|?;{}rctay", (ADDRESS, REGEX, DOUBLE, SINGLE, TEMPLATE, BACKTICK), (BLOCK, LINE)),
    "java": ("\"'/", (TRIPLE_DOUBLE, TRIPLE_DOUBLE_OPEN, DOUBLE, SINGLE), (BLOCK, LINE)),
    "cpp": ("\"'/#0-9", (RAW_STRING, RAW_STRING_OPEN, DOUBLE, NUMBER, SINGLE, INCLUDE), (BLOCK, SPLICED_LINE)),
    "c": ("\"'/#0-9", (DOUBLE, NUMBER, SINGLE, INCLUDE), (BLOCK, SPLICED_LINE)),
    "python": (
        "\"'#",
        (TRIPLE_DOUBLE, TRIPLE_SINGLE, TRIPLE_DOUBLE_OPEN, TRIPLE_SINGLE_OPEN, F_DOUBLE, F_SINGLE, DOUBLE, SINGLE),
        (HASH,),
    ),
    "css": ("\"'/(", (URL, DOUBLE, SINGLE), (BLOCK,)),
    "scss": ("\"'/(", (URL, DOUBLE, SINGLE), (BLOCK, LINE)),
}

# Texts of scripts in which a slash, a quote or a brace may mean one thing or another by what is open around it:
# slashes after a bracket, a sign or a word that this lexicon does not know, tags, and holes in templates.
AMBIGUOUS = (
    r"[)}+\-%^~<]\s*+/(?![*/])|\*\s++/(?![*/])|/>|\$\{"
    r"|(?<!\w)(?:in|of|instanceof|new|delete|void|else|do|default|extends)\s*+/(?![*/])"
)
# What a statement that is a string begins with.
STRING_LINE = r"(?:\A|\n)[ \t\f]*+[rRbBuU]{0,2}[\"']"


def _pattern(language: str) -> str:
    """Literals are kept; a comment alone on its line goes with that line.

    One look at a character decides whether a token may start there: the first
    file line apart, that is a quote, a comment sign or the end of a line. A
    comment alone is taken with the line end before it, not its own indent, as
    spaces would be tried at every word.
    """
    starts, literals, comments = LEXICONS[language]
    comment = "|".join(comments)
    tokens = [
        f"(?<kept>{'|'.join(literals)})",
        rf"\r?\n[ \t]*+(?:{comment})[ \t]*+(?=\r?\n)",
        comment,
    ]
    if BLOCK in comments:
        tokens.append(r"(?<rest>/\*(?s:.)*+)")
    return rf"\A(?:[ \t]*+(?:{comment})[ \t]*+\r?\n)++|(?=[{starts}\r\n])(?:{'|'.join(tokens)})"


def _strip_lexical(text: Column, language: str) -> Column:
    _, _, comments = LEXICONS[language]
    return F.regexp_replace(text, _pattern(language), "${kept}" + ("${rest}" if BLOCK in comments else ""))


def _strip_script(text: Column, language: Column) -> Column:
    """Scripts: by the pattern where it can tell, else by the scanner, which gets nulls for all other texts."""
    scanned = scripts_without_comments(F.when(language.isin(*SCRIPTS) & text.rlike(AMBIGUOUS), text))
    return F.coalesce(scanned, _strip_lexical(text, SCRIPTS[0]))


def without_docstrings(text: Column, language: Column, hold: bool = False) -> Column:
    """Python without statements that are strings only, other texts as they are; comments must be gone already.

    ``hold``: ``pass`` stands for those that were all of a body.
    """
    asked = (language == "python") & text.rlike(STRING_LINE)
    return F.coalesce(python_without_docstrings(F.when(asked, text), hold), text)


def _delete(text: Column, opener: str, closer: str) -> Column:
    """Delete every ``opener ... closer``, shortest first.

    Where an opener follows the last closer, the text from there on is matched
    once and put back, instead of being searched anew from every such opener.
    """
    quoted = rf"\Q{opener}\E(?s:.)*?\Q{closer}\E"
    dangling = F.contains(F.substring_index(text, closer, -1), F.lit(opener))
    return F.when(
        dangling, F.regexp_replace(text, rf"{quoted}|(\Q{opener}\E(?s:.)*+)", "$1")
    ).otherwise(F.regexp_replace(text, quoted, ""))


def _strip_markup(text: Column) -> Column:
    return _delete(text, "<!--", "-->")


def _strip_regex(text: Column, language: Column) -> Column:
    blocks = _delete(text, "/*", "*/")
    # A closer that equals its opener leaves one dangling opener at most, so the
    # triple quotes need no guard.
    hashes = F.regexp_replace(text, r"#[^\n]*+", "")
    doubles = F.regexp_replace(hashes, r'"""(?s:.)*?"""', "")
    return (
        F.when(language.isin(*C_LIKE), F.regexp_replace(blocks, r"//[^\n]*+", ""))
        .when(language == "python", F.regexp_replace(doubles, r"'''(?s:.)*?'''", ""))
        .when(language.isin(*MARKUP), _strip_markup(text))
        .when(language.isin(*STYLESHEETS), blocks)
        .otherwise(text)
    )


def strip_comments(text: Column, language: Column, mode: str = "lexical", docstrings: bool = False) -> Column:
    """Text without comments; other languages only get the blank-line clean-up.

    ``docstrings`` (lexical mode) also removes python's statements that are strings only.
    That may empty a body, so it is off by default.
    """
    if mode == "regex":
        return normalise_blank_lines(_strip_regex(text, language), text)
    if mode != "lexical":
        raise ValueError(f"mode must be 'lexical' or 'regex', not {mode!r}")
    stripped = F.when(language.isin(*MARKUP), _strip_markup(text)).when(language.isin(*SCRIPTS), _strip_script(text, language))
    for name in LEXICONS:
        if name not in SCRIPTS:
            stripped = stripped.when(language == name, _strip_lexical(text, name))
    bare = stripped.otherwise(text)
    return normalise_blank_lines(without_docstrings(bare, language) if docstrings else bare, text)
