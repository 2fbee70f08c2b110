r"""Scanning with memory, for what no regular expression can tell.

Whether a slash in a script starts a regex literal depends on what the bracket before
it was opened for, whether a quote starts a string on being in code or in the text
between two tags, and whether a line of python is a statement of its own on the
brackets that are still open. Both scanners here go over a text once, from one sign
that matters to the next, with a stack of what is open. They run as Arrow batches, and
only over texts that need them: a null goes in and out for all others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an operand follows, and words whose parenthesis a statement follows.
_BEFORE_OPERAND = frozenset(
    "return case typeof throw await yield in of instanceof new delete void else do default extends".split()
)
_BEFORE_STATEMENT = frozenset("if while for with".split())

_NEXT = re.compile(r"[^\"'`/<>(){}\[\]]++")
_BLOCK = re.compile(r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/")
_LINE = re.compile(r"//[^\r\n]*+")
_ADDRESS = re.compile(r"//[^\s<>\"'`]*+")
_QUOTED = {
    '"': re.compile(r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'),
    "'": re.compile(r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"),
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*+")
_TEMPLATE = re.compile(r"[^`\\$]++|\\(?s:.)|\$(?!\{)")
_WORD = re.compile(r"[\w$]")
_TAG = re.compile(r"<(?:([A-Za-z_$][\w$.:-]*+)|(?=>))")
_CLOSER = re.compile(r"</\s*+([\w$.:-]*+)\s*+>")
# What only a tag goes on with, if nothing closes it by name.
_ATTRIBUTES = re.compile(r"\s*+/>|\s++\{\s*+\.\.\.|\s++[\w:-]++\s*+=\s*+[\"'{]|(?:\s++[\w:-]++)++\s*+/>")
_IN_TAG = re.compile(r"[^\"'{/>]++")
_IN_TEXT = re.compile(r"[^<{]++")
_TAG_STRING = {'"': re.compile(r'"[^"]*+"'), "'": re.compile(r"'[^']*+'")}

# What is open, by its opener. ``${`` is a hole in a template, ``<{`` one between or within tags.
_CLOSES = {")": ("(", "if("), "]": ("[",), "}": ("{", "={", "${", "<{")}


class _Script:
    """One pass over javascript or typescript; ``comments`` are the places of what may be deleted."""

    def __init__(self, text: str):
        self.text, self.at, self.stack = text, 0, []
        self.comments: list[tuple[int, int]] = []
        # The last literal's or bracket's end, and whether an operand may follow it.
        self.ended, self.then_operand = 0, True
        self.closers: dict[str, int] | None = None
        # Where the last hole in a template, a tag or the text between tags begins.
        self.hole = -1

    def before(self, at: int) -> int:
        """The place after the last sign before ``at`` that is neither space nor comment."""
        text, n = self.text, len(self.comments) - 1
        while at > 0:
            if n >= 0 and self.comments[n][1] == at:
                at, n = self.comments[n][0], n - 1
            elif text[at - 1].isspace():
                at -= 1
            else:
                break
        return at

    def word_before(self, end: int) -> str:
        """The word that ends at ``end``; none if it names a property."""
        start = end
        while start > 0 and end - start < 12 and _WORD.match(self.text[start - 1]):
            start -= 1
        return "" if start and (self.text[start - 1] == "." or _WORD.match(self.text[start - 1])) else self.text[start:end]

    def wants_operand(self, at: int) -> bool:
        end = self.before(at)
        if end <= 0:
            return True
        if end == self.ended:
            return self.then_operand
        sign = self.text[end - 1]
        if _WORD.match(sign):
            return self.word_before(end) in _BEFORE_OPERAND
        return sign not in "\"'`])." and self.text[max(0, end - 2) : end] not in ("++", "--")

    def literal(self, end: int) -> None:
        self.at, self.ended, self.then_operand = end, end, False

    def opens_object(self, at: int) -> bool:
        """Whether a brace stands where a value is wanted, not a statement or a body."""
        end = self.before(at)
        if end <= 0 or end == self.hole:
            return end > 0
        if _WORD.match(self.text[end - 1]):
            return self.word_before(end) in _BEFORE_OPERAND - {"else", "do"}
        if end == self.ended or self.text[max(0, end - 2) : end] == "=>":
            return False
        return self.text[end - 1] in "=([,?:&|+-*/%<>~!^"

    def is_tag(self, at: int) -> re.Match | None:
        found = _TAG.match(self.text, at)
        if not found or not self.wants_operand(at):
            return None
        if self.closers is None:
            self.closers = {m[1]: m.start() for m in _CLOSER.finditer(self.text)}
        if self.closers.get(found[1] or "", -1) > at or _ATTRIBUTES.match(self.text, found.end()):
            return found
        return None

    def comment(self, slash: int) -> bool:
        """Take a comment that starts here; one that never closes takes the rest, and stays."""
        text = self.text
        if text.startswith("/*", slash):
            found = _BLOCK.match(text, slash)
            if found is None:
                self.at = len(text)
                return True
        elif text.startswith("//", slash):
            if slash > 1 and text[slash - 1] == ":" and _WORD.match(text[slash - 2]):
                self.at = _ADDRESS.match(text, slash).end()
                return True
            found = _LINE.match(text, slash)
        else:
            return False
        self.comments.append(found.span())
        self.at = found.end()
        return True

    def code(self) -> None:
        text, at = self.text, self.at
        sign = text[at]
        if sign in "\"'":
            found = _QUOTED[sign].match(text, at)
            self.literal(found.end()) if found else self.step()
        elif sign == "`":
            self.at += 1
            self.stack.append("`")
        elif sign == "/":
            if not self.comment(at):
                found = _REGEX.match(text, at) if self.wants_operand(at) else None
                self.literal(found.end()) if found else self.step()
        elif sign == "<":
            found = self.is_tag(at)
            if found:
                self.at = found.end()
                self.stack.append("<")
            else:
                self.step()
        elif sign == "(":
            self.stack.append("if(" if self.word_before(self.before(at)) in _BEFORE_STATEMENT else "(")
            self.step()
        elif sign == "[":
            self.stack.append("[")
            self.step()
        elif sign == "{":
            self.stack.append("={" if self.opens_object(at) else "{")
            self.step()
        elif sign in _CLOSES:
            self.at += 1
            if self.stack and self.stack[-1] in _CLOSES[sign]:
                self.ended, self.then_operand = self.at, self.stack.pop() in ("if(", "{")
            else:
                self.ended, self.then_operand = self.at, sign == "}"
        else:
            self.step()

    def step(self) -> None:
        self.at += 1

    def template(self) -> None:
        text, at = self.text, self.at
        if text[at] == "`":
            self.stack.pop()
            self.literal(at + 1)
        elif text.startswith("${", at):
            self.stack.append("${")
            self.at = self.hole = at + 2
        else:
            found = _TEMPLATE.match(text, at)
            self.at = found.end() if found else at + 1

    def tag(self) -> None:
        """Between a tag's name and its end."""
        text, at = self.text, self.at
        sign = text[at]
        if sign == ">":
            self.at += 1
            self.stack[-1] = ">"
        elif text.startswith("/>", at):
            self.stack.pop()
            self.literal(at + 2)
        elif sign == "{":
            self.stack.append("<{")
            self.at = self.hole = at + 1
        elif sign in "\"'":
            found = _TAG_STRING[sign].match(text, at)
            self.at = found.end() if found else at + 1
        elif sign != "/":
            self.at = _IN_TAG.match(text, at).end()
        elif not self.comment(at):
            self.step()

    def between_tags(self) -> None:
        text, at = self.text, self.at
        sign = text[at]
        if sign == "{":
            self.stack.append("<{")
            self.at = self.hole = at + 1
        elif sign != "<":
            self.at = _IN_TEXT.match(text, at).end()
        elif found := _CLOSER.match(text, at):
            self.stack.pop()
            self.literal(found.end())
        elif found := _TAG.match(text, at):
            self.stack.append("<")
            self.at = found.end()
        else:
            self.step()

    def run(self) -> list[tuple[int, int]]:
        text, stack = self.text, self.stack
        modes = {"`": self.template, "<": self.tag, ">": self.between_tags}
        while self.at < len(text):
            mode = modes.get(stack[-1]) if stack else None
            if mode:
                mode()
            elif found := _NEXT.match(text, self.at):
                self.at = found.end()
            else:
                self.code()
        return self.comments


_SPACES = re.compile(r"[ \t]*+")
_LINE_END = re.compile(r"\r?\n")


def without(text: str, comments: list[tuple[int, int]]) -> str:
    """The text without its comments; one alone on its line or lines goes with the line."""
    out, done, in_head = [], 0, True
    for start, end in comments:
        if start < done:
            continue
        line = start
        while line > done and text[line - 1] in " \t":
            line -= 1
        after = _SPACES.match(text, end).end()
        closes = _LINE_END.match(text, after)
        if in_head and line == done and closes:
            # The first lines of a text have no line end before them; theirs goes with them.
            done = closes.end()
            continue
        in_head = False
        if line > done and text[line - 1] == "\n" and closes:
            line -= 2 if line - 2 >= done and text[line - 2] == "\r" else 1
            out.append(text[done:line])
            done = after
        else:
            out.append(text[done:start])
            done = end
    return "".join([*out, text[done:]])


def strip_script(text: str) -> str:
    return without(text, _Script(text).run())


# Tokens of python without comments: strings, brackets, ends of lines, and the rest.
_TRIPLE = r'"""[^"\\]*+(?:(?:\\(?s:.)|"(?!""))[^"\\]*+)*+"""' + r"|'''[^'\\]*+(?:(?:\\(?s:.)|'(?!''))[^'\\]*+)*+'''"
_PLAIN = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_FIELD = rf"\{{(?:[^{{}}\"'\n\\]++|{_PLAIN}|\{{[^{{}}\n]*+\}})*+\}}"
_FORMATTED = "|".join(rf"{q}(?:[^{q}\\{{\n]++|\\(?s:.)|\{{\{{|{_FIELD})*+{q}" for q in "\"'")
_MARK, _FORMAT_MARK = r"(?:(?<!\w)[rRbBuU]{1,2})?+", r"(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])"
_PYTHON = re.compile(
    # Words up to one that a quote follows, which may be the mark of a string.
    r"(?P<words>(?:[^\s\"'()\[\]{}\\]++(?![\"'])[ \t\f]*+)++)"
    rf"|(?P<triple>{_MARK}(?:{_TRIPLE}))|(?P<other>{_FORMAT_MARK}(?:{_TRIPLE}|{_FORMATTED})|\"\"\"(?s:.)*+|'''(?s:.)*+)"
    rf"|(?P<plain>{_MARK}(?:{_PLAIN}))|(?P<open>[(\[{{])|(?P<close>[)\]}}])"
    r"|(?P<joined>\\\r?\n)|(?P<end>\r?\n)|[ \t\f]++|(?P<code>[\w.=,:]++|.)"
)


def drop_string_statements(text: str, hold: bool = False) -> str:
    """Python without statements that are strings only; comments must be gone already.

    A statement ends at the end of a line, unless a bracket is open or a backslash joins the next one. Strings
    that stand side by side are one; formatted ones are no constants and stay, and so does what is joined by a
    backslash or shares its line. With ``hold``, a body that had nothing else keeps ``pass`` in place of it.
    """
    out, done, start, depth = [], 0, 0, 0
    strings = others = False
    header = -1
    held = None

    def indent(at: int) -> int:
        return _SPACES.match(text, at).end() - at

    def let_go(deeper: bool) -> None:
        # The statement after a body's strings tells whether the body has more than these.
        nonlocal held
        if held is not None and not deeper:
            out.append(text[held[0] : held[0] + held[1]] + "pass\n")
        held = None

    for token in _PYTHON.finditer(text + "\n"):
        kind = token.lastgroup
        if kind in ("triple", "plain"):
            strings = True
        elif kind == "open":
            depth, others = depth + 1, True
        elif kind == "close":
            depth, others = max(0, depth - 1), True
        elif kind in ("words", "other", "joined", "code"):
            others = True
        elif kind == "end" and depth == 0:
            end = min(token.end(), len(text))
            if strings and not others:
                out.append(text[done:start])
                if hold and header >= 0 and held is None and indent(start) > header:
                    held = (start, indent(start), header)
                done = end
            elif others:
                if held is not None:
                    out.append(text[done:start])
                    done = start
                    let_go(indent(start) > held[2])
                header = indent(start) if text[start : token.start()].rstrip().endswith(":") else -1
            start, strings, others = end, False, False
    if held is not None:
        out.append(text[done:])
        done = len(text)
        let_go(False)
    return "".join([*out, text[done:]])


def _arrow(change) -> Column:
    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

    return run


def scripts_without_comments(text: Column) -> Column:
    return _arrow(strip_script)(text)


def python_without_docstrings(text: Column, hold: bool = False) -> Column:
    return _arrow(lambda t: drop_string_statements(t, hold))(text)
