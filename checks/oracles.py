"""The same results in SQL for DuckDB, written from the operators' definitions."""

from __future__ import annotations

from checks import fixtures
from glossmill.functions.text import JS_WS, JS_WS_CLASS

NL = "chr(10)"

# What the package must agree with, written out so that a wrong constant there shows.
DEFAULT_MODELS = {'openai': 'gpt-4o', 'anthropic': 'claude-haiku-4-5-20251001', 'gemini': 'gemini-2.5-flash-preview-05-20', 'openrouter': 'nvidia/nemotron-3-nano-omni-30b-a3b-reasoning:free'}
SKIP_PATTERNS = ('node_modules', 'dist', '.git', 'build', '__pycache__', '.next', 'out', 'vendor')
STYLE_GUIDES = {
    "jsdoc": "Wanted: one documentation block per declaration.",
    "inline": "Wanted: short remarks beside code whose purpose reading does not show.",
    "both": "Wanted: one documentation block per declaration, and short remarks where reading does not show the purpose.",
}
BLOCK_FORMS = {
    "javascript": "JSDoc", "typescript": "TSDoc", "python": "a docstring in triple quotes, first in the body",
    "java": "Javadoc", "cpp": "Doxygen", "c": "Doxygen",
}
CHECKS = (
    "An answer is stored if it is the program that was sent once its comments and docstrings are taken out; indentation counts.",
    "It is refused if it has fewer lines than what was sent.",
    "It is stored as it comes, so it is source text from its first character to its last.",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _trim(text: str, kind: str = "trim") -> str:
    return f"{kind}({text}, {_text(JS_WS)})"


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_text(pattern)}, {_text(by)}, 'g')"


def _tidy(text: str) -> str:
    """Blank-line clean-up."""
    squeezed = f"regexp_replace({text}, {_text('(?:' + chr(92) + 'r?' + chr(92) + 'n){3,}')}, {NL} || {NL}, 'g')"
    return f"({_trim(squeezed, 'rtrim')} || {NL})"


def _units(text: str) -> str:
    """UTF-16 units: one per character, two beyond the first plane."""
    astral = _replace(text, r"[^\x{10000}-\x{10FFFF}]")
    return f"(length({text}) + length({astral}))"


def _unfence(text: str) -> str:
    opened = f"regexp_replace({text}, {_text(r'^```[0-9A-Za-z_]*' + chr(92) + 'n?')}, '')"
    return _trim(f"regexp_replace({opened}, {_text(chr(92) + 'n?```' + chr(92) + 'z')}, '')")


def _case(key: str, table: dict[str, str], default: str = "null") -> str:
    arms = " ".join(f"when {_text(k)} then {_text(v)}" for k, v in table.items())
    return f"case {key} {arms} else {default} end"


# Languages and selection

EXTENSION = r"lower(regexp_extract(path, '[^/]\.([^./]*)\z', 1))"
LANGUAGE_OF = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "py": "python", "java": "java", "cpp": "cpp", "h": "cpp", "hpp": "cpp", "c": "c",
    "html": "html", "htm": "html", "css": "css", "scss": "scss",
}
CODE = "('javascript', 'typescript', 'python', 'java', 'cpp', 'c')"
SUPPORTED = "('javascript', 'typescript', 'python', 'java', 'cpp', 'c', 'html', 'css', 'scss')"
FOLDERS = "list_slice(string_split(path, '/'), 1, -2)"
SKIPPED = f"list_has_any({FOLDERS}, [{', '.join(_text(p) for p in SKIP_PATTERNS)}])"

FILES = f"""source_files as (select *, split_part(path, '/', 2) as source from ({fixtures.SOURCE_FILES}) s),
files as (select *, {EXTENSION} as extension, {_case(EXTENSION, LANGUAGE_OF)} as language from source_files)"""


def _with_files(query: str, *more: str) -> str:
    return "with recursive " + ",\n".join((FILES, *more)) + "\n" + query


def _planned(content: str = "content") -> str:
    return f"""planned as (select doc_id, source, path, language, {content} as content from files
  where language in {SUPPORTED} and not {SKIPPED})"""


PLANNED = _planned()
PLANNED_SOME_BLANK = _planned(fixtures.SOME_BLANK)

# Comments

BLOCK, LINE, HASH = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"//[^\r\n]*", r"#[^\r\n]*"
DQ, SQ, BT = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'", r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
TDQ = r'"""(?:[^"\\]|\\[\s\S]|"[^"\\]|"\\[\s\S]|""[^"\\]|""\\[\s\S])*"""'
TSQ = TDQ.replace('"', "'")
OPEN = r'"""[\s\S]*', r"'''[\s\S]*"
NUMBER = r"\b[0-9](?:'?[\w.])*"
IN_CLASS = r"\[(?:[^\]\\\n]|\\[^\n])*\]"
REGEX = (
    r"(?:[>(,=:\[!&|?;{}]|\b(?:return|case|typeof|throw|await|yield)\b)\s*/"
    rf"(?:[^/*\\\[\n]|\\[^\n]|{IN_CLASS})(?:[^/\\\[\n]|\\[^\n]|{IN_CLASS})*/"
)
SPLICED = r"//[^\\\r\n]*(?:\\(?:\r\n|[\s\S])?[^\\\r\n]*)*"
# Raw strings with the mark that the fixture uses.
RAW = r'\bR"x\((?:[^)]|\)+[^x)])*\)+x"'
INCLUDE = r"#[ \t]*include[ \t]*<[^>\n]*>"
URL = r"[uU][rR][lL]\([^()\"'\n]*\)"
# After a condition, and between tags that stand on one line.
AFTER_CONDITION = r"\bif \([a-z]*\) /(?:[^/*\\\[\n]|\\[^\n])(?:[^/\\\[\n]|\\[^\n])*/"
ELEMENT = r"<[a-z]+>[^<>{}\n]*</[a-z]+>"
TOKENS = {
    "javascript": ((AFTER_CONDITION, ELEMENT, REGEX, DQ, SQ, BT), (BLOCK, LINE)),
    "typescript": ((AFTER_CONDITION, ELEMENT, REGEX, DQ, SQ, BT), (BLOCK, LINE)),
    "java": ((TDQ, OPEN[0], DQ, SQ), (BLOCK, LINE)),
    "cpp": ((RAW, NUMBER, DQ, SQ, INCLUDE), (BLOCK, SPLICED)),
    "c": ((NUMBER, DQ, SQ, INCLUDE), (BLOCK, SPLICED)),
    "python": ((TDQ, TSQ, *OPEN, DQ, SQ), (HASH,)),
    "css": ((URL, DQ, SQ), (BLOCK,)),
    "scss": ((URL, DQ, SQ), (BLOCK, LINE)),
}
HTML = r"<!--[\s\S]*?-->"


BACK = r"\1\2"


def _comments(language: str) -> str:
    literals, comments = TOKENS[language]
    comment = "|".join(comments)
    rest = r"|(/\*[\s\S]*)" if BLOCK in comments else "|(^$)"
    return rf"({'|'.join(literals)})|(?m:^)[ \t]*(?:{comment})[ \t]*\r?\n|{comment}{rest}"


def _lexical(content: str) -> str:
    arms = " ".join(
        f"when {_text(name)} then {_replace(content, _comments(name), chr(92) + '1' + chr(92) + '2')}" for name in TOKENS
    )
    return _tidy(f"case language {arms} when 'html' then {_replace(content, HTML)} else {content} end")


def _regex(content: str) -> str:
    c_like = _replace(_replace(content, BLOCK), r"//[^\n]*")
    python = _replace(_replace(_replace(content, r"#[^\n]*"), r'"""[\s\S]*?"""'), r"'''[\s\S]*?'''")
    return _tidy(
        f"case when language in ('javascript', 'typescript', 'java', 'cpp', 'c') then {c_like} "
        f"when language = 'python' then {python} when language = 'html' then {_replace(content, HTML)} "
        f"when language in ('css', 'scss') then {_replace(content, BLOCK)} else {content} end"
    )


# Tokens of python without comments.
STRING = rf"(?:\b[rRbBuU]{{1,2}})?(?:{TDQ}|{TSQ})|{OPEN[0]}|{OPEN[1]}|(?:\b[rRbBuU]{{1,2}})?(?:{DQ}|{SQ})"
PYTHON = rf"{STRING}|[()\[\]{{}}]|\\\r?\n|\r?\n|[ \t\f]+|[^\"'()\[\]{{}}\\\r\n \t\f]+|[\s\S]"


def _without_docstrings(source: str, key: str, name: str) -> tuple[str, ...]:
    """``name(key, bare)`` of python texts ``source(key, bare)``: statements by the depth of brackets, and none that is strings only."""
    return (
        f"{name}_tokens as (select {key}, unnest(tokens) as token, generate_subscripts(tokens, 1) as i"
        f" from (select {key}, regexp_extract_all(bare, {_text(PYTHON)}) as tokens from {source}) t)",
        f"""{name}_depths as (select *, level - least(0, min(level) over (partition by {key} order by i)) as depth from (
    select *, sum(case when token in ('(', '[', '{{') then 1 when token in (')', ']', '}}') then -1 else 0 end)
      over (partition by {key} order by i) as level from {name}_tokens) l)""",
        f"""{name}_statements as (select {key}, statement, min(i) as first_i, string_agg(token, '' order by i) as code,
    bool_and(regexp_matches(token, '^[ \t\f\r\n]+$') or regexp_full_match(token, {_text(f'(?:[rRbBuU]{{0,2}}(?:{TDQ}|{TSQ}|{DQ}|{SQ}))')})) 
      and bool_or(regexp_matches(token, {_text("[" + chr(34) + chr(39) + "]$")})) as strings
  from (select *, coalesce(sum(case when depth = 0 and token in ({NL}, chr(13) || {NL}) then 1 else 0 end)
      over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as statement from {name}_depths) s
  group by {key}, statement)""",
        f"{name} as (select {key}, coalesce(string_agg(code, '' order by first_i) filter (not strings), '') as bare from {name}_statements group by {key})",
    )


# Lines and chunks

_S = f"[{JS_WS_CLASS}]"
DECLARATIONS = "|".join(
    (
        rf"^(?:export{_S}+)?(?:default{_S}+)?(?:async{_S}+)?function{_S}+",
        rf"^(?:export{_S}+)?(?:default{_S}+)?class{_S}+",
        rf"^def{_S}+",
        rf"^class{_S}+",
        rf"^(?:public|private|protected|static|abstract|final)(?:{_S}|\w)*{_S}+\w+{_S}*\(",
        rf"^(?:void|int|bool|auto|std::|[A-Z]\w*){_S}+\w+{_S}*\(",
    )
)
LINES = f"""texts as (select *, string_split(content, {NL}) as ls from planned),
lines as (select doc_id, path, len(ls) as n, unnest(range(len(ls))) as line_index, unnest(ls) as line from texts)"""
IS_DECLARATION = f"regexp_matches({_trim('line')}, {_text(DECLARATIONS)})"
POINTS = f"""points as (select doc_id, path, n, line_index from (
    select *, lag(line) over (partition by doc_id order by line_index) as before from lines) w
  where line_index >= 1 and {IS_DECLARATION} and {_trim('before')} = '')"""
CHUNKS = f"""cuts as (select doc_id, 0::bigint as start_line from texts
  union all
  select c.doc_id, (select min(line_index) from points b
      where b.doc_id = c.doc_id and b.n > 80 and b.line_index >= c.start_line + 80)
  from cuts c where exists (select 1 from points b
      where b.doc_id = c.doc_id and b.n > 80 and b.line_index >= c.start_line + 80)),
ends as (select doc_id, start_line,
    row_number() over (partition by doc_id order by start_line) - 1 as chunk_index,
    lead(start_line) over (partition by doc_id order by start_line) as next_line from cuts),
chunks as (select t.doc_id, source, path, language, content, chunk_index, start_line,
    coalesce(next_line, len(ls)) as end_line,
    array_to_string(ls[start_line + 1 : coalesce(next_line, len(ls))], {NL}) as text
  from texts t join ends e on t.doc_id = e.doc_id)"""
def _bounded(limit: int) -> str:
    """The last break point within the limit, else the first one after the cut."""
    after = f"select {{}}(line_index) from points b where b.doc_id = c.doc_id and b.n > {limit} and b.line_index > c.start_line"
    rest = f"c.n - c.start_line > {limit}"
    following = f"coalesce(({after.format('max')} and b.line_index <= c.start_line + {limit}), ({after.format('min')}))"
    cuts = f"""cuts as (select doc_id, n, 0::bigint as start_line from (select doc_id, len(ls) as n from texts)
  union all
  select doc_id, n, following from (select c.doc_id, c.n, {following} as following from cuts c where {rest}) f where following is not null)"""
    return cuts + CHUNKS[CHUNKS.index(",\nends as") :]


CHUNKED = (PLANNED, LINES, POINTS, CHUNKS)
NOT_BLANK = f"not_blank as (select * from planned where {_trim('content')} <> '')"
SENT = (
    PLANNED_SOME_BLANK,
    NOT_BLANK,
    LINES.replace("from planned", "from not_blank"),
    POINTS,
    CHUNKS,
)
RESPONSES = f"""responses as (select doc_id, path, language, content, chunk_index, text,
    {fixtures.OUTPUT} as output, {fixtures.ERROR} as error from chunks)"""
ANSWERED = (*SENT, RESPONSES)

# Requests


def _requests(provider: str, style: str, override: str) -> str:
    system = (
        "'You add documentation to ' || language || ' files. A program checks every answer before it is stored.' || "
        f"{NL} || {_case(style, STYLE_GUIDES, _text(STYLE_GUIDES['both']))} || {NL} || 'Form of a block: ' || "
        + _case("language", BLOCK_FORMS, "'what is usual in ' || language")
        + f" || '.' || {NL} || "
        + f" || {NL} || ".join(_text(check) for check in CHECKS)
    )
    return f"""parts as (select path, chunk_index, {provider} as provider,
    coalesce(nullif({override}, ''), {_case(provider, DEFAULT_MODELS)}) as model,
    {system} as system_text,
    language || ' source:' || {NL} || {NL} || text as user_text
  from chunks)"""


ENVELOPES = f"""select path, chunk_index, provider, model,
  case when provider = 'anthropic' then system_text end as system, user_text as user,
  case when provider = 'gemini' then system_text || {NL} || {NL} || user_text end as prompt,
  case when provider in ('openai', 'openrouter') then cast(to_json([
      {{role: 'system', content: system_text}}, {{role: 'user', content: user_text}}]) as varchar)
    when provider = 'anthropic' then cast(to_json([{{role: 'user', content: user_text}}]) as varchar) end as messages,
  case when provider in ('openai', 'openrouter', 'anthropic') then cast(0.2 as double) end as temperature,
  case when provider in ('openai', 'openrouter', 'anthropic') then 4096 end as max_tokens
from parts"""


# Files from responses


def _documented(text: str, whole: str, guard: float | None) -> tuple[str, str]:
    accepted = "true" if guard is None else (
        f"{_units(_trim('output'))}::double >= {_units(_trim('content'))}::double * {guard}::double"
    )
    return (
        f"""joined as (select path, min(error) filter (chunk_index = first_failed) as error,
    string_agg({text}, {NL} order by chunk_index) as text
  from (select *, min(case when error is not null then chunk_index end) over (partition by path) as first_failed
        from responses) r group by path)""",
        f"""documented as (select path, language, content, error is null as success, error,
    coalesce(output is not null and {accepted}, false) as accepted, output
  from (select p.path, p.language, p.content, j.error,
          case when j.path is not null and j.error is null then {whole} end as output
        from planned p left join joined j on p.path = j.path) d)""",
    )


OUTPUT = f"coalesce({_trim('output')}, '')"
PLAIN = (*ANSWERED, *_documented(OUTPUT, _unfence("text"), 0.5))
_LEAD = f"substr(text, 1, cast(length(text) - length({_trim('text', 'ltrim')}) as int))"
_TRAIL = f"case when {_trim('text')} = '' then '' else substr(text, cast(length({_trim('text', 'rtrim')}) + 1 as int)) end"
EDGED = (*ANSWERED, *_documented(f"{_LEAD} || {_unfence(OUTPUT)} || {_TRAIL}", "text", None))


def _summary(results: str) -> str:
    return f"""select count(*) as processed, count(*) filter (success) as succeeded,
  count(*) filter (not success) as failed,
  (select string_agg(message, {NL} order by path, message) from (
     select path, path || ': ' || error as message from {results}
     where not success order by path, message limit 5) m) as messages
from {results}"""


# Line changes


def _changes(pairs: str, *keys: str) -> str:
    key = ", ".join(keys)
    match = " and ".join(f"p.{k} = c.{k}" for k in keys)
    return f"""select {', '.join('p.' + k for k in keys)}, lines_added, lines_removed, before <> after as changed
from {pairs} p join (
  select {key}, sum(greatest(-net, 0)) as lines_added, sum(greatest(net, 0)) as lines_removed from (
    select {key}, line, sum(weight) as net from (
      select {key}, unnest(string_split(before, {NL})) as line, 1 as weight from {pairs}
      union all
      select {key}, unnest(string_split(after, {NL})) as line, -1 as weight from {pairs}) l
    group by {key}, line) n
  group by {key}) c on {match}"""


def _code(bare: str) -> str:
    """Lines that hold code."""
    return f"list_filter(list_transform(string_split({bare}, {NL}), lambda x: {_trim('x', 'rtrim')}), lambda x: x <> '')"


# Edits

SPANS = f"""spans as (select path, i * 10 as start, i * 10 + 3 as stop,
    case when i % 29 = 0 then '' else '<' || cast(i as varchar) || '>' end as replacement
  from (select path, unnest(range(1, cast({fixtures.SPAN_COUNT} as bigint) + 1)) as i from planned) s)"""
SELECTIONS = """selections as (select doc_id, path, start, least(start + width, size) as stop from (
    select doc_id, path, size, start, case when doc_id % 3 = 0 and start <> 5 then 0 else 55 end as width from (
      select doc_id, path, length(content) as size, unnest([5, least(70, length(content))]) as start from planned) a) b)"""
PICKED = """picked as (select p.doc_id, p.path, language, start, stop,
    substr(content, cast(start + 1 as int), cast(stop - start as int)) as text
  from planned p join selections s on p.path = s.path where stop > start)"""


def _spliced(spans: str) -> str:
    """Gaps between spans and the spans' replacements, in order, per file."""
    return f"""select p.path, coalesce(edited, content) as content, coalesce(n, 0) as n_spans, true as applied
from planned p left join (
  select path, count(*) as n,
    string_agg(gap || replacement, '' order by start) || max(tail) as edited
  from (select s.path, s.start, s.replacement,
      substr(content, cast(before + 1 as int), cast(s.start - before as int)) as gap,
      substr(content, cast(last_stop + 1 as int)) as tail
    from (select *, coalesce(lag(stop) over (partition by path order by start), 0) as before,
        max(stop) over (partition by path) as last_stop from {spans}) s join planned f on f.path = s.path) g
  group by path) e on e.path = p.path"""


def _generated(output: str) -> str:
    refused = "contains(text, '/* file src3 */')"
    return f"""select path, chunk_index, case when not {refused} then {output} end as output,
  case when {refused} then 'refused' end as error from chunks"""


_USER = f"(language || ' source:' || {NL} || {NL} || text)"
_RUN = (
    *SENT,
    f"responses as (select path, content, chunk_index, o.output, o.error from chunks join ({_generated(f'''{_trim(f"'// documented' || {NL} || {_USER}")}''')}) o using (path, chunk_index))",
)

GLOBBED = (
    f"len(list_filter({FOLDERS}, lambda x: starts_with(x, 'node_mod') or regexp_matches(x, '^d.st$') "
    "or x in ('src1', 'src7', 'src8'))) > 0 or starts_with(path, 'repo/src2/') or starts_with(path, 'repo/src3/')"
)
AUDITED = f"audited as (select path, doc_id, language, content as before, {fixtures.AFTER} as after from planned)"
PAIRS = f"pairs as ({fixtures.PAIRS})"


def _enough(ratio: float) -> str:
    return f"{_units(_trim('after'))}::double >= {_units(_trim('before'))}::double * {ratio}::double"


STRIP = f"where language in {CODE} and not {SKIPPED}"
STRIP_FILE = f"where language in {SUPPORTED} and not {SKIPPED}"

BARE_SIDES = (
        PLANNED,
        AUDITED,
        f"""sides as (select 'b' || path as side, language, {_lexical('before')} as bare from audited
  union all select 'a' || path, language, {_lexical('after')} from audited)""",
        "plain as (select side, bare from sides where language = 'python')",
        *_without_docstrings("plain", "side", "pure"),
        "bare as (select side, bare from sides where language <> 'python' union all select side, bare from pure)",
)

ORACLES: dict[str, str] = {
    "detect_languages": _with_files(
        f"""select path, extension, language,
  coalesce(case when opened in ({', '.join(_text(e) for e in LANGUAGE_OF)}) then opened end, language) as opened_language
from (select *, {fixtures.OPENED_AS} as opened from files) f"""
    ),
    "decode_bytes": _with_files(
        "select path, content || chr(65533) || 'a' || chr(65533) as content from files"
    ),
    "skip_folders": _with_files(f"select path, {SKIPPED} as skipped, {GLOBBED} as skipped_by_glob from files"),
    "scan_select": _with_files("select path, language from planned", PLANNED),
    "scan_ordered": _with_files("select path, language from planned order by path collate en, path", PLANNED),
    "scan_ordered_top": _with_files(
        "select path, language from planned order by path collate en, path limit 100", PLANNED
    ),
    "language_scopes": _with_files(
        f"""select path, language, coalesce(language in {CODE}, false) as strip_corpus,
  coalesce(language in {SUPPORTED}, false) as strip_file, coalesce(language in {SUPPORTED}, false) as generate from files"""
    ),
    "not_blank_files": _with_files("select path, language from not_blank", PLANNED_SOME_BLANK, NOT_BLANK),
    "plan_summary": _with_files("select language, count(*) as files from planned group by rollup (language)", PLANNED),
    "scan_tree": _with_files(
        f"select path, language, content, cast(null as varchar) as read_error from files {STRIP_FILE}"
    ),
    "scan_source_tree": _with_files(
        f"""select path, extension, language, strlen(content) as size, content, cast(null as varchar) as read_error from files
{STRIP_FILE} and extension in ('js', 'py', 'htm', 'html', 'scss') and language <> 'python' and starts_with(path, 'repo/src')"""
    ),
    "commit_tree": _with_files(
        f"select path, extension, language, strlen(content) as size, cast(null as varchar) as read_error from files {STRIP_FILE}"
    ),
    "write_tree": _with_files(
        """select case when doc_id % 29 = 0 then '/' || path else path end as path, doc_id % 29 <> 0 as success,
  case when doc_id % 29 = 0 then 'path leaves the tree' end as error from files"""
    ),
    "write_table": _with_files(f"select path, language, {_regex('content')} as content from files {STRIP}"),
    "strip_comments_regex": _with_files(
        f"select path, language, {_regex('content')} as content from files {STRIP_FILE}"
    ),
    "strip_comments_lexical": _with_files(
        f"select path, language, {_lexical('content')} as content from files {STRIP_FILE}"
    ),
    "strip_docstrings": _with_files(
        f"select path, {_tidy('bare')} as content from pure",
        PLANNED,
        f"plain as (select path, {_replace('content', _comments('python'), BACK)} as bare from planned where language = 'python')",
        *_without_docstrings("plain", "path", "pure"),
    ),
    "pages_strip_html": f"select page_id, {_tidy(_replace('html', HTML))} as html from pages",
    "blank_lines": f"select doc_id, {_tidy('spaced')} as text from (select doc_id, {fixtures.SPACED} as spaced from documents) d",
    "trim_text": f"""select doc_id, text, {_units('text')} as utf16_units
from (select doc_id, {_trim('(' + fixtures.SPACED + ')')} as text from documents) d""",
    "strip_fences": _with_files(
        f"select path, chunk_index, {_unfence('output')} as output from responses where output is not null", *ANSWERED
    ),
    "file_lines": _with_files("select path, line_index, line from lines", PLANNED, LINES),
    "declarations": _with_files(f"select path, line_index from lines where {IS_DECLARATION}", PLANNED, LINES),
    "find_break_points": _with_files("select path, line_index from points", PLANNED, LINES, POINTS),
    "chunk_files": _with_files("select path, chunk_index, start_line, end_line, text from chunks", *CHUNKED),
    "chunk_within_limit": _with_files(
        "select path, chunk_index, start_line, end_line, text from chunks", PLANNED, LINES, POINTS, _bounded(100)
    ),
    "chunk_rejoin": _with_files("select path, content from planned", PLANNED),
    "build_requests": _with_files(ENVELOPES, *SENT, _requests("'openai'", "'jsdoc'", "''")),
    "request_envelopes": _with_files(
        ENVELOPES,
        *SENT,
        _requests(f"({fixtures.PROVIDER})", f"({fixtures.STYLE})", f"({fixtures.OVERRIDE})"),
    ),
    "resolve_models": _with_files(
        f"""select path, provider, coalesce(nullif(override, ''), {_case('provider', DEFAULT_MODELS)}) as model
from (select path, {fixtures.PROVIDER} as provider, {fixtures.OVERRIDE} as override from files) f"""
    ),
    "normalise_outputs": _with_files(
        f"select path, chunk_index, {OUTPUT} as output from responses", *ANSWERED
    ),
    "file_results": _with_files(
        """select path, count(error) = 0 as success, min(error) filter (chunk_index = first_failed) as error
from (select *, min(case when error is not null then chunk_index end) over (partition by path) as first_failed
      from responses) r group by path""",
        *ANSWERED,
    ),
    "generate_batch": _with_files(
        _generated(f"'```' || {NL} || cast(length({_USER}) as varchar) || ' characters' || {NL} || '```'"), *SENT
    ),
    "ask_once": _with_files(
        _generated(f"'```' || {NL} || cast(length({_USER}) as varchar) || ' characters' || {NL} || '```'"), *SENT
    ),
    "document_corpus": _with_files(
        "select path, language, success, error, accepted, output from documented", *PLAIN
    ),
    "document_corpus_edges": _with_files(
        "select path, language, success, error, accepted, output from documented", *EDGED
    ),
    "review_corpus": _with_files(
        _changes("reviewed", "path"),
        *PLAIN,
        "reviewed as (select path, content as before, output as after from documented where accepted)",
    ),
    "document_arriving": _with_files(
        f"select path, language, success, error, accepted, output from documented where success and {_trim('content')} <> ''", *PLAIN
    ),
    "document_run": _with_files(
        _summary("documented"), *_RUN, *_documented(OUTPUT, _unfence("text"), 0.5)
    ),
    "apply_spans": _with_files(_spliced("spans"), PLANNED, SPANS),
    "apply_spans_sparse": _with_files(
        _spliced("few"),
        PLANNED,
        SPANS,
        "few as (select spans.* from spans join planned on spans.path = planned.path where language = 'scss')",
    ),
    "selection_extract": _with_files(
        "select path, language, start, stop as \"end\", text from picked", PLANNED, SELECTIONS, PICKED
    ),
    "selection_replace": _with_files(
        _spliced("marked"),
        PLANNED,
        SELECTIONS,
        PICKED,
        "marked as (select path, start, stop, '<<' || text || '>>' as replacement from picked)",
    ),
    "selection_requests": _with_files(
        ENVELOPES,
        PLANNED,
        SELECTIONS,
        PICKED,
        "chunks as (select path, language, text, start as chunk_index from picked)",
        _requests("'openai'", "'jsdoc'", "''"),
    ),
    "document_selections": _with_files(
        _spliced("accepted"),
        PLANNED,
        SELECTIONS,
        PICKED,
        f"""answered as (select path, start, stop, text as before,
    {_unfence(_trim(f"case when doc_id % 7 = 0 then substr(text, 1, 20) else '```' || {NL} || '// note' || {NL} || text || {NL} || '```' end"))} as after
  from picked where doc_id % 17 <> 0)""",
        f"accepted as (select path, start, stop, after as replacement from answered where {_enough(0.7)})",
    ),
    "length_guard": f"""with {PAIRS} select conv_id, turn, {_enough(0.5)} as file_accepted,
  {_enough(0.7)} as selection_accepted from pairs""",
    "review_changes": f"with {PAIRS} {_changes('pairs', 'conv_id', 'turn')}",
    "review_stripped": _with_files(
        _changes("stripped", "path"),
        f"stripped as (select path, content as before, {_regex('content')} as after from files {STRIP_FILE})",
    ),
    "preservation_audit": _with_files(
        f"""select path, language, code_kept, lines_kept, code_kept and lines_kept as preserved from (
  select a.path, language, {_code('b.bare')} = {_code('c.bare')} as code_kept,
    len(string_split(after, {NL})) >= len(string_split(before, {NL})) as lines_kept
  from audited a join bare b on b.side = 'b' || a.path join bare c on c.side = 'a' || a.path) a""",
        *BARE_SIDES,
    ),
    "audit_places": _with_files(
        """select path, (at_line - 1)::int as code_line, ours[at_line] as line_before, theirs[at_line] as line_after
from (select path, ours, theirs, list_min(list_filter(range(1, greatest(len(ours), len(theirs)) + 1), lambda i: ours[i] is distinct from theirs[i])) as at_line
  from codes where ours <> theirs) c""",
        *BARE_SIDES,
        f"""codes as (select a.path, {_code('b.bare')} as ours, {_code('c.bare')} as theirs
  from audited a join bare b on b.side = 'b' || a.path join bare c on c.side = 'a' || a.path)""",
    ),
    "review_hunks": _with_files(
        f"""select path, len(string_split(after, {NL})) - len(string_split(before, {NL})) as lines_more,
  length(after) - length(before) as characters_more from audited where before <> after""",
        PLANNED,
        AUDITED,
    ),
    "approve_hunks": _with_files(
        "select path, case when doc_id % 3 <> 0 then after else before end as content, true as applied from audited", PLANNED, AUDITED
    ),
    "run_summary": _with_files(_summary("documented"), *PLAIN),
    "strip_files": _with_files(
        f"""select path, language, stripped as content, stripped <> content as changed
from (select *, {_lexical('content')} as stripped from files {STRIP}) f"""
    ),
    "strip_results_of_files": _with_files(
        f"""select path, language, case when doc_id % 11 <> 0 then stripped end as content,
  coalesce(doc_id % 11 <> 0 and stripped <> content, false) as changed, doc_id % 11 <> 0 as success,
  case when doc_id % 11 = 0 then 'gone' end as error
from (select *, {_lexical('content')} as stripped from files {STRIP_FILE}) f"""
    ),
    "publish_approved": _with_files(
        """select path, language, output as content from documented
where accepted and path in (select path from planned where doc_id % 2 = 0)""",
        *PLAIN,
    ),
    "strip_stream": _with_files(
        f"""select path, language, stripped as content, stripped <> content as changed
from (select *, {_lexical('content')} as stripped from files {STRIP}) f"""
    ),
}
