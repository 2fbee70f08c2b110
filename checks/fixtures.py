"""SQL that Spark and DuckDB both run: the inputs of the checks, derived from
the given tables, whole."""

from __future__ import annotations

SOURCE_FILES = """
select doc_id,
  'repo/' || source
    || case when doc_id % 11 = 0 then '/node_modules' when doc_id % 13 = 0 then '/dist' else '' end
    || '/f' || cast(doc_id as string) || ext as path,
  case when ext = '.py' then '# file ' || source || chr(10)
         || replace(text, chr(10), chr(10) || chr(10) || 'def f(a):' || chr(10) || '    ' || q3 || 'doc' || q3 || chr(10)
            || '    u = "a#b"  # note' || chr(10) || repeat('    x = 1' || chr(10), 20) || chr(10) || chr(10) || chr(10))
       when ext in ('.html', '.htm') then '<!-- ' || source || ' -->' || chr(10)
         || replace(text, chr(10), '<br><!-- n' || chr(10) || 'm -->' || chr(10) || chr(10) || chr(10))
       else '/* file ' || source || ' */' || chr(10)
         || replace(text, chr(10), chr(10) || chr(10) || 'function f(a) {' || chr(10) || '  u = "http://h/p"; // note' || chr(10)
            || repeat('  x += 1;' || chr(10), 20) || '}' || chr(10) || chr(10) || chr(10)) end || tail as content
from (select doc_id, source, text, repeat(chr(34), 3) as q3,
        case when cast(doc_id % 14 as int) < 4 then chr(10) || 't = ' || chr(39) || 'a//b' || chr(92) || chr(39) || chr(39) || ' + ' || chr(96) || 'x/*y*/' || chr(96) || '; // n' || chr(10)
            || 'case  /' || chr(92) || '/[/' || chr(34) || ']/.test(u): z(); // n' || chr(13) || chr(10) || 'v = a / b; // n' || chr(10)
            || case when doc_id % 2 = 1 then 'if (ok) /' || chr(92) || '/' || chr(92) || '//.test(u); d(); // n' || chr(10)
              || 'w = <p>a // b</p>; // n' || chr(10) || 'y = (a + b) / c; // n' || chr(10) else '' end
          when cast(doc_id % 14 as int) = 4 then chr(10) || 's = ' || chr(39) || 'a#b' || chr(92) || chr(39) || chr(39) || '  # n' || chr(10) || 't = ' || repeat(chr(39), 3) || 'x#' || chr(10) || 'y' || repeat(chr(39), 3) || '  # n' || chr(10)
            || 'def g(a=' || chr(39) || 'k:' || chr(39) || '):' || chr(10) || '    ' || chr(39) || 'one' || chr(39) || ' ' || chr(34) || 'line' || chr(34) || chr(10)
            || '    v = [' || chr(10) || '      ' || chr(34) || 'kept' || chr(34) || chr(10) || '    ]' || chr(10) || 'class C(g):' || chr(10) || chr(10) || '    ' || chr(34) || 'c' || chr(34) || chr(10) || '    x = {g:' || chr(10) || '    ' || chr(34) || 'kept' || chr(34) || chr(10) || '    }' || chr(10)
            || 'def h(a,' || chr(10) || '      b):' || chr(10) || '    ' || chr(39) || 'one' || chr(39) || chr(10) || '    x = {"a":' || chr(10) || '      ' || repeat(chr(34), 3) || 'operand' || repeat(chr(34), 3) || chr(10) || '    }' || chr(10)
            || '    y = (a or' || chr(10) || repeat(chr(34), 3) || 'operand' || repeat(chr(34), 3) || ')' || chr(10) || '    z = (1 if b else' || chr(10) || '    ' || chr(39) || 'kept' || chr(39) || ')' || chr(10) || '    ' || chr(39) || 'gone' || chr(39) || chr(10)
          when cast(doc_id % 14 as int) = 5 then chr(10) || 'String t = ' || repeat(chr(34), 3) || ' // no ' || chr(92) || repeat(chr(34), 3) || ' ' || repeat(chr(34), 3) || '; // n' || chr(10) || 'public static int f(int a) { return ' || chr(39) || chr(34) || chr(39) || '; }' || chr(10)
          when cast(doc_id % 14 as int) in (6, 8) then chr(10) || '#include <a//b.h>' || chr(10) || 'auto t = R' || chr(34) || 'x(// no )' || chr(34) || ' )x' || chr(34) || '; int n = 1' || chr(39) || '000' || chr(39) || '0; // n' || chr(10)
          when cast(doc_id % 14 as int) = 7 then chr(10) || '#include <a//b.h>' || chr(10) || 'int n = 0x1' || chr(39) || 'f; char c = ' || chr(39) || chr(34) || chr(39) || '; // n ' || chr(92) || chr(10) || 'more' || chr(10)
          when cast(doc_id % 14 as int) in (10, 11) then chr(10) || 'a { b: url(http://x/y); c: ' || chr(39) || '/*' || chr(39) || ' } /* n */' || chr(10) || 'd { e: url(data:image/svg+xml;/*x*/) }' || chr(10)
          else '' end as tail,
        case cast(doc_id % 14 as int) when 0 then '.js' when 1 then '.jsx' when 2 then '.ts' when 3 then '.tsx'
          when 4 then '.py' when 5 then '.java' when 6 then '.cpp' when 7 then '.c' when 8 then '.h'
          when 9 then '.html' when 10 then '.css' when 11 then '.scss' when 12 then '.PY' else '.md' end as ext
      from documents) t
"""

# Some files hold white space only.
SOME_BLANK = "case when doc_id % 23 = 0 then ' \u3000' || chr(9) || chr(10) else content end"

# What an editor says a file is.
OPENED_AS = (
    "case cast(doc_id % 5 as int) when 0 then 'c' when 1 then 'javascript' when 2 then 'html' end"
)

# One provider and style per row; one provider is unknown.
PROVIDER = (
    "case cast(doc_id % 5 as int) when 0 then 'openai' when 1 then 'anthropic' when 2 then 'gemini' "
    "when 3 then 'openrouter' else 'other' end"
)
STYLE = "case cast(doc_id % 4 as int) when 0 then 'jsdoc' when 1 then 'inline' when 2 then 'both' else 'none' end"
OVERRIDE = "case cast(doc_id % 3 as int) when 0 then '' when 1 then 'model-' || source end"

# Responses to chunks: fenced and one comment line longer, or failed, empty, cut short.
OUTPUT = """case when (doc_id + chunk_index) % 17 = 0 then null
  when (doc_id + chunk_index) % 19 = 0 then ''
  when doc_id % 7 = 0 then substr(text, 1, cast(floor(length(text) / 3) as int))
  else '```' || language || chr(10) || '// documented' || chr(10) || text || chr(10) || '```' end"""
ERROR = "case when (doc_id + chunk_index) % 17 = 0 then 'model error ' || cast(doc_id % 5 as string) end"

# Documented texts to audit: true to the code, changed, shortened, or unchanged.
AFTER = """case cast(doc_id % 4 as int)
  when 0 then case when language = 'python' then '# note' || chr(10) || replace(content, 'def f(a):' || chr(10), 'def f(a):' || chr(10) || '    ' || repeat(chr(34), 3) || 'Return a.' || repeat(chr(34), 3) || chr(10)) else '/* note */' || chr(10) || content end
  when 1 then replace(replace(content, 'x += 1', 'x += 2'), 'operand', 'changed')
  when 2 then replace(content, chr(10) || chr(10), chr(10))
  else replace(content, 'a // b</p>', 'a // c</p>') end"""

PAIRS = """
select b.conv_id, b.turn, b.text as before, a.text as after
from conversations b join conversations a on a.conv_id = b.conv_id and a.turn = b.turn + 1
"""

# White space of several kinds and line ends of both kinds around a document.
SPACED = """case cast(doc_id % 3 as int)
  when 0 then '\ufeff\u00a0' || chr(9) || text || '\u2029\u3000' || chr(13) || chr(10)
  when 1 then replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) || '  ' || chr(10)
  else replace(text, '. ', chr(10) || chr(10) || chr(10) || ' ' || chr(10)) end"""

# Every thirteen characters a span of three, at ten, twenty, ...
SPAN_COUNT = "greatest(1, floor((length(content) - 3) / 10))"
