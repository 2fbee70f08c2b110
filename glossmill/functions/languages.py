"""Language detection and the language sets the operators accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each language.
LANGUAGE_EXTENSIONS = {
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "tsx", "mts"),
    "python": ("py",),
    "java": ("java",),
    "cpp": ("cpp", "h", "hpp"),
    "c": ("c",),
    "html": ("html", "htm"),
    "css": ("css",),
    "scss": ("scss",),
}
EXTENSIONS = tuple(ext for group in LANGUAGE_EXTENSIONS.values() for ext in group)

# Languages each kind of run takes.
CODE_LANGUAGES = ("javascript", "typescript", "python", "java", "cpp", "c")
MARKUP_LANGUAGES = ("html", "css", "scss")
SCOPES = {
    "strip_corpus": CODE_LANGUAGES,
    "strip_file": CODE_LANGUAGES + MARKUP_LANGUAGES,
    "generate": tuple(LANGUAGE_EXTENSIONS),
}


def extension(path: Column) -> Column:
    """Lower-cased last extension; '' for none, and for a dotfile such as ``.js``."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))


def detect_language(path: Column, language_id: Column | None = None) -> Column:
    """Language of a path, or null.

    ``language_id`` is an editor's own answer; it wins where it is spelled like
    a known extension, so a ``.h`` file opened as ``c`` is ``c``.
    """
    table = F.create_map(*[F.lit(x) for name, group in LANGUAGE_EXTENSIONS.items() for e in group for x in (e, name)])
    by_path = F.element_at(table, extension(path))
    if language_id is None:
        return by_path
    return F.coalesce(F.when(language_id.isin(*EXTENSIONS), language_id), by_path)
