"""Job settings and the table schemas the operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Providers and the model each one uses when none is named.
DEFAULT_MODELS = {
    "openai": "gpt-4o",
    "anthropic": "claude-haiku-4-5-20251001",
    "gemini": "gemini-2.5-flash-preview-05-20",
    "openrouter": "nvidia/nemotron-3-nano-omni-30b-a3b-reasoning:free",
}

# Documentation styles.
COMMENT_STYLES = ("jsdoc", "inline", "both")

# Folders that hold generated or vendored files.
SKIP_PATTERNS = ("node_modules", "dist", ".git", "build", "__pycache__", ".next", "out", "vendor")

# Sampling settings of a request, and the share of the input's
# length an output must reach for a whole file and for a selection.
TEMPERATURE = 0.2
MAX_TOKENS = 4096
FILE_RATIO = 0.5
SELECTION_RATIO = 0.7


@dataclass(frozen=True)
class JobConfig:
    """Settings of one run.

    ``min_lines`` is the least number of lines of every chunk but a file's last;
    a chunk grows until a declaration follows a blank line, so it has no upper
    bound. ``max_lines`` cuts files into as few chunks of that many lines at most as
    can be instead; only a stretch without a break point is longer. ``generate_partitions`` bounds how many model calls run side by side
    (``None`` leaves it to the session).
    """

    provider: str = "openai"
    model: str = ""
    comment_style: str = "jsdoc"
    min_lines: int = 80
    max_lines: int | None = None
    skip_patterns: tuple[str, ...] = SKIP_PATTERNS
    review: bool = True
    generate_partitions: int | None = None
    guard_ratio: float | None = FILE_RATIO
    per_chunk_fences: bool = False
    preserve_edges: bool = False

    def __post_init__(self) -> None:
        if self.provider not in DEFAULT_MODELS:
            raise ValueError(f"unknown provider {self.provider!r}, expected one of {sorted(DEFAULT_MODELS)}")
        if self.min_lines < 1:
            raise ValueError("min_lines must be at least 1")
        if self.max_lines is not None and self.max_lines < 1:
            raise ValueError("max_lines must be at least 1")
        if self.preserve_edges and not self.per_chunk_fences:
            raise ValueError("preserve_edges needs per_chunk_fences: a file-wide clean-up would trim the edges again")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MESSAGE = _schema(("role", T.StringType()), ("content", T.StringType()))

SOURCE_FILES = _schema(("path", T.StringType()), ("language", T.StringType()), ("content", T.StringType()))

CHUNKS = _schema(
    ("path", T.StringType()),
    ("chunk_index", T.IntegerType()),
    ("start_line", T.IntegerType()),
    ("end_line", T.IntegerType()),
    ("text", T.StringType()),
)

REQUESTS = _schema(
    ("path", T.StringType()),
    ("chunk_index", T.IntegerType()),
    ("provider", T.StringType()),
    ("model", T.StringType()),
    ("system", T.StringType()),
    ("user", T.StringType()),
    ("prompt", T.StringType()),
    ("messages", T.ArrayType(MESSAGE)),
    ("temperature", T.DoubleType()),
    ("max_tokens", T.IntegerType()),
)

RESPONSES = _schema(
    ("path", T.StringType()),
    ("chunk_index", T.IntegerType()),
    ("output", T.StringType()),
    ("error", T.StringType()),
)

RESULTS = _schema(("path", T.StringType()), ("success", T.BooleanType()), ("error", T.StringType()))

SPANS = _schema(
    ("path", T.StringType()),
    ("start", T.IntegerType()),
    ("end", T.IntegerType()),
    ("replacement", T.StringType()),
)

SELECTIONS = _schema(("path", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()))
