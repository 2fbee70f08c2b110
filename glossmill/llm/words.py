"""Words of a text, by bytes and by Unicode."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def byte_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, lowered, and digits and of anything beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@lru_cache(maxsize=1)
def _unicode_word() -> re.Pattern:
    marks = "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
    return re.compile(f"[\\w{marks}]+")


def folded_words(text: str | None) -> list[str]:
    """Runs of letters, marks and digits of any script; without regard to case, and with accents composed."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_WORD_BYTES).decode().split()
    return _unicode_word().findall(unicodedata.normalize("NFC", text.casefold()).replace("_", " "))
