"""Licence scans by ordered signature rules.

A text is reduced to words, and the rules are patterns over words with one space
between them. A rule is tried only where its keyword occurs. What the rules find is
put in order: by priority, then by length, then by place. A finding that lies inside
one of higher standing is suppressed, so a full notice is not reported again as the
name that it contains. The base phrases are found beside the rules and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.llm.words import byte_words

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# "gpl 3", "gpl v3", "gplv3", "gpl version 3".
_V = r"(?: ?v| version)? ?"
# Licences by label, how each is named in words, and a keyword that every such name contains.
NAMES = {
    "gpl-1.0": (rf"(?:gnu )?(?:general public licen[cs]e|gpl){_V}1(?: 0)?", "gpl|general public"),
    "gpl-2.0": (rf"(?:gnu )?(?:general public licen[cs]e|gpl){_V}2(?: 0)?", "gpl|general public"),
    "gpl-3.0": (rf"(?:gnu )?(?:general public licen[cs]e|gpl){_V}3(?: 0)?", "gpl|general public"),
    "lgpl-2.0": (rf"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl){_V}2(?: 0)?", "lgpl|lesser general|library general"),
    "lgpl-2.1": (rf"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl){_V}2 1", "lgpl|lesser general|library general"),
    "lgpl-3.0": (rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){_V}3(?: 0)?", "lgpl|lesser general"),
    "agpl-3.0": (rf"(?:gnu )?(?:affero general public licen[cs]e|agpl){_V}3(?: 0)?", "agpl|affero"),
    "apache-1.1": (rf"apache (?:software )?licen[cs]e{_V}1 1", "apache"),
    "apache-2.0": (rf"apache(?: software)?(?: licen[cs]e)?{_V}2(?: 0)?", "apache"),
    "mit": (r"mit(?: expat| x11)? licen[cs]e", " mit "),
    "mit-0": (r"mit no attribution(?: licen[cs]e)?", " mit no"),
    "bsd-1-clause": (r"(?:1|one) clause bsd(?: licen[cs]e)?|bsd 1 clause(?: licen[cs]e)?", "bsd"),
    "bsd-2-clause": (r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?|(?:simplified|freebsd) (?:bsd )?licen[cs]e", "bsd|simplified licen"),
    "bsd-3-clause": (r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "bsd"),
    "bsd-4-clause": (r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?|original bsd licen[cs]e", "bsd"),
    "0bsd": (r"(?:zero|0) clause bsd(?: licen[cs]e)?|0bsd", "bsd"),
    "mpl-1.1": (rf"(?:mozilla public licen[cs]e|mpl){_V}1 1", " mpl|mozilla public"),
    "mpl-2.0": (rf"(?:mozilla public licen[cs]e|mpl){_V}2(?: 0)?", " mpl|mozilla public"),
    "epl-1.0": (rf"(?:eclipse public licen[cs]e|epl){_V}1(?: 0)?", " epl|eclipse public"),
    "epl-2.0": (rf"(?:eclipse public licen[cs]e|epl){_V}2(?: 0)?", " epl|eclipse public"),
    "cddl-1.0": (rf"(?:common development and distribution licen[cs]e|cddl){_V}1(?: 0)?", "cddl|common development and"),
    "cpl-1.0": (rf"common public licen[cs]e{_V}1(?: 0)?", "common public"),
    "eupl-1.2": (rf"(?:european union public licen[cs]e|eupl){_V}1 2", "eupl|european union public"),
    "artistic-2.0": (rf"artistic licen[cs]e{_V}2(?: 0)?", "artistic licen"),
    "artistic-1.0": (rf"artistic licen[cs]e{_V}1(?: 0)?", "artistic licen"),
    "isc": (r"isc licen[cs]e", " isc licen"),
    "zlib": (r"zlib(?: libpng)? licen[cs]e", " zlib "),
    "boost-1.0": (rf"boost software licen[cs]e(?:{_V}1(?: 0)?)?", "boost software"),
    "unlicense": (r"the unlicense|unlicense org", "unlicense"),
    "wtfpl": (r"wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl|do what the fuck"),
    "postgresql": (r"postgresql licen[cs]e", "postgresql licen"),
    "python-2.0": (rf"(?:python software foundation|psf) licen[cs]e(?:{_V}2(?: 0)?)?", "psf licen|software foundation"),
    "ruby": (r"ruby licen[cs]e", " ruby licen"),
    "php-3.01": (rf"php licen[cs]e(?:{_V}3 01)?", " php licen"),
    "openssl": (r"openssl licen[cs]e", "openssl licen"),
    "ofl-1.1": (rf"(?:sil )?open font licen[cs]e(?:{_V}1 1)?", "open font"),
    "odbl-1.0": (rf"open (?:data commons )?database licen[cs]e(?:{_V}1(?: 0)?)?|odbl", "odbl|database licen"),
    "odc-by-1.0": (rf"open data commons attribution licen[cs]e(?:{_V}1(?: 0)?)?|odc by", "odc by|commons attribution"),
    "pddl-1.0": (r"public domain dedication and licen[cs]e|pddl", "pddl|public domain dedication"),
    "gfdl-1.3": (rf"(?:gnu )?(?:free documentation licen[cs]e|gfdl)(?:{_V}1 3)?", "gfdl|free documentation"),
    "ms-pl": (r"microsoft public licen[cs]e|ms pl", " ms pl |microsoft public"),
    "ms-rl": (r"microsoft reciprocal licen[cs]e|ms rl", " ms rl |microsoft reciprocal"),
    "sspl-1.0": (rf"server side public licen[cs]e(?:{_V}1)?|sspl", "sspl|server side public"),
    "busl-1.1": (rf"business source licen[cs]e(?:{_V}1 1)?", "business source"),
    "elastic-2.0": (rf"elastic licen[cs]e{_V}2(?: 0)?", "elastic licen"),
    "openrail": (r"(?:creativeml |bigscience )?open rail(?: m| s| d)?(?: licen[cs]e)?|openrail(?: m)?", "openrail|open rail"),
    "llama-community": (r"llama [0-9](?: [0-9])? community licen[cs]e(?: agreement)?", " llama "),
    "vim": (r"vim licen[cs]e", " vim licen"),
    "curl": (r"curl licen[cs]e", " curl licen"),
    "beerware": (r"beer ?ware licen[cs]e", " beer"),
    "cc0-1.0": (rf"cc0(?:{_V}1 0)?|creative commons zero(?:{_V}1 0)?|cc zero", "cc0|cc zero|commons zero"),
}
# Creative Commons: what may follow "by", in abbreviations and in words, for each version.
CC_PARTS = {"": ("", ""), "-sa": (" sa", " share ?alike"), "-nd": (" nd", " no ?deriv(?:ative)?s?(?: works)?"), "-nc": (" nc", " non ?commercial"), "-nc-sa": (" nc sa", " non ?commercial share ?alike"), "-nc-nd": (" nc nd", " non ?commercial no ?deriv(?:ative)?s?(?: works)?")}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
for _tail, (_short, _long) in CC_PARTS.items():
    for _version in CC_VERSIONS:
        NAMES[f"cc-by{_tail}-{_version.replace(' ', '.')}"] = (
            rf"(?:cc by{_short}|creative commons attribution{_long})(?: licen[cs]e| international| unported| generic)*{_V}{_version}",
            "cc by|creative commons",
        )
# How a text says that a licence holds, the surest way first: priority, words before the name, words after it.
PHRASINGS = (
    (90, r"spdx license identifier ", r""),
    (80, r"(?:is |are )?(?:re)?(?:licensed|released|distributed|available|published|provided|made available|covered|governed) (?:only )?(?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", r"(?: licen[cs]e)?(?: or(?: at your option)?(?: any)? later(?: version)?)?"),
    (70, r"(?:see|under|subject to|terms of|read|copy of|accept) the ", r"(?: for (?:more )?details)?"),
    (60, r"", r""),
)
# Notices that name no licence, or clauses of licence texts. Label, priority, pattern, keyword.
CLAUSES = (
    ("mit", 85, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", "hereby granted"),
    ("isc", 85, r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", 85, r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3-clause", 84, r"neither the name of (?:(?! neither the name of | may be used ).)+? nor the names of (?:its|any) contributors", "neither the name"),
    ("bsd-4-clause", 84, r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("zlib", 85, r"this software is provided as is without any express or implied warranty in no event", "express or implied"),
    ("boost-1.0", 85, r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("gpl", 84, r"this program is free software you can redistribute it and or modify it", "free software"),
    ("gpl", 84, r"either version [123](?: 0)? of the licen[cs]e or at your option any later version", "later version"),
    ("unlicense", 85, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("apache-2.0", 84, r"you may not use this file except in compliance with the licen[cs]e", "in compliance with"),
    ("mpl-2.0", 84, r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
    ("public-domain", 70, r"(?:is |are )?(?:released|dedicated|placed)? ?(?:in|into|to) the public domain", "public domain"),
    ("proprietary", 60, r"all rights reserved", "rights reserved"),
    ("proprietary", 65, r"proprietary and confidential", "proprietary"),
    ("proprietary", 65, r"may not be (?:copied|reproduced|redistributed)(?: or \w+)* without (?:the )?(?:prior |express )*written permission", "written permission"),
    ("gpl", 50, r"(?:gnu )?general public licen[cs]e|gnu gpl", "gnu|general public"),
    ("lgpl", 51, r"(?:gnu )?lesser general public licen[cs]e|gnu lgpl", "gnu|lesser general"),
    ("agpl", 51, r"(?:gnu )?affero general public licen[cs]e|gnu agpl", "gnu|affero"),
    ("apache", 50, r"apache (?:software )?licen[cs]e", "apache"),
    ("bsd", 50, r"bsd(?: style| type)? licen[cs]e", "bsd"),
    ("cc-by", 50, r"cc by|creative commons attribution(?: licen[cs]e)?", "cc by|creative commons"),
    ("creative-commons", 40, r"creative commons(?: licen[cs]e)?", "creative commons"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: re.Pattern
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Found:
    """Words ``first`` to ``last``, the last one included."""

    label: str
    priority: int
    first: int
    last: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every licence in every phrasing, and the clauses; in order of priority."""
    out = []
    for label, (name, keyword) in NAMES.items():
        for priority, before, after in PHRASINGS:
            out.append(Rule(label, priority, _compiled(f"{before}(?:{name}){after}"), tuple(keyword.split("|"))))
    out += [Rule(label, priority, _compiled(pattern), tuple(keyword.split("|"))) for label, priority, pattern, keyword in CLAUSES]
    return tuple(sorted(out, key=lambda r: -r.priority))


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(f"(?<= )(?:{pattern})(?= )")


@lru_cache(maxsize=1)
def _prefilter():
    """An automaton for all keywords and base phrases, and the rules' numbers by keyword."""
    import ahocorasick

    by_keyword: dict[str, list[int]] = {phrase: [] for phrase in BASE}
    for number, rule in enumerate(rules()):
        for word in rule.keywords:
            by_keyword.setdefault(word, []).append(number)
    finder = ahocorasick.Automaton()
    for word in by_keyword:
        finder.add_word(word, word)
    finder.make_automaton()
    return finder, by_keyword


def keywords_in(text: str) -> set[str]:
    return {word for _, word in _prefilter()[0].iter(text)}


def normalise(text: str | None) -> tuple[int, str]:
    """The number of words, and the words with a space before and after each."""
    words = byte_words(text)
    return len(words), f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def _starts(text: str, phrase: str) -> list[int]:
    """Places of a phrase as a whole, overlapping ones too."""
    out, at = [], text.find(f" {phrase} ")
    while at >= 0:
        out.append(at + 1)
        at = text.find(f" {phrase} ", at + 1)
    return out


def _number_of_words(text: str, places: list[int]) -> list[int]:
    """The word that starts at each place, counted from 0; places in order."""
    out, at, words = [], 0, 0
    for place in places:
        words += text.count(" ", at, place)
        at = place
        out.append(words - 1)
    return out


def base_places(text: str, keywords: set[str]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place of a base phrase."""
    spots = sorted((place, label) for phrase, label in BASE.items() if phrase in keywords for place in _starts(text, phrase))
    return [(word, label) for word, (_, label) in zip(_number_of_words(text, [p for p, _ in spots]), spots, strict=True)]


def detect(text: str, keywords: set[str]) -> list[Found]:
    """What stands of the rules' findings in normalised text, by place."""
    numbers = sorted({n for word in keywords for n in _prefilter()[1][word]})
    hits = [(r.priority, m.start(), m.end(), r.label) for r in map(rules().__getitem__, numbers) for m in r.pattern.finditer(text)]
    # Priority, then length, then place; containment is looked up among what already stands.
    hits = sorted(set(hits), key=lambda h: (-h[0], h[1] - h[2], h[1], h[3]))
    standing = sorted(_not_contained(hits), key=lambda h: (h[1], h[2], h[3]))
    firsts = _number_of_words(text, [h[1] for h in standing])
    return [Found(label, priority, first, first + text.count(" ", start, end)) for first, (priority, start, end, label) in zip(firsts, standing, strict=True)]


def _not_contained(hits: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Hits that lie in no earlier one, in n log n steps: ends kept grow with the starts kept."""
    starts: list[int] = []
    end_of: dict[int, int] = {}
    out = []
    for hit in hits:
        _, start, end, _ = hit
        i = bisect_right(starts, start)
        if i and end_of[starts[i - 1]] >= end:
            continue
        out.append(hit)
        # Keep the frontier: drop intervals that this one contains.
        while i < len(starts) and end_of[starts[i]] <= end:
            end_of.pop(starts.pop(i))
        if i and starts[i - 1] == start:
            end_of[start] = end
        else:
            insort(starts, start)
            end_of[start] = end
    return out


def scan(text: Column) -> Column:
    """A struct for each whole text; null counts as empty.

    Fields: ``n_words``; ``base``: the base phrases' places as ``(word, label)``; ``found``:
    the standing detections as ``(label, priority, first, last)`` in words;
    ``score``: the surest detection's priority as a share of the surest of all
    rules (a base phrase alone counts as a bare name), 0 without any.
    """
    kind = "struct<n_words:bigint,base:array<struct<word:bigint,label:string>>,found:array<struct<label:string,priority:int,first:bigint,last:bigint>>,score:double>"

    @F.arrow_udf(kind)
    def scanned(texts):
        import pyarrow as pa

        places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        sizes, base, found, score = [], [], [], []
        top = rules()[0].priority
        for t in texts.to_pylist():
            n, words = normalise(t)
            sizes.append(n)
            keywords = keywords_in(words)
            base.append([{"word": w, "label": k} for w, k in base_places(words, keywords)])
            hits = detect(words, keywords)
            found.append([vars(h) for h in hits])
            score.append(max([h.priority for h in hits] + [50] * bool(base[-1]) + [0]) / top)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(base, places), pa.array(found, spans), pa.array(score, pa.float64())],
            ["n_words", "base", "found", "score"],
        )

    return scanned(text)
