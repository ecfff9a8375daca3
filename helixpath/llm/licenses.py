"""License scans: ordered signature rules behind a keyword prefilter, with priority and containment between detections.

Rules are regular expressions over a text's words (A-Z lower-cased, joined by single blanks), so
punctuation, line breaks and case do not matter. A keyword prefilter (an Aho-Corasick automaton over the
keywords of all rules) leaves most texts without any expression to try. Of overlapping detections, one that lies within another
of an equal or better priority is suppressed; of the same place, the better priority and then the earlier rule stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import LOWER_BYTES, slices

#: The base phrases and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: What stands between words, after A-Z are lower-cased (fixed pattern).
_GAPS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int  # 0 is best
    weight: float  # what one detection adds to the belief that the text is licensed material


def _families() -> list[Rule]:
    """The rules in order: full statements, then names, then tags. Families differ in versions and forms only."""
    rules: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int, weight: float) -> None:
        rules.append(Rule(label, keyword, pattern, priority, weight))

    given = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) under(?: the terms of)?(?: the| a| an)? "
    # GNU: three licenses, their versions, three ways to state each
    for short, name in (("gpl", "general public licen[cs]e"), ("lgpl", "(?:lesser|library) general public licen[cs]e"), ("agpl", "affero general public licen[cs]e")):
        word = "general public"
        for version in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}[short]:
            v, tag = version, version.replace(" ", ".")
            add(f"{short}-{tag}-or-later", word, rf"\b(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?v(?:ersion )?{v}(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?any later version\b", 0, 0.9)
            add(f"{short}-{tag}-only", word, rf"\b(?:gnu )?{name} v(?:ersion )?{v} only\b", 0, 0.9)
            add(f"{short}-{tag}", word, rf"\b(?:gnu )?{name} v(?:ersion )?{v}\b", 1, 0.8)
            add(f"{short}-{tag}-or-later", short, rf"\bspdx license identifier {short} {v}(?: 0)? or later\b", 0, 0.95)
            add(f"{short}-{tag}-only", short, rf"\bspdx license identifier {short} {v}(?: 0)? only\b", 0, 0.95)
            add(f"{short}-{tag}", short, rf"\b(?:gnu )?{short} ?v?{v}(?: 0)?\b", 2, 0.5)
        add(f"{short}-any", word, rf"\bgnu {name}\b", 3, 0.6)
    # Creative Commons: six licenses, their versions, three ways to state each
    parts = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s",
             "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    for code, name in parts.items():
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tag = f"cc-{code}-{version.replace(' ', '.')}"
            add(tag, "cc", rf"\bcc {code.replace('-', ' ')} {version}\b", 1, 0.8)
            add(tag, "creative", rf"\bcreative ?commons {name} {version}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?\b", 0, 0.9)
            add(tag, "creativecommons", rf"\bcreativecommons org licenses {code.replace('-', ' ')} {version}\b", 0, 0.95)
        add(f"cc-{code}", "cc", rf"\bcc {code.replace('-', ' ')}\b", 3, 0.5)
        add(f"cc-{code}", "creative", rf"\bcreative ?commons {name}\b", 2, 0.7)
    # Versioned licenses: name, keyword, words of the name, versions
    for label, key, name, versions in (
        ("apache", "apache", "apache (?:software )?licen[cs]e", ("1 0", "1 1", "2 0")), ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")), ("cddl", "development and distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
        ("eupl", "european union", "european union public licen[cs]e", ("1 0", "1 1", "1 2")), ("afl", "academic free", "academic free licen[cs]e", ("1 2", "2 0", "2 1", "3 0")),
        ("osl", "open software", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")), ("gfdl", "documentation license", "(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
        ("bsl", "boost", "boost software licen[cs]e", ("1 0",)), ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
        ("lppl", "latex", "latex project public licen[cs]e", ("1 0", "1 1", "1 2", "1 3")), ("ecl", "educational community", "educational community licen[cs]e", ("1 0", "2 0")),
        ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ()), ("cpl", "common public", "common public licen[cs]e", ("1 0",)),
        ("odbl", "database license", "open (?:data commons open )?database licen[cs]e", ("1 0",)), ("ofl", "open font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
        ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")), ("php", "php license", "php licen[cs]e", ("3 0", "3 01")),
        ("qpl", "q public", "q public licen[cs]e", ("1 0",)), ("ipl", "ibm public", "ibm public licen[cs]e", ("1 0",)), ("sspl", "server side", "server side public licen[cs]e", ("1",)),
        ("busl", "business source", "business source licen[cs]e", ("1 0", "1 1")), ("elastic", "elastic", "elastic licen[cs]e", ("1 0", "2 0")),
    ):
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            add(tag, key, rf"\b{given}{name} v(?:ersion )?{v}\b", 0, 0.9)
            add(tag, key, rf"\b{name} v?(?:ersion )?{v}\b", 1, 0.8)
        add(label, key, rf"\b{given}{name}\b", 2, 0.7)
        add(label, key, rf"\b{name}\b", 3, 0.5)
    # Licenses by name only, and by the sentences they are known for
    for label, key, pattern, weight in (
        ("mit", "mit license", r"mit licen[cs]e", 0.7), ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
        ("x11", "x11 license", r"x11 licen[cs]e", 0.7), ("isc", "isc license", r"isc licen[cs]e", 0.7), ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.95),
        ("bsd-2-clause", "2 clause bsd", r"2 clause bsd(?: licen[cs]e)?", 0.8), ("bsd-3-clause", "3 clause bsd", r"3 clause bsd(?: licen[cs]e)?", 0.8), ("bsd-4-clause", "4 clause bsd", r"4 clause bsd(?: licen[cs]e)?", 0.8),
        ("bsd", "bsd license", r"bsd licen[cs]e", 0.6), ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
        ("bsd-3-clause", "neither the name", r"neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors", 0.9), ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.7),
        ("zlib", "this software is provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors", 0.8),
        ("unlicense", "unlicense", r"(?:the )?unlicense", 0.7), ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain", 0.95),
        ("wtfpl", "do what the", r"do what the fuck you want to public licen[cs]e", 0.95), ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 0.8), ("cc0-1.0", "universal", r"creative ?commons (?:cc0 )?(?:1 0 )?universal", 0.8),
        ("public-domain", "public domain", r"(?:dedicated to|placed in|released (?:in)?to|in) the public domain", 0.6), ("ogl-uk", "open government", r"open government licen[cs]e(?: v?(?:ersion )?\d(?: 0)?)?", 0.7),
        ("json", "good not evil", r"the software shall be used for good not evil", 0.95), ("beerware", "beer", r"beer ?ware licen[cs]e", 0.9), ("python", "python software foundation", r"python software foundation licen[cs]e(?: version 2)?", 0.8),
        ("ruby", "ruby license", r"ruby licen[cs]e", 0.6), ("postgresql", "postgresql", r"postgresql licen[cs]e", 0.8), ("openssl", "openssl", r"openssl licen[cs]e", 0.8), ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e", 0.9),
        ("vim", "vim license", r"vim licen[cs]e", 0.7), ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: v?(?:ersion )?1 0)?", 0.9), ("ngpl", "nethack", r"nethack general public licen[cs]e", 0.9),
        ("commercial", "commercial license", r"commercial licen[cs]e (?:agreement|required)", 0.6), ("proprietary", "proprietary", r"proprietary (?:and|or) confidential", 0.7), ("proprietary", "end user", r"end user licen[cs]e agreement", 0.7),
        ("no-redistribution", "redistribution", r"(?:no|unauthorized) redistribution(?: is)?(?: prohibited| permitted)?", 0.6), ("no-reproduction", "reproduc", r"may not be reproduced(?: or)?(?: distributed| transmitted)?", 0.6),
        ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", 0.4), ("copyright", "all rights reserved", r"all rights reserved", 0.4), ("unknown-license", "the terms", r"(?:licen[cs]ed under|subject to) the terms", 0.3),
        ("unknown-license", "spdx", r"spdx licen[cs]e identifier \w+", 0.4), ("unknown-license", "see the license", r"see the licen[cs]e for the specific language", 0.4),
    ):
        add(label, key, rf"\b{pattern}\b", 0 if weight >= 0.9 else 2 if weight >= 0.6 else 4, weight)
    return rules


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        import ahocorasick

        self.rules = _families() if rules is None else rules
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in {r.keyword, r.keyword.replace("license", "licence")}:
                by_keyword.setdefault(k, []).append(i)
        self.finder = ahocorasick.Automaton()
        for k, which in by_keyword.items():
            self.finder.add_word(k, which)
        self.finder.make_automaton()

    def detections(self, words: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in characters of ``words``, after suppression, by start."""
        tried: set[int] = set()
        for _, which in self.finder.iter(words):
            tried.update(which)
        found = [(m.start(), m.end(), i) for i in sorted(tried) for m in self.compiled[i].finditer(words)]
        rank = lambda d: (self.rules[d[2]].priority, d[2])
        found.sort(key=lambda d: (d[0], -d[1], rank(d)))
        kept: list[tuple[int, int, int]] = []
        open_: list[tuple[int, int, int]] = []  # kept ones that reach past the current start
        for d in found:
            open_ = [k for k in open_ if k[1] > d[0]]
            around = [k for k in open_ if k[0] <= d[0] and d[1] <= k[1]]
            same = next((k for k in around if k[:2] == d[:2]), None)
            if same is not None or any(self.rules[k[2]].priority <= self.rules[d[2]].priority for k in around):
                continue
            kept.append(d)
            open_.append(d)
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,last_word:long>>"
_DETECTION = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def scan_text(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text."""
    words = _GAPS.sub(b" ", text.translate(LOWER_BYTES)).decode().strip(" ")
    places: list[tuple[int, str]] = []
    padded = f" {words} "
    begins: list[int] | None = None

    def word_at(char: int) -> int:
        nonlocal begins
        if begins is None:
            begins = [0, *(m.end() for m in re.finditer(" ", words))]
        return bisect_right(begins, char) - 1

    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append((word_at(at), label))
            at = padded.find(f" {phrase} ", at + 1)
    s = scanner()
    found = s.detections(words)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(s.rules[d[2]].label for d in found)})
    doubt = 1.0
    for rule in sorted({d[2] for d in found}):
        doubt *= 1.0 - s.rules[rule].weight
    for _ in base:
        doubt *= 0.5
    spans = [{"label": s.rules[i].label, "first_word": word_at(a), "last_word": word_at(b - 1)} for a, b, i in found]
    starts = [p for p, _ in places]
    return words.count(" ") + bool(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 - doubt, spans


def scan(docs: DataFrame) -> DataFrame:
    """SCAN of each whole text of ``docs``, one row for each row; other columns are left out.

    n_base, first_word and last_word are of the base phrases alone. labels has theirs and those of the rules' remaining detections.
    score: 1 - product of (1 - weight) over the rules detected and 0.5 over the base labels. Null and
    empty texts have no words, empty label strings and score 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _DETECTION]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in batches:
            for part in slices(batch, "text"):
                out = [scan_text(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, SCAN)
