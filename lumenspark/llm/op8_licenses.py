"""License scans: an Aho-Corasick automaton over words, and licence expressions by a shunting-yard parser.

Texts become words (runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased) joined by
single spaces, with one space at either end, so that a phrase matches whole words only. One automaton finds the base
phrases, further notice phrases, and the identifier tag; the raw text behind a tag is parsed as an expression of
identifiers, `and`, `or`, `with` and parentheses. An expression allows reuse if every `and` part does and one `or` part
does; `with` adds an exception to the identifier before it. Broken expressions are read up to the first bad token.

score: how free a document's notices are, from 0 to 1. Without notices it is 0.5; else the lowest value among them:
permissive 1, weak copyleft 0.6, strong copyleft 0.3, use restricted 0.1, an unknown identifier 0.5; an `or` takes the
best of its parts, an `and` the worst.

Cases: a null or empty text has no words, no places and empty labels; repeated documents are judged alike; an empty
table gives no rows; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenspark.llm.batches import map_texts
from lumenspark.llm.op6_decontaminate import _TABLE

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
    "bsd license": "bsd",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    **{f"cc by {version}": "cc-by" for version in ("1 0", "2 0", "2 5", "3 0", "4 0")},
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
VALUES = {
    "mit": 1.0, "mit-text": 1.0, "apache": 1.0, "bsd": 1.0, "bsd-text": 1.0, "isc": 1.0, "cc-by": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "mpl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.3, "agpl": 0.3, "cc-by-nc": 0.1, "all-rights-reserved": 0.1,
}
#: Families of licence identifiers by how free they are; a family stands for its versions and variants (`gpl-2.0-only`).
_CLASSES = {
    1.0: "0bsd afl antlr apache beerware blueoak boost bsd bsl bzip2 cc-by cc-pddc cc0 cecill-b curl ecl efl fair ftl hpnd icu ijg imagemagick intel isc libpng libtiff mit mit-0 mulanpsl naist ncsa ntp odc-by openssl pddl php pil postgresql psf python ruby tcl unicode unlicense upl vsl w3c wtfpl x11 xnet zend zlib zpl",
    0.6: "apsl artistic bittorrent cc-by-sa cddl cecill-c cpl epl erlpl eupl-1.0 interbase ipa ipl lgpl lgplv2 lgplv3 lpl lppl mpl ms-pl ms-rl nasa nokia npl odbl ofl sissl spl sugarcrm vim wxwindows ypl",
    0.3: "agpl agplv3 cecill cpal cua-opl eupl gfdl gpl gplv2 gplv3 honest oclc osl parity qpl rpl sleepycat watcom",
    0.1: "bigscience busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd commons-clause elastic hippocratic json llama openrail polyform proprietary rail sspl",
}
_FAMILIES = {family: value for value, families in _CLASSES.items() for family in families.split()}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_TAG_TEXT = re.compile(r"spdx-license-identifier:", re.I | re.A)
_RANK = {"or": 1, "and": 2, "with": 3}
UNKNOWN = 0.5


def value_of(identifier: str) -> float:
    """The value of the longest family that the identifier is, or begins with before a hyphen or plus sign; else UNKNOWN."""
    low = identifier.lower()
    ends = [len(low), *[i for i, c in enumerate(low) if c in "-+"][::-1]]
    return next((_FAMILIES[low[:i]] for i in ends if low[:i] in _FAMILIES), UNKNOWN)


def tokens_of(text: str, at: int = 0) -> list[str]:
    """Tokens from `at` up to the end of the line or the first thing that can't belong to an expression."""
    out, depth, operand = [], 0, False
    while m := _TOKEN.match(text, at):
        t = m[1]
        low = t.lower()
        if t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif low in _RANK:
            if not operand:
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        out.append(low if low in _RANK else t)
        at = m.end()
    while out and (out[-1] in _RANK or out[-1] == "("):
        depth -= out[-1] == "("
        out.pop()
    return out + [")"] * depth


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: or < and < with, all to the left."""
    out, waiting = [], []
    for t in tokens:
        if t in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            out.append(t)
    while waiting:
        if (t := waiting.pop()) != "(":
            out.append(t)
    return out


def evaluate(text: str, at: int = 0) -> tuple[list[str], float] | None:
    """Identifiers (with their exceptions) and value of the licence expression at `at`; None without an identifier."""
    names: list[str] = []  # of all operands in order
    stack: list[tuple[int, float]] = []  # where an operand's names begin, and its value
    for t in postfix(tokens_of(text, at)):
        if t not in _RANK:
            stack.append((len(names), value_of(t)))
            names.append(t.lower())
            continue
        (right, rv), (left, lv) = stack.pop(), stack.pop()
        if t == "with":
            names[right - 1 :] = [f"{names[right - 1]} with {names[right]}"]
            stack.append((left, max(lv, 0.6) if lv >= 0.3 else lv))
        else:
            stack.append((left, max(lv, rv) if t == "or" else min(lv, rv)))
    return (names[stack[-1][0] :], stack[-1][1]) if stack else None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: TAG}.items():
        a.add_word(f" {phrase} ", (label, phrase in BASE, len(phrase) + 2))
    a.make_automaton()
    return a


_made: list = []


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    if not _made:
        _made.append(_automaton())
    words = text.encode("utf-8", "replace").translate(_TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.5
    line = f" {b' '.join(words).decode('latin-1')} "  # one character a byte: phrases are ASCII
    starts, base, labels, values, tagged = [], set(), set(), [], False
    for end, (label, is_base, size) in _made[0].iter(line):
        if label == TAG:
            tagged = True
            continue
        if is_base:
            starts.append(end + 1 - size)
            base.add(label)
        labels.add(label)
        values.append(VALUES[label])
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            if found := evaluate(text, m.end()):
                labels.update(f"spdx:{x}" for x in found[0])
                values.append(found[1])
    where = [line.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), where[0], where[1], ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.5)


FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
    *[T.StructField(c, T.StringType()) for c in ("base_labels", "labels")],
    T.StructField("score", T.DoubleType()),
]


def report(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, one row per document."""
    return map_texts(docs, ["doc_id"], "text", FIELDS, lambda texts: [list(c) for c in zip(*map(scan, texts), strict=True)])
