"""Licence notices and identifier tags in texts.

One Aho-Corasick automaton per task finds the notice phrases in the text's
words.  Identifier tags (``SPDX-License-Identifier: <expression>``) are found by
the same automaton; the expression behind a tag is evaluated by a shunting-yard
parser for ``and``, ``or``, ``with`` and brackets, and its licences add labels.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import LOWER, NON_ALNUM, Words, slices

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices, which add labels but are no base places.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "for any purpose with or without fee is hereby granted provided that": "isc",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution 3 0": "cc-by",
    "creative commons attribution 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "the unlicense": "unlicense",
    "free and unencumbered software released into the public domain": "unlicense",
}
#: what tags write for no licence at all, or none that is known
NO_LICENCE = {"none", "noassertion"}
#: a family and the version behind it
VERSIONED = re.compile(r"([a-z][a-z0-9.-]*?)-v?[0-9]")
#: identifiers without a version: known even when other text follows on the line
PLAIN = {
    *("mit", "isc", "unlicense", "zlib", "0bsd", "x11", "ncsa", "ntp", "curl", "ruby", "vim", "wtfpl", "beerware"),
    *("postgresql", "openssl", "libpng", "libtiff", "ijg", "icu", "ftl", "hpnd", "json", "info-zip", "tcl", "sleepycat"),
}
TAG = "spdx license identifier"
LINE_AFTER_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n*/]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")
#: binding strength
OPERATORS = {"with": 3, "and": 2, "or": 1}


class BadExpression(ValueError):
    pass


def parse_expression(text: str) -> list[str]:
    """A licence expression in postfix order, operators last.

    Reads as far as tokens form an expression; raises when nothing does.
    """
    return _parse(text)[0]


def _parse(text: str) -> tuple[list[str], bool]:
    """The expression in postfix order, and whether no word of the text is left over."""
    out: list[str] = []
    waiting: list[str] = []
    wants_name = True
    whole = False
    for token in TOKEN.findall(text.lower()):
        if token == "(":
            if not wants_name:
                break
            waiting.append(token)
        elif token == ")":
            if wants_name or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in OPERATORS:
            if wants_name:
                break
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            wants_name = True
        else:
            if not wants_name:
                break
            out.append(token)
            wants_name = False
    else:
        whole = not wants_name
    if wants_name and waiting and waiting[-1] in OPERATORS:
        waiting.pop()  # an operator without a right side is not part of it
    if "(" in waiting or not out:
        raise BadExpression(text)
    return out + waiting[::-1], whole


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The choices an expression leaves: each a set of licences that hold together."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in OPERATORS:
            stack.append([frozenset([token])])
            continue
        if len(stack) < 2:
            raise BadExpression(" ".join(postfix))
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif token == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:  # an exception: the licence it goes with stays
            stack.append(left)
    if len(stack) != 1:
        raise BadExpression(" ".join(postfix))
    return stack[0]


def label_of(identifier: str, whole: bool = True) -> str | None:
    """The family of a licence identifier (lower case), or itself where it has none.

    A version and what follows it (-only, -or-later, a country) is left out, a + too.  A name
    that is neither versioned nor known counts only in an expression that is a
    whole line, as it may be a word of a sentence.
    """
    name = identifier.rstrip("+.-")
    if not name or name in NO_LICENCE:
        return None
    if name.startswith(("licenseref-", "documentref-")):
        return name
    if name.startswith("bsd-"):
        return "bsd"
    versioned = VERSIONED.match(name)
    if versioned:
        return versioned[1]
    name = name.removesuffix("-or-later").removesuffix("-only")
    return name if whole or name in PLAIN else None


def licences(postfix: list[str]) -> list[str]:
    """All licences of an expression, as the union of its choices has them, in any length."""
    stack: list[list[str]] = []
    for token in postfix:
        if token not in OPERATORS:
            stack.append([token])
            continue
        if len(stack) < 2:
            raise BadExpression(" ".join(postfix))
        right = stack.pop()
        if token != "with":
            stack[-1] += right
    if len(stack) != 1:
        raise BadExpression(" ".join(postfix))
    return stack[0]


#: how much a family asks of those who use a text: a choice goes to the least; all others ask 2
BURDEN = {
    **dict.fromkeys(("mit", "bsd", "apache", "isc", "zlib", "unlicense", "cc0", "0bsd", "cc-by", "bsl"), 0),
    **dict.fromkeys(("lgpl", "mpl", "epl", "cddl", "cc-by-sa"), 1),
    "agpl": 3,
}


def chosen(postfix: list[str], whole: bool = True) -> list[str]:
    """The labels that hold after every ``or`` went to its lighter side: all of an ``and``, none of the side left.

    A side weighs what its heaviest licence asks, then the number of its licences; the left one
    wins a tie.  One pass, however many choices the expression has.
    """
    stack: list[tuple[tuple[int, int], dict[str, None]]] = []
    for token in postfix:
        if token not in OPERATORS:
            label = label_of(token, whole)
            stack.append(((BURDEN.get(label, 2), 1), {} if label is None else {label: None}))
            continue
        if len(stack) < 2:
            raise BadExpression(" ".join(postfix))
        (right, more), (left, own) = stack.pop(), stack.pop()
        if token == "with":  # an exception: the licence it goes with stays
            stack.append((left, own))
        elif token == "or":
            stack.append((left, own) if left <= right else (right, more))
        else:
            stack.append(((max(left[0], right[0]), left[1] + right[1]), own | more))
    if len(stack) != 1:
        raise BadExpression(" ".join(postfix))
    return list(stack[0][1])


def tag_labels(text: str) -> tuple[set[str], set[str], bool]:
    """Labels of all tags in a text, those that hold by choice, and whether some tag names unknown licences only."""
    labels: set[str] = set()
    held: set[str] = set()
    unknown = False
    for m in LINE_AFTER_TAG.finditer(text):
        try:
            postfix, whole = _parse(m[1])
            names = licences(postfix)
        except BadExpression:
            unknown = True
            continue
        found = {x for x in (label_of(name, whole) for name in names) if x}
        labels |= found
        held.update(chosen(postfix, whole))
        unknown |= not found
    return labels, held, unknown


def automaton(phrases):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in (*phrases, TAG):
        # words are set off by spaces on both sides; neighbours share one
        machine.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    machine.make_automaton()
    return machine


def _scan(phrases: dict[str, str], notices: dict[str, str]):
    space = np.uint8(0x20)

    def run(batches):
        machine = automaton({**notices, **phrases})
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                n = b - a
                plain = np.where(NON_ALNUM[words.data], space, words.data).tobytes()
                texts = batch.column("text").slice(a, n)
                n_base, first, last, base, labels, score, hold = [], [], [], [], [], [], []
                for d in range(n):
                    starts, kinds, others, tagged, blanks = [], [], [], False, None
                    # one byte is one character here; single spaces between words and at both ends
                    joined = b" ".join(plain[offsets[d] : offsets[d + 1]].split())
                    text = f" {joined.decode('latin-1')} "
                    for end, (phrase, size) in machine.iter(text):
                        if phrase == TAG:
                            tagged = True
                            continue
                        if phrase not in phrases:
                            others.append(notices[phrase])
                            continue
                        if blanks is None:  # words before each place, counted once
                            blanks = np.cumsum(np.frombuffer(f" {text}".encode("latin-1"), np.uint8) == space) - 1
                        starts.append(int(blanks[end - size + 1]))
                        kinds.append(phrases[phrase])
                    own = set(kinds)
                    more, held, unknown = tag_labels(texts[d].as_py()) if tagged else (set(), set(), False)
                    n_base.append(len(starts))
                    first.append(min(starts) if starts else None)
                    last.append(max(starts) if starts else None)
                    base.append(",".join(sorted(own)))
                    labels.append(",".join(sorted(own | more | set(others))))
                    score.append(_score(len(starts) + len(others), int(words.count[d]), bool(more), bool(held), unknown))
                    hold.append(sorted(held))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, n),
                        pa.array(words.count, pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array(base, pa.string()),
                        pa.array(labels, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(hold, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licences"],
                )

    return run


def _score(places: int, n_words: int, tagged: bool, held: bool, unknown: bool) -> float:
    """How sure it is that the text states a licence: a known tag 1 (0.9 when the licences
    that hold by choice are unknown ones); an unknown tag 0.7;
    phrases 0.5 and up by their number, less in texts where they are a small part."""
    if tagged:
        return 1.0 if held else 0.9
    if not places:
        return 0.7 if unknown else 0.0
    share = min(1.0, 50.0 * places / max(1, n_words))
    return max(0.7 if unknown else 0.0, 0.5 + 0.2 * (1 - 0.5**places) + 0.2 * share)


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, licences`` per document.

    ``licences`` are the labels that hold after every choice (or) of a tag's expression went to the
    licence that asks least, sorted; empty without tags.

    A null or empty text has no words, no labels (empty strings) and score 0.
    Places may overlap and each counts; equal rows give equal results.  The base columns
    are those of ``phrases``; ``notices`` and tags add to ``labels`` and ``score``.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan(dict(phrases), dict(notices)),
        "doc_id BIGINT, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, "
        "base_labels STRING, labels STRING, score DOUBLE, licences ARRAY<STRING>",
    )
