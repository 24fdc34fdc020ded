"""License scans: an Aho-Corasick automaton for notices and tags, expressions by shunting-yard.

A text is lower-cased (A-Z only) and cut into words of letters, digits and non-ASCII
characters. The automaton finds every place where the words of a known phrase stand
consecutively, whatever separates them; phrases may overlap. An identifier tag starts a
licence expression that runs to the end of its line; it is parsed into reverse Polish form
and evaluated.

Missing texts count as empty. Empty texts have no words, no labels and score 0. A malformed
expression adds the identifiers it names but counts as half the evidence. Repeated rows get
the same answer each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases of the base scan, as words, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Further notices that this scan knows.
NOTICE_PHRASES = (
    ("licensed under the apache license", "apache-2"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl-3"),
    ("mozilla public license version 2", "mpl-2"),
    ("eclipse public license", "epl"),
    ("bsd 2 clause license", "bsd-2"),
    ("bsd 3 clause license", "bsd-3"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by 4 0", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)

TAG = "spdx license identifier"

# Identifiers of expressions, lower case, with their labels.
IDENTIFIERS = {
    "mit": "mit",
    "isc": "isc",
    "apache-2.0": "apache-2",
    "bsd-2-clause": "bsd-2",
    "bsd-3-clause": "bsd-3",
    "mpl-2.0": "mpl-2",
    "gpl-2.0": "gpl-2",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "agpl-3.0": "agpl-3",
    "epl-2.0": "epl",
    "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc0-1.0": "public-domain",
    "unlicense": "public-domain",
}
PERMISSIVE = {"mit", "isc", "apache-2", "bsd", "bsd-2", "bsd-3", "cc-by", "public-domain"}
STRENGTH = {"or": 1, "and": 2, "with": 3}

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("permissive", pa.bool_()),
        ("expressions", pa.list_(pa.string())),
    ]
)

# Bytes to word characters or blanks: A-Z to a-z, other ASCII but digits and a-z to a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n*/\"'<>]+)")
_TOKENS = re.compile(r"\(|\)|[a-z0-9.+:-]+")


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form of an expression; None if it is malformed.

    ``with`` binds tighter than ``and``, and that tighter than ``or``; all bind to the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in STRENGTH:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels that the expression names, and whether its terms allow permissive use.

    One permissive side of an ``or`` is enough, ``and`` needs both, and an exception after
    ``with`` leaves its licence as it was. Unknown identifiers label themselves and are not
    permissive.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in STRENGTH:
            (right, free_right), (left, free_left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, free_left))
            elif token == "and":
                stack.append((left | right, free_left and free_right))
            else:
                stack.append((left | right, free_left or free_right))
        else:
            label = IDENTIFIERS.get(token.rstrip("+"), token)
            stack.append(({label}, label in PERMISSIVE))
    return stack.pop()


def build_automaton():
    """Phrases between blanks; the value says how long a phrase is, its label, and if it is base."""
    import ahocorasick

    found: dict[str, list[tuple[str, bool]]] = {}
    for phrases, base in ((BASE_PHRASES, True), (NOTICE_PHRASES, False), (((TAG, ""),), False)):
        for phrase, label in phrases:
            found.setdefault(f" {phrase} ", []).append((label, base))
    automaton = ahocorasick.Automaton()
    for phrase, labels in found.items():
        automaton.add_word(phrase, (len(phrase), labels))
    automaton.make_automaton()
    return automaton


def scan_text(text: str, automaton) -> tuple:
    """n_words, n_base, first, last, base labels, labels, score, permissive, expressions."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    evidence = 0.0
    tagged = False
    counted, at = 0, 0
    for end, (length, found) in automaton.iter(line):
        start = end - length + 1
        for label, is_base in found:
            if not label:
                tagged = True
                continue
            labels.add(label)
            evidence += 1.0
            if is_base:
                # Ends only grow, starts nearly: count the blanks from the last place on.
                if start >= counted:
                    at += line.count(" ", counted, start)
                    counted = start
                    places.append(at)
                else:
                    places.append(line.count(" ", 0, start))
                base.add(label)
    permissive = [label in PERMISSIVE for label in labels]
    expressions = []
    if tagged:
        for written in _TAGGED.findall(text.lower()):
            expression = written.strip()
            tokens = _TOKENS.findall(expression)
            if not tokens:
                continue
            expressions.append(expression)
            postfix = to_postfix(tokens)
            if postfix is None:
                names = {IDENTIFIERS[t.rstrip("+")] for t in tokens if t.rstrip("+") in IDENTIFIERS}
                labels |= names
                evidence += 1.0
                permissive.append(False)
            else:
                names, free = evaluate(postfix)
                labels |= names
                evidence += 2.0
                permissive.append(free)
    return (
        len(words),
        len(places),
        min(places) if places else None,
        max(places) if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1.0 - 0.5**evidence,
        all(permissive) if permissive else None,
        expressions,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = build_automaton()
    for batch in batches:
        rows = [scan_text(t or "", automaton) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[] for _ in SCHEMA.names[1:]]
        arrays = [batch.column(0)] + [
            pa.array(list(c), f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: see SCHEMA. No shuffle; documents are read in small batches."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        _scan,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
        " base_labels string, labels string, score double, permissive boolean,"
        " expressions array<string>",
    )
