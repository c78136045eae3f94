"""Licence scan: one Aho-Corasick pass per text, and licence expressions.

The text is lower-cased (A-Z), cut into words of a-z, 0-9 and non-ASCII
characters, and the words are joined by single spaces. One automaton over that
string finds the base phrases, notice phrases and the identifier tag. What
follows a tag on its line is read as a licence expression: a shunting-yard parser
turns and/or/with and parentheses into postfix order, and the postfix form is
evaluated to a freedom value, `or` taking the freer side, `and` the stricter.

Null and empty texts have no words, no places, empty labels and score 0. Rows are
independent: repeated rows give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import prepared

#: Fixed phrases and labels of the base rule.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TAG = "spdx license identifier"
#: Notice phrases with label and weight of evidence.
NOTICES = {
    "mit license": ("mit", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "apache license": ("apache", 0.6),
    "apache license version 2 0": ("apache-2", 0.9),
    "gnu general public license": ("gpl", 0.7),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "creative commons attribution": ("cc-by", 0.6),
    "cc by 4 0": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("all-rights-reserved", 0.8),
}
#: How freely a text under a licence may be used, by the start of its name.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.6, "epl": 0.6,
    "agpl": 0.3, "gpl": 0.4, "all-rights-reserved": 0.0,
}
WEIGHT_BASE, WEIGHT_TAG = 0.9, 1.0
_RANK = {"or": 1, "and": 2, "with": 3}
_SYMBOL = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
_SEPARATORS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_TAG_LINE = re.compile(r"spdx[^\r\n0-9a-z]+license[^\r\n0-9a-z]+identifier[^\r\n0-9a-z(]*([^\r\n]*)")


def freedom(licence: str) -> float:
    """Value of the longest known start of a name; 0.5 for an unknown licence."""
    known = [k for k in FREEDOM if licence == k or licence.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else 0.5


def postfix(symbols: list[str]) -> list[str] | None:
    """Shunting-yard: operators after their operands; None if ill-formed.

    An expression ends where an operand follows an operand, so prose after an
    identifier is not part of it.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    for s in symbols:
        if operand:
            if s == "(":
                held.append(s)
            elif s in _RANK or s == ")":
                return None
            else:
                out.append(s)
                operand = False
        elif s in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[s]:
                out.append(held.pop())
            held.append(s)
            operand = True
        elif s == ")":
            if "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> tuple[float, list[str], str]:
    """Freedom value, licences (without exceptions) and the expression in full
    parentheses, from postfix order."""
    stack: list[tuple[float, list[str], str]] = []
    for s in order:
        if s not in _RANK:
            stack.append((freedom(s), [s], s))
            continue
        (rv, rl, rt), (lv, ll, lt) = stack.pop(), stack.pop()
        if s == "with":
            # an exception grants more, so the licence counts as a step freer
            stack.append((min(1.0, lv + 0.1), ll, f"{lt} with {rt}"))
        else:
            stack.append(((max if s == "or" else min)(lv, rv), ll + rl, f"({lt} {s} {rt})"))
    return stack[0]


def expressions(raw: str) -> list[tuple[float, list[str], str]]:
    """Every well-formed expression after an identifier tag of a lower-cased text."""
    found = []
    for m in _TAG_LINE.finditer(raw):
        order = postfix(_SYMBOL.findall(m[1]))
        if order:
            found.append(evaluate(order))
    return found


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces; the value tells the phrase's length in words."""
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, found_by: ahocorasick.Automaton) -> tuple:
    """Columns of one text, in the order of SCHEMA without the id."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(_SEPARATORS).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base: list[tuple[int, str]] = []
    labels: dict[str, float] = {}
    values: list[float] = []
    tagged, at, seen = False, 0, 0
    for end, phrase in found_by.iter(line):
        if phrase in BASE:
            start = end - len(phrase) - 1
            if start < at:  # a longer phrase may end later yet start earlier
                seen, at = 0, 0
            seen += line.count(" ", at, start + 1)
            at = start + 1
            base.append((seen - 1, BASE[phrase]))
            labels[BASE[phrase]] = max(labels.get(BASE[phrase], 0), WEIGHT_BASE)
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels[label] = max(labels.get(label, 0), weight)
        tagged = tagged or phrase == TAG
    parsed = expressions(raw.decode("utf-8", "replace").lower()) if tagged else []
    for value, licences, _ in parsed:
        values.append(value)
        labels.update(dict.fromkeys(licences, WEIGHT_TAG))
    plain = [freedom(x) for x in labels if not any(x in licences for _, licences, _ in parsed)]
    places = [p for p, _ in base]
    return (
        len(words),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({x for _, x in base})),
        ",".join(sorted(labels)),
        max(labels.values(), default=0.0),
        min(values + plain, default=None),
        " | ".join(t for _, _, t in parsed),
    )


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, freedom double, expression string"
)


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, counts, places, labels, `score` (weight of the
    strongest evidence), `freedom` (of the strictest licence found, null without
    any) and the tagged expressions."""
    prepared(docs.sparkSession)
    schema = f"{doc_id} long, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = automaton()
        for batch in batches:
            rows = [scan(t.as_py(), found_by) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, type=f.type) for c, f in zip(columns, _OUT, strict=True)],
                names=[doc_id, *_OUT.names],
            )

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("text")).mapInArrow(run, schema)


_OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("freedom", pa.float64()),
        ("expression", pa.string()),
    ]
)
