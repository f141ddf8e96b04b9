"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags, expressions are parsed and evaluated.

Phrases are sought in the words of a text, whatever stands between them. An identifier tag is followed by an
expression of identifiers, ``and``, ``or``, ``with`` and brackets; a shunting-yard parser puts it in postfix order, and
evaluating that gives the licences named and how freely the text may be used: the least of all that must hold
(``and``), the most of those one may choose from (``or``), a little more with an exception (``with``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import whole_text

# --- fixed values: phrases (words), their labels, and how freely a licence lets its texts be used -----------------
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "eclipse public license": "epl", "isc license": "isc", "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons attribution": "cc-by",
    "creative commons zero": "cc0", "public domain": "public-domain", "proprietary and confidential": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.0, "proprietary": 0.0,
}
#: A licence nobody knows, a text without any, and what an exception adds.
UNKNOWN, NONE, EXCEPTION = 0.1, 0.5, 0.1
_RANK = {"or": 1, "and": 2, "with": 3}
# ------------------------------------------------------------------------------------------------------------------
_PLAIN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+")
#: Lower-case names of licences by how their identifiers begin, longest first.
_FAMILIES = sorted(FREEDOM, key=len, reverse=True)


def family(identifier: str) -> str:
    """The licence an identifier is of (``gpl-3.0-or-later``: ``gpl``), or the identifier itself."""
    name = identifier.rstrip("+")
    return next((f for f in _FAMILIES if name == f or name.startswith(f + "-")), name)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order; null where the expression isn't whole."""
    out, held, operand = [], [], True  # operand: an identifier or an opening bracket comes next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> tuple[set[str], float]:
    """Licences named and how free the whole is, from an expression in postfix order."""
    held: list[tuple[set[str], float]] = []
    for t in order:
        if t in _RANK:
            (right, b), (left, a) = held.pop(), held.pop()
            held.append((left, min(1.0, a + EXCEPTION)) if t == "with" else (left | right, min(a, b) if t == "and" else max(a, b)))
        else:
            held.append(({family(t)}, FREEDOM.get(family(t), UNKNOWN)))
    return held.pop()


def expression(text: str, at: int = 0) -> tuple[set[str], float] | None:
    """The longest whole expression that begins at a place of a (lower-case) text and stays on its line, evaluated.

    It ends before whatever can't continue it: a second name, a bracket that nothing opened, another character.
    """
    tokens, depth, operand, whole = [], 0, True, 0
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        found = _TOKEN.match(text, at)
        t = found.group() if found else None
        if t is None or operand == (t in _RANK or t == ")"):
            break
        if t == ")" and not depth:
            break
        depth += (t == "(") - (t == ")")
        operand = t in _RANK or t == "("
        tokens.append(t)
        at = found.end()
        if not operand and not depth:
            whole = len(tokens)
    return evaluate(postfix(tokens[:whole])) if whole else None


def _automaton(patterns) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern, value in patterns:
        out.add_word(pattern, value)
    out.make_automaton()
    return out


_WORDS = _automaton((f" {p} ", (p, label, table is BASE)) for table in (BASE, NOTICES) for p, label in table.items())
_TAGGED = _automaton((t, len(t)) for t in TAGS)


def _notices(words: list[bytes]) -> Iterator[tuple[int, int, str, bool]]:
    """First word, word after the last, label, whether it is a base phrase; in order of place, longer ones first."""
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = list(_WORDS.iter(joined))
    if hits:
        gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32) == 32)  # word k comes after gap k
        after = np.searchsorted(gaps, [end for end, _ in hits])
        found = [(int(b) - p.count(" ") - 1, int(b), label, is_base) for b, (_, (p, label, is_base)) in zip(after, hits)]
        yield from sorted(found, key=lambda h: (h[0], -h[1]))


def scan(data: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = data.translate(_PLAIN).split()
    places, base, labels, scores, reach = [], set(), set(), [], 0
    for start, after, label, is_base in _notices(words):
        labels.add(label)
        if is_base:
            places.append(start)
            base.add(label)
        if after > reach:  # else a longer notice around it says what its words mean: "cc by" in "cc by nc"
            scores.append(FREEDOM[label])
            reach = after
    lower = data.lower()
    if b"license" in lower:
        text = lower.decode("utf-8", "replace")
        for end, _ in _TAGGED.iter(text):
            found = expression(text, end + 1)
            if found:
                labels |= found[0]
                scores.append(found[1])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            float(min(scores)) if scores else NONE)


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Null and empty texts have no words, no labels (empty strings) and the score of a text without a licence; repeated rows are
    scanned each. The score is the least of all notices and expressions of the text. A tag without a whole expression is
    no label. One pass over two columns, no shuffle; a text is held whole, with its words, by one worker at a time.
    """
    kind = docs.schema[id].dataType.simpleString()
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["id", *fields])
    rows = docs.select(F.col(f"`{id}`").alias("id"), whole_text(text).cast("binary").alias("data"))
    out = rows.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id)
