"""Collocations, vector codes and licences against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sparkrisk.llm import codebooks, collocations, licences

R = random.Random(9)
CLASH = "id long, doc_id long, text string, lang string, score string, n long, phrase string, key long, data string, fp long, label string, code string"


def docs(spark, rows):
    full = [(7, r[0], r[1], r[2] if len(r) > 2 else None, None, 3, "p", 1, None, 4, "l", "c") for r in rows]
    return spark.createDataFrame(full, CLASH).repartition(3)


# ---- collocations ---------------------------------------------------------------------------

def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = (r[2] if len(r) > 2 else None) or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i:i + m]] = max(longer[lang, w[i:i + m]], a)
    out = []
    for (lang, w), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * longer[lang, w] < 80 * a:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def phrase_rows():
    some = ["a", "b", "New", "york", "city", "hall", "ü", "東京", "x y", "q'"]
    rows = []
    for i in range(120):
        words = [R.choice(some) for _ in range(R.randrange(0, 40))]
        text = "".join(w + R.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for w in words)
        rows.append((i if i % 9 else None, text, R.choice(["en", "en", "de", None])))
    rows += [(200 + i, "New york city hall and more") for i in range(9)] + [(500, None), (501, ""), (502, " \t.,!"), (503, "x" * 5000 + " y")]
    return rows + [(1, rows[1][1], rows[1][2])] * 3


@pytest.mark.parametrize("least,top", [(3, 2000), (6, 7)])
def test_collocations(spark, least, top):
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows), least=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, top)


def test_no_collocations(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None), (2, "a b c"), (None, "")])).count() == 0


def test_slices_see_every_gram_once(spark):
    words = [R.choice("abcdefg") * R.randrange(1, 4) for _ in range(600)]
    data = "".join(w + R.choice([" ", "  ", ", "]) for w in words).encode()

    def counted(step):
        block = collocations.Block(collocations._Numbers())
        for index, tokens, carried in collocations.slices(data, step):
            block.add(1, 2, index, tokens, carried)
        block.close()
        found = [block.entries(n, 1, None) for n in (1, 2, 3, 4)]
        merged = [collocations._merged(1)(pd.DataFrame({"n": [n], "data": [collocations.packed(e)]})) for n, e in zip((1, 2, 3, 4), found)]
        return [sorted(zip(m["fp"], m["check"], m["a"])) for m in merged]
    assert counted(7) == counted(64) == counted(1 << 20)


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    """All words have one first hash: the check value alone parts the phrases."""
    monkeypatch.setattr(collocations, "word_hashes", lambda w: (1, collocations.xxhash.xxh3_64_intdigest(w)))
    block = collocations.Block(collocations._Numbers())
    block.add(1, 2, 0, [b"a", b"b", b"a", b"b", b"c", b"a"], 0)
    block.close()
    e = block.entries(2, 1, None)
    got = collocations._merged(1)(pd.DataFrame({"n": [2, 2], "data": [collocations.packed(e)] * 2}))
    assert got["fp"].nunique() == 1 and sorted(got["a"]) == [2, 2, 2, 4]


def test_score_beyond_64_bits(spark):
    """2,000,000 * a of a count of 10 ** 13 still gives the exact score."""
    a = 10 ** 13
    found = spark.createDataFrame([(1, 11, 1, a), (1, 12, 2, a + 7), (2, 13, 3, a)], "n int, fp long, check long, a long")
    read = spark.createDataFrame([("en", 2, "x y", a, 13, 3, [(0, 1, 11, 1), (1, 1, 12, 2)])],
                                 "lang string, n int, phrase string, a long, fp long, check long, parts array<struct<o:long,m:long,fp:long,check:long>>")
    assert [tuple(r) for r in collocations.scored(found, read).collect()] == [("en", "x y", a, a, a + 7, 2000000 * a // (2 * a + 7))]


# ---- vector codes ---------------------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, y in rows:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(4096 * x) for x in v], y))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(first[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == w * parts]
    books = [[r[1][p * w:(p + 1) * w] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    cut = [[r[1][p * w:(p + 1) * w] for p in range(parts)] for r in kept]
    for _ in range(rounds):
        for p in range(parts):
            where = [near(c[p], books[p])[1] for c in cut]
            for k in set(where):
                mine = [c[p] for c, e in zip(cut, where) if e == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for r, e in zip(kept, errors):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, total[r[2]], digest) for r, f, e in zip(kept, found, errors)), key=str)


def vector_rows(n, width=16):
    g = np.random.default_rng(n)
    centres = g.normal(size=(7, width))
    rows = [(i, (centres[i % 7] + g.choice([0.0, 0.05, 0.5]) * g.normal(size=width)).tolist(), [None, 1, 2][i % 3]) for i in range(3, n)]
    rows += [(1000 + i, rows[0][1], 5) for i in range(6)] + [(7, rows[1][1], 1), (7, rows[2][1], 1), (None, rows[3][1], None)]
    return rows + [(900, None, 1), (901, [float("nan")] * width, 1), (902, [None] * width, 1), (903, [float("inf")] * width, None), (904, [0.0] * width, 2)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 3, "x", None) for i, v, y in rows], "vec_id long, embedding array<double>, label int, at long, part string, v string").repartition(3)


@pytest.mark.parametrize("n,block", [(150, 40), (300, 2048), (12, 8)])
def test_vector_codes(spark, n, block):
    rows = vector_rows(n)
    got = codebooks.compressed(vectors(spark, rows), block_rows=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows)


def test_vectors_that_have_no_code(spark):
    rows = vector_rows(20)
    odd = rows + [(5000, [1.0] * 12, 1), (5001, [1.0] * 24, 1), (5002, [], 1), (5003, [1e30] * 16, 1)]
    got = codebooks.compressed(vectors(spark, odd))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows)
    assert codebooks.compressed(vectors(spark, [])).count() == 0
    assert codebooks.compressed(vectors(spark, [(1, None, 2)])).count() == 0


def test_cover_tree_answers_what_all_distances_say():
    g = np.random.default_rng(1)
    points = np.concatenate([g.integers(-5000, 5000, (300, 4)), g.integers(-40, 40, (400, 4)), np.zeros((50, 4), np.int64)])
    order, nodes = codebooks.cover_tree(points)
    assert sorted(order) == list(range(len(points)))
    p = points[order]
    for n in nodes:
        far = np.sqrt(((p[n["start"]:n["stop"]] - p[n["centre"]]) ** 2).sum(1))
        assert far.max() <= n["radius"] + 1e-9
    entries = np.concatenate([g.integers(-3000, 3000, (9, 4)), np.zeros((2, 4), np.int64)])
    assert (codebooks.nearest(p, nodes, entries) == codebooks._squares(p, entries).argmin(1)).all()


# ---- licences -------------------------------------------------------------------------------

def brute_base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


LICENCE_TEXTS = [
    None, "", " \n", "CC BY", "cc by cc by nc", "cc-by/CC_BY cc\nby; cc byx xcc by", "All Rights Reserved. all rights\treserved all rights, reserved",
    "the GNU General Public License, version 3", "general public licenses", "東京 cc by ü", "x " * 3000 + "cc by", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\nfoo", "spdx-license-identifier: (MIT",
    "SPDX-License-Identifier: AND", "SPDX-License-Identifier: MIT */ more words", "SPDX-License-Identifier:", "cc by \udcff".encode("utf-8", "replace").decode(),
]


def test_licence_base(spark):
    pool = ["cc", "by", "nc", "all", "rights", "reserved", "general", "public", "license", "lesser", "x"]
    texts = LICENCE_TEXTS + ["".join(R.choice(pool) + R.choice([" ", ", ", "-", "\n"]) for _ in range(R.randrange(60))) for _ in range(60)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, "CC BY")]
    got = licences.scanned(docs(spark, rows))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = got.collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(((d, *brute_base(t)) for d, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in found)
    by = {r.doc_id: (r.labels, r.score) for r in found}
    assert by[0] == by[1] == by[2] == ("", licences.NONE)
    assert by[11] == ("cc-by,cc-by-nc", 0.2)
    assert by[12] == ("apache,gpl,mit", 0.9) and by[13][0] == "" and by[14][0] == "" and by[15] == ("mit", 0.9)
    assert licences.scanned(docs(spark, [])).count() == 0


def brute_value(tokens):
    """Recursive descent, in the order or, and, with."""
    def either(i, level):
        word = ("or", "and", "with")[level]
        below = (lambda j: either(j, level + 1)) if level < 2 else one
        value, i = below(i)
        while i < len(tokens) and tokens[i] == word:
            other, i = below(i + 1)
            value = {"or": max(value, other), "and": min(value, other), "with": min(1.0, value + licences.EXCEPTION)}[word]
        return value, i

    def one(i):
        if tokens[i] == "(":
            value, i = either(i + 1, 0)
            return value, i + 1
        return licences.FREEDOM.get(licences.family(tokens[i]), licences.UNKNOWN), i + 1
    return either(0, 0)[0]


def random_expression(depth):
    if depth == 0 or R.random() < 0.3:
        return [R.choice(["mit", "gpl-3.0-only", "apache-2.0", "lgpl-2.1+", "mpl-2.0", "odd-1"])]
    inner = random_expression(depth - 1) + [R.choice(["and", "or", "with"])] + random_expression(depth - 1)
    return ["(", *inner, ")"] if R.random() < 0.5 else inner


def test_expressions():
    for _ in range(300):
        tokens = random_expression(4)
        assert licences.evaluate(licences.postfix(tokens))[1] == pytest.approx(brute_value(tokens))
        assert licences.expression(" " + " ".join(tokens) + " tail words")[1] == pytest.approx(brute_value(tokens))
    for bad in (["mit", "mit"], ["and"], ["(", "mit"], ["mit", ")"], ["mit", "or"], [], ["(", ")"]):
        assert licences.postfix(bad) is None
