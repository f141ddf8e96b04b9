"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, counted in a shuffle, read back where they are frequent.

Prefix polynomials over the word hashes give the fingerprint of any n-gram by one subtraction. Fingerprints travel
with a count and a pointer to an occurrence (a document's key, the index of the first token). Phrases only exist
for frequent fingerprints: the pointer's text is read again, and a phrase counts only if the words found there
have the fingerprint. A part of a frequent phrase is at least as frequent, so n-grams with an infrequent
part are left out before the shuffle, by a filter of bounded size that lets some through and stops none wrongly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.session import materialized
from .tables import short_batches, whole_text

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
#: Bytes of text for one bucket of fingerprints, tokens of one block, bytes of a long text that are cut into words at once.
BUCKET_BYTES, BLOCK_TOKENS, SLICE_BYTES = 1 << 23, 1 << 19, 1 << 20
#: Bits of the filter at most (32 MB); where more n-grams are frequent it lets more through, with the same result.
MOST_FILTER_BITS = 1 << 28
ENTRY = np.dtype([("fp", "<u8"), ("key", "<i8"), ("check", "<u4"), ("count", "<u4"), ("start", "<u4")])
_PLANES = ("<u8", "<u4", "<u4", "<u4")  # steps between fingerprints, counts, starts, places of keys
_BREAK = b"\xff"  # no UTF-8 text holds this byte
_CUTS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BASES = tuple(int(x) | 1 for x in np.random.default_rng(23).integers(1 << 60, 1 << 63, 2))
_U = np.uint64


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(n, base, dtype=_U)]), dtype=_U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def word_hashes(word: bytes) -> tuple[int, int]:
    """Two independent hashes of 64 bits; a word's own bytes are all that counts."""
    both = xxhash.xxh3_128_intdigest(word)
    return both & 0xFFFFFFFFFFFFFFFF, both >> 64


class _Numbers(dict):
    """Numbers of words, given on first sight; number 0 is the break between pieces."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def hashes(self) -> np.ndarray:
        return np.array([word_hashes(w) for w in self], dtype=_U).reshape(-1, 2)


def slices(data: bytes, step: int | None = None) -> Iterator[tuple[int, list[bytes], int]]:
    """Tokens of a text, breaks between pieces included, in bounded slices: index of the first token, tokens, and
    how many of them were in the slice before (so that n-grams across a cut are seen, once)."""
    step = step or SLICE_BYTES
    at, index, carried = 0, 0, []
    while at < len(data):
        end = len(data)
        if at + step < end:
            cut = data.find(b" ", at + step)
            end = cut if cut >= 0 else end
        found = data[at:end].translate(_CUTS).lower().replace(b"\n", b" \xff ").split()
        yield index - len(carried), carried + found, len(carried)
        index += len(found)
        carried = (carried + found)[-(LONGEST - 1):]
        at = end


def packed(e: np.ndarray) -> bytes:
    """Entries in order of fp, for the shuffle: steps instead of fingerprints, each key once, and numbers byte by byte
    (all lowest bytes, then all second ones, …), so that what is mostly zero compresses to nothing."""
    keys, place = np.unique(e["key"], return_inverse=True)
    numbers = (np.diff(e["fp"], prepend=_U(0)), e["count"], e["start"], place)
    planes = [np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(len(e), -1).T).tobytes() for x, t in zip(numbers, _PLANES)]
    return b"".join([np.array([len(e), len(keys)], dtype="<u4").tobytes(), keys.tobytes(), e["check"].tobytes(), *planes])


def unpacked(data: bytes) -> np.ndarray:
    n, m = (int(x) for x in np.frombuffer(data, dtype="<u4", count=2))
    out, at = np.zeros(n, dtype=ENTRY), 8 + 8 * m
    keys = np.frombuffer(data, dtype="<i8", count=m, offset=8)
    out["check"] = np.frombuffer(data, dtype="<u4", count=n, offset=at)
    at, numbers = at + 4 * n, []
    for t in _PLANES:
        size = np.dtype(t).itemsize
        numbers.append(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(t).ravel())
        at += n * size
    out["fp"], out["count"], out["start"], out["key"] = np.cumsum(numbers[0], dtype=_U), numbers[1], numbers[2], keys[numbers[3]]
    return out


class Block:
    """Tokens of some slices side by side, and the fingerprints of their n-grams."""

    def __init__(self, numbers: _Numbers):
        self.numbers, self.parts, self.size = numbers, [], 0

    def add(self, key: int, lang: int, index: int, tokens: list[bytes], carried: int) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        self.parts.append((key, lang, index, ids, carried))
        self.size += len(ids) + 1

    def close(self) -> "Block":
        self.parts.sort(key=lambda p: p[0])  # the least key comes first wherever n-grams are equal
        sizes = np.array([len(p[3]) + 1 for p in self.parts])
        zero = np.zeros(1, dtype=np.int32)
        self.ids = np.concatenate([x for p in self.parts for x in (p[3], zero)])
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.keys = np.array([p[0] for p in self.parts], dtype=np.int64)
        self.langs = np.array([p[1] for p in self.parts], dtype=_U)
        begin = np.cumsum(sizes) - sizes
        self.index = np.arange(len(self.ids)) - begin[self.of] + np.array([p[2] for p in self.parts])[self.of]
        self.new = np.arange(len(self.ids)) - begin[self.of] >= np.array([p[4] for p in self.parts])[self.of]
        self.breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.ids == 0, dtype=np.int32)])
        hashes, n = self.numbers.hashes(), len(self.ids)
        size = max(2 * BLOCK_TOKENS, 1 << n.bit_length())  # few different lengths of the tables of powers
        self.sums = [np.concatenate([[_U(0)], np.cumsum(hashes[self.ids, k] * _powers(b, size)[:n], dtype=_U)]) for k, b in enumerate(_BASES)]
        self.back = [_powers(pow(b, -1, 1 << 64), size) for b in _BASES]
        return self

    def fingerprints(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check value of the n-grams that begin at the given tokens."""
        tag = self.langs[self.of[at]] + _U(n * 0x9E3779B97F4A7C15 % (1 << 64))
        one, two = (_mixed((s[at + n] - s[at]) * b[at] + tag) for s, b in zip(self.sums, self.back))
        return one, (two >> _U(32)).astype(np.uint32)

    def places(self, n: int) -> np.ndarray:
        """Where an n-gram begins that lies in one piece and ends in the new part of a slice."""
        last = len(self.ids) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero((self.breaks[n:] == self.breaks[:last]) & self.new[n - 1:])

    def entries(self, n: int, m: int, allowed: np.ndarray | None) -> np.ndarray:
        """One entry per different n-gram whose m-grams all pass the filter."""
        at = self.places(n)
        if allowed is not None:
            last = len(self.ids) - m + 1
            fine = np.zeros(len(self.ids) + LONGEST, dtype=bool)
            fine[:last] = passes(allowed, self.fingerprints(np.arange(last), m)[0]) if last > 0 else False
            for k in range(n - m + 1):
                at = at[fine[at + k]]
        fp, check = self.fingerprints(at, n)
        order = np.argsort(fp, kind="stable")
        fp, check = fp[order], check[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(fp)), bool), (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
        out = np.zeros(len(first), dtype=ENTRY)
        out["fp"], out["check"], out["count"] = fp[first], check[first], np.diff(np.append(first, len(fp)))
        where = at[order[first]]
        out["key"], out["start"] = self.keys[self.of[where]], self.index[where]
        return out


def passes(allowed: np.ndarray, fp: np.ndarray) -> np.ndarray:
    bit = fp & _U(len(allowed) * 8 - 1)
    return (allowed[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8) & 1).astype(bool)


def _filter(table: DataFrame, column: str = "fp") -> np.ndarray:
    """A filter of at least 16 bits a row, MOST_FILTER_BITS at most, that lets all values of the column through."""
    bits = min(MOST_FILTER_BITS, max(1 << 12, 1 << (16 * table.count()).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = table.groupBy(F.shiftright(bit, 3).cast("int").alias("at")).agg(
        F.bit_or(F.get(F.array(*[F.lit(1 << k) for k in range(8)]), bit.bitwiseAND(F.lit(7)).cast("int"))).alias("v")).toPandas()
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).astype(np.uint8)
    return out


def _chunks(sizes: tuple[int, ...], m: int, allowed: np.ndarray | None, buckets: int, totals: bool):
    """Entries of each block, cut into one row per size and bucket of fingerprints; the words per language beside them."""
    def flush(block: Block) -> Iterator[tuple]:
        block.close()
        for n in sizes:
            found = block.entries(n, m, allowed)  # in order of fp, so buckets are runs
            bucket = (found["fp"] >> _U(40)).astype(np.int64) * buckets >> 24
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(found)]):
                yield n, int(bucket[a]), None, 0, packed(found[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["n", "bucket", "lang", "total", "data"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=fields)
        words: dict[str, int] = {}
        block = Block(_Numbers())
        for batch in batches:
            for key, lang, data in zip(*(batch.column(i) for i in range(3))):
                key, lang, data = key.as_py(), lang.as_py(), data.as_py()
                tag = word_hashes(lang.encode())[0]
                for index, tokens, carried in slices(data):
                    block.add(key, tag, index, tokens, carried)
                    if totals:
                        words[lang] = words.get(lang, 0) + int((block.parts[-1][3][carried:] > 0).sum())
                    if block.size >= BLOCK_TOKENS:
                        yield batch_of(list(flush(block)))
                        block = Block(_Numbers())
                        pa.default_memory_pool().release_unused()
        if block.parts:
            yield batch_of(list(flush(block)))
        if words:
            yield batch_of([(0, 0, lang, n, None) for lang, n in words.items()])
    return run


def _merged(least: int):
    """Entries of one bucket added up; the frequent ones, each with the pointer of the least key."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([unpacked(d) for d in rows["data"]])
        e = e[np.lexsort((e["key"], e["check"], e["fp"]))]
        first = np.flatnonzero(np.concatenate([[True], (e["fp"][1:] != e["fp"][:-1]) | (e["check"][1:] != e["check"][:-1])]))
        a = np.add.reduceat(e["count"].astype(np.int64), first)
        e, a = e[first][a >= least], a[a >= least]
        return pd.DataFrame({"n": np.full(len(e), rows["n"].iloc[0], dtype=np.int32), "fp": e["fp"].astype(np.int64), "check": e["check"].astype(np.int64),
                             "a": a, "key": e["key"], "start": e["start"].astype(np.int64)})
    return merge


def _keyed(docs: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """``key``, ``lang``, ``data``: the key is of id, language and text, and less the longer the text is, so that pointers
    gather in few documents."""
    data = whole_text(text).cast("binary")
    name = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    size = F.length(F.conv(F.octet_length(data).cast("string"), 10, 2))
    key = F.shiftleft((F.lit(31) - F.least(size, F.lit(31))).cast("long"), 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64(f"`{id}`", name, data), 6))
    return docs.select(key.alias("key"), name.alias("lang"), data.alias("data"))


def frequent(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Tables of the frequent n-grams (``n``, ``fp``, ``check``, ``a``, ``key``, ``start``) and of words (``lang``, ``total``).

    Words first, then pairs of frequent words, then longer n-grams of frequent pairs. Number of buckets follows the
    bytes of text, so a group that one task merges is bounded.
    """
    texts = _keyed(docs, id, text, lang)
    size = texts.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    buckets = min(1 << 23, max(1, math.ceil(size / BUCKET_BYTES)))
    schema = "n int, bucket int, lang string, total long, data binary"
    out, found, words = None, None, None
    for sizes, m in (((1,), 1), ((2,), 1), (tuple(range(3, LONGEST + 1)), 2)):
        allowed = None if found is None else _filter(found)
        with short_batches(docs.sparkSession):
            chunks = texts.mapInArrow(_chunks(sizes, m, allowed, buckets, words is None), schema)
            if words is None:
                chunks = materialized(chunks)
                words = materialized(chunks.where("n = 0").groupBy("lang").agg(F.sum("total").alias("total")))
            found = materialized(chunks.where("n > 0").groupBy("n", "bucket").applyInPandas(
                _merged(least), "n int, fp long, check long, a long, key long, start long"))
        out = found if out is None else out.unionByName(found)
    return out, words


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted phrases of each document, with the fingerprints of all their parts; others' words are passed over."""
    for batch in batches:
        for lang, data, wanted in zip(*(batch.column(i) for i in range(3))):
            lang, data = lang.as_py(), data.as_py()
            want = wanted.values.flatten()
            start, size, a, fp, check = (np.asarray(x) for x in want)
            tag = word_hashes(lang.encode())[0]
            for index, tokens, carried in slices(data):
                block = Block(_Numbers())
                block.add(0, tag, index, tokens, carried)
                block.close()
                for n in range(2, LONGEST + 1):
                    mine = np.flatnonzero((size == n) & (start >= index) & (start + n <= index + len(tokens)) & (start + n > index + carried))
                    at = start[mine] - index
                    one, two = block.fingerprints(at, n)
                    true = (one.astype(np.int64) == fp[mine]) & (two.astype(np.int64) == check[mine]) & (block.breaks[at + n] == block.breaks[at])
                    mine, at = mine[true], at[true]
                    if not len(mine):
                        continue
                    cells = [(o, m, *block.fingerprints(at + o, m)) for m in range(1, n) for o in range(n - m + 1)]
                    table = lambda k: np.stack([np.broadcast_to(c[k], at.shape) for c in cells], axis=1).astype(np.int64).ravel()
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(cells)), pa.StructArray.from_arrays(
                        [pa.array(table(k)) for k in range(4)], names=["o", "m", "fp", "check"]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array([b" ".join(tokens[x:x + n]) for x in at], pa.binary()),
                         pa.array(a[mine]), pa.array(fp[mine]), pa.array(check[mine]), parts], names=["lang", "n", "phrase", "a", "fp", "check", "parts"])


def phrases(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``n``, ``phrase``, ``a``, ``fp``, ``check``, ``parts`` of the frequent n-grams of two words or more, read at their pointers."""
    wanted = found.where("n > 1").groupBy("key").agg(F.collect_list(F.struct("start", F.col("n").cast("long").alias("n"), "a", "fp", "check")).alias("wanted"))
    wanted = materialized(wanted)
    allowed = _filter(wanted, "key")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(allowed, np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))))
    with short_batches(docs.sparkSession):
        texts = _keyed(docs, id, text, lang).mapInArrow(near, "key long, lang string, data binary")
        read = texts.join(wanted, "key").select("lang", "data", "wanted").mapInArrow(
            _read, "lang string, n int, phrase binary, a long, fp long, check long, parts array<struct<o:long,m:long,fp:long,check:long>>")
        return materialized(read.dropDuplicates(["fp", "check"]).withColumn("phrase", F.col("phrase").cast("string")))


def scored(found: DataFrame, read: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates with ``l``, ``r`` and ``score`` of their lowest-scoring cut, without those that a longer one covers."""
    cells = read.select("n", "a", F.col("fp").alias("of"), F.col("check").alias("of_check"), F.explode("parts").alias("p")).select("n", "a", "of", "of_check", "p.*")
    ends = cells.where((F.col("o") == 0) | (F.col("o") + F.col("m") == F.col("n")))
    counts = found.select("fp", "check", F.col("a").alias("f"))
    cut = F.when(F.col("o") == 0, F.col("m")).otherwise(F.col("o"))
    sides = ends.join(counts, ["fp", "check"]).groupBy("of", "of_check", "a", cut.alias("k")).agg(
        F.max(F.when(F.col("o") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("o") > 0, F.col("f"))).alias("r"))
    # 2,000,000 * a may pass 64 bits, so the quotient is one of decimals
    sides = sides.withColumn("score", F.expr("cast((2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    best = sides.groupBy("of", "of_check").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    over = cells.where("m > 1").groupBy("fp", "check").agg(F.max("a").alias("longer"))
    best = best.select(F.col("of").alias("fp"), F.col("of_check").alias("check"), "cut.l", "cut.r", "cut.score")
    rows = read.select("lang", "phrase", "a", "fp", "check").join(best, ["fp", "check"]).join(over, ["fp", "check"], "left")
    return rows.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).select("lang", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases of two to four words.

    Null and empty texts have no words, a null language is ``und``; repeated rows count each, rows without an id too.
    Order: score and ``a`` descending, then the phrase's bytes. Very long texts are cut into words slice by slice. Two n-grams
    are taken as one only if 96 bits of two independent fingerprints agree; those whose pointer's text says otherwise are left out.
    """
    found, words = frequent(docs, id, text, lang, least)
    read = phrases(docs, found, id, text, lang)
    rows = materialized(scored(found, read))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most rows: the best of each share first, then the best of those
    shares = max(1, math.ceil(read.count() / (8 * top)))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.join(words.withColumnRenamed("total", "n"), "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
