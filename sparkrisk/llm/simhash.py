"""SimHash near-duplicates: fingerprints, deletion-variant signatures, components.

The 64 bits are cut into two halves of 32. Two fingerprints that differ in at most two bits differ in
at most one bit in one of the halves, so that half, with one bit blanked out (or none), is a key the
two have in common. Keys are joined by equality and every pair is verified by its full distance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.session import materialized
from .graph import components
from .tables import short_batches, whole_text

SHINGLE_WORDS, SEED, DISTANCE = 3, 42, 2
#: Pairs that one key may give; the fingerprints of fuller keys are linked by ``_linked_by_neighbours``, as exactly.
PAIRS_PER_KEY = 4096
#: Signature variants that one task makes: fingerprints are few bytes, so their size says nothing of the rows they become.
VARIANTS_PER_TASK = 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _word_blocks(data: bytes, step: int = 1 << 21) -> Iterator[list[bytes]]:
    """All words, in lists of about ``step`` bytes of text, so that a long text needs little memory."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + step) if at + step < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def _bit_totals(words: list[bytes], n: int) -> tuple[np.ndarray, int]:
    """How often each of the 64 bits is set in the hashes of the word windows, and how many windows there are."""
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b - 1], SEED) for a, b in zip(starts, ends[n - 1:])), dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)]), len(hashes)


def fingerprint(text: str, n: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    totals, count, kept = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        kept += words
        if len(kept) >= n:
            more, m = _bit_totals(kept, n)
            totals, count, kept = totals + more, count + m, kept[len(kept) - n + 1:] if n > 1 else []
    if not count and kept:
        totals, count = _bit_totals(kept, len(kept))
    return sum(1 << int(i) for i in np.flatnonzero(2 * totals > count))


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array(np.array([fingerprint(t.as_py()) for t in batch], dtype=np.uint64).astype(np.int64))
        del batch
        pa.default_memory_pool().release_unused()  # an idle worker stays alive, its buffers needn't


def fingerprint_column(text: Column) -> Column:
    return F.arrow_udf(_fingerprints, T.LongType())(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _variants(fps: DataFrame) -> DataFrame:
    """``key``, ``side``, ``fp``: each half as it is, and with each bit blanked out; side: the blanked bit."""
    rows = []
    for half in (0, 1):
        value = F.shiftrightunsigned("fp", 32) if half else F.col("fp").bitwiseAND((1 << 32) - 1)
        for j in range(33):
            tag = F.lit((half * 33 + j) << 32)
            bit = 1 << j if j < 32 else 0
            rows.append(F.struct(value.bitwiseAND((1 << 32) - 1 - bit).bitwiseOR(tag).alias("key"),
                                 (F.lit(0) if j == 32 else F.shiftright(value, j).bitwiseAND(1).cast("int")).alias("side")))
    return fps.select(F.explode(F.array(*rows)).alias("v"), "fp").select("v.key", "v.side", "fp")


def _whole(key: str) -> Column:
    """Whether nothing is blanked out in the key."""
    return (F.shiftright(key, 32) % 33) == 32


def _linked_by_neighbours(fps: DataFrame) -> DataFrame:
    """Edges that connect the same fingerprints as all links among ``fps``, in 65 rows each.

    Two fingerprints are within two bits of each other exactly when some 64-bit value is within one
    bit of both. So each one is listed at itself and its 64 neighbours; a value lists at most 65.
    """
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), j)) for j in range(64)])
    listed = fps.select("fp", F.explode(near).alias("at"))
    low = listed.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    return listed.join(low.select("at", "a"), "at").select(F.col("fp").alias("b"), "a").where("a <> b").select("a", "b")


def links(fps: DataFrame, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that give their components."""
    n, set_ = F.col("n"), F.col("ones")
    tasks = max(1, math.ceil(66 * fps.count() / VARIANTS_PER_TASK))
    fps = fps.repartition(tasks, "fp")
    keys = _variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.sum("side").alias("ones"))
    keys = materialized(keys.select("key", F.when(_whole("key"), n * (n - 1) / 2).otherwise(set_ * (n - set_)).alias("pairs"))
                        .where("pairs > 0"))
    rows = materialized(_variants(fps).join(keys, "key"))
    few = rows.where(F.col("pairs") <= pairs_per_key)
    x = few.where(_whole("key") | (F.col("side") == 0)).select("key", F.col("fp").alias("a"))
    y = few.where(_whole("key") | (F.col("side") == 1)).select("key", F.col("fp").alias("b"))
    met = x.join(y, "key").where(~_whole("key") | (F.col("a") < F.col("b")))
    met = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    many = materialized(rows.where(F.col("pairs") > pairs_per_key).select("fp").distinct())
    return met.union(_linked_by_neighbours(many))


def _grouped(docs: DataFrame, id: str, text: str, carry: list[str]) -> DataFrame:
    """Each row's ``__id``, ``fp``, ``component`` (the least fingerprint of it) and ``component_id``."""
    with short_batches(docs.sparkSession):
        base = materialized(docs.select(F.col(f"`{id}`").alias("__id"), fingerprint_column(whole_text(text)).alias("fp"), *carry))
    fps = materialized(base.groupBy("fp").agg(F.min("__id").alias("low")))
    found = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    placed = materialized(fps.join(found, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))
    lowest = materialized(placed.groupBy("component").agg(F.min("low").alias("component_id")))
    named = materialized(placed.join(lowest, "component").select("fp", "component", "component_id"))
    return base.join(named, "fp")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
    A text of fewer than three words is one shingle. Repeated rows stay repeated. A row without an id
    has a fingerprint and takes part; its component is the smallest id there is in it, or null.
    """
    return _grouped(docs, id, text, []).select(F.col("__id").alias(id), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component of near-duplicates: the smallest id, then any one row of it.

    Where no row of a component has an id, one of its rows stays. Columns and values are as they came.
    The text is written once beside a row number, and read again for the rows that stay.
    """
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row")
    rows = materialized(docs.select(whole, F.monotonically_increasing_id().alias("__at")))
    groups = _grouped(rows.select("__at", F.col(f"__row.`{id}`").alias("__doc"), F.col(f"__row.`{text}`").alias("__text")),
                      "__doc", "__text", ["__at"])
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__at")).alias("first"))
    stays = materialized(first.select(F.col("first.__at").alias("__at")))
    # what stays grows with the documents, so it is never broadcast, however few they are
    return rows.join(stays.hint("merge"), "__at", "left_semi").select(*[F.col(f"__row.`{n}`").alias(n) for n in docs.columns])
