"""Repeated paragraphs and passages: MinHash banding, exact Jaccard, removals by component.

A paragraph is a line, or, where text is wrapped, the lines between two blank ones; near-duplicates of it are
found by banding its MinHash signature and verified by the Jaccard similarity of their sets of five-word
shingles. Those of fewer than SHINGLE words have no shingle and are compared as they are. A passage copied into
the middle of a line is no paragraph, so windows of WINDOW words are compared too, as they are. They begin
at anchors, words whose hash is the least of ANCHORS neighbours, so the same passage has the same windows
wherever it stands: every run of ANCHORS + WINDOW - 1 words holds at least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.session import materialized
from .graph import components
from .tables import short_batches, whole_text

SHINGLE, LEAST_WORDS, WINDOW, ANCHORS, JACCARD = 5, 1, 24, 26, 0.8
#: Text is wrapped if all lines between two blank ones are shorter than this, in words.
WRAPPED = 24
#: Two rows a band: a pair at 0.8 meets in one of six bands with probability 1 - (1 - 0.64) ** 6 = 0.998.
BANDS, ROWS = 6, 2
#: Members up to which a band's bucket, or a rare shingle's, is joined with itself. Members of fuller buckets meet in those of their
#: rare shingles, which misses nothing, and fuller ones of these have leaders.
BUCKET = 12
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_ODD = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _STEP, dtype=np.uint64)]), dtype=np.uint64)


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and line of every word, lower-cased; positions in code points."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = _SPACE[np.minimum(code, 0x3000)] & (code <= 0x3000)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in text.lower().split()), dtype=np.uint64, count=len(starts))
    return hashes, starts, ends, np.cumsum(code == 10)[starts] if len(starts) else starts


def _shingles(h: np.ndarray) -> np.ndarray:
    if len(h) < SHINGLE:
        return h[:0]
    p = _powers(SHINGLE)
    return _mixed(sum(h[k:len(h) - SHINGLE + 1 + k] * p[k] for k in range(SHINGLE)))


def _paragraphs(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and hash of each line that has words, then of each wrapped paragraph."""
    first = np.flatnonzero(np.diff(line, prepend=-1))
    after = np.append(first[1:], len(line))
    place = np.arange(len(h)) - np.repeat(first, after - first)
    hashes = np.add.reduceat(h * _powers(int((after - first).max()))[place], first)
    # lines without words count too, so blocks begin where the number of the line goes up by more than one
    block = np.flatnonzero(np.diff(line[first], prepend=-2) > 1)
    beyond = np.append(block[1:], len(first))
    wrapped = (beyond - block > 1) & (np.maximum.reduceat(after - first, block) < WRAPPED)
    begin, end = first[block[wrapped]], after[beyond[wrapped] - 1]
    joined = np.array([(h[a:b] * _powers(b - a)).sum(dtype=np.uint64) for a, b in zip(begin, end)], dtype=np.uint64)
    return np.concatenate([first, begin]), np.concatenate([after, end]), _mixed(np.concatenate([hashes, joined]))


def _units(text: str) -> tuple[np.ndarray, ...]:
    """Kind (0 line, 1 window), start, end, hash of each unit of a text, and band keys (empty for windows)."""
    h, starts, ends, line = _words(text)
    if len(h) < LEAST_WORDS:  # no words
        none = np.zeros(0, dtype=np.int64)  # typed: an untyped empty array would turn hashes beside it into doubles
        return none, none, none, none, []
    first, after, own = _paragraphs(h, line)
    s = _shingles(h)
    bands = [np.zeros(0, dtype=np.int64)] * len(first)
    long = np.flatnonzero(after - first >= SHINGLE)
    if len(long):
        bounds = np.stack([first[long], after[long] - SHINGLE + 1], axis=1).ravel()
        padded = np.append(s, np.full(SHINGLE + 1, np.iinfo(np.uint64).max, dtype=np.uint64))
        least = [np.minimum.reduceat(_mixed(padded * odd), bounds)[::2] for odd in _ODD]
        keys = [_mixed(least[b * ROWS] * _STEP + least[b * ROWS + 1] * np.uint64(3) + np.uint64(b)) for b in range(BANDS)]
        for k, key in zip(long, np.stack(keys, axis=1).astype(np.int64)):
            bands[k] = key
    pair = _mixed(h[:-1] + np.uint64(3) * h[1:])
    at = np.zeros(0, dtype=np.int64)
    if len(pair) >= ANCHORS:
        least = np.lib.stride_tricks.sliding_window_view(pair, ANCHORS).argmin(1)
        at = np.unique(np.arange(len(least)) + least)
        at = at[at + WINDOW <= len(h)]
    windows = _mixed((h[at[:, None] + np.arange(WINDOW)] * _powers(WINDOW)).sum(1, dtype=np.uint64))
    kind = np.concatenate([np.zeros(len(first), dtype=np.int32), np.ones(len(at), dtype=np.int32)])
    begin = np.concatenate([starts[first], starts[at]])
    end = np.concatenate([ends[after - 1], ends[at + WINDOW - 1]])
    hashes = np.concatenate([own, windows]).astype(np.int64)
    return kind, begin, end, hashes, [*bands, *[np.zeros(0, dtype=np.int64)] * len(at)]


def units(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``at`` (the row), ``text_key``, ``kind``, ``start``, ``end``, ``hash``, ``bands`` of all units of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in range(6)]
            size = 0
            for k, value in enumerate(batch.column(3)):
                found = _units(value.as_py())
                held[0].append(np.full(len(found[0]), k, dtype=np.int64))
                for column, more in zip(held[1:5], found[:4]):
                    column.append(np.asarray(more))
                held[5].extend(found[4])
                size += len(found[0])
                if size > 50_000 or k == batch.num_rows - 1:
                    row = pa.array(np.concatenate(held[0]))
                    columns = [c.take(row) for c in batch.columns[:3]]
                    kind, start, end, hashes = (np.concatenate(c) for c in held[1:5])
                    sizes = np.cumsum([0, *map(len, held[5])]).astype(np.int32)
                    bands = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*held[5], np.zeros(0, np.int64)])))
                    columns += [pa.array(kind.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(hashes.astype(np.int64)), bands]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "text_key", "kind", "start", "end", "hash", "bands"])
                    held, size = [[] for _ in range(6)], 0

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("at"), F.xxhash64(whole_text(text)).alias("text_key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "id long, at long, text_key long, kind int, start long, end long, hash long, bands array<long>")


def _sets(docs: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``hash`` and ``set`` (sorted shingle hashes) of the lines in ``wanted`` (hash, text_key, id).

    The id belongs to the key, so that of many copies of a text only the one that is asked for is read again.
    """
    listed = wanted.groupBy("text_key", F.col("id").alias("of")).agg(F.collect_set("hash").alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sets = [], []
            for t, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, _, _, line = _words(t)
                first, after, own = _paragraphs(h, line)
                want = set(want)
                for key, a, b in zip(own.astype(np.int64).tolist(), first, after):
                    if key in want:
                        want.discard(key)
                        hashes.append(key)
                        sets.append(np.unique(_shingles(h[a:b])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["hash", "set"])

    texts = docs.select(F.xxhash64(whole_text(text)).alias("key"), F.col(f"`{id}`").cast("long").alias("id"), whole_text(text).alias("text"))
    same = (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("of"))
    return texts.join(listed, same).select("text", "hashes").mapInArrow(run, "hash long, set array<long>").dropDuplicates(["hash"])


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """``s``, ``hash``, ``size``, ``rest``, ``common``: the rarest shingles of every set, so that any two sets with a Jaccard similarity of
    JACCARD or more have one in common: the first size - ceil(JACCARD * size) + 1 in the order of their frequency. ``rest``: how many of the
    set come no earlier than ``s`` in that order; ``common``: the mean frequency of the set's rarest. Shingles of one set only are left out."""
    rows = sets.select("hash", F.size("set").alias("size"), F.explode("set").alias("s"))
    often = materialized(rows.groupBy("s").agg(F.count("*").alias("often")))
    rows = rows.join(often, "s").groupBy("hash", "size").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("all"))
    least = (F.col("size") - F.ceil(F.col("size") * JACCARD) + 1).cast("int")
    rows = rows.select("hash", "size", F.slice("all", 1, least).alias("rarest"))
    common = F.aggregate("rarest", F.lit(0).cast("long"), lambda n, r: n + r.often) / F.size("rarest")
    rare = rows.select("hash", "size", common.alias("common"), F.posexplode("rarest").alias("place", "r")).where("r.often > 1")
    return materialized(rare.select("hash", "size", "common", (F.col("size") - F.col("place")).alias("rest"), F.col("r.s").alias("s")))


def _sizes_fit(x: str, y: str) -> Column:
    """Sets of sizes too far apart can't be similar enough."""
    return F.least(x, y) >= JACCARD * F.greatest(x, y)


def _enough(shared: Column, x: Column, y: Column) -> Column:
    """Sets of sizes ``x`` and ``y`` that share so many shingles are similar enough."""
    return shared >= JACCARD * (x + y - shared)


def _may_meet(side: str, other: str) -> Column:
    """Two sets can be similar if the shingle in which they meet is the first, in the order of frequency, that they share: then they share no
    more than the ``rest`` of either. Of two similar sets that have several in common, one is the first, and there they are found."""
    return _enough(F.least(f"rest{side}", f"rest{other}"), F.col(f"size{side}"), F.col(f"size{other}"))


def _pairs(members: DataFrame, key: str) -> DataFrame:
    x, y = (members.select(key, *[F.col(c).alias(f"{c}_{side}") for c in members.columns if c != key]) for side in "ab")
    met = x.join(y, key).where("hash_a < hash_b")
    met = met.where(_may_meet("_a", "_b")) if "rest" in members.columns else met
    return met.select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """The pairs whose sets are similar enough, with the columns ``more`` of theirs."""
    both = pairs.join(sets.select(F.col("hash").alias("a"), F.col("set").alias("sa"), F.size("set").alias("na")), "a")
    both = both.join(sets.select(F.col("hash").alias("b"), F.col("set").alias("sb"), F.size("set").alias("nb")), "b")
    both = both.where(_sizes_fit("na", "nb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(_enough(common, F.col("na"), F.col("nb"))).select("a", "b", *more)


def _by_leaders(groups: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """The components ``near`` (``node``, ``component``) as all similar pairs of the groups (rows of ``_rare_shingles``) join them, without
    making these pairs.

    A leader is compared with every member that isn't in its component, and leaves the group, whose pairs with it are then
    settled. Groups of one component are done: any further link is within it. In a group of near copies the first leader
    links nearly all, and the next ones are taken from what is outside the largest component; their number grows, so
    groups that hold several clusters without links between them end soon too. What a round links is components, so its
    graph has a node for each of them and not for each line. Leaders come by how frequent their rarest shingles are, so
    the line that the others are copies of is among the first, and the largest component, once it has several lines, has
    one too: its centre may have come into it by a lesser link.
    """
    alone = groups.select(F.col("hash").alias("node"), F.col("hash").alias("component"))
    near = materialized(near.select("node", "component").union(alone).groupBy("node").agg(F.min("component").alias("component")))
    kept = ["s", "hash", "size", "rest", "common"]
    active = groups.join(near, F.col("hash") == F.col("node")).select(*kept, F.col("component").alias("c"))
    for leaders in chain([1], (16 * 4 ** k for k in count())):
        active = materialized(active)
        main = active.groupBy("s", "c").agg(F.count("*").alias("n")).groupBy("s").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("k"))
        active = materialized(active.join(main.where("k > 1").select("s", F.col("m.c").alias("main"), (F.col("m.n") > 1).alias("several")), "s"))
        if active.isEmpty():
            return near
        place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("common"), F.xxhash64("hash"), "hash"))  # one order, so that groups share leaders
        outside = active.where("c <> main").withColumn("place", place).where(F.col("place") <= leaders)
        inside = F.min(F.struct(-F.col("common"), F.xxhash64("hash"), "hash", "c", "size", "rest")).alias("l")
        inside = active.where("c = main and several").groupBy("s").agg(inside).select("s", "l.*")
        first = [x.select("s", F.col("hash").alias("leader"), F.col("c").alias("of"), F.col("size").alias("size_of"), F.col("rest").alias("rest_of")) for x in (outside, inside)]
        first = materialized(first[0].union(first[1]))
        met = active.join(first, "s").where("c <> of").where(_may_meet("", "_of"))
        met = met.select(F.least("leader", "hash").alias("a"), F.greatest("leader", "hash").alias("b"), F.least("c", "of").alias("ca"), F.greatest("c", "of").alias("cb"))
        links = _verified(met.distinct(), sets, "ca", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(links).select(F.col("node").alias("c"), F.col("component").alias("into"))
        left = active.join(first.select("s", F.col("leader").alias("hash")), ["s", "hash"], "left_anti")
        active = left.join(joined, "c", "left").select(*kept, F.coalesce("into", "c").alias("c"))
        near = materialized(near.join(joined, F.col("component") == F.col("c"), "left").select("node", F.coalesce("into", "component").alias("component")))


def _similar(docs: DataFrame, id: str, text: str, rows: DataFrame) -> DataFrame:
    """``node``, ``component`` of the lines' hashes: the components of the similar ones. Some are of one line alone."""
    keyed = rows.where("kind = 0").select("hash", F.explode("bands").alias("band"))
    shared = materialized(keyed.groupBy("band").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high").select("band"))
    met = materialized(rows.where("kind = 0").select("hash", F.struct("id", "text_key").alias("place"), F.explode("bands").alias("band"))
                       .join(shared, "band").groupBy("band", "hash").agg(F.min("place").alias("place")))
    sizes = materialized(met.groupBy("band").agg(F.count("*").alias("n")))
    met = materialized(met.join(sizes, "band"))
    sets = materialized(_sets(docs, id, text, met.groupBy("hash").agg(F.min("place").alias("place")).select("hash", "place.*")))
    few = met.where(F.col("n") <= BUCKET)
    full = met.where(F.col("n") > BUCKET).select("hash").distinct()
    rare = _rare_shingles(sets.join(full, "hash"))
    sizes = materialized(rare.groupBy("s").agg(F.count("*").alias("n"), F.min("size").alias("least")))
    # what is too late in its own order for even the smallest of the others stays out
    rare = materialized(rare.join(sizes, "s").where(_enough(F.col("rest"), F.col("size"), F.greatest("least", F.col("size") * JACCARD))))
    in_few = rare.where(F.col("n") <= BUCKET).select("s", "hash", "size", "rest")
    pairs = _pairs(few.select("band", "hash"), "band").union(_pairs(in_few, "s")).distinct()
    return _by_leaders(rare.where(F.col("n") > BUCKET).drop("n", "least"), sets, components(_verified(pairs, sets)))


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated paragraph or window: id, ``start``, ``end`` (code points), ``kind``, ``cluster_id``, ``removed``.

    Only what two or more documents share is listed; a cluster's first occurrence (least id, then place) is
    the one that isn't removed. Texts without words have no units. Rows without an id take part and
    come last; a repeated row is a document of its own. Lines are joined through their hashes, so copies of
    a line cost one row each and no pair.
    """
    with short_batches(docs.sparkSession):
        rows = materialized(units(docs, id, text))
    near = _similar(docs, id, text, rows)
    near = near.select(F.lit(0).alias("kind"), F.col("node").alias("hash"), F.col("component").alias("cluster"))
    once = rows.groupBy("kind", "hash").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min(F.struct(F.col("id").isNull(), "id", "at", "start")).alias("first"))
    once = once.join(near, ["kind", "hash"], "left").withColumn("similar", F.col("cluster").isNotNull()).withColumn("cluster", F.coalesce("cluster", "hash"))
    # hashes that occur in one document only and aren't near another line end here
    once = materialized(once.where((F.col("low") < F.col("high")) | F.col("similar")))
    clusters = materialized(once.groupBy("kind", "cluster").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).where("low < high"))
    named = materialized(once.select("kind", "hash", "cluster").join(clusters.select("kind", "cluster", "first"), ["kind", "cluster"]))
    found = rows.select("id", "at", "kind", "start", "end", "hash").join(named, ["kind", "hash"])
    is_first = (F.col("at") == F.col("first.at")) & (F.col("start") == F.col("first.start"))
    return found.select(F.col("id").alias(id), "start", "end", F.when(F.col("kind") == 0, "paragraph").otherwise("window").alias("kind"),
                        F.col("cluster").alias("cluster_id"), (~is_first).alias("removed"))
