"""Toxic text: a convolutional classifier on hashed word embeddings, in numpy.

A word is the sum of the embeddings of hashes of itself and of its beginnings, so forms of one stem share
weights. Filters of several widths run over the words, the maximum of each over the whole text is kept, and
a logistic layer joins them. All labelled documents are learned from: the log odds that embeddings start with
are counted over all of them, shards of them are fitted side by side from there, and the weights are averaged.
The language of a text is guessed from its own common words; each language's threshold is found on all
training rows that the fit hasn't seen, and scores are shifted so that it lies at 0.3.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.session import materialized
from .tables import short_batches, whole_text

#: Labelled documents that are fitted as one, and documents and characters of a shard where there are more.
WHOLE, SHARD, SHARD_CHARS = 6000, 2000, 20_000_000
EPOCHS, BATCH, RATE = 5, 32, 0.03
#: Cells a unit of the logit has; a threshold lies between two cells.
CELLS = 4096
BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 18, 8, (1, 2, 3), 6, (4, 5, 6)
#: Buckets in fewer fitting documents have no embedding; that many documents' worth of the base rate smooths the others' start.
LEAST_DOCS, PRIOR_DOCS = 4, 4.0
THRESHOLD, LEAST_POSITIVES = 0.3, 15
#: Words a worker keeps, and words it scores at a time.
KEPT, STEP = 60_000, 60_000
#: Common words by which a text's language is told; the last group is for none of them.
COMMON = {"en": "the of and to in is that it for with was as be are this", "fr": "le la les de des et un une qui que en pour par sur dans",
          "de": "der die das und von zu den ein eine mit nicht ist im dem des", "es": "el los las y en un una por con para que del se al su"}
LANGUAGES = [*COMMON, "other"]
_COMMON = [frozenset(v.split()) for v in COMMON.values()]
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_NO_MARKS = [0] * len(_COMMON)
_MARKS = {w: [int(w in c) for c in _COMMON] for w in frozenset().union(*_COMMON)}


def buckets(token: str) -> tuple[list[int], list[int]]:
    """Hash buckets of a token (-1: none), and for each language whether it is one of its common words."""
    word = token.lower()
    if not word.isalpha():
        word = _EDGE.sub("", word)
    if word.isascii() and word:
        data, n = word.encode(), len(word)
        found = [crc32(data + b"$") % BUCKETS] + [crc32(data[:k]) % BUCKETS if n >= k else -1 for k in STEMS]
        return found, _MARKS.get(word, _NO_MARKS)
    if not word:
        return [-1] * (1 + len(STEMS)), [0] * len(_COMMON)
    keys = [word + "$"] + [word[:n] if len(word) >= n else None for n in STEMS]
    return [-1 if k is None else crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys], _MARKS.get(word, _NO_MARKS)


class Words:
    """Numbers for the tokens met so far; number 0 is padding. What is known of new ones waits in ``rows`` and ``common``."""

    def __init__(self):
        self.number, self.rows, self.common = {"": 0}, [-1] * (1 + len(STEMS)), [0] * len(_COMMON)  # flat: short lists would keep the garbage collector busy

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and common-word marks of the tokens that are new since the last call."""
        out = np.array(self.rows, dtype=np.int32).reshape(-1, 1 + len(STEMS)), np.array(self.common, dtype=np.int8).reshape(-1, len(_COMMON))
        self.rows, self.common = [], []
        return out

    def kept(self, used: np.ndarray) -> "Words":
        """The same with only the numbers in ``used`` (sorted, 0 first), counted anew."""
        tokens, fewer = list(self.number), Words()
        fewer.number, fewer.rows, fewer.common = {tokens[i]: k for k, i in enumerate(used)}, [], []
        return fewer

    def of(self, tokens: list[str]) -> np.ndarray:
        number = self.number
        for t in set(tokens).difference(number):
            row, common = buckets(t)
            number[t] = len(number)
            self.rows.extend(row)
            self.common.extend(common)
        return np.fromiter(map(number.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def language_of(hits: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES from the counts of common words."""
    return np.where(hits.sum(1) > 0, hits.argmax(1), len(_COMMON))


_PAD = max(WIDTHS) - 1


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' numbers in one array, padding after each, and where each begins."""
    gap = np.zeros(_PAD, dtype=np.int32)
    parts = [p for d in docs for p in (d if len(d) else gap[:1], gap)]
    starts = np.cumsum([0] + [max(1, len(d)) + _PAD for d in docs[:-1]])
    return np.concatenate([*parts, gap]), starts


class Classifier:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)  # the last row (-1) is for no bucket
        self.filters = [r.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5 / len(f)
        self.bias = np.full(len(WIDTHS) * FILTERS, -1.0)
        self.out, self.base = np.abs(r.normal(0, 0.2, len(WIDTHS) * FILTERS)), -2.0
        self.shift, self.columns = np.zeros(len(LANGUAGES)), FILTERS * sum(WIDTHS)

    def start(self, seen: np.ndarray, base: float, seed: int = 7) -> np.ndarray:
        """Buckets seen often enough begin with their log odds as first component and small noise; gives which they are.

        ``seen`` counts the documents of either label by bucket, ``base`` is the share of label 1.
        """
        n = seen.sum(0)
        odds = np.log((seen[1] + PRIOR_DOCS * base) / (seen[0] + PRIOR_DOCS * (1 - base))) - np.log(base / (1 - base))
        used = n >= LEAST_DOCS
        used[-1] = False
        self.embed[used] = np.random.default_rng(seed).normal(0, 0.05, (int(used.sum()), DIM))
        self.embed[used, 0] += odds[used]
        return used

    def fit(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, used: np.ndarray, seed: int = 7) -> None:
        """Adagrad over the log loss; only the words at a filter's maximum get a gradient, in the buckets that ``used`` marks."""
        r = np.random.default_rng(seed)
        rows = np.where(used[rows], rows, -1)
        params = [self.embed, *self.filters, self.bias, self.out]
        seen = [np.full(p.shape, 1e-3, dtype=p.dtype) for p in params]
        seen_base = 1e-3
        def step(k: int, grad: np.ndarray, at=slice(None)) -> None:
            seen[k][at] += grad ** 2
            params[k][at] -= RATE * grad / np.sqrt(seen[k][at])
        for _ in range(EPOCHS):
            order = r.permutation(len(docs))
            for a in range(0, len(order), BATCH):
                some = order[a:a + BATCH]
                idx, starts = _padded([docs[i] for i in some])
                spread = rows[idx]
                x = sum(self.embed.take(spread[:, k], axis=0) for k in range(spread.shape[1])).astype(float)
                n, doc = len(idx) - _PAD, np.searchsorted(starts, np.arange(len(idx) - _PAD), side="right") - 1
                pooled, where = np.empty((len(some), len(self.bias))), np.empty((len(some), len(self.bias)), dtype=np.int64)
                for k, f in enumerate(self.filters):
                    h = sum(x[j:n + j] @ f[j] for j in range(len(f)))
                    h[idx[:n] == 0] = -np.inf  # no window begins in the padding, where it would reach into the next document
                    top = np.maximum.reduceat(h, starts)
                    p, c = np.nonzero(h == top[doc])
                    at = np.empty((len(some), FILTERS), dtype=np.int64)
                    at[doc[p[::-1]], c[::-1]] = p[::-1]  # the first of equals stays
                    pooled[:, k * FILTERS:(k + 1) * FILTERS], where[:, k * FILTERS:(k + 1) * FILTERS] = top, at
                z = np.maximum(pooled + self.bias, 0)
                score = 1 / (1 + np.exp(-np.clip(z @ self.out + self.base, -30, 30)))
                g = (score - labels[some]) / len(some)
                back = g[:, None] * self.out[None] * (z > 0)
                pos, grads = [], []
                for k, f in enumerate(self.filters):
                    own, gk = where[:, k * FILTERS:(k + 1) * FILTERS], back[:, k * FILTERS:(k + 1) * FILTERS]
                    df = np.empty_like(f)
                    for j in range(len(f)):
                        df[j] = np.einsum("bfd,bf->df", x[own + j], gk)
                        pos.append((own + j).ravel())
                        grads.append((gk[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                    step(1 + k, df)
                step(1 + len(self.filters), back.sum(0))
                step(2 + len(self.filters), z.T @ g + 1e-4 * self.out)
                seen_base += g.sum() ** 2
                self.base -= RATE * g.sum() / np.sqrt(seen_base)
                pos, grads = np.concatenate(pos), np.concatenate(grads)
                hit = np.abs(grads).sum(1) > 0
                spread, grads = rows[idx[pos[hit]]], grads[hit]
                flat, inverse = np.unique(spread.ravel(), return_inverse=True)
                total = np.zeros((len(flat), DIM))
                np.add.at(total, inverse, np.repeat(grads, spread.shape[1], axis=0))
                real = flat >= 0
                step(0, total[real].astype(np.float32), flat[real])

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place of it, side by side: scoring only adds these up."""
        x = self.embed[rows].sum(1)
        return np.concatenate([x @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)

    def logits(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        idx, starts = _padded(docs)
        n, pooled, column, each = len(idx) - _PAD, [], 0, table.take(idx, axis=0)
        for w in WIDTHS:
            h = sum(each[j:n + j, column + j * FILTERS:column + (j + 1) * FILTERS] for j in range(w))
            h[idx[:n] == 0] = -np.inf
            pooled.append(np.maximum.reduceat(h, starts))
            column += w * FILTERS
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.base

    def dense(self) -> np.ndarray:
        """All weights but the embeddings, in rows as long as theirs."""
        flat = np.concatenate([*(f.ravel() for f in self.filters), self.bias, self.out, [self.base]])
        return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)

    def take(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Weights by row: those of embeddings by bucket, then those of ``dense``."""
        own = keys < BUCKETS
        self.embed[keys[own]] = weights[own]
        flat = weights[~own][np.argsort(keys[~own])].ravel()
        for f in (*self.filters, self.bias, self.out):
            f[...] = flat[:f.size].reshape(f.shape)
            flat = flat[f.size:]
        self.base = float(flat[0])

    def calibrate(self, cells: np.ndarray) -> None:
        """Each language's threshold is the middle of the best cut (by F1); too few positives: that of all texts.

        ``cells``: language, cell, rows, positives, least and greatest logit of each cell that has rows.
        """
        def best(of: np.ndarray) -> float:
            of = of[np.argsort(-of[:, 1], kind="stable")]
            last = np.append(of[1:, 1] != of[:-1, 1], True)  # of the rows of one cell, in several languages
            first = np.flatnonzero(np.append(True, last[:-1]))
            low, high = np.minimum.reduceat(of[:, 4], first), np.maximum.reduceat(of[:, 5], first)
            n, hits = np.cumsum(of[:, 2])[last], np.cumsum(of[:, 3])[last]
            k = int((2 * hits / (n + hits[-1])).argmax())
            return float(low[k] if k + 1 == len(low) else (low[k] + high[k + 1]) / 2)
        overall = best(cells) if cells[:, 3].sum() else 0.0
        for k in range(len(LANGUAGES)):
            of = cells[cells[:, 0] == k]
            cut = best(of) if of[:, 3].sum() >= LEAST_POSITIVES else overall
            self.shift[k] = np.log(THRESHOLD / (1 - THRESHOLD)) - cut


def _counted(fitting: DataFrame) -> np.ndarray:
    """Documents of either label by bucket. What reaches the driver is bounded by the number of buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            words = Words()
            numbers = [np.unique(words.of(value.as_py().split())) for value in batch.column(1)]
            rows, _ = words.taken()
            for d, y in zip(numbers, batch.column(0).to_pylist()):
                seen[int(y), np.unique(rows[d])] += 1
        at = np.flatnonzero(seen[:, :-1].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    with short_batches(fitting.sparkSession):
        got = fitting.select("toxic", "text").mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(
            F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[:, np.asarray(got["bucket"])] = np.asarray(got["clean"]), np.asarray(got["toxic"])
    return seen


def _averaged(fitting: DataFrame, shards: int, model: Classifier, used: np.ndarray) -> pa.Table:
    """Weights by row (``key``): the average over the shards that changed it, each fitted from the model's weights."""
    packed = fitting.sparkSession.sparkContext.broadcast((model, used))

    def run(table: pa.Table) -> pa.Table:
        first, used = packed.value
        own = copy.deepcopy(first)
        table, words = table.sort_by("id"), Words()
        numbers = [words.of(value.as_py().split()) for value in table["text"]]
        own.fit(numbers, words.taken()[0], np.asarray(table["toxic"]), used)
        changed = np.flatnonzero((own.embed != first.embed).any(1))
        dense = own.dense()
        weights = np.concatenate([own.embed[changed].astype(float), dense])
        keys = np.concatenate([changed, BUCKETS + 1 + np.arange(len(dense))])
        return pa.table({"key": keys, **{f"w{k}": weights[:, k] for k in range(DIM)}})

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    fitted = fitting.select(shard, "id", "toxic", "text").groupBy("shard").applyInArrow(run, "key long, " + ", ".join(f"w{k} double" for k in range(DIM)))
    return fitted.groupBy("key").agg(*[F.avg(f"w{k}").alias(f"w{k}") for k in range(DIM)]).toArrow()


def train(docs: DataFrame, labelled: DataFrame, id: str = "doc_id", text: str = "text", shard: int = SHARD) -> Classifier:
    """Fit on all labelled documents; ``labelled`` has ``id`` and ``toxic`` (0, 1; null rows are left out).

    Four fifths of them fit the weights, one fifth sets the thresholds. Up to WHOLE documents are fitted as one; more
    are dealt into shards of about ``shard``, and of SHARD_CHARS characters at most on average. Of a repeated id the least
    text counts. Without labels of both kinds the classifier keeps its first weights. Texts and labels are joined by shuffle at every size.
    """
    own = Classifier()
    rows = (labelled.select(F.col(f"`{id}`").alias("id"), F.col("toxic").cast("double").alias("toxic")).where("id is not null and toxic is not null")
            .groupBy("id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col(f"`{id}`").alias("id"), whole_text(text).alias("text"))
    picked = texts.join(rows.hint("merge"), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    held = F.crc32(F.concat(F.lit("fold "), F.col("id").cast("string")).cast("binary")) % 5 == 0
    picked = materialized(picked.withColumn("held", held))
    fitting = picked.where("not held").select("id", (F.col("toxic") > 0.5).cast("double").alias("toxic"), "text")
    low, high = picked.agg(F.min("toxic"), F.max("toxic")).first()
    n, base, chars = fitting.agg(F.count("*"), F.avg("toxic"), F.sum(F.length("text"))).first()
    if low == high or base in (None, 0.0, 1.0):
        return own
    used = own.start(_counted(fitting), base)
    shards = max(1 if n <= WHOLE else -(-n // shard), -(-chars // SHARD_CHARS))
    got = _averaged(fitting, shards, own, used)
    own.take(np.asarray(got["key"]), np.stack([np.asarray(got[f"w{k}"]) for k in range(DIM)], axis=1))
    kept = picked.where("held").select((F.col("toxic") > 0.5).cast("long").alias("toxic"), _judged(picked, own, "text").alias("j"))
    z = F.least(F.greatest(F.col("j.z"), F.lit(-30.0)), F.lit(30.0))
    cells = kept.select("toxic", "j.language", z.alias("z")).groupBy("language", F.floor(F.col("z") * CELLS).alias("cell")).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("z").alias("low"), F.max("z").alias("high")).toArrow()
    if len(cells):
        own.calibrate(np.stack([np.asarray(c, dtype=float) for c in cells.columns], axis=1))
    return own


def _judged(docs: DataFrame, model: Classifier, text: str) -> Column:
    """``z``, the shifted logit, and ``language`` (its index) of each text."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, words = packed.value, Words()
        n = 0  # words in the tables, which are filled in place
        table = np.empty((KEPT + STEP, own.columns), dtype=np.float32)
        common = np.empty((KEPT + STEP, len(_COMMON)), dtype=np.int8)

        def flush(some: list[np.ndarray]) -> np.ndarray:
            nonlocal words, table, common, n
            rows, marks = words.taken()
            if n + len(rows) > len(table):
                more = n + len(rows) - len(table)
                table = np.concatenate([table, np.empty((more, table.shape[1]), dtype=table.dtype)])
                common = np.concatenate([common, np.empty((more, common.shape[1]), dtype=common.dtype)])
            for at in range(0, len(rows), 10_000):
                part = rows[at:at + 10_000]
                table[n + at:n + at + len(part)] = own.tables(part)
            common[n:n + len(rows)] = marks
            n += len(rows)
            hits = np.stack([common[d].sum(0, dtype=np.int64) for d in some])
            language = language_of(hits)
            z = own.logits(some, table) + own.shift[language]
            if n > KEPT:  # the words of these texts stay
                used = np.unique(np.concatenate([[0], *some]).astype(np.int64))
                words, n = words.kept(used), len(used)
                table[:n], common[:n] = table[used], common[used]
            return np.stack([z, language], axis=1)

        for batch in batches:
            out, some, size = [], [], 0
            for value in batch:  # one text at a time leaves Arrow
                some.append(words.of(value.as_py().split()))
                size += len(some[-1])
                if size > STEP:
                    out.append(flush(some))
                    some, size = [], 0
            if some:
                out.append(flush(some))
            found = np.concatenate([np.zeros((0, 2)), *out])
            yield pa.StructArray.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].astype(np.int32))], names=["z", "language"])
            del batch
            pa.default_memory_pool().release_unused()  # an idle worker stays alive, its buffers needn't

    return F.arrow_udf(scores, T.StructType().add("z", T.DoubleType()).add("language", T.IntegerType()))(whole_text(text))


def score(docs: DataFrame, model: Classifier, text: str = "text", to: str = "score") -> DataFrame:
    """The documents with ``to`` (0 to 1; 0.3 and more: toxic). The whole text is read; null and empty texts
    get the score of no words. Nothing but the text is an input. No shuffle; the model (a few MB) is broadcast."""
    z = _judged(docs, model, text).getField("z")
    return docs.withColumn(to, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0)))))
