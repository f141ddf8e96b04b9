"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie. Where a node has no edge for the next byte, its failure link leads to the node
for what is left after the longest matches so far are popped, and the number of popped tokens is stored
with the link. So each byte is read once and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import read_ranks
from .tables import whole_text

KEPT, TEXT_STEP = 400_000, 4_000_000


class Automaton:
    """Counts the greedy longest matches of a word; a word that can't be covered is one unknown token."""

    def __init__(self, vocabulary: list[bytes]):
        edge: dict[int, int] = {}
        ends, size = [False], 1
        for token in vocabulary:
            v = 0
            for c in token:
                key = v << 8 | c
                if (u := edge.get(key)) is None:
                    u = edge[key] = size
                    size += 1
                    ends.append(False)
                v = u
            ends[v] = True
        children: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for key, u in edge.items():
            children[key >> 8].append((key & 255, u))
        link, popped = [-1] * size, [0] * size
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for c, u in children[v]:
                if ends[u]:
                    link[u], popped[u] = 0, 1
                else:
                    z, n = link[v], popped[v]
                    while z >= 0 and (to := edge.get(z << 8 | c)) is None:
                        n += popped[z]
                        z = link[z]
                    if z >= 0:
                        link[u], popped[u] = to, n
                queue.append(u)
        self.edge, self.link, self.popped, self.known = edge, link, popped, {}

    def count(self, word: bytes) -> int:
        edge, link, popped, v, n = self.edge, self.link, self.popped, 0, 0
        for c in word:
            while (to := edge.get(v << 8 | c)) is None:
                n += popped[v]
                v = link[v]
                if v < 0:
                    return 1
            v = to
        while v:
            n += popped[v]
            v = link[v]
            if v < 0:
                return 1
        return n

    def total(self, words: list[str]) -> int:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > KEPT:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.count(w.encode("utf-8"))
        return sum(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def _automaton(vocabulary: tuple[bytes, ...]) -> Automaton:
    return Automaton(list(vocabulary))


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", to: str = "n_tokens") -> DataFrame:
    """The id and the number of word pieces of the whole text.

    The pattern cuts a text into words; each is covered by the longest tokens of the vocabulary from left to
    right. Null and empty texts count 0, repeated rows are counted each. The vocabulary is read on the driver
    and broadcast (under 1 MB). No shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tuple(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = _automaton(vocabulary.value), regex.compile(pattern)
        for batch in batches:
            counts = []
            for value in batch.column(1):
                text_ = value.as_py()
                if len(text_) <= TEXT_STEP:
                    counts.append(own.total(cut.findall(text_)))
                else:
                    matches, n = cut.finditer(text_), 0
                    while block := [m.group() for m in islice(matches, 200_000)]:
                        n += own.total(block)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n"])

    kept = docs.select(F.col(f"`{id}`").alias("id"), whole_text(text).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n long").withColumnRenamed("id", id).withColumnRenamed("n", to)
