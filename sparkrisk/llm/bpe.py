"""Byte-level BPE: DuckDB contracts the distinct pieces of a partition's texts; Arrow looks up the bytes of ids again.

A text is cut into pieces by the tokenizer's pattern. A partition keeps the ids of pieces it has met; new
ones go to DuckDB together, a row for each (piece, position), where a recursive query contracts each
piece's leftmost pair of minimum rank until none is left. Pieces longer than ``LONG_PIECE`` bytes, for
which the recursion's cost grows with the square of the length, are contracted with a heap instead, in
the same order.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .tables import whole_text

LONG_PIECE = 128
#: Characters of text and token rows handled at a time, squared bytes of the new pieces of one recursive query
#: (what its steps may add up to), and pieces a worker keeps. Workers share an executor with a JVM whose heap is
#: full after earlier stages, so all are small; pieces that were met again stay, which keeps the few as useful as many.
TEXT_STEP, ROW_STEP, PIECE_STEP, KEPT = 1_000_000, 100_000, 1_000_000, 150_000

#: key: piece * 256 + position, so one order serves all pieces; best: rank * 256 + position of the pair to contract.
_CONTRACT = """
with recursive parts(key, tok, step) as (
  select key, tok, 0 from started
  union all (
    with paired as materialized (
      select key, tok, step, lead(tok) over (order by key) as following, lead(key) over (order by key) as other from parts),
    chosen as (
      select key >> 8 as piece, min(m.merged::bigint << 8 | (key & 255)) as best, arg_min(other, m.merged::bigint << 8 | (key & 255)) as gone
      from paired join merges m on m.a = tok and m.b = following where other >> 8 = key >> 8 group by key >> 8)
    select key, case when key & 255 = best & 255 then (best >> 8)::int else tok end, step + 1
    from paired join chosen on piece = key >> 8 where key <> gone)
), last as (select key >> 8 as piece, max(step) as step from parts group by key >> 8)
select p.key >> 8 as piece, tok from parts p join last l on l.piece = p.key >> 8 and l.step = p.step order by p.key
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_BEYOND = re.compile("[^\x00-\u024f]")


def _plain(pattern: str) -> re.Pattern | None:
    """The pattern for texts without a character that ``_BEYOND`` finds, in the built-in engine, which is faster.

    Letters, numbers and white space are listed one by one. None if the pattern has other escapes.
    """
    sets = {e: "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(e, chr(c))) for e in (r"\p{L}", r"\p{N}", r"\s")}
    out, at, inside = [], 0, False
    while at < len(pattern):
        escape = next((e for e in sets if pattern.startswith(e, at)), None)
        if escape:
            out.append(sets[escape] if inside else f"[{sets[escape]}]")
        elif pattern.startswith(r"\S", at) and not inside:
            escape = r"\S"
            out.append(f"[^{sets[r'\s']}]")
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(escape or " ")
    return re.compile("".join(out))


class Contractor:
    """The merge table in DuckDB, and the pieces met so far with their ids (little-endian 32 bits)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut, self.plain, self.known, self.again = ranks, regex.compile(pattern), _plain(pattern), {}, set()
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        rows = ((ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        a, b, merged = np.fromiter(chain.from_iterable(rows), dtype=np.int32).reshape(-1, 3).T.copy()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB"})
        self.db.register("given", pa.table({"a": a, "b": b, "merged": merged}))
        self.db.execute("create table merges as select * from given")
        spelt = {r: t for t, r in ranks.items()}
        self.spelt = pa.array([spelt.get(r, b"") for r in range(max(spelt, default=-1) + 2)], pa.binary())  # the last for ids beyond

    def _heap(self, piece: bytes) -> list[int]:
        ids, n = [int(self.byte[c]) for c in piece], len(piece)
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is gone
        starts = list(range(-1, n - 1))
        def rank(i):
            j = ends[i]
            return self.ranks.get(piece[i:ends[j]]) if j < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not ends[i] or rank(i) != r:
                continue
            j = ends[i]
            ends[i], ids[i], ends[j] = ends[j], r, 0
            if ends[i] < n:
                starts[ends[i]] = i
            for k in (starts[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return [ids[i] for i in range(n) if ends[i]]

    def _recursive(self, pieces: list[bytes]) -> Iterator[bytes]:
        lengths = np.array([len(p) for p in pieces])
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        self.db.register("started", pa.table({
            "key": np.repeat(np.arange(len(pieces), dtype=np.int64), lengths) << 8 | place,
            "tok": self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]}))
        got = self.db.execute(_CONTRACT).fetchnumpy()
        ids, ends = np.asarray(got["tok"], dtype="<u4").tobytes(), np.searchsorted(got["piece"], np.arange(len(pieces) + 1)) * 4
        return (ids[a:b] for a, b in pairwise(ends.tolist()))

    def learn(self, pieces: set[str]) -> None:
        """Find and keep the ids of new pieces."""
        new = []
        for piece in pieces:
            data = piece.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) > LONG_PIECE:
                self.known[piece] = np.array(self._heap(data), dtype="<u4").tobytes()
            else:
                new.append((piece, data))
        for a, b in _steps([len(data) ** 2 for _, data in new], PIECE_STEP) if new else ():
            part = new[a:b]
            for (piece, _), ids in zip(part, self._recursive([data for _, data in part])):
                self.known[piece] = ids

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those not kept; makes room for them first, where what was met again since then, and what is asked for, stays."""
        met = pieces.intersection(self.known)
        new = pieces.difference(met)
        self.again |= met
        if len(self.known) + len(new) > KEPT:
            stay = self.again if len(self.again) + len(new) <= KEPT // 2 else met
            self.known, self.again = {p: self.known[p] for p in stay}, set()
        return new

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [(self.cut if self.plain is None or _BEYOND.search(t) else self.plain).findall(t) for t in texts]
        self.learn(self._unknown(set(chain.from_iterable(cut))))
        for pieces in cut:
            yield b"".join(map(self.known.__getitem__, pieces))

    def encode_long(self, text: str) -> bytes:
        """A text too long to list all its pieces at once."""
        out, matches = [], self.cut.finditer(text)
        while block := [m.group() for m in islice(matches, 200_000)]:
            self.learn(self._unknown(set(block)))
            out.append(b"".join(map(self.known.__getitem__, block)))
        return b"".join(out)

    def decode(self, many: list[bytes]) -> Iterator[bytes]:
        """The bytes of each list of ids, ROW_STEP ids at a time; an id that no token has stands for nothing."""
        for packed in many:
            ids = np.minimum(np.frombuffer(packed, dtype="<u4"), np.uint32(len(self.spelt) - 1))
            steps = (self.spelt.take(pa.array(ids[at:at + ROW_STEP])) for at in range(0, len(ids), ROW_STEP))
            yield b"".join(pc.binary_join(pa.ListArray.from_arrays([0, len(s)], s), b"")[0].as_py() for s in steps)


@lru_cache(maxsize=2)
def _contractor(key: tuple[bytes, str]) -> Contractor:
    packed, pattern = key
    return Contractor({base64.b64decode(t): int(r) for t, r in map(bytes.split, packed.splitlines())}, pattern)


def _steps(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about ``most``."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if total or start == 0:
        yield start, k + 1


def _ranks_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id: str, text: str, decoded: str | None) -> DataFrame:
    packed = docs.sparkSession.sparkContext.broadcast(_ranks_file(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _contractor((packed.value, pattern))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _steps(pc.utf8_length(texts).to_pylist(), TEXT_STEP):
                some = texts.slice(a, b - a).to_pylist()
                out = [own.encode_long(some[0])] if len(some) == 1 and len(some[0]) > TEXT_STEP else list(own.encode(some))
                columns, names = [ids.slice(a, b - a), pa.array(out, pa.binary())], ["id", "ids"]
                if decoded:
                    columns, names = [*columns, pa.array(list(own.decode(out)), pa.binary())], [*names, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = docs.select(F.col(f"`{id}`").alias("id"), whole_text(text).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids binary" + (f", `{decoded}` binary" if decoded else "")).withColumnRenamed("id", id)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and ``ids``: the text's token ids as little-endian unsigned 32-bit integers, one binary per row.

    Same ids as tiktoken's ``encode_ordinary`` with these ranks and this pattern; no special tokens. Null
    counts as empty, an empty text has no ids, repeated rows are encoded each. The rank file is read on the
    driver and travels with the tasks (under 1 MB). No shuffle; a worker holds a step of texts and at most
    KEPT pieces.
    """
    return _encoded(docs, ranks_path, pattern, id, text, None)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", to: str = "decoded") -> DataFrame:
    """``encode``, and what ``decode`` makes of its ids as column ``to``, in one pass by one worker a task."""
    return _encoded(docs, ranks_path, pattern, id, text, to)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with ``to``: the bytes that the ids of column ``ids`` (as ``encode`` writes them) stand for. Null stays null."""
    packed = encoded.sparkSession.sparkContext.broadcast(_ranks_file(ranks_path))
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _contractor((packed.value, pattern))
        for batch in batches:
            if not batch.num_rows:
                continue
            many = batch.column(at).to_pylist()
            for a, b in _steps((len(m or b"") // 4 for m in many), ROW_STEP):
                text = own.decode([m or b"" for m in many[a:b]])
                column = pa.array([None if m is None else t for m, t in zip(many[a:b], text)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], names=[*batch.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{to}` binary")
