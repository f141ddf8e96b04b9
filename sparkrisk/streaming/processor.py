"""History features from keyed state: the per-event twin of operators.history.

State of an entity: count, moments of the amount, extremes, last time, and the times of the last
24 hours. The newest times sit next to the moments; beyond ``INLINE_TIMES`` they move into
time buckets of a map state. Only bucket counts and the one or two buckets that hold a cut-off
are read back, so the cost of a very busy entity does not grow with its day.

Entities are dealt into a fixed number of groups, and a group is Spark's key: calling Python, making a
frame and asking for state cost much more than an entity's few events, so a group pays for them once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

INLINE_TIMES = 4096
BUCKETS_PER_SPAN = 96
#: Events of one key whose features are made at a time.
CHUNK = 65_536
#: Groups of entities; a checkpoint's number is fixed, as its state is kept by group.
GROUPS = 2048

MOMENTS_SCHEMA = ("n bigint, m bigint, mean double, m2 double, low double, high double, last bigint, "
                  "times binary, bucket_ids binary, bucket_counts binary")


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.int64).tobytes()


def _unpack(b) -> np.ndarray:
    return np.frombuffer(bytes(b), dtype=np.int64) if b else np.empty(0, dtype=np.int64)


def merged(left: tuple, right: tuple) -> tuple:
    """Number, mean and squared deviations of two runs of values together, element by element."""
    (n, mean, m2), (k, other, more) = left, right
    share = np.divide(k, n + k, out=np.zeros(len(k)), where=n + k > 0)
    d = other - mean
    return n + k, np.where(n > 0, mean + d * share, other), m2 + more + d * d * n * share


def prefix_moments(a: np.ndarray) -> tuple:
    """Number, mean and squared deviations of the values up to each place; NaN is no value.

    Runs of 1, 2, 4, … values are merged with the run before them, so there are log2(n) steps over whole arrays.
    """
    known = ~np.isnan(a)
    out = known.astype(float), np.where(known, a, 0.0), np.zeros(len(a))
    step = 1
    while step < len(a):
        more = merged(tuple(x[:-step] for x in out), tuple(x[step:] for x in out))
        out = tuple(np.concatenate([x[:step], y]) for x, y in zip(out, more))
        step *= 2
    return out


class HistoryProcessor:
    """One entity: features of each event before the event enters the state.

    ``state`` and ``spill`` are the entity's value and its map, as GroupProcessor hands them over.

    ``late="accept"`` treats an event older than the entity's last time as it comes;
    ``late="route"`` marks it ``is_late`` without features and leaves the state alone.
    """

    # input columns; plain identifiers, because chunks reach Python as named tuples
    id_col, time_col, amount_col = "row_id", "row_time", "row_amount"

    def __init__(self, id_name, keep, names, spans, units, late="accept", inline_times=INLINE_TIMES):
        self.inline_times = inline_times
        self.id_name, self.names = id_name, list(names)
        self.keep, self.spans, self.units = list(keep), dict(spans), units
        self.late = late
        self.longest = max(self.spans.values())
        self.bucket = max(1, self.longest // BUCKETS_PER_SPAN)

    # -- state access -------------------------------------------------------------

    def _load(self):
        stored = self.state.get()
        if stored is None:
            return dict(n=0, m=0, mean=0.0, m2=0.0, low=None, high=None, last=None,
                        times=_unpack(None), ids=_unpack(None), counts=_unpack(None))
        n, m, mean, m2, low, high, last, times, ids, counts = stored
        return dict(n=n, m=m, mean=mean, m2=m2, low=low, high=high, last=last,
                    times=_unpack(times), ids=_unpack(ids), counts=_unpack(counts))

    def _store(self, s) -> None:
        if s["last"] is not None:
            oldest = s["last"] - self.longest
            s["times"] = s["times"][np.searchsorted(s["times"], oldest, "left"):]
            self._drop_expired(s, oldest)
        if len(s["times"]) > self.inline_times:
            self._move_out(s)
        self.state.update((int(s["n"]), int(s["m"]), float(s["mean"]), float(s["m2"]), s["low"], s["high"], s["last"],
                           _pack(s["times"]), _pack(s["ids"]), _pack(s["counts"])))

    def _drop_expired(self, s, oldest) -> None:
        gone = s["ids"] < oldest // self.bucket
        for b in s["ids"][gone]:
            self.spill.removeKey((int(b),))
        s["ids"], s["counts"] = s["ids"][~gone], s["counts"][~gone]

    def _move_out(self, s) -> None:
        cut = len(s["times"]) - self.inline_times // 2
        old, s["times"] = s["times"][:cut], s["times"][cut:]
        counts = dict(zip(s["ids"].tolist(), s["counts"].tolist()))
        buckets = old // self.bucket
        for b in np.unique(buckets).tolist():
            part = old[buckets == b]
            if b in counts:
                part = np.sort(np.concatenate([self._bucket(b), part]))
            self.spill.updateValue((b,), (_pack(part),))
            counts[b] = len(part)
        s["ids"] = np.array(sorted(counts), dtype=np.int64)
        s["counts"] = np.array([counts[b] for b in sorted(counts)], dtype=np.int64)

    def _bucket(self, b: int) -> np.ndarray:
        got = self.spill.getValue((int(b),))
        return _unpack(got[0]) if got else _unpack(None)

    def _times_since(self, s, cutoffs: np.ndarray) -> np.ndarray:
        """Stored times at or after each cut-off."""
        out = len(s["times"]) - np.searchsorted(s["times"], cutoffs, "left")
        if len(s["ids"]):
            where = cutoffs // self.bucket
            at = np.searchsorted(s["ids"], where, "left")
            tail = np.append(np.cumsum(s["counts"][::-1])[::-1], 0)
            out = out + tail[at]
            for b in np.intersect1d(where, s["ids"]):
                hit = where == b
                out[hit] -= np.searchsorted(self._bucket(b), cutoffs[hit], "left")
        return out

    # -- events --------------------------------------------------------------------

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.take(np.lexsort((sortable(frame[self.id_col]), frame[self.time_col].to_numpy())))
        t, a = self.values(frame)
        late, features = self.run(t, a)
        for at, f in features:
            yield self._shape(frame.take(at), f, False)
        if late.any():
            yield self._shape(frame[late], None, True)

    def values(self, frame) -> tuple[np.ndarray, np.ndarray]:
        return frame[self.time_col].to_numpy(dtype=np.int64), frame[self.amount_col].to_numpy(dtype=np.float64, na_value=np.nan)

    def run(self, t: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, dict]]]:
        """Which of the events (in order) are late, and places and features of the others, which enter the state."""
        s = self._load()
        late = t < s["last"] if self.late == "route" and s["last"] is not None else np.zeros(len(t), dtype=bool)
        fresh, out = np.flatnonzero(~late), []
        for at in range(0, len(fresh), CHUNK):
            part = fresh[at:at + CHUNK]
            out.append((part, self._features(s, t[part], a[part])))
            self._store(s)
        return late, out

    def _advance(self, s, frame) -> dict:
        return self._features(s, *self.values(frame))

    def _features(self, s, t: np.ndarray, a: np.ndarray) -> dict:
        size = len(t)
        index = np.arange(size)
        out = {"n": s["n"] + index}
        for name, span in self.spans.items():
            cutoffs = t - span
            out[name] = self._times_since(s, cutoffs) + index - np.minimum(index, np.searchsorted(t, cutoffs, "left"))
        nothing = math.nan
        before = (float(s["m"]), s["mean"], s["m2"])
        m, mu, m2 = merged(tuple(np.full(size + 1, x) for x in before), tuple(np.concatenate([[0.0], x]) for x in prefix_moments(a)))
        first = [nothing if s[k] is None else s[k] for k in ("low", "high")]
        low, high = np.fmin.accumulate(np.concatenate([first[:1], a])), np.fmax.accumulate(np.concatenate([first[1:], a]))
        mean = np.where(m > 0, mu, nothing)[:-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            std = np.where(m > 1, np.where(low == high, 0.0, np.sqrt(np.maximum(m2, 0.0) / (m - 1))), nothing)[:-1]
        previous = np.concatenate([[np.nan if s["last"] is None else float(s["last"])], np.full(size - 1, np.nan)])
        gap = (t - previous) / self.units
        gap[1:] = (t[1:] - np.maximum(t[:-1], t[0] if s["last"] is None else s["last"])) / self.units
        if s["last"] is not None:
            gap[0] = (int(t[0]) - s["last"]) / self.units
        out.update(mean=mean, std=std, low=low[:-1], high=high[:-1], gap=gap, amount=a)
        s.update(n=s["n"] + size, m=int(m[-1]), mean=float(mu[-1]), m2=float(m2[-1]),
                 low=None if math.isnan(low[-1]) else float(low[-1]), high=None if math.isnan(high[-1]) else float(high[-1]),
                 last=int(t[-1]) if s["last"] is None else max(s["last"], int(t[-1])),
                 times=np.sort(np.concatenate([s["times"], t])))
        return out

    def _shape(self, frame, f, late) -> pd.DataFrame:
        out = {self.id_name: frame[self.id_col].to_numpy()}
        out.update({c: frame[f"k{i}"].array for i, c in enumerate(self.keep)})
        if f is None:
            nothing = pd.array([None] * len(frame), dtype="Float64")
            whole = pd.array([None] * len(frame), dtype="Int64")
            base = [whole] + [nothing] * 9
            counts = [whole] * len(self.spans)
        else:
            a, mean, std = f["amount"], f["mean"], f["std"]
            with np.errstate(divide="ignore", invalid="ignore"):
                by_mean = np.where(mean != 0, a / mean, np.nan)
                z = np.where(std > 0, (a - mean) / std, np.nan)
            # NaN in a float column leaves Python as NULL
            base = [f["n"], np.log1p(f["n"]), mean, std, f["low"], f["high"], f["gap"], by_mean, a - mean, z]
            counts = [f[w] for w in self.spans]
        out.update(dict(zip(self.names, base + counts)))
        out["is_late"] = late
        return pd.DataFrame(out)

    # -- warm start ------------------------------------------------------------------

    def begin(self, moments: tuple | None, t: np.ndarray) -> None:
        """Moments of warm_start_table (number, number of amounts, mean, m2, least, greatest, last time), if they are known by now, and recent times."""
        s = self._load()
        if moments is not None:
            n, m, mean, m2, low, high, last = moments
            s.update(n=int(n), m=int(m), mean=0.0 if pd.isna(mean) else float(mean), m2=float(m2),
                     low=None if pd.isna(low) else float(low), high=None if pd.isna(high) else float(high), last=int(last))
        if len(t):
            s["times"] = np.sort(np.concatenate([s["times"], t]))
        self._store(s)


def sortable(ids: pd.Series) -> np.ndarray:
    return (ids.rank() if ids.dtype == object else ids).to_numpy()


class _Held:
    """The value of one entity of a group."""

    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value


class _OwnBuckets:
    """The buckets of one entity in the group's map."""

    def __init__(self, of, entity):
        self.of, self.entity = of, entity

    def getValue(self, bucket):
        return self.of.getValue((self.entity, *bucket))

    def updateValue(self, bucket, value) -> None:
        self.of.updateValue((self.entity, *bucket), value)

    def removeKey(self, bucket) -> None:
        self.of.removeKey((self.entity, *bucket))


class GroupProcessor(StatefulProcessor):
    """The entities of a group, each by ``HistoryProcessor``: one list holds their values, one map the buckets of the busy ones.

    A list is written anew as a whole, so each value says when it was last written, and with a time to live an entity
    that wasn't written for that long begins anew; the list itself goes when none of its entities was.
    """

    def __init__(self, own: HistoryProcessor, entity_type: str, ttl_ms=None):
        self.own, self.entity_type, self.ttl_ms = own, entity_type, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getListState("moments", f"entity {self.entity_type}, {MOMENTS_SCHEMA}, written bigint", self.ttl_ms)
        self.spill = handle.getMapState("old_times", f"entity {self.entity_type}, bucket bigint", "times binary", self.ttl_ms)

    def close(self) -> None:
        pass

    def _load(self, now: int) -> dict:
        """Entity's key -> [entity, its value, when it was written]; expired ones are dropped with their buckets."""
        out = {}
        for entity, *value, written in self.state.get():
            if self.ttl_ms and written + self.ttl_ms <= now:
                for b in _unpack(value[8]).tolist():
                    self.spill.removeKey((entity, b))
            else:
                out[_key(entity)] = [entity, tuple(value), written]
        return out

    def _store(self, held: dict) -> None:
        self.state.put([(entity, *value, written) for entity, value, written in held.values()])

    def _entity(self, held: dict, entity) -> _Held:
        """Hands an entity's state to ``own``."""
        self.own.state = _Held(held[_key(entity)][1] if _key(entity) in held else None)
        self.own.spill = _OwnBuckets(self.spill, entity)
        return self.own.state

    def handleInputRows(self, key, rows, timerValues):
        # all rows of the group in this micro-batch; the source's rate limit bounds them
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        own, now = self.own, timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else None
        codes, entities = pd.factorize(frame["entity"], use_na_sentinel=False)
        frame = frame.take(order := np.lexsort((sortable(frame[own.id_col]), frame[own.time_col].to_numpy(), codes)))
        t, a = own.values(frame)
        bounds = np.searchsorted(codes[order], np.arange(len(entities) + 1))
        held, places, found, size, late_places = self._load(now), [], [], 0, []
        for entity, begin, end in zip(entities.tolist(), bounds[:-1], bounds[1:]):
            state = self._entity(held, entity)
            late, features = own.run(t[begin:end], a[begin:end])
            late_places.append(begin + np.flatnonzero(late))
            if features:
                held[_key(entity)] = [entity, state.value, now]
            for at, f in features:
                places.append(begin + at)
                found.append(f)
                size += len(at)
                if size >= CHUNK:
                    yield self._shape(frame, places, found)
                    places, found, size = [], [], 0
        self._store(held)
        if places:
            yield self._shape(frame, places, found)
        late = np.concatenate(late_places)
        if len(late):
            yield own._shape(frame.take(late), None, True)

    def _shape(self, frame, places, found) -> pd.DataFrame:
        return self.own._shape(frame.take(np.concatenate(places)), {k: np.concatenate([f[k] for f in found]) for k in found[0]}, False)

    # -- warm start ------------------------------------------------------------------

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of warm_start_table: one for each entity with its moments, further ones with recent times. A group's rows may come in several parts."""
        if not len(initialState):
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else None
        codes, entities = pd.factorize(initialState["entity"], use_na_sentinel=False)
        known, timed = (initialState["kind"] == "state").to_numpy(), (initialState["kind"] == "time").to_numpy()
        columns = ["n", "n_amt", "mean_amt", "m2", "min_amt", "max_amt", "last_time"]
        moments = dict(zip(codes[known].tolist(), initialState.loc[known, columns].itertuples(index=False, name=None)))
        recent, of = initialState[timed], codes[timed]
        order = np.argsort(of, kind="stable")
        n = recent["n"].to_numpy(dtype=np.int64)[order]
        t, of = np.repeat(recent["last_time"].to_numpy(dtype=np.int64)[order], n), np.repeat(of[order], n)
        bounds = np.searchsorted(of, np.arange(len(entities) + 1))
        held = self._load(now)
        for k, entity in enumerate(entities.tolist()):
            state = self._entity(held, entity)
            self.own.begin(moments.get(k), t[bounds[k]:bounds[k + 1]])
            held[_key(entity)] = [entity, state.value, now]
        self._store(held)


def _key(entity):
    """What equal entities share, NaN included; there is no null."""
    return None if entity != entity else bytes(entity) if isinstance(entity, bytearray) else entity
