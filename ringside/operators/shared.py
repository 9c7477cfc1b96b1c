"""Shared opponents of bouts, found and summed where they are, group by group.

Joining histories to bouts gives as many rows as the square of a contestant's
bouts, so nothing of that kind is dealt. Opponents are cut into groups by their
names, and bouts into slices. A task has one of each: it gets the histories with
its opponents, as packed arrays, then its bouts, piece by piece, and passes on sums
a bout. It holds about ``ENTRIES`` entries of histories, some 120 bytes each while
they are sorted. Bouts are dealt once for each group, histories once for each slice.

Contestants are told apart by 64-bit hashes of their names (a million of them
share one with probability 3e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.opponents import DECAY, YEARS
from .ratings import LAST

# Rating of who isn't rated yet, and where ratings begin to count. Fixed values.
START, FLOOR, SPAN = 1500.0, 1000.0, 1000.0
ENTRIES, BOUTS = 1_800_000, 4_500_000
_ROWS, _AT_ONCE, _PIECE = 48, 8_192, 300_000
_HISTORY, _ELO, _PRESTIGE, _BOUTS = range(4)
_VALUE = (("x", "<i8"), ("tick", "<i4"), ("v", "<f8"))
#: Columns of a packed row; behind those of bouts come the bytes of their urls.
_LAYOUT = {_HISTORY: (("f", "<i8"), ("x", "<i8"), ("tick", "<i4"), ("late", "<i4"), ("of", "<i1")), _ELO: _VALUE, _PRESTIGE: _VALUE, _BOUTS: (("a", "<i8"), ("b", "<i8"), ("tick", "<i4"), ("late", "<i4"), ("size", "<i4"))}
_SUMS = "fight_url string, n long, sa double, sb double, won_a long, decided_a long, won_b long, decided_b long"
_PACKED = "task int, grp int, kind int, packed binary"


def bounds_of(rows: DataFrame, key: str, entries: int) -> list:
    """Values of ``key`` that cut its rows into groups of about ``ENTRIES`` of
    the ``entries``; none where one group holds all."""
    n = -(-entries // ENTRIES)
    if n < 2:
        return []
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)]).alias("cuts")).first()["cuts"] or []
    return sorted(set(cuts))


def _packed(kind: int, columns: dict, end: int, urls: pa.Array | None = None) -> Iterator[bytes]:
    """The first ``end`` rows in pieces; ``urls`` is a large binary array."""
    for at in range(0, end, _ROWS):
        to = min(at + _ROWS, end)
        parts = [np.int32(to - at).tobytes(), *(columns[c][at:to].astype(t).tobytes() for c, t in _LAYOUT[kind])]
        if urls is not None:
            offsets = np.frombuffer(urls.buffers()[1], dtype="<i8")
            parts.append(memoryview(urls.buffers()[2])[offsets[at] : offsets[to]] if offsets[to] > offsets[at] else b"")
        yield b"".join(parts)


def _unpacked(kind: int, pieces: list[bytes]) -> dict:
    out: dict = {c: [] for c, _ in _LAYOUT[kind]}
    urls = []
    for p in pieces:
        n, at = int(np.frombuffer(p, "<i4", 1)[0]), 4
        for c, t in _LAYOUT[kind]:
            out[c].append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
        urls.append(p[at:])
    columns = {c: np.concatenate(v) if v else np.zeros(0, t) for (c, t), v in zip(_LAYOUT[kind], out.values(), strict=True)}
    if kind == _BOUTS:
        offsets = np.append(0, np.cumsum(columns["size"], dtype=np.int32)).astype("<i4")
        columns["url"] = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(urls)))
    return columns


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["task", "grp", "kind", "packed"])


def _group(name: Column, bounds: list[str]) -> Column:
    """The number of bounds at or before the name."""
    return sum((F.when(name >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def _dealt(spark: SparkSession, n: int) -> list[int]:
    """A value for each group whose hash goes to a partition of its own."""
    rows = spark.range(50 * n + 50).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect()
    found = {r["p"]: r["v"] for r in rows}
    return [found[p] for p in range(n)] if len(found) == n else list(range(n))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Columns of some thousand rows at a time, as arrays."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _bouts_packed(bouts: DataFrame, bounds: list[str], slices: int, keys: list[int]) -> DataFrame:
    h = F.xxhash64
    of = lambda s: F.when(F.col("winner") == F.col(s), 1).when(F.col("winner").isNotNull(), 2).otherwise(0).cast("byte")
    rows = bouts.select(
        F.col("fight_url").alias("url"), h("a").alias("a"), h("b").alias("b"), F.col("tick").cast("int").alias("tick"), F.datediff("event_date", F.lit("1970-01-01")).alias("day"),
        of("a").alias("of_a"), of("b").alias("of_b"), _group(F.col("a"), bounds).alias("grp_a"), _group(F.col("b"), bounds).alias("grp_b"), F.pmod(h("fight_url"), F.lit(slices)).cast("int").alias("slice"),
    )
    groups = len(bounds) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches):
            c = {n: t.column(n).to_numpy() for n in t.column_names if n != "url"}
            late, out = c["day"] - c["tick"], []
            urls = t.column("url").combine_chunks().cast(pa.large_binary())
            by = np.lexsort((c["a"], c["slice"]))
            for s in range(slices):
                mine = by[c["slice"][by] == s]
                columns = {"a": c["a"][mine], "b": c["b"][mine], "tick": c["tick"][mine], "late": late[mine]}
                mine_urls = urls.take(pa.array(mine))
                columns["size"] = np.diff(np.frombuffer(mine_urls.buffers()[1], "<i8")[: len(mine) + 1]) if len(mine) else np.zeros(0)
                for piece in _packed(_BOUTS, columns, len(mine), mine_urls):
                    out += [(keys[k * slices + s], k, _BOUTS, piece) for k in range(groups)]
            twice = lambda x, y: np.concatenate([x, y])
            grp, x = twice(c["grp_b"], c["grp_a"]), twice(c["b"], c["a"])
            both = {"f": twice(c["a"], c["b"]), "x": x, "tick": twice(c["tick"], c["tick"]), "late": twice(late, late), "of": twice(c["of_a"], c["of_b"])}
            for k in range(groups):
                mine = np.flatnonzero(grp == k)
                mine = mine[np.argsort(x[mine], kind="stable")]
                for piece in _packed(_HISTORY, {n: v[mine] for n, v in both.items()}, len(mine)):
                    out += [(keys[k * slices + s], k, _HISTORY, piece) for s in range(slices)]
            if out:
                yield _rows(out)

    return rows.mapInArrow(run, _PACKED)


def _values_packed(values: DataFrame, kind: int, value: str, bounds: list[str], slices: int, keys: list[int]) -> DataFrame:
    """fighter, tick and a value of the contestants of each group."""
    rows = values.where(F.col(value).isNotNull()).select(F.xxhash64("fighter").alias("x"), F.col("tick").cast("int").alias("tick"), F.col(value).cast("double").alias("v"), _group(F.col("fighter"), bounds).alias("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches):
            c, out = {n: t.column(n).to_numpy() for n in t.column_names}, []
            for k in np.unique(c["grp"]).tolist():
                mine = np.flatnonzero(c["grp"] == k)
                mine = mine[np.argsort(c["x"][mine], kind="stable")]
                for piece in _packed(kind, {n: c[n][mine] for n in ("x", "tick", "v")}, len(mine)):
                    out += [(keys[k * slices + s], k, kind, piece) for s in range(slices)]
            if out:
                yield _rows(out)

    return rows.mapInArrow(run, _PACKED)


def _cutoff(day: np.ndarray) -> np.ndarray:
    """The same day of the month ``YEARS`` before, or that month's last."""
    date = day.astype("datetime64[D]")
    month = date.astype("datetime64[M]")
    old = month - 12 * YEARS
    last = (old + 1).astype("datetime64[D]") - old.astype("datetime64[D]") - np.timedelta64(1, "D")
    return (old.astype("datetime64[D]") + np.minimum(date - month.astype("datetime64[D]"), last)).astype(np.int64)


def _keyed(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    return (major.astype(np.int64) << 32) + (minor.astype(np.int64) + (1 << 31))


def _at(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)"""
    if not len(sorted_):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class _Values:
    """Values by contestant and tick; of equal ticks the greatest counts."""

    def __init__(self, got: dict, names: np.ndarray):
        x, tick, v = got["x"], got["tick"], got["v"]
        at, there = _at(names, x)
        key, v = _keyed(at[there], tick[there]), v[there]
        by = np.lexsort((v, key))
        key, v = key[by], v[by]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, dtype=bool)
        self.key, self.v = key[last], v[last]

    def of(self, x: np.ndarray, tick: np.ndarray, forward: bool, none: float) -> np.ndarray:
        """The first at or after the tick if ``forward``, else the last at or before it."""
        if not len(self.key):
            return np.full(len(x), none)
        at = np.searchsorted(self.key, _keyed(x, tick), side="left") if forward else np.searchsorted(self.key, _keyed(x, tick), side="right") - 1
        safe = np.clip(at, 0, len(self.key) - 1)
        return np.where((safe == at) & ((self.key[safe] >> 32) == x), self.v[safe], none)


class _Group:
    """The histories with one group's opponents, in two orders: by (contestant,
    opponent, tick) with running figures, and by (contestant, tick)."""

    def __init__(self, met: dict, elo: dict, prestige: dict):
        x, f, tick, of = met.pop("x"), met.pop("f"), met.pop("tick").astype(np.int64), met.pop("of")
        day = tick + met.pop("late")
        self.x_names, self.f_names = np.unique(x), np.unique(f)
        x, f = np.searchsorted(self.x_names, x).astype(np.int32), np.searchsorted(self.f_names, f).astype(np.int32)
        self.elo, self.prestige = (_Values(v, self.x_names) if len(v["x"]) else None for v in (elo, prestige))
        by = np.lexsort((tick, _keyed(f, x))).astype(np.int32)
        f, x, tick, day, of = f[by], x[by], tick[by], day[by], of[by]
        del by
        pair = _keyed(f, x)
        new = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, dtype=bool)
        self.pairs, self.start, self.x = pair[new], np.flatnonzero(new).astype(np.int32), x
        del pair
        self.number = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.at_tick = _keyed(self.number, tick)
        # the latest day so far within the pair
        self.day = ((np.maximum.accumulate(_keyed(self.number, day)) & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)
        run = lambda v: np.append(np.int32(0), np.cumsum(v, dtype=np.int32))
        self.won, self.decided = run(of == 1), run(of > 0)
        self.next = np.append(np.where(self.number[1:] == self.number[:-1], tick[1:], LAST), LAST).astype(np.int32) if len(tick) else tick
        # by (contestant, tick)
        self.order = np.lexsort((tick, f)).astype(np.int32)
        self.f_tick = _keyed(f[self.order], tick[self.order])
        self.f_day = np.maximum.accumulate(_keyed(f[self.order], day[self.order])) if len(day) else self.f_tick

    def sums(self, a: np.ndarray, b: np.ndarray, tick: np.ndarray, day: np.ndarray) -> np.ndarray:
        """n, sa, sb, won_a, decided_a, won_b, decided_b of each bout."""
        out, cut = np.zeros((7, len(a))), _cutoff(day)
        fa, in_a = _at(self.f_names, a)
        fb, in_b = _at(self.f_names, b)
        low, high = np.searchsorted(self.f_day, _keyed(fa, cut)), np.searchsorted(self.f_tick, _keyed(fa, tick))
        width = np.where(in_a & in_b, np.maximum(high - low, 0), 0)
        upto = np.cumsum(width)
        at = 0
        while at < len(a):  # pieces of a bounded number of entries, one bout at least
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PIECE, side="right")))
            self._piece(slice(at, end), width, low, fb, a, b, tick, day, cut, out)
            at = end
        return out

    def _piece(self, part: slice, width, low, fb, a, b, tick, day, cut, out) -> None:
        w = width[part]
        if not w.sum():
            return
        bout = np.repeat(np.arange(part.start, part.stop), w)
        entry = self.order[np.repeat(low[part] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
        last = self.next[entry] >= tick[bout]  # the last meeting before the tick
        bout, entry = bout[last], entry[last]
        x = self.x[entry]
        at, there = _at(self.pairs, _keyed(fb[bout], x))
        ok = there & (self.day[entry] >= cut[bout]) & (self.x_names[x] != a[bout]) & (self.x_names[x] != b[bout])
        bout, entry, x, at = bout[ok], entry[ok], x[ok], at[ok]
        other = np.searchsorted(self.at_tick, _keyed(at, tick[bout])) - 1
        ok = (other >= self.start[at])
        ok &= self.day[np.maximum(other, 0)] >= cut[bout]
        bout, entry, x, at, other = bout[ok], entry[ok], x[ok], at[ok], other[ok]
        first = self.start[self.number[entry]]
        won_a, decided_a = self.won[entry + 1] - self.won[first], self.decided[entry + 1] - self.decided[first]
        won_b, decided_b = self.won[other + 1] - self.won[self.start[at]], self.decided[other + 1] - self.decided[self.start[at]]
        aged = lambda d: np.exp(-DECAY * ((day[bout] - d) / 365.25))
        elo = self.elo.of(x, tick[bout], True, START) if self.elo else START
        prestige = self.prestige.of(x, tick[bout], False, 0.0) if self.prestige else 0.0
        weight = (0.5 * (np.maximum(elo - FLOOR, 0.0) / SPAN) + 0.5 * prestige) * ((aged(self.day[entry]) + aged(self.day[other])) / 2)
        share = lambda won, decided: weight * np.divide(won, decided, out=np.zeros(len(won)), where=decided > 0)
        figures = (np.ones(len(bout)), share(won_a, decided_a), share(won_b, decided_b), won_a, decided_a, won_b, decided_b)
        n = part.stop - part.start
        for k, v in enumerate(figures):
            out[k, part] += np.bincount(bout - part.start, weights=v, minlength=n)


def sums(bouts: DataFrame, bounds: list[str], expected: int, elo: DataFrame | None = None, prestige: DataFrame | None = None) -> DataFrame:
    """n, sa, sb, won_a, decided_a, won_b, decided_b of every bout (fight_url, tick,
    event_date, a, b, winner): what ``finished`` needs. ``bounds``: sorted names that cut
    the contestants into groups; ``expected``: about how many bouts there are. ``elo``:
    (fighter, tick, elo), known before each of a contestant's own ticks, and after the
    last; a rating changes at own bouts only, so the first at or after the bout's tick is
    the one before it. ``prestige``: (fighter, tick, score); the last at or before."""
    groups, slices = len(bounds) + 1, max(1, -(-expected // BOUTS))
    keys = _dealt(bouts.sparkSession, groups * slices)
    rows = _bouts_packed(bouts, bounds, slices, keys)
    for values, kind, value in ((elo, _ELO, "elo"), (prestige, _PRESTIGE, "score")):
        if values is not None:
            rows = rows.union(_values_packed(values, kind, value, bounds, slices, keys))
    names = [c.split()[0] for c in _SUMS.split(", ")]

    def judged(index: _Group, pieces: list[bytes], all_shown: bool) -> pa.RecordBatch:
        got = _unpacked(_BOUTS, pieces)
        tick = got["tick"].astype(np.int64)
        found = index.sums(got["a"], got["b"], tick, tick + got["late"])
        shown = np.arange(len(tick)) if all_shown else np.flatnonzero(found[0] > 0)
        figures = [pa.array(found[k, shown] if k in (1, 2) else found[k, shown].astype(np.int64)) for k in range(7)]
        return pa.RecordBatch.from_arrays([got["url"].take(pa.array(shown)), *figures], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, grp, held, index = None, 0, {}, None
        for batch in batches:
            kinds, grps, tasks = (batch.column(c).to_numpy() for c in ("kind", "grp", "task"))
            for i in range(batch.num_rows):
                if tasks[i] != task:
                    if held.get(_BOUTS):
                        yield judged(index, held[_BOUTS], grp == 0)
                    task, grp, held, index = tasks[i], grps[i], {k: [] for k in _LAYOUT}, None
                if kinds[i] == _BOUTS and index is None:
                    index = _Group(*(_unpacked(k, held.pop(k)) for k in (_HISTORY, _ELO, _PRESTIGE)))
                held[kinds[i]].append(batch.column("packed")[i].as_py())
                if len(held.get(_BOUTS, ())) * _ROWS >= _AT_ONCE:
                    yield judged(index, held[_BOUTS], grp == 0)  # the first group shows every bout
                    held[_BOUTS] = []
        if held.get(_BOUTS):
            yield judged(index, held[_BOUTS], grp == 0)

    parts = rows.repartition(groups * slices, "task").sortWithinPartitions("task", "kind").mapInArrow(run, _SUMS)
    return parts.groupBy("fight_url").agg(*[F.sum(c).alias(c) for c in names[1:]])


def finished(found: DataFrame) -> DataFrame:
    """The columns of common opponents for each bout; NULL where there are none."""
    some = lambda value: F.when(F.col("n") > 0, value)
    rate = lambda s: some(F.coalesce(F.try_divide(f"won_{s}", f"decided_{s}"), F.lit(0.0)))
    return found.select(
        "fight_url", F.col("n").cast("int").alias("n_common_opponents"), some(F.col("sa")).alias("common_opp_score_a"), some(F.col("sb")).alias("common_opp_score_b"),
        some(F.col("sa") - F.col("sb")).alias("common_opp_score_delta"), rate("a").alias("common_opp_a_win_rate"), rate("b").alias("common_opp_b_win_rate"),
    )
