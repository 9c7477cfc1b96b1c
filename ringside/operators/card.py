"""Averages over a contestant's earlier bouts by their place on the card.

The five highest bout orders count as the main card, the rest as the others (ties:
the earlier bout). Bouts only come later, so one that has left the five never comes
back: a fold over each contestant's bouts in order, with five of them and the rest's
sums, instead of a join of each bout with all before it.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.dialect import Dialect, Part
from ..plans.features import MAIN_CARD
from ..plans.replay import RATES

MEASURES = {"sig": "sig_strikes_per_min", "td": "td_per_15min", "gr": "grappling_dominance"}
_OUT = "fight_url string, side int, n long, " + ", ".join(f"main_{m} double, prelim_{m} double" for m in MEASURES)


def _listed(d: Dialect) -> str:
    rates = ", ".join(f"CAST({RATES[r]} AS DOUBLE) AS {m}" for m, r in MEASURES.items())
    return f"SELECT fighter, tick, fight_url, CAST(side AS INT) AS side, CAST(bout_order AS DOUBLE) AS bout_order, coalesce(has, FALSE) AS has, {rates} FROM sides"


#: The input of ``averages`` from the replay's sides.
LISTED: Part = ("listed", _listed)


class _Past:
    """The bouts of one contestant so far."""

    def __init__(self) -> None:
        self.n, self.main, self.sums, self.counts, self.known = 0, [], [0.0] * len(MEASURES), [0] * len(MEASURES), None

    def add(self, order: float, tick: int, url: str, measures: tuple) -> None:
        self.n, self.known = self.n + 1, None
        insort(self.main, (-order, tick, url, measures), key=lambda x: x[:3])
        if len(self.main) > MAIN_CARD:
            for i, v in enumerate(self.main.pop()[3]):
                if v is not None:
                    self.sums[i] += v
                    self.counts[i] += 1

    def shown(self) -> tuple:
        if self.known is None:
            out: list = [self.n]
            for i in range(len(MEASURES)):
                top = [x[3][i] for x in self.main if x[3][i] is not None]
                out += [sum(top) / len(top) if top else None, self.sums[i] / self.counts[i] if self.counts[i] else None]
            self.known = tuple(out)
        return self.known


_NONE = (0, *[None] * (2 * len(MEASURES)))


def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(fighter, tick, fight_url, side, bout_order, has, measures...), sorted ->
    (fight_url, side, n, averages...) of the bouts before each tick."""
    who, at, past, today = None, None, _Past(), []
    for fighter, tick, url, side, order, has, *measures in rows:
        if fighter != who:
            who, past, today = fighter, _Past(), []
        elif tick != at:
            for x in today:
                past.add(*x)
            today = []
        at = tick
        yield (url, side, *(_NONE if order is None else past.shown()))
        if order is not None and has:
            today.append((order, tick, url, tuple(measures)))


def averages(rows: DataFrame) -> DataFrame:
    """fight_url, side, n (earlier bouts that count) and the averages of both places."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * (2 * len(MEASURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for row in folded(each()):
            out.append(row)
            if len(out) >= 10_000:
                yield made()
                out = []
        if out:
            yield made()

    columns = ["fighter", "tick", "fight_url", "side", "bout_order", "has", *MEASURES]
    return rows.select(*columns).repartition("fighter").sortWithinPartitions("fighter", "tick", "fight_url", "side").mapInArrow(run, _OUT)
