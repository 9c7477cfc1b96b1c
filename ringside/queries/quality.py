"""The eleven invariants, quarantine, era report and the quarantine anti-join."""

from __future__ import annotations

from ..plans import canonical
from ..plans import quality as Q
from ..plans.bouts import FIGHTERS_FROM_SALES
from ..plans.dialect import Dialect, Duck, Spark
from .base import Registry

_r = Registry()
_SALES = ("lineitem", "orders", "customer", "supplier")
TODAY = "2001-01-01"
LABEL_START = "1997-01-01"


class _Inner:
    """The canonical tables are parts of the plan itself here."""

    def table(self, name: str) -> str:
        return name if name in {n for n, _ in canonical.TABLES} else super().table(name)


class _Spark(_Inner, Spark):
    pass


class _Duck(_Inner, Duck):
    pass


def _local(part):
    name, sql = part
    return name, lambda d: sql(_Spark() if d.name == "spark" else _Duck())


_base = (FIGHTERS_FROM_SALES, *canonical.TABLES)
for _name, _sql in Q.invariants(TODAY).items():
    _r.staged(f"dq_{_name}", (*_base, _local(("out", _sql))), *_SALES)
_all = (*_base, _local(Q.all_findings(TODAY)))
_r.staged("dq_quarantine", (*_all, Q.QUARANTINE), *_SALES)
_r.staged("dq_era_report", (*_all, Q.era_report(LABEL_START)), *_SALES)
_r.staged("dq_reason_counts", (*_all, ("out", lambda d: "SELECT coalesce(table_name, 'all') AS table_name, coalesce(reason_code, 'all') AS reason_code, count(*) AS n FROM violations GROUP BY ROLLUP (table_name, reason_code)")), *_SALES)


def _kept(d: Dialect) -> str:
    """Totals rows that no finding names."""
    return """SELECT t.fight_url, t.fighter_url, t.significant_strikes_landed FROM fight_totals t
LEFT JOIN (SELECT DISTINCT row_key FROM quarantine WHERE table_name = 'fight_totals') q ON q.row_key = t.fight_url || '|' || t.fighter_url WHERE q.row_key IS NULL"""


_r.staged("dq_quarantine_antijoin", (*_all, Q.QUARANTINE, ("out", _kept)), *_SALES)

QUERIES, SQL = _r.queries, _r.sql
