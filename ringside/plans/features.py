"""Feature families over the replayed states: A - B is focal less opponent.

Each family is a list of (column, SQL) over ``framed``: the focal row's prior
state, ``opp`` (the opponent's, from the other row of the bout), and both
profiles. NULL means unknown; the exceptions (counts of a debut, rates without a
win) are written out. Ratings come from ``operators.ratings`` and are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from .dialect import Dialect, Part, Spark, columns, difference
from .replay import RATES, SUMS

#: Weight classes from light to heavy. Fixed values.
CLASS_ORDER = (
    "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight", "Strawweight", "Flyweight", "Bantamweight",
    "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight", "Heavyweight",
)
#: Methods of an injury stoppage, as exact texts. Fixed values.
INJURY_METHODS = ("Could Not Continue", "Could Not Continue - Injury", "TKO - Doctor's Stoppage", "Doctor's Stoppage", "Overturned - Injury")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def class_rank(name: str) -> str:
    return "CASE " + name + "".join(f" WHEN {quoted(c)} THEN {i}" for i, c in enumerate(CLASS_ORDER)) + " END"


def dbl(sql: str) -> str:
    return f"CAST({sql} AS DOUBLE)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN {dbl('1')} ELSE {dbl('0')} END"


def ratio(a: str, b: str) -> str:
    return f"{a} / nullif({dbl(b)}, 0)"


def whole_age(dob: str) -> str:
    return (
        f"{dbl(f'year(event_date) - year({dob}) - CASE WHEN month(event_date) * 100 + day(event_date) < month({dob}) * 100 + day({dob}) THEN 1 ELSE 0 END')}"
    )


def _state(d: Dialect) -> str:
    return d.pack(fights="fights", wins="wins", ko_wins="ko_wins", submission_wins="submission_wins", rolling="rolling")


def _paired(d: Dialect) -> str:
    w = "OVER (PARTITION BY fight_url ORDER BY side)"
    return f"SELECT *, coalesce(lag(st) {w}, lead(st) {w}) AS opp FROM (SELECT *, {_state(d)} AS st FROM prior_state) s"


def _framed(d: Dialect) -> str:
    return """SELECT p.*, f.height_cm, f.reach_cm, f.stance, f.dob, o.height_cm AS o_height_cm, o.reach_cm AS o_reach_cm, o.stance AS o_stance, o.dob AS o_dob
FROM paired p LEFT JOIN profiles f ON p.fighter = f.fighter LEFT JOIN profiles o ON p.opponent = o.fighter"""


def _class_members(d: Dialect) -> str:
    """Contestants of each class and the year they are first seen in it."""
    return """SELECT weight_class, s.fighter, min(year(event_date)) AS since, max(reach_cm) AS reach_cm, max(height_cm) AS height_cm
FROM sides s JOIN profiles f ON s.fighter = f.fighter GROUP BY weight_class, s.fighter"""


def _class_limits(d: Dialect) -> str:
    """75th percentiles of reach and height of a class, from contestants seen in
    it before the year."""
    return f"""SELECT y.yr, m.weight_class, {d.percentile('reach_cm', 0.75)} AS reach_p75, {d.percentile('height_cm', 0.75)} AS height_p75
FROM (SELECT DISTINCT year(event_date) AS yr FROM ticks_dates) y JOIN class_members m ON m.since < y.yr GROUP BY y.yr, m.weight_class"""


def _ticks_dates(d: Dialect) -> str:
    return "SELECT DISTINCT event_date FROM bouts"


FRAME: tuple[Part, ...] = (("paired", _paired), ("framed_plain", _framed))
LIMITS: tuple[Part, ...] = (("ticks_dates", _ticks_dates), ("class_members", _class_members), ("class_limits", _class_limits))


def _framed_with_limits(d: Dialect) -> str:
    return """SELECT f.*, l.reach_p75, l.height_p75 FROM framed_plain f
LEFT JOIN class_limits l ON l.weight_class = f.last_state.klass AND l.yr = year(f.event_date)"""


FRAME_ALL: tuple[Part, ...] = (*FRAME, *LIMITS, ("framed", _framed_with_limits))


def activity(d: Dialect) -> dict[str, str]:
    since = dbl(d.days("event_date", "last_state.day"))
    injury = ", ".join(quoted(m) for m in INJURY_METHODS)
    return {
        "days_since_last_fight": since,
        "fights_last_12mo": dbl("fights_12mo"), "fights_last_3yr": dbl("fights_3yr"), "fights_last_5yr": dbl("fights_5yr"),
        "total_ufc_fights": dbl("fights"),
        "last_fight_injury_stoppage": f"CASE WHEN fights > 0 THEN {flag(f'last_state.method IN ({injury})')} END",
        "age_x_inactivity": f"{d.days('event_date', 'dob')} / {dbl('365.25')} * {since}",
        "inactivity_tier": f"CASE WHEN {since} < 180 THEN {dbl('0')} WHEN {since} <= 365 THEN {dbl('1')} WHEN {since} <= 730 THEN {dbl('2')} WHEN {since} > 730 THEN {dbl('3')} END",
    }


def experience(d: Dialect) -> dict[str, str]:
    return {
        "title_fight_experience": dbl("title_fights"), "has_been_champion": flag("first_title_date IS NOT NULL"),
        "days_as_champion": f"coalesce({dbl(d.days('event_date', 'first_title_date'))}, {dbl('0')})",
        "main_event_experience": dbl("five_round_fights"), "five_round_experience": dbl("five_round_fights"),
        "five_round_win_pct": ratio("five_round_wins", "five_round_fights"),
    }


OPP_FINISH = f"coalesce({ratio('(opp.ko_wins + opp.submission_wins)', 'opp.wins')}, {dbl('0')})"


def finishing(d: Dialect) -> dict[str, str]:
    rate = lambda n: f"coalesce({ratio(n, 'wins')}, {dbl('0')})"
    stopped = "finished_by_ko + finished_by_sub"
    return {
        "finish_rate": rate("(ko_wins + submission_wins)"), "ko_rate": rate("ko_wins"), "submission_rate": rate("submission_wins"),
        "early_finish_rate": rate("round_one_finishes"), "has_ever_been_finished": flag(f"{stopped} > 0"),
        "times_finished_by_ko": dbl("finished_by_ko"), "times_finished_by_sub": dbl("finished_by_sub"), "has_been_finished_r1": flag("finished_round_one > 0"),
        "never_been_finished": flag(f"{stopped} = 0"), "avg_fight_duration_sec": "rolling.avg_seconds", "fight_duration_variance": "rolling.var_seconds",
        "never_been_finished_x_opp_finish_rate": f"CASE WHEN {stopped} = 0 THEN {OPP_FINISH} ELSE {dbl('0')} END",
    }


def output(d: Dialect) -> dict[str, str]:
    return {r: f"rolling.avg_{r}" for r in RATES}


def physical(d: Dialect) -> dict[str, str]:
    return {
        "height_cm": "height_cm", "reach_cm": "reach_cm", "reach_to_height_ratio": "reach_cm / nullif(height_cm, 0)", "stance": "stance",
        "age_at_fight": whole_age("dob"), "weight_class": "weight_class",
    }


def record(d: Dialect) -> dict[str, str]:
    pct = ratio("wins", "fights")
    stopped = "(finished_by_ko + finished_by_sub)"
    debut = "fights = 0 AND opp.fights > 0"
    return {
        "win_pct_all": pct, "win_pct_last3": f"CASE WHEN fights >= 3 THEN {pct} END", "win_pct_last5": f"CASE WHEN fights >= 5 THEN {pct} END",
        "current_streak": f"coalesce({dbl('last_state.streak')}, {dbl('0')})", "win_pct_by_finish": ratio("(ko_wins + submission_wins)", "wins"),
        "win_pct_by_decision": ratio("decision_wins", "wins"), "loss_pct_by_finish": ratio(stopped, "losses"),
        "loss_pct_by_decision": ratio(f"(losses - {stopped})", "losses"), "ufc_win_pct": pct, "ufc_record_fights_count": dbl("fights"),
        "is_ufc_debut": flag("fights = 0"), "debut_opponent_ufc_experience": f"CASE WHEN {debut} THEN {dbl('opp.fights')} END",
        "debut_opponent_ufc_win_pct": f"CASE WHEN {debut} THEN {ratio('opp.wins', 'opp.fights')} END",
        "contender_series_win": flag("event_url LIKE '%contender-series%'"),
    }


def rematch(d: Dialect) -> dict[str, str]:
    met = "meeting.day IS NOT NULL"
    return {
        "is_rematch": flag(met), "fights_since_first_meeting": f"CASE WHEN {met} THEN {dbl('fights - meeting.upto')} END",
        "result_of_first_meeting": f"CASE WHEN {met} THEN CASE WHEN meeting.winner IS NULL THEN {dbl('0.5')} WHEN meeting.winner = fighter THEN {dbl('1')} ELSE {dbl('0')} END END",
        "first_meeting_method": "meeting.method", "first_meeting_competitive": f"CASE WHEN {met} THEN {flag('upper(meeting.method) LIKE ' + quoted('%DECISION%'))} END",
        "first_meeting_score_delta": dbl("meeting.round"),
    }


def weight(d: Dialect) -> dict[str, str]:
    known = "fights > 0"
    first, now = class_rank("last_state.first_class"), class_rank("last_state.klass")
    large = flag("reach_cm > reach_p75 AND height_cm > height_p75")
    return {
        "is_weight_class_change": f"CASE WHEN {known} THEN {flag('last_state.first_class <> last_state.klass')} END",
        "direction_of_change": f"CASE WHEN {known} THEN {dbl(f'sign({now} - {first})')} END",
        "fights_at_current_class": f"CASE WHEN {known} THEN {dbl('last_state.class_n')} END",
        "win_pct_at_current_class": f"CASE WHEN {known} THEN {ratio('last_state.class_won', 'last_state.class_n')} END",
        "prior_class_win_pct": f"CASE WHEN {known} AND last_state.first_class <> last_state.klass THEN {ratio('last_state.first_won', 'last_state.first_n')} END",
        "is_large_for_class": f"CASE WHEN {known} THEN {large} END",
        "grappling_utilization_rate": f"CASE WHEN {known} THEN rolling.avg_grapple END",
        "weight_bully_score": f"CASE WHEN {known} THEN {large} * rolling.avg_grapple END",
    }


def weight_cut(d: Dialect) -> dict[str, str]:
    first, now = class_rank("last_state.first_class"), class_rank("last_state.klass")
    none = "CAST(NULL AS DOUBLE)"
    return {
        "missed_weight_last_3": none, "missed_weight_career": none,
        "moving_down_in_weight": f"CASE WHEN {now} IS NOT NULL AND {first} IS NOT NULL THEN {flag(f'{now} < {first}')} END",
        "short_notice": none, "full_camp": none,
    }


def matchup(d: Dialect) -> dict[str, str]:
    f, o = (lambda r: f"rolling.avg_{r}"), (lambda r: f"opp.rolling.avg_{r}")
    delta = lambda r: f"{f(r)} - {o(r)}"
    wrestler = lambda g: f"({g('td_accuracy_pct')} * {g('td_per_15min')} * {g('td_defense_pct')})"
    sub_f = f"({f('sub_attempts_per_15min')} * ({ratio('submission_wins', 'wins')}))"
    sub_o = f"({o('sub_attempts_per_15min')} * ({ratio('opp.submission_wins', 'opp.wins')}))"
    wf, wo = wrestler(f), wrestler(o)
    both = "rolling.tick IS NOT NULL AND opp.rolling.tick IS NOT NULL"
    striker = lambda g: f"coalesce({g('sig_strikes_per_min')} >= 4 AND coalesce({g('td_per_15min')} < 3, TRUE), FALSE)"
    grappler = lambda g: f"coalesce({g('td_per_15min')} >= 3, FALSE)"
    pressure = lambda g: f"coalesce({g('sig_strikes_per_min')} >= 5, FALSE)"
    counter = lambda g: f"coalesce({g('damage_ratio')} >= 1.5 AND {g('sig_strikes_per_min')} < 4, FALSE)"
    var_f, var_o = "rolling.var_seconds", "opp.rolling.var_seconds"
    none = "CAST(NULL AS DOUBLE)"
    return {
        "reach_delta": "reach_cm - o_reach_cm", "height_delta": "height_cm - o_height_cm", "age_delta": f"{whole_age('dob')} - {whole_age('o_dob')}",
        "stance_matchup": "CASE WHEN stance IS NULL OR o_stance IS NULL THEN NULL WHEN stance = 'Switch' OR o_stance = 'Switch' THEN 'switch_involved' "
        "WHEN stance = 'Southpaw' AND o_stance = 'Southpaw' THEN 'south_v_south' WHEN stance = 'Southpaw' OR o_stance = 'Southpaw' THEN 'ortho_v_south' ELSE 'ortho_v_ortho' END",
        "southpaw_matchup": f"CASE WHEN stance IS NULL OR o_stance IS NULL THEN NULL ELSE {flag(chr(39) + 'Southpaw' + chr(39) + ' IN (stance, o_stance)')} END",
        "finish_rate_delta": f"{ratio('(ko_wins + submission_wins)', 'wins')} - {ratio('(opp.ko_wins + opp.submission_wins)', 'opp.wins')}",
        "five_round_experience_delta": none, "ufc_experience_delta": f"CASE WHEN fights > 0 AND opp.fights > 0 THEN {dbl('fights - opp.fights')} END",
        "title_fight_exp_delta": none, "striking_efficiency_delta": delta("striking_accuracy_pct"), "td_accuracy_delta": delta("td_accuracy_pct"),
        "damage_ratio_delta": delta("damage_ratio"), "avg_fight_duration_delta": "rolling.avg_seconds - opp.rolling.avg_seconds",
        "fight_duration_variance_delta": f"{var_f} - {var_o}", "wrestler_score_a": wf, "wrestler_score_b": wo, "submission_score_a": sub_f, "submission_score_b": sub_o,
        "wrestling_delta": f"{wf} - {wo}", "submission_delta": f"{sub_f} - {sub_o}",
        "grappling_type_mismatch": f"CASE WHEN {wf} IS NULL OR {wo} IS NULL OR {sub_f} IS NULL OR {sub_o} IS NULL THEN NULL ELSE "
        f"{flag(f'({wf} > {wo} AND {sub_o} > {sub_f}) OR ({wo} > {wf} AND {sub_f} > {sub_o})')} END",
        "striker_vs_grappler": f"CASE WHEN {both} THEN {flag(f'({striker(f)} AND {grappler(o)}) OR ({grappler(f)} AND {striker(o)})')} END",
        "pressure_vs_counter": f"CASE WHEN {both} THEN {flag(f'({pressure(f)} AND {counter(o)}) OR ({counter(f)} AND {pressure(o)})')} END",
        "pace_mismatch_score": f"({delta('sig_strikes_per_min')}) * ({var_f} - {var_o})", "southpaw_orthodox_history": none,
    }


FAMILIES = {
    "activity": activity, "experience": experience, "finishing": finishing, "output": output, "physical": physical, "record": record,
    "rematch": rematch, "weight_dominance": weight, "weight_cut": weight_cut, "matchup": matchup,
}
#: Columns that are texts; all others are doubles, rounded in query results.
TEXTS = {"stance", "weight_class", "stance_matchup", "first_meeting_method"}
#: A product of large factors: it is shown with three digits less.
COARSE = {"pace_mismatch_score"}


def _shown(name: str, sql: str, digits: int | None) -> str:
    if name in TEXTS or digits is None:
        return f"{sql} AS {name}"
    digits = digits - 3 if name in COARSE else digits
    return f"{difference(sql, digits) if name in COARSE or 'delta' in name else f'round({sql}, {digits})'} AS {name}"


def family_part(name: str, digits: int | None = None) -> Part:
    """A final part that selects one family; doubles rounded to ``digits``."""

    def sql(d: Dialect) -> str:
        cols = FAMILIES[name](d)
        shown = [_shown(n, c, digits) for n, c in cols.items()]
        return f"SELECT fight_url, side, {columns(shown)} FROM framed"

    return name, sql


MAIN_CARD = 5
CARD_COLUMNS = {
    "sig_strikes_main_card_avg": "main_sig", "sig_strikes_prelim_avg": "prelim_sig", "td_rate_main_card_avg": "main_td", "td_rate_prelim_avg": "prelim_td",
    "grappling_abandonment_delta": "main_gr - prelim_gr",
    "output_variance_by_position": "CASE WHEN n >= 3 THEN (main_sig - prelim_sig) * (main_sig - prelim_sig) / 4 END",
}


def _card(d: Dialect) -> str:
    """Averages over the contestant's earlier bouts by their place on the card:
    the five highest bout orders against the rest (ties: the earlier bout). NULL
    where the bout's own order isn't known."""
    both = [f"avg(CASE WHEN place <= {MAIN_CARD} THEN {c} END) AS main_{c}, avg(CASE WHEN place > {MAIN_CARD} THEN {c} END) AS prelim_{c}" for c in ("sig", "td", "gr")]
    return f"""SELECT fight_url, side, count(past) AS n, {columns(both)}
FROM (SELECT c.fight_url, c.side, h.fight_url AS past, h.r_sig_strikes_per_min AS sig, h.r_td_per_15min AS td, h.r_grappling_dominance AS gr,
  row_number() OVER (PARTITION BY c.fight_url, c.side ORDER BY h.bout_order DESC, h.tick, h.fight_url) AS place
  FROM posted c LEFT JOIN posted h ON h.fighter = c.fighter AND h.tick < c.tick AND h.bout_order IS NOT NULL AND h.has AND c.bout_order IS NOT NULL) placed
GROUP BY fight_url, side"""


CARD: Part = ("card", _card)


def shown_card(digits: int | None) -> list[str]:
    return [_shown(n, c, digits) for n, c in CARD_COLUMNS.items()]


def wide_part(digits: int | None = None, card: bool = False) -> Part:
    """All families of a side in one row; ``card`` adds those of ``CARD``."""

    def sql(d: Dialect) -> str:
        shown = []
        for family in FAMILIES.values():
            shown += [_shown(n, c, digits) for n, c in family(d).items()]
        shown += shown_card(digits) if card else []
        source = "framed LEFT JOIN card USING (fight_url, side)" if card else "framed"
        return f"SELECT fight_url, event_url, CAST(event_date AS VARCHAR(10)) AS event_date, side, fighter, opponent, {columns(shown)} FROM {source}"

    return "wide", sql



#: What a side has of its own; families read it, or that of the opponent.
_STATES = ("last_state", "rolling", "meeting")
_PROFILE = ("height_cm", "reach_cm", "stance", "dob")
_PLAIN = (*SUMS, "fights_12mo", "fights_3yr", "fights_5yr", "first_title_date", "event_url", "event_date", "fighter", "opponent", "weight_class", *_PROFILE)


def formulas(names: Iterable[str] | None = None) -> dict[str, str]:
    """The columns of the families (all, or those named) and how they come from ``framed``."""
    found = {n: c for family in FAMILIES.values() for n, c in family(Spark()).items()}
    return found if names is None else {n: found[n] for n in names if n in found}


def read_by(texts: Iterable[str]) -> tuple[str, ...]:
    """The fields of a side that the formulas read, of the side or its opponent: plain
    names, or ``state.name``."""
    named = re.compile(rf"\b(?:opp\.|o_)?((?:{'|'.join(_STATES)})\.\w+|{'|'.join(_PLAIN)})\b")
    found = {m for t in texts for m in named.findall(t)}
    return tuple(sorted(found))


def side_part(fields: Iterable[str]) -> Part:
    """These fields of every side as plain columns, and what the bout was to it:
    result (1 won, 0 lost, else NULL)."""
    own = [f"f.{f}" if f in _PROFILE else f"p.{f} AS {f.replace('.', '__')}" for f in fields]
    result = "CASE WHEN p.winner = p.fighter THEN 1 WHEN p.winner = p.opponent THEN 0 END AS result"
    return "side_rows", lambda d: f"SELECT p.fight_url, p.side, {columns(result, own)} FROM prior_state p LEFT JOIN profiles f ON p.fighter = f.fighter"


def framed_from(fields: Iterable[str], own: str, other: str) -> list[str]:
    """The columns of ``framed`` from those of both sides by their prefixes."""
    plain = [f for f in fields if "." not in f]

    def states(prefix: str) -> dict[str, str]:
        of = {s: [f.split(".")[1] for f in fields if f.startswith(f"{s}.")] for s in _STATES}
        return {s: Spark().pack(**{n: f"{prefix}{s}__{n}" for n in names}) for s, names in of.items() if names}

    opponents = {f: f"{other}{f}" for f in plain} | states(other)
    return [
        *[f"{own}{f} AS {f}" for f in plain], *[f"{sql} AS {s}" for s, sql in states(own).items()],
        *[f"{other}{f} AS o_{f}" for f in _PROFILE if f in plain], *([f"{Spark().pack(**opponents)} AS opp"] if opponents else []),
    ]
