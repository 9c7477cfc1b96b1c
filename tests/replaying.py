"""An independent replay: bout after bout in plain Python, for comparison."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

METHODS = ("KO/TKO", "Submission", "Decision - Unanimous", "Decision - Split", "DQ", "TKO - Doctor's Stoppage")
CLASSES = ("Lightweight", "Welterweight", "Lightweight Title")


def tables(seed: int, n_events: int = 14, people: int = 7) -> dict[str, list[dict]]:
    """Small canonical tables; contestants may meet several times at one event."""
    rng = random.Random(seed)
    events, fights, totals = [], [], []
    day = date(2018, 1, 6)
    for e in range(n_events):
        day += timedelta(days=rng.choice([0, 7, 90, 200, 400]))
        url = f"e{e:03d}" + ("-contender-series" if e % 5 == 0 else "")
        events.append({"event_url": url, "name": f"E{e}", "date": day})
        for f in range(rng.randint(1, 5)):
            a, b = rng.sample([f"p{i}" for i in range(people)], 2)
            won = rng.choice([a, b, a, b, None])
            method = rng.choice(METHODS) if won else rng.choice(["Draw", "No Contest"])
            fight = f"f{e:03d}{f}"
            fights.append({
                "fight_url": fight, "event_url": url, "fighter_a_url": a, "fighter_b_url": b, "winner_url": won, "method": method, "ending_round": rng.randint(1, 3),
                "ending_time": f"{rng.randint(0, 4)}:{rng.randint(0, 59):02d}", "time_format": rng.choice(["3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)"]), "weight_class": rng.choice(CLASSES),
                "bout_order": rng.choice([None, 1, 2, 3, 8]),
            })
            if rng.random() < 0.8:
                for who in (a, b):
                    hit, tried = rng.randint(0, 40), rng.randint(0, 20)
                    totals.append({
                        "fight_url": fight, "fighter_url": who, "knockdowns": rng.randint(0, 2), "significant_strikes_landed": hit, "significant_strikes_attempted": hit + tried,
                        "total_strikes_landed": hit + 5, "total_strikes_attempted": hit + tried + 9, "takedowns_landed": rng.randint(0, 3), "takedowns_attempted": rng.randint(3, 6),
                        "submission_attempts": rng.randint(0, 2), "reversals": 0, "control_time_seconds": rng.randint(0, 300),
                    })
    fighters = [{"fighter_url": f"p{i}", "name": f"P {i}", "height_cm": 170.0 + i, "reach_cm": None if i == 3 else 171.0 + 2 * i, "stance": [None, "Southpaw", "Orthodox", "Switch"][i % 4], "date_of_birth": date(1990, 2, 28) if i else None} for i in range(people)]
    return {"events": events, "fights": fights, "fight_totals": totals, "fighters": fighters}


def ticks(t: dict[str, list[dict]]) -> list[tuple[dict, list[dict]]]:
    """Events in order with their fights in order."""
    by = defaultdict(list)
    for f in t["fights"]:
        by[f["event_url"]].append(f)
    return [(e, sorted(by[e["event_url"]], key=lambda f: f["fight_url"])) for e in sorted(t["events"], key=lambda e: (e["date"], e["event_url"]))]


def careers(t: dict[str, list[dict]]) -> dict[tuple[str, str], dict]:
    """(fight, contestant) -> record before the event."""
    out, rec = {}, defaultdict(lambda: {"fights": 0, "wins": 0, "losses": 0, "draws": 0, "ko": 0, "sub": 0, "streak": 0, "dates": [], "classes": [], "sig": []})
    totals = {(r["fight_url"], r["fighter_url"]): r for r in t["fight_totals"]}
    for e, fights in ticks(t):
        for f in fights:
            for who in (f["fighter_a_url"], f["fighter_b_url"]):
                r = rec[who]
                out[f["fight_url"], who] = {**r, "dates": list(r["dates"]), "classes": list(r["classes"]), "sig": list(r["sig"])[-10:]}
        for f in fights:
            a, b = f["fighter_a_url"], f["fighter_b_url"]
            h, m = int(f["ending_time"].split(":")[0]), int(f["ending_time"].split(":")[1])
            minutes = (f["ending_round"] - 1) * 5 + h + m / 60
            method = f["method"].upper()
            both = (f["fight_url"], a) in totals and (f["fight_url"], b) in totals
            for who in (a, b):
                r = rec[who]
                r["fights"] += 1
                r["dates"].append(e["date"])
                r["classes"].append(f["weight_class"])
                if both:
                    r["sig"].append((totals[f["fight_url"], who]["significant_strikes_landed"] / minutes if minutes else None, minutes))
                if f["winner_url"] is None:
                    r["draws"] += "DRAW" in method
                elif f["winner_url"] == who:
                    r["wins"] += 1
                    r["streak"] = r["streak"] + 1 if r["streak"] > 0 else 1
                    ko = "KO" in method and "COULD NOT" not in method
                    r["ko"] += ko
                    r["sub"] += not ko and "SUBMISSION" in method
                else:
                    r["losses"] += 1
                    r["streak"] = r["streak"] - 1 if r["streak"] < 0 else -1
    return out
