"""Pages to rows: events lists, events, fights and fighters.

A small element tree is built with the standard library; each parser is a plain
function of a page, and ``pages_to_rows`` runs it over a table of pages in Arrow
batches, one page to any number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Positions of the statistics in their tables. Fixed values.
TOTALS_AT = {"knockdowns": 1, "significant_strikes": 2, "total_strikes": 4, "takedowns": 5, "submission_attempts": 7, "reversals": 8, "control_time_seconds": 9}
SPLITS_AT = {"head": 3, "body": 4, "leg": 5, "distance": 6, "clinch": 7, "ground": 8}


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)
    parent: Node | None = None

    def all(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        """Descendants in document order, by tag and by a class they have."""
        found = []
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if n.__class__ is str:
                continue
            if (tag is None or n.tag == tag) and (cls is None or cls in n.attrs.get("class", "").split()):
                found.append(n)
            if n.children:
                stack += n.children[::-1]
        return found

    def text(self, sep: str = "") -> str:
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return " ".join(self.children[0].split())
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                stack += reversed(c.children)
        return " ".join(sep.join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "td", "tr", "li") and self.at.tag == tag:
            self.at = self.at.parent or self.root  # an end tag was left out
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: A tag with quoted attributes, or text. What the standard library's parser reads in another way than by these is left to it.
_TOKEN = re.compile(r'<(/)?([a-z][a-z0-9]*)((?:[ \n]+[a-z][-a-z]*="[^"]*")*)>|([^<]+)')
_ATTR = re.compile(r'([a-z][-a-z]*)="([^"]*)"')
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
_NESTS_NOT = ("p", "td", "tr", "li")


@lru_cache(maxsize=4096)
def _attrs(text: str) -> dict[str, str]:
    return dict(_ATTR.findall(text))


def _plain_tree(html: str) -> Node | None:
    """The tree of a page that holds plain tags and text only, as the library's
    parser would give it; else None."""
    if "&" in html:
        return None
    at = root = Node("", {})
    end = 0
    for m in _TOKEN.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        closes, tag, attrs, text = m.groups()
        if text is not None:
            at.children.append(text)
        elif closes:
            if attrs:
                return None
            n = at
            while n is not root and n.tag != tag:
                n = n.parent
            if n is not root:
                at = n.parent
        else:
            if tag in _RAW:
                return None
            if tag in _NESTS_NOT and at.tag == tag:
                at = at.parent or root  # an end tag was left out
            node = Node(tag, _attrs(attrs) if attrs else {}, [], at)
            at.children.append(node)
            if tag not in VOID:
                at = node
    return root if end == len(html) else None


def tree(html: str | None) -> Node:
    if html and (plain := _plain_tree(html)) is not None:
        return plain
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _int(text: str) -> int:
    return int(re.sub(r"[^0-9]", "", text) or 0)


def _pair(text: str) -> tuple[int, int]:
    m = re.search(r"(\d+)\s+of\s+(\d+)", text)
    return (int(m[1]), int(m[2])) if m else (0, 0)


def _seconds(text: str) -> int | None:
    m = re.match(r"(\d+):(\d{2})$", text)
    return int(m[1]) * 60 + int(m[2]) if m else None


def _day(text: str, form: str) -> date | None:
    try:
        return datetime.strptime(text, form).date()
    except ValueError:
        return None


def _labelled(items: list[Node], label: str, ignore_case: bool = False) -> str:
    for item in items:
        t = item.text(" ")
        if (t.lower().startswith(f"{label.lower()}:") if ignore_case else t.startswith(f"{label}:")):
            return t.split(":", 1)[1].strip()
    return ""


def _name(page: Node) -> str:
    found = page.all(cls="b-content__title-highlight")
    return found[0].text() if found else ""


def parse_events_list(html: str | None) -> list[dict]:
    """Links to events, in order, each once."""
    links = [a.attrs.get("href", "") for a in tree(html).all("a", "b-link") if "b-link_style_black" in a.attrs.get("class", "").split()]
    return [{"event_url": u} for u in dict.fromkeys(u for u in links if "event-details" in u)]


def parse_event(html: str | None) -> list[dict]:
    """Name, date and place of an event, and its fights' links."""
    page = tree(html)
    items = page.all(cls="b-list__box-list-item")
    rows = [r.attrs["data-link"] for r in page.all("tr", "b-fight-details__table-row") if "fight-details" in r.attrs.get("data-link", "")]
    return [{"name": _name(page), "date": _day(_labelled(items, "Date"), "%B %d, %Y"), "location": _labelled(items, "Location") or None, "fight_urls": list(dict.fromkeys(rows))}]


def _tables(tables: list[tuple[Node, list[Node], list[str]]], marker: str) -> tuple[Node | None, Node | None]:
    """Of the tables (with their heads and header texts) with the marker in a header:
    the one of the whole fight (one head) and the one by round (a head for each)."""
    whole = by_round = None
    for t, heads, headers in tables:
        if not any(marker in h for h in headers):
            continue
        if len(heads) == 1:
            whole = whole or t
        elif len(heads) > 1:
            by_round = by_round or t
    return whole, by_round


def _rows(table: Node | None) -> list[Node]:
    return [r for b in table.all("tbody") for r in b.all("tr")] if table else []


def _cells(row: Node) -> list[list[str]]:
    """The paragraphs of each cell."""
    return [[p.text(" ") for p in c.all("p")] for c in row.all("td")]


def _cell(cells: list[list[str]], at: int, side: int) -> str:
    texts = cells[at] if at < len(cells) else []
    return texts[side] if side < len(texts) else ""


def _totals(cells: list[list[str]], side: int) -> dict:
    out = {}
    for name, at in TOTALS_AT.items():
        text = _cell(cells, at, side)
        if name in ("significant_strikes", "total_strikes", "takedowns"):
            out[f"{name}_landed"], out[f"{name}_attempted"] = _pair(text)
        else:
            out[name] = _seconds(text) if name == "control_time_seconds" else _int(text)
    return out


def _splits(cells: list[list[str]], side: int) -> dict:
    out = {}
    for name, at in SPLITS_AT.items():
        out[f"{name}_landed"], out[f"{name}_attempted"] = _pair(_cell(cells, at, side))
    return out


def parse_fight(html: str | None) -> list[dict]:
    """One fight with its totals, rounds and breakdowns (lists; empty where a
    page has no statistics). A page without two fighters raises."""
    nodes = tree(html).all()
    classed = [(n, n.attrs["class"].split()) for n in nodes if n.attrs.get("class")]
    people = [n for n, c in classed if "b-fight-details__person" in c]
    urls = [a.attrs.get("href", "") for p in people for a in p.all("a", "b-link") if "fighter-details" in a.attrs.get("href", "")][:2]
    a, b = urls
    winner = None
    for person, url in zip(people, urls, strict=False):
        status = person.all(cls="b-fight-details__person-status")
        if status and status[0].text() == "W":
            winner = winner or url
    meta = [n for n, c in classed if "b-fight-details__text-item" in c or "b-fight-details__text-item_first" in c]
    title = [n for n, c in classed if "b-fight-details__fight-title" in c]
    tables = []
    for t in (n for n in nodes if n.tag == "table"):
        heads = t.all("thead")
        tables.append((t, heads, [th.text() for h in heads for th in h.all("th")]))
    whole, by_round = _tables(tables, "KD")
    s_whole, s_round = _tables(tables, "Head")
    sides = list(enumerate(urls))
    rounds = [(i + 1, _cells(r)) for i, r in enumerate(_rows(by_round))]
    splits = [(0, _cells(r)) for r in _rows(s_whole)[:1]] + [(i + 1, _cells(r)) for i, r in enumerate(_rows(s_round))]
    field_of = lambda label: _labelled(meta, label, ignore_case=True)
    return [{
        "fighter_a_url": a, "fighter_b_url": b, "winner_url": winner, "method": field_of("Method"), "ending_round": _int(field_of("Round")),
        "ending_time": field_of("Time") or "0:00", "time_format": field_of("Time format"), "referee": field_of("Referee") or None,
        "weight_class": (title[0].text() if title else "") or None,
        "totals": [{"fighter_url": u, **_totals(r, s)} for r in map(_cells, _rows(whole)[:1]) for s, u in sides],
        "rounds": [{"fighter_url": u, "round": n, **_totals(r, s)} for n, r in rounds for s, u in sides],
        "breakdowns": [{"fighter_url": u, "round": n, **_splits(r, s)} for n, r in splits for s, u in sides],
    }]


def parse_fighter(html: str | None) -> list[dict]:
    """Name and measurements of a fighter."""
    page, fields = tree(html), {}
    for item in page.all(cls="b-list__box-list-item"):
        label, colon, value = item.text(" ").partition(":")
        if colon and value.strip() not in ("", "--"):
            fields[label.strip()] = value.strip()
    number = lambda key: re.search(r"(\d+)", fields.get(key, ""))
    tall, reach, heavy = re.search(r"(\d+)'\s*(\d+)", fields.get("Height", "")), number("Reach"), number("Weight")
    return [{
        "name": _name(page), "height_cm": round((int(tall[1]) * 12 + int(tall[2])) * 2.54, 1) if tall else None, "weight_kg": round(int(heavy[1]) * 0.45359237, 1) if heavy else None,
        "reach_cm": round(int(reach[1]) * 2.54, 1) if reach else None, "stance": fields.get("STANCE"), "date_of_birth": _day(fields.get("DOB", ""), "%b %d, %Y"),
    }]


_T = "fighter_url string, {r}knockdowns int, significant_strikes_landed int, significant_strikes_attempted int, total_strikes_landed int, total_strikes_attempted int, takedowns_landed int, takedowns_attempted int, submission_attempts int, reversals int, control_time_seconds int"
_S = "fighter_url string, round int, " + ", ".join(f"{n}_{k} int" for n in SPLITS_AT for k in ("landed", "attempted"))


def _struct(fields: str) -> str:
    return "array<struct<" + ", ".join(f.strip().replace(" ", ":") for f in fields.split(",")) + ">>"


PARSERS: dict[str, tuple[Callable[[str | None], list[dict]], str]] = {
    "events_list": (parse_events_list, "event_url string"),
    "event": (parse_event, "name string, date date, location string, fight_urls array<string>"),
    "fight": (
        parse_fight,
        "fighter_a_url string, fighter_b_url string, winner_url string, method string, ending_round int, ending_time string, time_format string, referee string, weight_class string, "
        f"totals {_struct(_T.format(r=''))}, rounds {_struct(_T.format(r='round int, '))}, breakdowns {_struct(_S)}",
    ),
    "fighter": (parse_fighter, "name string, height_cm double, weight_kg double, reach_cm double, stance string, date_of_birth date"),
}


def parsed_pages(pages: DataFrame, kind: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_url, the parser's columns and ``error``: the rows of every page once
    (by url; of several versions the least text), or what is wrong with it."""
    parse, schema = PARSERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                try:
                    rows += [{"page_url": u, "error": None, **r} for r in parse(h)]
                except Exception as e:  # a page of another make is a result
                    rows.append({"page_url": u, "error": f"{type(e).__name__}: {e}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)

    columns = f"page_url string, {schema}, error string"
    shape = to_arrow_schema(T.StructType.fromDDL(columns))
    once = pages.selectExpr(f"{url_col} AS url", f"{html_col} AS html").groupBy("url").agg(F.min("html").alias("html"))
    return once.mapInArrow(run, columns)


def pages_to_rows(pages: DataFrame, kind: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_url and the parser's columns, of the pages that can be read."""
    return parsed_pages(pages, kind, url_col, html_col).where("error is null").drop("error")
