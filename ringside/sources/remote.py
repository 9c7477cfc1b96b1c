"""Paged services and crawls, with the transport injected.

A fetch function does the input and output; what is here decides which pages to
ask for, when to ask again, and what rows come of the answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import kept
from . import html

PAGE = 100


def retrying(fetch: Callable, attempts: int = 3, wait: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``fetch`` tried again with growing waits; the last failure is raised."""

    def tried(*args, **kwargs):
        for n in range(attempts):
            try:
                return fetch(*args, **kwargs)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(wait * factor**n)

    return tried


def paged(fetch: Callable[..., list], page: int = PAGE, **params) -> Iterator:
    """Items of fetch(limit=, offset=, ...) until a page is short or empty."""
    offset = 0
    while True:
        items = fetch(limit=page, offset=offset, **params)
        yield from items
        if len(items) < page:
            return
        offset += page


def payload_table(spark: SparkSession, fetch: Callable[..., list[str]], **params) -> DataFrame:
    """One row a payload (JSON text) of a paged service."""
    return spark.createDataFrame([(p,) for p in paged(fetch, **params)], "payload string")


def fetched(urls: DataFrame, fetch: Callable[[str], str], column: str = "url") -> tuple[DataFrame, DataFrame]:
    """(url, html) of each different url, fetched by the executors, and the
    (url, reason) of those that failed. The answers are checkpointed, so a page
    is not asked for twice."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for u in pdf["url"]:
                try:
                    out.append((u, fetch(u), None))
                except Exception as e:  # a page that can't be had is a result
                    out.append((u, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "html", "reason"])

    got = kept(urls.selectExpr(f"{column} AS url").distinct().mapInPandas(run, "url string, html string, reason string"))
    return got.where("reason is null").select("url", "html"), got.where("reason is not null").select("url", "reason")


def crawl(spark: SparkSession, start: str, fetch: Callable[[str], str]) -> dict[str, DataFrame]:
    """events -> event -> fight -> fighter pages as parsed tables, each page once;
    ``failed`` has (url, reason) of the pages that weren't had or couldn't be read."""
    failed = []

    def step(urls: DataFrame, kind: str, column: str = "url") -> DataFrame:
        got, lost = fetched(urls, fetch, column)
        rows = kept(html.parsed_pages(got, kind))
        failed.extend([lost, rows.where("error is not null").selectExpr("page_url AS url", "error AS reason")])
        return rows.where("error is null").drop("error")

    events = step(spark.createDataFrame([(start,)], "url string"), "events_list")
    event_rows = step(events, "event", "event_url")
    fight_rows = step(event_rows.selectExpr("explode(fight_urls) AS url"), "fight")
    fighters = step(fight_rows.selectExpr("explode(array(fighter_a_url, fighter_b_url)) AS url"), "fighter")
    return {"event": event_rows, "fight": fight_rows, "fighter": fighters, "failed": reduce(DataFrame.unionByName, failed)}


def routed(fight_rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of parsed fights by the table they belong to."""
    nested = lambda c: fight_rows.selectExpr("page_url AS fight_url", f"explode({c}) AS r").select("fight_url", "r.*")
    fights = fight_rows.drop("totals", "rounds", "breakdowns").withColumnRenamed("page_url", "fight_url")
    return {"fights": fights, "fight_totals": nested("totals"), "round_stats": nested("rounds"), "sig_strike_breakdowns": nested("breakdowns")}


def config(path: str | None, defaults: dict) -> dict:
    """Defaults overlaid with a YAML file, where there is one."""
    if path is None or not Path(path).exists():
        return dict(defaults)
    return {**defaults, **(yaml.safe_load(Path(path).read_text()) or {})}
