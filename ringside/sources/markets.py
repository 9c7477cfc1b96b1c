"""Market payloads: JSON in JSON to rows, and validated order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "struct<markets:array<struct<conditionId:string,id:string,question:string,clobTokenIds:string,outcomes:string,active:boolean,closed:boolean,endDate:string>>>"
)
LEVELS = "array<struct<price:double,size:double>>"


def market_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row for each token of each active market that isn't closed.

    Token ids and outcomes are JSON lists inside JSON strings; what can't be read
    is left out. A market that doesn't say that it is open counts as closed."""
    market = payloads.select(F.explode(F.from_json(column, EVENT)["markets"]).alias("m")).where("coalesce(m.active, false) and not coalesce(m.closed, true)")
    both = F.arrays_zip(F.from_json("m.clobTokenIds", "array<string>").alias("token_id"), F.from_json("m.outcomes", "array<string>").alias("outcome"))
    rows = market.select(F.coalesce("m.conditionId", "m.id").alias("market_id"), F.coalesce("m.question", F.lit("")).alias("question"), "m.active", "m.closed", F.col("m.endDate").alias("end_date"), F.explode(both).alias("t"))
    return rows.select("market_id", "question", "t.token_id", "t.outcome", "active", "closed", "end_date").where("token_id is not null and outcome is not null")


def best_levels(levels: Column, descending: bool, depth: int) -> Column:
    """The best ``depth`` levels; equal prices keep their order."""
    at = F.transform(levels, lambda x, i: F.struct((-x["price"] if descending else x["price"]).alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(at), 1, depth), lambda s: s["x"])


def valid_levels(levels: Column) -> Column:
    """All prices inside (0, 1) and sizes not negative."""
    return F.forall(levels, lambda x: (x["price"] > 0) & (x["price"] < 1) & (x["size"] >= 0))


def snapshots(books: DataFrame, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(good, bad): raw books with ``bids`` and ``asks``, cut to the best levels
    with mid, spread and top of book; and the rows whose levels aren't valid."""
    ok = F.coalesce(valid_levels(F.col("bids")) & valid_levels(F.col("asks")), F.lit(False))
    good = books.where(ok).withColumn("bids", best_levels(F.col("bids"), True, depth)).withColumn("asks", best_levels(F.col("asks"), False, depth))
    top = lambda side, part: F.try_element_at(side, F.lit(1))[part]
    good = (
        good.withColumn("best_bid", top(F.col("bids"), "price")).withColumn("best_bid_size", top(F.col("bids"), "size"))
        .withColumn("best_ask", top(F.col("asks"), "price")).withColumn("best_ask_size", top(F.col("asks"), "size"))
        .withColumn("mid_price", (F.col("best_bid") + F.col("best_ask")) / 2).withColumn("spread", F.col("best_ask") - F.col("best_bid"))
    )
    return good, books.where(~ok)
