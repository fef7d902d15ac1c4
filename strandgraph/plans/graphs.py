"""The graphs that the queries use, out of the fixed tables; each with the SQL of its links (s, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edges import edges_from

SQL = {
    "part_supp": "select distinct l_partkey s, l_suppkey t from lineitem",
    "supp_part": "select distinct l_suppkey s, l_partkey t from lineitem",
    "order_cust": "select distinct o_orderkey s, o_custkey t from orders",
    "cust_order": "select distinct o_custkey s, o_orderkey t from orders",
    "user_seq": "select distinct s, t from (select user_id s, lead(user_id) over (order by ts, event_id) t from events) where t is not null",
    "sparse": "select distinct o_custkey*3 s, l_partkey*7+1 t from orders join lineitem on o_orderkey=l_orderkey",
}


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name in ("part_supp", "supp_part"):
        pair = ("l_partkey", "l_suppkey")
        return edges_from(read("lineitem"), *(pair if name == "part_supp" else pair[::-1]))
    if name in ("order_cust", "cust_order"):
        pair = ("o_orderkey", "o_custkey")
        return edges_from(read("orders"), *(pair if name == "order_cust" else pair[::-1]))
    if name == "user_seq":
        from ..operators.ordering import numbered

        # the next event's user: events get their places by a range sort, then meet the place before theirs
        placed = numbered(read("events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "place").select("place", "user_id")
        after = placed.select((F.col("place") - 1).alias("place"), F.col("user_id").alias("next_user"))
        return edges_from(placed.join(after, "place"), "user_id", "next_user")
    if name == "sparse":
        orders = read("orders").select("o_orderkey", "o_custkey")
        lines = read("lineitem").select("l_orderkey", "l_partkey")
        both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        return edges_from(both.select((F.col("o_custkey") * 3).alias("a"), (F.col("l_partkey") * 7 + 1).alias("b")), "a", "b")
    raise KeyError(name)


__all__ = ["SQL", "graph"]
