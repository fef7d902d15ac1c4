"""python -m strandgraph COMMAND: the usual steps from a shell; give Spark's own settings by spark-submit or its config files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators.compress import SECTIONS, Format, compress, open_compressed
from .operators.traversal import top_rank


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandgraph")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("renumber", help="close the gaps between ids, order kept; writes a sorted edge list")
    c.add_argument("edges")
    c.add_argument("out")
    c.add_argument("--start", type=int, default=0)
    c = sub.add_parser("compress", help="write a compressed table of an edge list and report its sizes")
    c.add_argument("edges")
    c.add_argument("out")
    c.add_argument("--variant", choices=list(SECTIONS), default="final")
    for name in ("ws", "mrc", "th", "jump", "chunk"):
        c.add_argument(f"--{name}", type=int, default=getattr(Format(), name))
    c.add_argument("--code", action="append", default=[], metavar="SECTION=CODE", help="for example residuals=zeta3")
    c = sub.add_parser("report", help="sizes of a compressed table")
    c.add_argument("table")
    c = sub.add_parser("bfs", help="how many nodes each start reaches")
    c.add_argument("table")
    c.add_argument("starts", type=int, nargs="+")
    c.add_argument("--print", action="store_true", dest="listed", help="list them in the order of their visits")
    c = sub.add_parser("pagerank", help="ranks of some nodes, and the node of highest rank")
    c.add_argument("table")
    c.add_argument("iterations", type=int)
    c.add_argument("alpha", type=float)
    c.add_argument("nodes", type=int, nargs="*")
    c.add_argument("--compat", action="store_true")
    return p


def show(df: DataFrame) -> None:
    names = df.columns
    print(*names, sep="\t")
    for row in df.toLocalIterator():
        print(*(row[n] for n in names), sep="\t")


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "renumber":
        Graph.read_text(spark, a.edges).renumbered(a.start).write_text(a.out)
    elif a.command == "compress":
        codes = dict(c.split("=", 1) for c in a.code)
        fmt = Format(a.variant, codes, a.ws, a.mrc, a.th, a.jump, a.chunk)
        compress(Graph.read_text(spark, a.edges).edges, fmt).write(a.out)
        show(open_compressed(spark, a.out).report())
    elif a.command == "report":
        show(open_compressed(spark, a.table).report())
    else:
        links = Graph.open(spark, a.table).edges.persist()  # decoded once for all starts and rounds
        graph = Graph(links)
        if a.command == "bfs":
            for start in a.starts:
                found = graph.bfs(start, ordered=a.listed)
                if a.listed:
                    show(found.orderBy("visit_pos"))
                show(found.agg(F.lit(start).alias("start"), F.count(F.lit(1)).alias("reached")))
        else:
            ranks = graph.pagerank(a.iterations, a.alpha, a.compat)
            show(ranks.filter(F.col("node").isin(a.nodes)).orderBy("node").union(top_rank(ranks)))
        links.unpersist()


if __name__ == "__main__":
    run(SparkSession.builder.appName("strandgraph").getOrCreate())
