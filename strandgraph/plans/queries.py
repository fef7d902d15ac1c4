"""Named queries, one or more for each operator, over the graphs of graphs.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import basics, compress, ordering, similarity, traversal
from ..sources import edges as edge_source
from ..sources import stream
from .graphs import graph

Query = Callable[[SparkSession, str], DataFrame]

WS, TH, JUMP, START, ITERATIONS, ALPHA = 7, 3, 100, 1, 5, 0.15
CODES = ("unary", "gamma", "delta", "nibble", "zeta1", "zeta2", "zeta3")
#: Values that the code queries encode: successive ones and each power of two with its neighbours.
SMALL, POWERS = 2000, 40
_found: dict[str, Query] = {}


def query(function: Query) -> Query:
    _found[function.__name__] = function
    return function


def on(name: str):
    """A query over one graph."""

    def wrap(function: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(graph(spark, sf_dir, name))

        run.__name__ = function.__name__
        return query(run)

    return wrap


def text(array: str | Column) -> Column:
    return F.concat_ws(",", F.transform(array, lambda x: x.cast("string")))


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@on("part_supp")
def edge_scan(e):
    return e


@on("sparse")
def graph_stats(e):
    return basics.stats(e)


@on("supp_part")
def out_degree(e):
    return basics.out_degrees(e)


@on("cust_order")
def degree_histogram(e):
    return basics.degree_histogram(e)


@on("part_supp")
def max_degree(e):
    return basics.stats(e).select("max_degree")


@on("supp_part")
def sinks(e):
    return basics.sinks(e)


@on("sparse")
def has_successors(e):
    return basics.has_successors(e).select("node", F.col("has_succ").cast("int").alias("has_succ"))


@on("user_seq")
def self_loops(e):
    return basics.self_loops(e)


@query
def sort_validate(spark, sf_dir):
    """The links of parts and suppliers that don't come after the one before them, in the order of the table's own
    key (rows that tie in it come by their links)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return edge_source.out_of_order(rows, ["l_orderkey", "l_linenumber", "src", "dst"]).agg(F.count(F.lit(1)).alias("violations"))


@on("order_cust")
def sort_validate_text(e):
    """The same for a text file that was written in order: none."""
    path = _folder(e.sparkSession)
    edge_source.write_text(e, path)
    rows = edge_source.read_ordered(e.sparkSession, path)
    return edge_source.out_of_order(rows, ["file", "block", "line"]).agg(F.count(F.lit(1)).alias("violations"))


@on("part_supp")
def edges_sorted(e):
    return ordering.numbered(e, ["src", "dst"], "place").select("src", "dst", "place")


@on("sparse")
def renumber_map(e):
    return basics.renumber_map(e)


@on("sparse")
def renumber_edges(e):
    return basics.renumber(e)


@on("sparse")
def renumber_from_one(e):
    return basics.renumber(e, start=1)


@on("part_supp")
def adjacency_list(e):
    return basics.adjacency(e).select("node", text("succ").alias("succ"))


@on("sparse")
def adjacency_filled(e):
    return basics.adjacency_filled(e).select("node", text("succ").alias("succ"))


@on("part_supp")
def successors_point_lookup(e):
    return basics.successors(e, 42)


@on("user_seq")
def zigzag(e):
    return e.select("src", "dst", codes.zigzag(F.col("src"), F.col("dst")).alias("z"))


@on("user_seq")
def zigzag_inverse(e):
    coded = e.select("src", "dst", codes.zigzag(F.col("src"), F.col("dst")).alias("z"))
    return coded.select("src", "z", codes.zigzag_inverse(F.col("src"), F.col("z")).alias("dst"))


@on("supp_part")
def gap_transform(e):
    return basics.gaps(e).select("src", "dst", "gap")


@on("supp_part")
def gap_inverse(e):
    return basics.from_gaps(basics.gaps(e).select("src", "pos", "gap"))


def values(spark: SparkSession, top: int | None = None) -> DataFrame:
    v = spark.range(SMALL).select(F.col("id").alias("v"))
    powers = spark.range(11, POWERS).select(F.explode(F.array(*(F.expr(f"shiftleft(1L, cast(id as int)) + {d}") for d in (-1, 0, 1)))).alias("v"))
    both = v.union(powers).distinct()
    return both.filter(F.col("v") < top) if top else both


def _code_queries() -> None:
    for name in CODES:

        def lengths(spark, sf_dir, name=name):
            return values(spark).select("v", codes.length(F.col("v"), name).alias("n"))

        def strings(spark, sf_dir, name=name):
            return values(spark, SMALL if name == "unary" else None).select("v", codes.bits(F.col("v"), name).alias("bits"))

        _found[f"len_{name}"], _found[f"bits_{name}"] = lengths, strings


_code_queries()


@query
def minimal_binary(spark, sf_dir):
    pairs = spark.range(70).select(F.col("id").alias("top")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))))
    return pairs.select("x", "top", codes.minimal_binary(F.col("x"), F.col("top")).alias("bits"))


def _g_bits(e: DataFrame) -> DataFrame:
    """Variant G without leaving the JVM: each list's gaps in zeta2."""
    lists = basics.adjacency(e)
    gaps = basics.list_gaps(F.col("node"), F.col("succ"))
    return lists.select("node", F.concat_ws("", F.transform(gaps, lambda g: codes.bits(g, "zeta2"))).alias("bits"))


def _g_sizes(e: DataFrame) -> DataFrame:
    sizes = basics.gaps(e).groupBy(F.col("src").alias("of")).agg(F.sum(codes.length(F.col("gap"), "zeta2")).alias("n"))
    return basics.universe(e).join(sizes, F.col("node") == F.col("of"), "left").select("node", F.coalesce("n", F.lit(0)).cast("bigint").alias("nbits"))


@on("user_seq")
def g_list_bits(e):
    return _g_bits(e)


@on("part_supp")
def g_total_size(e):
    total = _g_sizes(e).agg(F.sum("nbits").alias("list_bits"), F.count(F.lit(1)).alias("ids"))
    return total.select("list_bits", F.ceil(F.col("list_bits") / 8).cast("bigint").alias("list_bytes"), (8 * (F.col("ids") + 1)).alias("index_bytes"))


@on("part_supp")
def g_offsets(e):
    return ordering.running_sum(_g_sizes(e), ["node"], F.col("nbits"), "start").select("node", number("start").alias("start"))


@on("part_supp")
def sparse_index_jump(e):
    return g_offsets_of(e).filter(F.col("node") % JUMP == 0)


def g_offsets_of(e: DataFrame) -> DataFrame:
    return ordering.running_sum(_g_sizes(e), ["node"], F.col("nbits"), "start").select("node", number("start").alias("start"))


@on("user_seq")
def g_bytes_hex(e):
    return _g_bits(e).select("node", codes.packed_hex(F.col("bits")).alias("packed"))


@on("part_supp")
def code_comparison(e):
    sums = basics.gaps(e).agg(*(F.sum(codes.length(F.col("gap"), c)).alias(c) for c in CODES))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, CODES)), F.array(*CODES))).alias("code", "total_bits"))


@on("supp_part")
def window_candidates(e):
    return similarity.window_candidates(e, WS)


@on("user_seq")
def overlap_scores(e):
    return similarity.overlap_scores(e, WS).select("src", "ref_src", "common")


@on("part_supp")
def reference_choice(e):
    return similarity.reference_choice(e, WS)


def _mask(e: DataFrame) -> DataFrame:
    return similarity.copy_mask(e, similarity.reference_choice(e, WS))


@on("user_seq")
def copy_mask(e):
    return _mask(e).select("src", "ref_src", "dst", F.col("copied").cast("int").alias("copied"))


@on("user_seq")
def copy_blocks(e):
    return similarity.copy_blocks(_mask(e)).select("src", number("block").alias("block"), F.col("copied").cast("int").alias("copied"), "size")


@on("supp_part")
def intervals(e):
    return similarity.intervals(e, TH)


@on("supp_part")
def interval_encoding(e):
    found = similarity.interval_codes(similarity.intervals(e, TH), TH)
    return found.select("src", "low", "left_value", "sign", "length_value")


@on("user_seq")
def residuals(e):
    return similarity.residuals(e, _mask(e), TH).select("src", "dst", "gap")


@on("user_seq")
def intersection_difference(e):
    """Common and own successors of each list and its chosen reference, as array operations."""
    lists = basics.adjacency(e)
    choice = similarity.reference_choice(e, WS).select("src", "ref_src")
    a = lists.select(F.col("node").alias("src"), F.col("succ").alias("own"))
    b = lists.select(F.col("node").alias("ref_src"), F.col("succ").alias("other"))
    both = choice.join(a, "src").join(b, "ref_src")
    return both.select("src", "ref_src", text(F.array_sort(F.array_intersect("own", "other"))).alias("common"), text(F.array_sort(F.array_except("own", "other"))).alias("extra"))


def _roundtrip(name: str, variant: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compress.compress(graph(spark, sf_dir, name), variant=variant, chunk=512, **options).edges()

    _found[f"roundtrip_{variant}"] = run


for _variant, _graph in (("G", "supp_part"), ("CL", "part_supp"), ("CB", "user_seq"), ("I", "part_supp"), ("final", "part_supp")):
    _roundtrip(_graph, _variant)


@on("part_supp")
def chain_invariants(e):
    """Lists whose chain is longer than mrc, or not one more than their reference's: none."""
    made = compress.compress(e, variant="final", mrc=2, ws=WS, chunk=512)
    lists = ordering.cut(made.lists.select("node", "ref_node", "chain"))
    of = lists.select(F.col("node").alias("of"), F.col("chain").alias("before"))
    joined = lists.join(of, F.col("ref_node") == F.col("of"), "left")
    wrong = (F.col("chain") > 2) | (F.col("chain") != F.coalesce(F.col("before") + 1, F.lit(0)))
    return joined.agg(F.count(F.when(wrong, 1)).alias("violations"))


SECTIONS = ("size", "reference", "block_count", "blocks", "intervals", "residuals")


@on("user_seq")
def section_bit_budget(e):
    """Sums of the bits of each section, and of what lists have beyond them: none."""
    made = compress.compress(e, variant="final", ws=WS, th=TH)
    known = sum((F.col(f"sections.{s}") for s in SECTIONS[1:]), F.col("sections.size"))
    return made.lists.agg(*(F.sum(f"sections.{s}").alias(s) for s in SECTIONS), F.sum(F.col("nbits") - known).alias("beyond"))


@on("part_supp")
def compressed_point_lookup(e):
    return compress.compress(e, variant="final", chunk=256).successors(42)


@on("part_supp")
def compressed_report(e):
    return compress.compress(e, variant="G").report().select("max_id", "links", "list_bits", number("list_bytes").alias("list_bytes"), "index_bytes")


@on("part_supp")
def first_reference_unbounded(e):
    """The reference that the chunk processor takes if nothing bounds chains: the same as reference_choice."""
    made = compress.compress(e, variant="CB", ws=WS, mrc=1 << 30, chunk=1 << 40)
    return made.lists.filter("ref_node IS NOT NULL").select(F.col("node").alias("src"), F.col("ref_node").alias("ref_src"), F.col("copied").alias("common"))


def _folder(spark: SparkSession) -> str:
    ordering.with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


@on("user_seq")
def compressed_write_read(e):
    path = _folder(e.sparkSession)
    compress.compress(e, variant="final", chunk=64).write(path)
    return compress.open_compressed(e.sparkSession, path).edges()


def _stream(variant: str) -> None:
    """Links that were written to one binary file of a format and read from it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        stream.write_stream(compress.compress(graph(spark, sf_dir, "user_seq"), variant=variant), path)
        return stream.stream_edges(spark, path, variant)

    _found[f"stream_{variant}"] = run


for _variant in compress.SECTIONS:
    _stream(_variant)


@on("order_cust")
def text_edge_list_roundtrip(e):
    path = _folder(e.sparkSession)
    edge_source.write_text(e, path)
    return edge_source.read_text(e.sparkSession, path)


@on("part_supp")
def bfs_levels(e):
    return traversal.bfs(e, START)


@on("user_seq")
def bfs_visit_order(e):
    return traversal.bfs_ordered(e, START)


@on("part_supp")
def bfs_count(e):
    return traversal.bfs(e, START).agg(F.count(F.lit(1)).alias("reached"))


@on("order_cust")
def bfs_multi_start(e):
    return traversal.bfs(e, [1, 7, 99])


def _search_compressed(variant: str) -> None:
    """The search over links decoded from the compressed lists of one format."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return traversal.bfs(compress.compress(graph(spark, sf_dir, "user_seq"), variant=variant, chunk=64).edges(), START)

    _found[f"bfs_{variant}"] = run


for _variant in compress.SECTIONS:
    _search_compressed(_variant)


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("node", F.round("rank", 12).alias("rank"))


@on("user_seq")
def pagerank_standard(e):
    return _rounded(traversal.pagerank(e, ITERATIONS, ALPHA))


@on("order_cust")
def pagerank_compat(e):
    return _rounded(traversal.pagerank(e, ITERATIONS, ALPHA, compat=True))


@on("part_supp")
def pagerank_sinks(e):
    return _rounded(traversal.pagerank(e, ITERATIONS, ALPHA))


@on("user_seq")
def pagerank_sum(e):
    return traversal.pagerank(e, ITERATIONS, ALPHA).agg(F.round(F.sum("rank"), 9).alias("total"))


@on("user_seq")
def pagerank_topk(e):
    """The last digits of sums depend on their order, so ranks are rounded before they are compared."""
    return traversal.top_rank(_rounded(traversal.pagerank(e, ITERATIONS, ALPHA)), 10)


@on("user_seq")
def pagerank_requested_nodes(e):
    return _rounded(traversal.pagerank(e, ITERATIONS, ALPHA).filter(F.col("node").isin(0, 1, 5, 14)))


def queries() -> dict[str, Query]:
    return dict(_found)
