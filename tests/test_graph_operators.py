import random

import pytest

from strandgraph.operators import basics, similarity, traversal
from strandgraph.sources import edges as source

from .conftest import TOY


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_search_order(toy):
    found = traversal.bfs_ordered(toy, 1).orderBy("visit_pos").collect()
    assert [r.node for r in found] == [1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 0]
    assert [r.level for r in found] == [0, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert [r.visit_pos for r in found] == list(range(11))


@pytest.mark.parametrize("seed", range(3))
def test_search_against_a_queue(edges, seed):
    r = random.Random(seed)
    pairs = {(r.randint(0, 40), r.randint(0, 40)) for _ in range(70)}
    order, level = [3], {3: 0}
    for v in order:
        for t in sorted(t for s, t in pairs if s == v):
            if t not in level:
                level[t] = level[v] + 1
                order.append(t)
    found = traversal.bfs_ordered(edges(pairs), 3).orderBy("visit_pos").collect()
    assert [x.node for x in found] == order
    levels = dict(rows(traversal.bfs(edges(pairs), 3), "node", "level"))
    assert levels == level
    assert all(levels[t] <= levels[s] + 1 for s, t in pairs if s in levels)


def test_search_from_a_lonely_node(edges):
    assert rows(traversal.bfs(edges([(0, 1), (9, 0)]), 7), "node", "level") == [(7, 0)]
    assert rows(traversal.bfs(edges([(0, 1), (1, 2), (2, 3)]), 0, max_levels=2), "node", "level") == [(0, 0), (1, 1), (2, 2)]
    for links, start in (([], 0), ([], -1), ([(0, 1)], 2), ([(0, 1)], -1), ([(0, 1)], [0, 10**12])):
        with pytest.raises(ValueError):
            traversal.bfs(edges(links), start)
        with pytest.raises(ValueError):
            traversal.bfs_ordered(edges(links), start if isinstance(start, int) else max(start))


# Ranks of the toy graph after 5 rounds with alpha 0.15.
STANDARD = [0.1166018872, 0.1166018872, 0.0850291867, 0.0850291867, 0.0641567654, 0.0744783350, 0.0443509002, 0.0443509002, 0.0443509002, 0.0850291867, 0.0652233214, 0.0546724698, 0.0652233214, 0.0549017519]
COMPAT = [0.1027527475, 0.0251170779, 0.0125270486, 0.0125270486, 0.1027527475, 0.0125270486, 0.1027527475, 0.1027527475, 0.1027527475, 0.0125270486, 0.1027527475, 0.1027527475, 0.1027527475, 0.1027527475]


@pytest.mark.parametrize("compat", [False, True])
def test_ranks(toy, compat):
    found = traversal.pagerank(toy, compat=compat).orderBy("node").collect()
    assert [r["rank"] for r in found] == pytest.approx(COMPAT if compat else STANDARD, abs=1e-9)
    assert sum(r["rank"] for r in found) == pytest.approx(1)


def test_top_rank_ties(toy):
    assert [r.node for r in traversal.top_rank(traversal.pagerank(toy), 2).collect()] == [0, 1]


def test_ranks_of_nothing(edges):
    assert traversal.pagerank(edges([])).count() == 0
    with pytest.raises(ValueError):
        traversal.pagerank(edges([]), alpha=2)


def test_statistics(toy, edges):
    assert tuple(basics.stats(toy).first()) == (13, 14, 20, 7)
    assert tuple(basics.stats(edges([])).first()) == (None, 0, 0, 0)
    assert rows(basics.sinks(toy), "node") == [(0,), (4,), (10,), (11,), (12,), (13,)]
    assert rows(basics.self_loops(toy), "src") == [(2,)]
    assert rows(basics.has_successors(toy), "node", "has_succ")[:3] == [(0, False), (1, True), (2, True)]


def test_renumbering(edges):
    some = edges([(2, 5), (5, 9), (9, 2)])
    assert rows(basics.renumber_map(some), "old_id", "new_id") == [(2, 0), (5, 1), (9, 2)]
    assert rows(basics.renumber(some), "src", "dst") == [(0, 1), (1, 2), (2, 0)]
    assert rows(basics.renumber_map(some, 1), "new_id") == [(1,), (2,), (3,)]
    assert basics.renumber(edges([])).count() == 0


def test_gaps(toy, edges):
    by = {}
    for s, _, gap in rows(basics.gaps(toy), "src", "pos", "gap"):
        by.setdefault(s, []).append(gap)
    assert by == {1: [2, 0, 0, 0, 3], 2: [0, 0, 1, 3, 0, 0, 0], 3: [3], 5: [5, 0, 5, 0, 1, 0], 9: [17]}
    assert rows(basics.from_gaps(basics.gaps(toy)), "src", "dst") == sorted(TOY)
    zero_first = [(0, 0), (0, 3), (0, 4)]
    assert rows(basics.from_gaps(basics.gaps(edges(zero_first))), "src", "dst") == zero_first


def test_filled_lists(edges):
    found = rows(basics.adjacency_filled(edges([(2, 4), (2, 1)])), "node", "succ")
    assert found == [(0, []), (1, []), (2, [1, 4]), (3, []), (4, [])]


def test_references_take_the_oldest_of_equal_ones(edges):
    some = edges([(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 6), (4, 9)])
    assert rows(similarity.reference_choice(some, 7), "src", "ref_src", "common") == [(2, 1, 2), (3, 1, 2)]
    assert rows(similarity.reference_choice(some, 1), "src", "ref_src", "common") == [(2, 1, 2), (3, 2, 2)]


def test_blocks_that_begin_uncopied(edges):
    some = edges([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)])
    blocks = similarity.copy_blocks(similarity.copy_mask(some, similarity.reference_choice(some, 1)))
    assert rows(blocks, "src", "block", "copied", "size") == [(2, 1, False, 1), (2, 2, True, 2)]


def test_text_source(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# from to\n1 2\n1\t3\n\n  2   1 \n1 2\n")
    assert rows(source.read_text(spark, str(tmp_path / "e.txt")), "src", "dst") == [(1, 2), (1, 3), (2, 1)]
    (tmp_path / "bad.txt").write_text("1 2\n1 x\n")
    with pytest.raises(Exception, match="not an edge"):
        source.read_text(spark, str(tmp_path / "bad.txt")).collect()


def test_order_check(spark):
    rows_ = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 5), (3, 1, 4), (4, 2, 0)], "place bigint, src bigint, dst bigint")
    assert rows(source.unsorted(rows_, "place"), "place") == [(1,), (3,)]
    assert rows(source.out_of_order(rows_, ["place"]), "src", "dst") == [(1, 2), (1, 4)]


def test_order_check_of_a_text_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 2\n1 3\n\n2 0\n1 9\n1 9\n")
    (tmp_path / "b.txt").write_text("0 1\n5 5\n")
    found = source.out_of_order(source.read_ordered(spark, str(tmp_path)), ["file", "block", "line"])
    assert rows(found, "src", "dst") == [(0, 1), (1, 9), (1, 9)]
    many = "".join(f"{k} {k + 1}\n" for k in range(200_000))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "long.txt").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert source.out_of_order(source.read_ordered(spark, str(tmp_path / "c")), ["file", "block", "line"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_edges_from_ignores_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (3, None), (-1, 2)], "a bigint, b bigint")
    assert rows(source.edges_from(df, "a", "b"), "src", "dst") == [(1, 2)]
