import random

import pytest

from strandgraph.functions.bitcodes import pack
from strandgraph.graph import Graph
from strandgraph.operators.compress import SECTIONS, Format, Reader, Writer, compress, open_compressed

from .conftest import TOY

CODES = ("unary", "gamma", "delta", "nibble", "zeta1", "zeta2", "zeta3", "zeta6")


def lists(pairs, top):
    return [(v, sorted(t for s, t in pairs if s == v)) for v in range(top + 1)]


def pairs_of(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_toy_stream():
    w = Writer(Format("final", ws=2, mrc=3, th=3, jump=4))
    written = {v: w.write(v, succ) for v, succ in lists(TOY, 13)}
    stream = "".join(e.bits for e in written.values())
    assert len(stream) == 167
    assert pack(stream).hex() == "415baa08c1952b8b3090230219452b2b437898217a"
    assert [written[v].reference for v in (1, 2, 3, 5, 9)] == [0, 1, 0, 3, 0]
    assert written[5].mask == [1, 1, 0, 1, 1, 0, 1] and written[5].blocks == [2, 1, 2, 1, 1]
    assert written[2].order == [2, 3, 5, 9, 10, 11, 12] and written[2].runs == [(10, 12)]


def test_toy_gaps():
    w = Writer(Format("G"))
    assert "".join(w.write(v, s).bits for v, s in lists(TOY, 13)) == "1111010100100010101100100010101001000010101001010101101000100010"


def test_toy_offsets(toy):
    g = compress(toy, variant="G")
    assert [r.start for r in g.offsets().orderBy("node").collect()] == [0, 0, 14, 32, 37, 37, 56, 56, 56, 56, 64, 64, 64, 64]
    f = compress(toy, variant="final", ws=2, mrc=3, th=3, jump=4)
    assert [r.start for r in f.index().orderBy("node").collect()] == [0, 89, 142, 165]


@pytest.mark.parametrize("seed", range(40))
def test_random_lists_read_back(seed):
    r = random.Random(seed)
    top = r.randint(0, 60)
    pairs = {(r.randint(0, top), r.randint(0, top) if r.random() < 0.5 else min(top, r.randint(0, 9))) for _ in range(r.randint(0, 300))}
    variant = r.choice(list(SECTIONS))
    fmt = Format(variant, {s: r.choice(CODES) for s in SECTIONS[variant]}, ws=r.randint(1, 9), mrc=r.randint(1, 4), th=r.randint(2, 5))
    w, back = Writer(fmt), Reader(fmt)
    for v, succ in lists(pairs, top):
        e = w.write(v, succ)
        assert back.read(v, e.bits) == e.order
        assert sorted(e.order) == succ and e.chain <= fmt.mrc and sum(e.sections.values()) == len(e.bits)


@pytest.mark.parametrize("variant", SECTIONS)
def test_tables_read_back(edges, variant, tmp_path):
    r = random.Random(variant)
    pairs = {(r.randint(0, 200), r.randint(0, 90)) for _ in range(1500)}
    made = compress(edges(pairs), variant=variant, chunk=32, ws=4)
    assert pairs_of(made.edges()) == sorted(pairs)
    made.write(str(tmp_path / "g"))
    again = open_compressed(made.lists.sparkSession, str(tmp_path / "g"))
    assert again.fmt == made.fmt and pairs_of(again.edges()) == sorted(pairs)
    assert sorted(x.dst for x in again.successors(77).collect()) == sorted(t for s, t in pairs if s == 77)


@pytest.mark.parametrize("pairs", [[], [(0, 0)], [(4, 4)], [(0, 0), (0, 3), (0, 4)], [(7, 1)], [(2, 9)], [(1, 5), (2, 5), (3, 5)], [(0, 1), (1, 2), (2, 3), (3, 4)]])
def test_small_graphs(edges, pairs):
    for variant in SECTIONS:
        assert pairs_of(compress(edges(pairs), variant=variant, ws=50, mrc=1, jump=1000, chunk=3).edges()) == pairs


def test_one_and_many_chunks_agree(toy):
    assert pairs_of(compress(toy, chunk=1).edges()) == pairs_of(compress(toy, chunk=1000).edges()) == sorted(TOY)


def test_bad_options():
    for bad in ({"variant": "X"}, {"ws": 0}, {"mrc": 0}, {"th": 1}, {"jump": 0}, {"codes": {"size": "gamma"}, "variant": "G"}, {"codes": {"size": "zeta"}}):
        with pytest.raises(ValueError):
            Format(**bad)


def test_graph_object(spark, toy, tmp_path):
    g = Graph(toy)
    g.write_text(str(tmp_path / "t"))
    assert pairs_of(Graph.read_text(spark, str(tmp_path / "t")).edges) == sorted(TOY)
    g.compress(variant="CB").write(str(tmp_path / "c"))
    assert pairs_of(Graph.open(spark, str(tmp_path / "c")).edges) == sorted(TOY)
    assert g.renumbered(1).stats().first().asDict() == {"max_id": 11, "num_ids": 12, "links": 20, "max_degree": 7}
    with pytest.raises(ValueError):
        g.bfs(14)
