import random

import pytest

from strandgraph.operators.compress import SECTIONS, compress
from strandgraph.sources import stream
from strandgraph.sources.stream import read_stream, stream_edges, write_stream

from .conftest import TOY


def test_toy_file(spark, toy, tmp_path):
    write_stream(compress(toy, variant="final", ws=2, mrc=3, th=3, jump=4), str(tmp_path / "f"))
    raw = (tmp_path / "f").read_bytes()
    number = lambda n: n.to_bytes(8, "little")
    head = bytes([1, 2, 1, 3, 4, 3, 4, 2]) + b"".join(map(number, (13, 20, 7, 21, 4, 2, 4, 3))) + b"".join(map(number, (0, 89, 142, 165)))
    assert raw == head + bytes.fromhex("415baa08c1952b8b3090230219452b2b437898217a")
    lists = read_stream(spark, str(tmp_path / "f"), "final")
    assert sorted((r.src, r.dst) for r in lists.edges().collect()) == sorted(TOY)
    assert [r.start for r in lists.index().orderBy("node").collect()] == [0, 89, 142, 165]


@pytest.mark.parametrize("variant", SECTIONS)
def test_files_read_back(edges, spark, variant, tmp_path):
    r = random.Random(variant)
    pairs = {(r.randint(0, 150), r.randint(0, 90)) for _ in range(1200)}
    write_stream(compress(edges(pairs), variant=variant, chunk=r.choice([32, 1000]), ws=5, codes={"residuals": "delta"}), str(tmp_path / "f"))
    assert sorted((x.src, x.dst) for x in stream_edges(spark, str(tmp_path / "f"), variant).collect()) == sorted(pairs)
    with pytest.raises(Exception):
        write_stream(compress(edges(pairs), variant=variant), str(tmp_path / "f"))


@pytest.mark.parametrize("variant", ["G", "final"])
def test_blocks_make_the_same_file(edges, spark, variant, tmp_path, monkeypatch):
    pairs = {(s, (s * 7 + k * k) % 500) for s in range(400) for k in range(s % 9)}
    made = compress(edges(pairs), variant=variant, jump=3, chunk=50)
    write_stream(made, str(tmp_path / "one"))
    monkeypatch.setattr(stream, "BLOCK_BITS", 40)
    write_stream(made, str(tmp_path / "many"))
    assert (tmp_path / "one").read_bytes() == (tmp_path / "many").read_bytes()
    assert sorted((x.src, x.dst) for x in stream_edges(spark, str(tmp_path / "many"), variant).collect()) == sorted(pairs)
