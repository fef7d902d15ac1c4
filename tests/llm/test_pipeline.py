import hashlib
import random
from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from strandgraph.llm import quality_rules, sentencepieces
from strandgraph.llm.queries import oracle_sql, queries

from .conftest import prose
from .test_documents import base, brute_mix
from .test_duplicates import brute_near, brute_substrings, edited


def corpus():
    r = random.Random(8)
    rows = [(k, prose(k, r.randint(5, 120))) for k in range(150)]
    rows += [(200 + k, edited(rows[k][1], 1, r)) for k in range(100, 130) if len(rows[k][1].split()) > 60]
    rows += [(300 + k, rows[k][1]) for k in range(20, 40)]
    passage = prose(9999, 55)
    rows += [(400 + k, f"{prose(5000 + k, 40)} {passage}\n{prose(6000 + k, 30)}") for k in range(15)]
    return rows + [(500 + k, "bad### " * 40) for k in range(10)] + [(600, None), (601, "")]


def test_stages_against_brute_force(spark, documents, tmp_path):
    rows = corpus()
    docs = documents(rows).select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) AS n_chars")
    state = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        if name == "quality rules":
            good = {i for i, t in state.items() if not base(t)[5] and base(t)[2] * 10 <= base(t)[0]}
            assert {r.doc_id for r in got} == good
        elif name == "near duplicates":
            assert {r.doc_id for r in got} == {i for i, _, c in brute_near(sorted(state.items()), 5) if i == c}
            assert all(r.text == state[r.doc_id] for r in got)
        elif name == "repeated passages":
            expected = {i: (n - gone, digest) for i, n, gone, digest in brute_substrings(sorted(state.items()), 20)}
            assert {r.doc_id: (len(r.text.split()), hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest()) for r in got} == expected
            assert all(r.n_chars == len(r.text) for r in got)
            assert sum(r.text != state[r.doc_id] for r in got) >= 13
        elif name == "mixing":
            drawn = brute_mix([(r.doc_id, r.text, r.source) for r in before.collect()])
            assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for i, t, _ in drawn)
            assert {r.doc_id for r in got} <= set(state) and all(r.source == source[r.doc_id] for r in got)
        else:
            library = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.read_model(None))
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            made = [(i, library.encode(state[i])) for i in ids]
            assert sorted(tuple(r)[:4] for r in got) == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in made)
        if k < 4:
            state = {r.doc_id: r.text for r in got}
            ids = [r.doc_id for r in got]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixing", "encoding"]
    assert len(quality_rules.RULES) == len({r.name for r in quality_rules.RULES})


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA)).columns[:2] == ["doc_id", "n_tokens"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df, r = queries()[name](spark, str(DATA)), c.sql(oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(r.columns)
    got = sorted(repr(tuple(row[x] for x in order)) for row in df.collect())
    assert got == sorted(repr(tuple(row[r.columns.index(x)] for x in order)) for row in r.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0
