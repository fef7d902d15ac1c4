import math
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandgraph.llm import cap_filters, common


def clusters(seed, d=64, n=12):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = r.standard_normal(d)
        base /= np.linalg.norm(base)
        for _ in range(r.integers(1, 25)):
            noise = r.standard_normal(d)
            out.append(base + noise / np.linalg.norm(noise) * r.choice([0.05, 0.15, 0.24, 0.3]))
    return np.array(out) * r.uniform(0.1, 30, (len(out), 1))


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        low = np.array([min([label[k], *label[near[k]]]) for k in range(len(x))])
        if (low == label).all():
            return near, label
        label = low


def test_recall_and_components(spark):
    found = links = 0
    for seed in (1, 2):
        x = clusters(seed)
        near, label = brute(x)
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        rows = {r.key: r for r in cap_filters.near_vectors(df).collect()}
        assert len(rows) == len(x)
        assert all(rows[k].n_links <= near[k].sum() for k in rows)
        found += sum(r.n_links for r in rows.values())
        links += near.sum()
        assert np.mean([rows[k].component == label[k] for k in rows]) > 0.98
    assert found >= 0.99 * links


def test_small_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 5)
    x = clusters(3)
    near, _ = brute(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = cap_filters.near_vectors(df).collect()
    assert all(r.n_links <= near[r.key].sum() + 1 for r in rows)
    assert sum(r.n_links for r in rows) >= 0.98 * near.sum()


def test_hard_rows(spark):
    one, other = [1.0] * 8, [1.0, -1.0] * 4
    rows = [
        (1, one, "?"), (2, one, "?"), (3, [2.0] * 8, "?"), (4, other, "?"), (5, None, "?"), (6, [], "?"), (7, [0.0] * 8, "?"), (8, [1.0, None] * 4, "?"),
        (9, [math.nan] + [1.0] * 7, "?"), (10, [math.inf] * 8, "?"), (None, one, "?"), (11, [1.0] * 9, "?"), (12, [3.0] * 9, "?"), (2, other, "?"), (13, [1e300] * 8, "?"),
        (14, [1e-300] * 8, "?"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, key string")
    found = sorted(((r.key, r.n_links, r.component) for r in cap_filters.near_vectors(df).collect()), key=repr)
    # 1, 2, 3, 13, 14 and the one without an id point the same way; one row of 2 and 4 are equal; 11 and 12 are longer
    expected = [(1, 5, 1), (2, 5, 1), (3, 5, 1), (13, 5, 1), (14, 5, 1), (None, 5, 1), (4, 1, 2), (2, 1, 2), (11, 1, 11), (12, 1, 11)]
    expected += [(k, 0, k) for k in (5, 6, 7, 8, 9, 10)]
    assert found == sorted(expected, key=repr)
    assert cap_filters.near_vectors(df.limit(0)).collect() == []


def test_lengths_that_agree_modulo_a_power_of_two(spark):
    rows = [(k, [1.0 + k % 2] * (8 if k < 2 else 4104)) for k in range(4)] + [(4, None), (None, [0.0] * 3), (None, [5.0] * 3)]
    out = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(((r.key, r.n_links, r.component) for r in out), key=repr) == sorted([(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4), (None, 0, None), (None, 0, None)], key=repr)


@pytest.mark.parametrize(("d", "filler"), [(8, 8_000), (64, 50_000), (256, 8_000)])
def test_recall_of_planted_pairs_among_many_vectors(spark, tmp_path, d, filler):
    """Isolated pairs among isotropic vectors, through Spark; 50,000 of 8 and 256 dimensions pass too, but take minutes."""
    n = 400
    pairs_of = [pairs(d + k, d, n, c) for k, c in enumerate((0.951, 0.96, 0.97))]
    x = np.concatenate([np.stack(p, axis=1).reshape(-1, d) for p in pairs_of] + [np.random.default_rng(d).standard_normal((filler, d))]).astype(np.float32)
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": values}), tmp_path / "v.parquet", row_group_size=8192)
    df = spark.read.parquet(str(tmp_path))
    planted = 2 * n * len(pairs_of)
    out = cap_filters.near_vectors(df).filter(f"key < {planted}").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by = {r.key: r for r in out}
    links = (unit[:planted] @ unit.T >= 0.95).sum(axis=1) - 1  # brute force
    assert all(by[k].n_links <= links[k] for k in by)  # none is false
    assert sum(by[k].n_links for k in by) >= 0.95 * links.sum()
    assert np.mean([by[k].component == by[k + 1].component for k in range(0, planted, 2)]) >= 0.95


def pairs(seed, d, n, cosine):
    """n random unit vectors and a partner of each at the cosine, as isolated pairs are."""
    r = np.random.default_rng(seed)
    x, z = r.standard_normal((2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("d", [2, 3, 5, 8, 12, 16, 64, 384])
@pytest.mark.parametrize("n", [51_282, 1_000_000, 3_000_000])
def test_isolated_pairs_share_filters_however_many_vectors_there_are(d, n):
    x, y = pairs(d, d, 200, 0.951)
    code = cap_filters.code(d, cap_filters.DIRECTIONS * n)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.best(x), code.best(y))]) >= 0.9


def test_best_are_the_best_directions(monkeypatch):
    monkeypatch.setattr(cap_filters, "SCORES", 700)
    for d, blocks in ((16, 2), (24, 3), (24, 4)):
        x, _ = pairs(4, d, 20, 0.9)
        code = cap_filters.Code(d, {2: 4096, 3: (1 << 30) + 1, 4: (1 << 40) + 1}[blocks])
        assert code.blocks == blocks
        code.words = 12
        code.code = [c[:12] for c in code.code]
        turned, sums = x @ code.turn, np.zeros((len(x), 1))
        for lo, hi, c in zip(code.edges, code.edges[1:], code.code):
            sums = (sums[:, :, None] + (turned[:, lo:hi] @ c.T)[:, None, :]).reshape(len(x), -1)
        assert code.best(x, 40).tolist() == np.sort(np.argsort(-sums, axis=1)[:, :40], axis=1).tolist()


def test_pairs_without_a_common_element():
    r = np.random.default_rng(4)
    lists = [np.sort(r.choice(40, r.integers(0, 6), replace=False)).tolist() for _ in range(60)]
    group = np.repeat(np.arange(6), 10)
    i, j = np.array([(a, b) for a in range(60) for b in range(a + 1, 60) if group[a] == group[b]]).T
    found = cap_filters._unshared(group, pa.array(lists, pa.list_(pa.int64())), i, j)
    assert found.tolist() == [not set(lists[a]) & set(lists[b]) for a, b in zip(i, j)]
    empty = cap_filters._unshared(group[:2], pa.array([[], []], pa.list_(pa.int64())), np.array([0]), np.array([1]))
    assert empty.tolist() == [True]


def test_groups_verified_together_or_alone(spark, monkeypatch):
    r = np.random.default_rng(8)
    bases = r.standard_normal((40, 16))
    rows = [(k, (bases[k % 40] + 0.1 * r.standard_normal(16)).tolist()) for k in range(700)]
    rows += [(700 + k, r.standard_normal(3).tolist()) for k in range(80)]  # another length in the same batches
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    results = []
    for small, batch in ((24, 10000), (0, 10000), (1 << 20, 10000), (24, 7)):
        monkeypatch.setattr(cap_filters, "SMALL", small)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            results.append(sorted(map(tuple, cap_filters.near_vectors(docs).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(found == results[0] for found in results)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = {(a, b) for a in range(780) for b in range(a + 1, 780) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    assert sum(x[1] for x in results[0]) <= 2 * len(links) and sum(x[1] for x in results[0]) >= 0.95 * 2 * len(links) > 0


def test_tasks_are_bounded_and_get_a_vector_once(spark, tmp_path, monkeypatch):
    """However many filters a vector meets, and whatever the number of shuffle partitions."""
    x = np.concatenate([clusters(seed) for seed in (5, 6, 7)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    expected = sorted(map(tuple, cap_filters.near_vectors(df).collect()))
    verify, folder = cap_filters._verify, str(tmp_path)

    def watched(*options):
        run = verify(*options)

        def watch(batches):
            held = [batch for batch in batches if batch.num_rows]
            nodes = [node for batch in held for node in batch.column("node").to_pylist()]
            if held:
                Path(folder, str(uuid.uuid4())).write_text(f"{len(nodes)} {len(set(nodes))} {sum(batch.nbytes for batch in held)}")
            yield from run(iter(held))

        return watch

    monkeypatch.setattr(cap_filters, "_verify", watched)
    monkeypatch.setattr(cap_filters, "TASK_BYTES", 1 << 18, raising=False)
    assert sorted(map(tuple, cap_filters.near_vectors(df).collect())) == expected
    tasks = [[int(n) for n in p.read_text().split()] for p in tmp_path.iterdir()]
    assert len(tasks) > 8 and all(rows == nodes and size <= 1 << 19 for rows, nodes, size in tasks)


def test_few_checkpoint_files(spark):
    """Hadoop's local file system starts processes for each file, and those share the executor's memory for a moment."""
    x = clusters(9)
    near, label = brute(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(48)
    common.with_checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    own = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in own}, sum(1 for _ in folder.rglob("part-*"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = cap_filters.near_vectors(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n_links for r in rows) >= 0.98 * near.sum() and np.mean([r.component == label[r.key] for r in rows]) > 0.98
    assert sum(1 for _ in folder.rglob("part-*")) - files <= 48
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


@pytest.mark.parametrize("d", [8, 64, 384])
def test_filters_of_a_vector_are_of_few_bands(d):
    """A vector goes to a task for each band at most, not for each of its 96 filters."""
    x, _ = pairs(d, d, 100, 0.9)
    code = cap_filters.code(d, cap_filters.DIRECTIONS * 1_000_000)
    found = code.best(x) // code.band
    assert np.mean([len(np.unique(bands)) for bands in found]) <= 40 and found.max() >= 500
