import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash

from strandgraph.llm import common, minhash, substring_dedup

from .conftest import HARD, prose


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


# ---- passages


def place(row):
    """Rows without an id come first, by a hash of their text."""
    return (0, xxhash.xxh64_intdigest(row[1] or "", 42) & (1 << 62) - 1) if row[0] is None else (1, row[0])


def brute_substrings(rows, window):
    """(n_words, n_removed, digest) of each row; equal ids don't remove each other's words."""
    first = {}
    for row in sorted(rows, key=place):
        i, w = place(row), words(row[1])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t in rows:
        w, own = words(t), place((i, t))
        keep, seen = [True] * len(w), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if first[key] != own or key in seen:
                keep[s : s + window] = [False] * window
            seen.add(key)
        kept = [a for a, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_substrings(docs, window, **more):
    rows = substring_dedup.dedup(docs, window=window, **more).select("the_rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def planted(seed, n=120):
    r = random.Random(seed)
    passages = [prose(1000 + k, r.randint(15, 60)).split() for k in range(6)]
    rows = []
    for i in range(n):
        w = prose(i * 7 + seed, r.randint(0, 90)).split()
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = p
        rows.append((r.randrange(10**6), "  ".join(w)))
    return rows + [(r.randrange(10**6), t) for _, t in r.sample(rows, 10)]


def test_passages(documents):
    for window in (20, 5):
        rows = planted(window)
        assert found_substrings(documents(rows), window) == brute_substrings(rows, window)


def test_passages_of_hard_rows(documents):
    assert found_substrings(documents(HARD, extra=True), 20) == brute_substrings(HARD, 20)
    assert found_substrings(documents([]), 20) == []


def test_repeats_inside_one_text(documents):
    rows = [(1, "a b " * 50), (2, "a " * 300), (3, prose(1, 30) + " " + prose(1, 30)), (4, "c " * 19), (5, "c " * 20), (6, "c " * 21)]
    assert found_substrings(documents(rows), 20) == brute_substrings(rows, 20)


@pytest.mark.parametrize("width", [(64, 16), (64, 64), (1 << 14, 64)])
def test_a_full_sketch_and_many_segments_lose_nothing(documents, monkeypatch, width):
    rows = planted(3)
    monkeypatch.setattr(substring_dedup, "sketch_width", lambda *_: width)
    assert found_substrings(documents(rows), 20) == brute_substrings(rows, 20)


def test_the_share_of_single_windows_that_pass_stays_small(documents, monkeypatch):
    """With a sketch in proportion, of 1 and of 100 parts."""
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 16)
    for n in (60, 6000):
        r = random.Random(n)
        docs = documents([(k, " ".join(f"{r.randrange(10**9):x}" for _ in range(120))) for k in range(n)])
        keyed = docs.selectExpr("doc_id AS the_key", "text AS the_text")
        passed = substring_dedup.repeated_minimisers(keyed, 20).selectExpr("sum(size(minimisers)) AS n").first()["n"] or 0
        assert passed < 0.1 * n * 101 / 7, n


def test_rows_without_an_id_have_keys_of_their_own(documents):
    p = prose(4, 40)
    rows = [(None, f"{prose(k, 5)} {p} {prose(k + 50, 30)}") for k in range(60)] + [(None, p)] * 3 + [(5, p), (-7, f"x {p}")]
    assert found_substrings(documents(rows), 20) == brute_substrings(rows, 20)


def test_cut_text_keeps_its_white_space(documents):
    p = prose(9, 25)
    docs = documents([(1, f"one\n{p}\ntwo"), (2, f"first  line\n\n{p}\nlast  line"), (3, "left\n\n alone "), (4, p)], extra=True)
    out = {r.doc_id: r for r in substring_dedup.cut_repeats(docs).collect()}
    assert out[1].text == f"one\n{p}\ntwo" and out[3].text == "left\n\n alone "
    assert out[2].text == "first  line\nlast  line" and out[4].text == ""
    assert out[1].the_text == "?" and list(out[1].asDict()) == docs.columns


# ---- near duplicates


def shingles(t, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_near(rows, n):
    """(id, set size, component) of each row, by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((find(i), find(j)))
                    up[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def found_near(docs, n):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, n).collect()), key=repr)


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def families(seed):
    r = random.Random(seed)
    rows, at = [], 0
    for size, edits in ((40, 6), (25, 3), (8, 2), (3, 1)):
        base = prose(seed * 31 + size, 150)
        for _ in range(size):
            at += r.randint(1, 50)
            rows.append((at, edited(base, r.randint(0, edits), r)))
    rows += [(at + k, prose(k, r.randint(1, 60))) for k in range(1, 40)]
    rows += [(at + 100 + k, t) for k, (_, t) in enumerate(r.sample(rows, 12))]
    r.shuffle(rows)
    return rows


def test_near_duplicates(documents):
    for seed in (1, 2):
        rows = families(seed)
        expected = brute_near(rows, 4)
        assert len({c for _, _, c in expected}) < len(rows) - 50
        assert found_near(documents(rows), 4) == expected


def test_small_blocks_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = families(3)
    assert found_near(documents(rows), 4) == brute_near(rows, 4)


def test_prefixes_lose_no_link():
    part, whole = minhash.SIMILARITY
    for a in range(1, 60):
        for b in range(a, 80):
            least = next((c for c in range(1, a + 1) if whole * c >= part * (a + b - c)), None)
            if least:  # the first shared shingle has least - 1 others behind it in either set, in any one order
                assert minhash._prefixes(a)[1] >= a - least + 1 and minhash._prefixes(b)[0] >= b - least + 1


def templated(seed, size, fixed, own, linked):
    """size pages of a template of fixed words with own words of their own, and copies of some with one word changed."""
    r = random.Random(seed)
    base = prose(seed, fixed).split()
    rows = []
    for i in range(size):
        mine = [f"own{i}x{k}" for k in range(own)]
        rows.append((3 * i + 1, " ".join(base[: fixed // 2] + mine + base[fixed // 2 :])))
    rows += [(3 * i + 2, rows[i][1].replace(f"own{i}x1 ", "changed ")) for i in r.sample(range(size), linked)]
    r.shuffle(rows)
    return rows


def test_pages_of_one_template_are_not_compared_with_all_others(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 8)
    rows, able = templated(11, 300, 120, 24, 12), []
    filtered = minhash._able
    monkeypatch.setattr(minhash, "_able", lambda stars, *more: able.append((stars.count(), filtered(stars, *more))) or able[-1][1])
    expected = brute_near(rows, 4)
    assert len({c for _, _, c in expected}) == 300
    assert found_near(documents(rows), 4) == expected
    [(all_rows, left)] = able
    assert all_rows >= 300 and left.count() <= 0.1 * all_rows


def test_few_checkpoints_besides_those_of_components(documents, monkeypatch):
    """Each writes a file a partition, for which an executor may start several processes."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    made, write = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: made.append(1) or write(df))
    rows = families(3)
    assert found_near(documents(rows), 4) == brute_near(rows, 4)
    assert len(made) <= 10


@pytest.fixture
def checkpoint_files(spark):
    """Counts the files that checkpoints have; shuffles have 48 partitions meanwhile, however small they are."""
    own = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    common.with_checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    yield lambda: sum(1 for _ in folder.rglob("part-*"))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_have_few_checkpoint_files(documents, checkpoint_files, monkeypatch):
    """Hadoop's local file system starts processes for each file, and those share the executor's memory for a moment."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows, before = families(3), checkpoint_files()
    assert found_near(documents(rows), 4) == brute_near(rows, 4)
    assert checkpoint_files() - before <= 48


def test_gathered_tables_are_whole_and_nothing_is_held(spark, checkpoint_files, monkeypatch):
    rows = spark.range(20_000).repartition("id").selectExpr("id", "array(id, -id) AS list", "if(id % 7 = 0, null, md5(string(id))) AS digest")
    expected = sorted(map(tuple, rows.collect()))
    files = []
    for size in (1 << 30, 100_000, 1):
        monkeypatch.setattr(common, "FILE_BYTES", size)
        before = checkpoint_files()
        assert sorted(map(tuple, common.gathered(rows).collect())) == expected
        files.append(checkpoint_files() - before)
    assert files[0] == 1 < files[1] < files[2] == 48
    assert common.gathered(rows.filter("id < 0")).collect() == []
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_near_duplicates_of_hard_rows(documents):
    assert found_near(documents(HARD, extra=True), 4) == brute_near(HARD, 4)
    assert found_near(documents([]), 4) == []


def test_one_of_each_group_stays(documents):
    rows = families(4)
    docs = documents(rows, extra=True)
    kept = minhash.keep_one(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute_near(rows, 5) if i == c)


def test_one_row_stays_of_repeated_rows_and_rows_without_ids(documents):
    a, b = prose(1, 80), prose(2, 80)
    near = a.replace(a.split()[40], "changed")
    docs = documents([(None, a), (None, a), (None, near), (None, b), (None, b), (7, a), (7, a), (9, near), (3, prose(3, 50)), (3, prose(3, 50)), (None, ""), (4, "")], extra=True)
    kept = minhash.keep_one(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, a), (None, b), (3, prose(3, 50)), (None, ""), (4, "")], key=repr)


def test_long_sets_are_compared_in_slabs(monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 3000 - 90 * k], r.integers(0, 1 << 62, 30 * k, dtype=np.uint64)])) for k in range(12)]
    rows = np.arange(12)
    whole = minhash._pairs(sets, rows, rows)
    monkeypatch.setattr(minhash, "SLAB", 100)
    assert [x.tolist() for x in minhash._pairs(sets, rows, rows)] == [x.tolist() for x in whole]
    alike = {(i, j) for i in range(12) for j in range(12) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*(x.tolist() for x in whole))) == alike


def test_densified_bins_agree_as_often_as_sets():
    r = np.random.default_rng(1)
    for size in (5, 60, 2000):
        agreed = []
        for _ in range(200):
            s = np.unique(r.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2))
            r.shuffle(s)
            a, b = np.sort(s), np.sort(s[:size])
            agreed.append((minhash.densified(a) == minhash.densified(b)).mean())
        assert abs(np.mean(agreed) - size / (size + size // 4)) < 0.03
