import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from strandgraph.llm import licences, mixing, quality_classifier, quality_rules

from .conftest import HARD, prose

# ---- quality rules


def base(t):
    t = t or ""
    w = re.findall(r"[^ \t-\r]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


RULED = HARD + [
    (20, "a b c d e f g h " * 9), (21, prose(1, 50) + " " + " ".join(prose(1, 50).split()[10:22])), (22, "HE SAID SO " * 20 + prose(8, 30)), (23, "w### " * 30),
    (24, "same line here\n" * 12 + prose(5, 90)), (25, "x y " * 4 + "x y z"), (26, " | ".join(prose(6, 40).split())), (27, "123 456 " * 3 + "7 " * 40),
]


def test_rules(documents):
    docs = documents(RULED, extra=True)
    out = quality_rules.judge(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    own = out.columns[len(docs.columns) :]
    got = sorted((r["doc_id"] or 0, *(r[c] for c in own[:5]), r[own[5]]) for r in out.collect())
    assert got == sorted((i or 0, *base(t)) for i, t in RULED)
    assert all(r[own[6]] is False for r in out.collect() if r[own[5]])


def test_filter_agrees_with_verdict(documents):
    docs = documents(RULED, extra=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality_rules.judge(documents(RULED)).filter("kept").collect())
    assert quality_rules.keep_good(documents([])).collect() == [] == quality_rules.judge(documents([])).collect()


def test_order_follows_rejections(documents):
    rows = [(k, "w### " * 30) for k in range(50)]
    order = [r.name for r in quality_rules.order_rules(documents(rows))]
    assert set(order) == {r.name for r in quality_rules.RULES}
    assert order.index("symbols") < order.index("min_words")
    assert all([r.name for r in quality_rules.order_rules(documents(rows))] == order for _ in range(2))


def test_sample_is_spread_over_files(spark, tmp_path):
    """The first files hold nothing that a rule rejects; the cheapest rule goes first there."""
    clean, loud = [prose(k, 60) for k in range(40)], ["ALL UPPER CASE " * 20 + prose(k, 5) for k in range(40)]
    for k in range(40):
        spark.createDataFrame([(t,) for t in (clean if k < 20 else loud)], "text string").coalesce(1).write.parquet(f"{tmp_path}/t/p={k:02}")
    docs = spark.read.parquet(f"{tmp_path}/t")
    names = [r.name for r in quality_rules.order_rules(docs)]
    assert names.index("shouting") < names.index("letters") and names[0] in ("shouting", "duplicate_lines")
    assert quality_rules._spread(docs).select("p").distinct().count() == 16
    assert quality_rules._spread(docs.groupBy("text").count()).count() > 0


def test_costs_are_measured(spark):
    found = quality_rules.measure_costs(spark.createDataFrame([(prose(k, 80),) for k in range(30)], "text string"), 2, 1)
    assert set(found) == set(quality_rules.COSTS)


def test_echoes(spark):
    texts = ["a a b", "a aa a", "x\n\tx x", "", " b", "b b", "ab b ab", "$ $ $", "é é", "a a\n"]
    m = quality_rules.Measures(spark.createDataFrame([(t,) for t in texts], "text string"))
    m.take(["n_echoes"])
    for r in m.df.collect():
        w = re.findall(r"[^ \t-\r]+", r.text)
        assert r.n_echoes == sum(x == y for x, y in zip(w, w[1:])), r.text


def test_no_python_in_the_plan(documents):
    for df in (quality_rules.judge(documents(RULED)), quality_rules.keep_good(documents(RULED)), licences.scan(documents(RULED)), mixing.mix(documents(RULED))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ---- licences


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def grams(t):
    w = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).strip().split()
    return {f"{x} {y}" for x, y in zip(w, w[1:])}


def plain_words(t):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).split()


def brute_licence(t, templates):
    """(licence, dice, matching units) with every unit and every window compared with every template."""
    t = re.sub("[^a-z0-9\n]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    units = {" ".join(plain_words(u)) for u in [*t.split("\n"), *re.split(r"\n(?: ?\n)+", t), t]}
    fixed = [(name, x) for name in sorted(templates) for x in templates[name]]
    scored = [[(dice(grams(u), grams(x)), name) for name, x in fixed] for u in units]
    n = sum(max(own)[0] >= 0.8 for own in scored)
    found = [h for own in scored for h in own if h[0] >= 0.8]
    w = plain_words(t)
    for name, x in fixed:
        size, own = len(plain_words(x)), grams(x)
        for p in range(len(w) - 1):
            if f"{w[p]} {w[p + 1]}" in own and (s := dice(grams(" ".join(w[p : p + size])), own)) >= 0.8:
                found.append((s, name))
    best = min(found, key=lambda h: (-h[0], h[1]), default=(0.0, None))
    return best[1], round(best[0], 9), n


def test_licences(documents):
    mit, full = licences.TEMPLATES["MIT"][2:4]
    gpl = licences.TEMPLATES["GPL-3.0"][1]
    code = "\n".join(f"x{k} = call({k}, y{k % 7})  # step {k}" for k in range(60))
    rows = HARD + [
        (20, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 30)), (21, mit.replace("Software", "Program", 2)), (22, "Licensed under CC BY 4.0."), (23, "Released under the MIT"),
        (24, "intro\n\n" + "\n".join(mit.split(". ")) + "\n\nmore " + prose(3, 50)), (25, "licensed UNDER the apache license -- version 2.0\nReleased under the MIT License."),
        (26, f"The MIT License\n\nCopyright (c) 2020 A. Person\n\n{full}\n\n{code}"), (27, "Our parser is small and fast. Released under the MIT License. See the docs for more."),
        (28, "# " + gpl.replace(". ", ".\n#\n# ") + "\n" + code), (29, f"{prose(4, 200)} {licences.TEMPLATES['BSD-3-Clause'][1]} {prose(5, 200)}"), (30, "the of and to in " * 30),
    ]
    out = licences.scan(documents(rows, extra=True))
    got = sorted(((r.doc_id, r["_licence"], round(r["_dice"], 9), r.n_licence_units) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_licence(t, licences.TEMPLATES)) for i, t in rows), key=repr)
    by = {g[0]: g[1] for g in got}
    assert [by[k] for k in (20, 22, 26, 27, 28, 29, 30)] == ["MIT", "CC-BY-4.0", "MIT", "MIT", "GPL-3.0", "BSD-3-Clause", None]
    assert licences.scan(documents([])).collect() == []
    other = {"B": ("one two three four", "x"), "A": ("one two three four",)}
    assert [r._licence for r in licences.scan(documents([(1, "zero one two three four five")], extra=True), other).collect()] == ["A"]
    assert [r._licence for r in licences.scan(documents([(1, "a b")], extra=True), {}).collect()] == [None]


#: Heads of files as they are found in public repositories, none of them a template itself.
HEADERS = {
    "Apache-2.0": "/*\n * Copyright 2019 The Project Authors\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     https://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n * See the License for the specific language governing permissions and\n * limitations under the License.\n */\nint main() { return 0; }",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nlet x = 1;",
    "BSL-1.0": "// Copyright A. Person 2011.\n// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\n#pragma once",
    "LGPL-2.1": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n#\n# This library is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n# Lesser General Public License for more details.\n#\n# You should have received a copy of the GNU Lesser General Public\n# License along with this library; if not, write to the Free Software\n# Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301 USA\nimport os",
    "BSD-3-Clause": "// Copyright 2014 The Project Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.\nint x;",
}


def test_heads_of_real_files(documents):
    got = {r.doc_id: r.licence for r in licences.scan(documents(list(enumerate(HEADERS.values())))).collect()}
    assert [got[k] for k in range(len(HEADERS))] == list(HEADERS)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_bounds_lose_no_template(threshold):
    for m in range(1, 60):
        low, high, need = licences.bounds(m, threshold)
        for a in range(1, 200):
            assert (2 * min(a, m) >= threshold * (a + m)) == (low <= a <= high)
            assert all(c >= need for c in range(1, min(a, m) + 1) if 2 * c >= threshold * (a + m))


# ---- mixing


def test_mixing_is_poisson_to_the_weights(spark):
    docs = spark.range(30000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 10 = 1 THEN 'b' ELSE 'c' END AS source")
    out = mixing.mix(docs, {"a": 1.0, "b": 2.0, "c": 1.0, "none": 9.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["b"] == pytest.approx(15000, rel=0.05) and n["a"] == pytest.approx(7500, rel=0.05)
    counts = {r["count"]: r["n"] for r in out.filter("source = 'a'").groupBy("doc_id").count().groupBy("count").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    rate = 0.75
    for k in (1, 2, 3):
        assert counts[k] / 10000 == pytest.approx(math.exp(-rate) * rate**k / math.factorial(k), abs=0.015)
    again = mixing.mix(docs.repartition(5), {"a": 1.0, "b": 2.0, "c": 1.0, "none": 9.0})
    key = lambda df: sorted((r.doc_id, r["copy"]) for r in df.select("doc_id", "copy").collect())
    assert key(out) == key(again)
    order = [r.doc_id for r in out.limit(3000).collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1


def test_mixing_without_broadcast(documents, monkeypatch):
    rows = [(k, str(k)) for k in range(300)]
    a = sorted(map(repr, mixing.mix(documents(rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, mixing.mix(documents(rows)).collect())) == a


def poisson_quantiles(rate, at):
    """Least k with P(X <= k) > each of at, by logarithms from the mode."""
    k = np.arange(int(rate - 15 * rate**0.5), int(rate + 15 * rate**0.5))
    logs = k * math.log(rate) - rate - np.array([math.lgamma(i + 1) for i in k])
    return k[np.searchsorted(np.cumsum(np.exp(logs)), at, "right")]


@pytest.mark.parametrize(("rate", "n"), [(0.01, 20000), (5, 2000), (500, 200), (746, 200), (800, 200), (10_000, 200), (100_000, 30)])
def test_mixing_at_any_rate_is_poisson(spark, rate, n):
    """One small source in a large table: its documents are repeated up to 100,000 times in the mean."""
    docs = spark.range(2 * n).selectExpr("id AS doc_id", f"CASE WHEN id < {n} THEN 'a' ELSE 'b' END AS source")
    by_source = spark.createDataFrame([("a", float(rate))], "mix_source string, mix_rate double")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "rates", lambda *_: by_source)
        rows = mixing.mix(docs).groupBy("doc_id").agg({"*": "count", "copy": "max"}).collect()
    counts = np.zeros(n)
    for r in rows:
        counts[r["doc_id"]] = r["count(1)"]
        assert r["count(1)"] == r["max(copy)"]
    assert abs(counts.mean() - rate) < 3 * (rate / n) ** 0.5
    assert abs(counts.var() / rate - 1) < 5 * ((2 + 1 / rate) / n) ** 0.5
    if rate >= 500:
        for share, k in zip((0.1, 0.5, 0.9), poisson_quantiles(rate, (0.1, 0.5, 0.9))):
            assert abs(np.mean(counts <= k) - share) < 3 * (share * (1 - share) / n) ** 0.5 + 0.05


def brute_mix(rows, weights=None):
    """(id, text, copy) of rows (id, text, source), one by one: numbers by hashlib, quantiles by logarithms."""
    sources = {r[2] for r in rows} if weights is None else set(weights) & {r[2] for r in rows}
    total = sum(1 if weights is None else weights[x] for x in sources)
    kept, out = [r for r in rows if r[2] in sources], []
    for i, text, source in kept:
        rate = (1 if weights is None else weights[source]) / total * len(kept) / sum(r[2] == source for r in kept)
        at = f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}:{source or ''}"
        u = int(hashlib.md5(f"{mixing.SEED}:{at}".encode()).hexdigest()[:13], 16) / 2**52
        n, below = 0, 0.0
        while (below := below + math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))) <= u:
            n += 1
        out += [(i, text, c) for c in range(1, n + 1)]
    return out


def test_mixing_against_brute_force(documents):
    rows = [(k if k % 3 else None, f"text {k}", "abc"[k % 7 % 3]) for k in range(400)] + [(9, None, "a"), (None, "", None), (7, "x", "b"), (7, "x", "b")]
    docs = documents([(i, t) for i, t, _ in rows]).sparkSession.createDataFrame(rows, "doc_id bigint, text string, source string")
    for weights in (None, {"a": 3.0, "c": 0.5, "z": 1.0}):
        got = sorted(repr(tuple(r)) for r in mixing.mix(docs, weights).select("doc_id", "text", "copy").collect())
        assert got == sorted(map(repr, brute_mix(rows, weights)))


def test_mixing_spreads_rows_without_ids(spark):
    docs = spark.range(8000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id < 4000 THEN 'same' ELSE CAST(id AS STRING) END AS text", "CAST(id % 2 AS STRING) AS source")
    out = mixing.mix(docs)
    kept = out.select("text").distinct().count()
    assert 0.55 < kept / 4002 < 0.72  # a share of 1 / e goes: each text has its own draw
    sizes = [r[0] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_mixing_hard_rows(documents):
    docs = documents(HARD, extra=True).unionByName(documents([(99, "t")], extra=True).drop("source").selectExpr("*", "CAST(NULL AS STRING) AS source"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_copy"]
    assert mixing.mix(documents([])).collect() == []


# ---- quality classifier


def labelled(spark, n=1500):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        t = prose(k, 20 + k % 90)
        if bad:
            t = [" ".join(w + "###" for w in t.split()), t.upper().replace(" ", "!! "), " | ".join(t.split()), (t.split()[0] + " ") * 60][k // 4 % 4]
        rows.append((k, t))
        labels.append((k, int(not bad), 0))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier_on_held_out_rows(spark, documents):
    rows, labels = labelled(spark)
    out = {r.doc_id: r for r in quality_classifier.classify(documents(rows, extra=True), labels).collect()}
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [r for r in out.values() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def plain_statistics(t):
    """The classifier's statistics once more, from words and characters."""
    t = t or ""
    w = re.findall(r"[^ \t-\r]+", t)
    n, count = max(len(w), 1), lambda chars: sum(c in chars for c in t)
    lengths = [len(x.encode()) for x in w]
    mean = sum(lengths) / n
    upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    kinds = [count(" \t\v\f\r"), count("\n"), upper, lower, count("0123456789"), count("#*$%&|<>"), count("!?"), count("."), count(",;:")]
    raw = t.encode()
    wide = sum(b >= 128 for b in raw)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    most = max(map(w.count, set(w)), default=0)
    return [
        math.log1p(len(w)), math.log1p(mean), math.log1p(max(sum(x * x for x in lengths) / n - mean**2, 0) ** 0.5), (upper / max(upper + lower, 1)) ** 0.5,
        sum("A" <= x[0] <= "Z" for x in w) / n, math.log1p(kinds[5] / n), (kinds[6] / n) ** 0.5, (sum(x == 1 for x in lengths) / n) ** 0.5, (kinds[4] / n) ** 0.5,
        (wide / max(len(raw), 1)) ** 0.5, (kinds[7] / n) ** 0.5, (kinds[8] / n) ** 0.5, (kinds[1] / n) ** 0.5, len(set(w)) / n,
        (sum(a == b for a, b in zip(w, w[1:])) / n) ** 0.5, ((len(triples) - len(set(triples))) / max(len(triples), 1)) ** 0.5, (most / n) ** 0.5,
        math.log1p((len(raw) - wide - sum(kinds)) / n),
    ]


def test_classifier_against_brute_force(spark, documents):
    """Densities by inverse matrices and determinants, from statistics made one text at a time."""
    rows, labels = labelled(spark, 300)
    rows += [(10**6 + k, t) for k, t in enumerate(("", None, "Ünï ###", "a"))]
    got = {r.doc_id: r for r in quality_classifier.classify(documents(rows), labels).collect()}
    x = np.array([plain_statistics(t) for _, t in rows])
    label = {r.doc_id: r.quality for r in labels.collect()}
    y = np.array([label.get(i, -1) if zlib.crc32(str(i).encode()) % 5 else -1 for i, _ in rows])
    parts = [x[y == c] for c in (0, 1)]
    n, means = [len(p) for p in parts], [p.mean(axis=0) for p in parts]
    spreads = [np.cov(p.T, bias=True) for p in parts]
    pooled = np.maximum((n[0] * np.diag(spreads[0]) + n[1] * np.diag(spreads[1])) / sum(n), 1e-9)
    centre = np.concatenate(parts).mean(axis=0)
    scale = np.sqrt(pooled + sum(k * (m - centre) ** 2 for k, m in zip(n, means)) / sum(n))
    x = centre + np.clip((x - centre) / scale, -8, 8) * scale
    log = []
    for m, s in zip(means, spreads):
        s = 0.8 * s + 0.2 * np.diag(pooled)
        log.append([-((v - m) @ np.linalg.inv(s) @ (v - m) + np.linalg.slogdet(s)[1]) / 2 for v in x])
    odds = np.array(log[1]) - np.array(log[0]) + math.log(n[1] / n[0])
    for (i, _), z in zip(rows, odds):
        want = 1 / (1 + math.exp(-min(max(z, -700), 700)))
        assert got[i].score == pytest.approx(want, abs=1e-7) and got[i].predicted == (want >= 0.3)


def test_held_out_labels_teach_nothing(spark, documents):
    rows, labels = labelled(spark, 400)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality_classifier.classify(documents(rows), x).collect()) for x in (labels, flipped))
    assert a == b


def test_classifier_hard_rows(spark, documents):
    rows, labels = labelled(spark, 400)
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 7, 0), (6, 1, 0), (6, 1, 0)], labels.schema))
    hard = [(None if i is None else i + 10**6, t) for i, t in HARD]
    out = quality_classifier.classify(documents(rows + hard, extra=True), odd).collect()
    assert len(out) == len(rows) + len(hard) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in quality_classifier.classify(documents(hard), labels.limit(0)).collect())
    assert quality_classifier.classify(documents([]), labels).collect() == []
