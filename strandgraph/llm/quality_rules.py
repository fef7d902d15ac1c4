"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule compares a weighted sum of measures of a document (counts over its characters, words and lines) with a bound. The
cascade estimates on a bounded sample, spread over the files, what each rule costs and how many documents it rejects, and
sorts the rules by rejections per cost. The cost of a rule is the sample's characters and words times what its measures take
for each of them (COSTS, measured by measure_costs()), so the order is the same in every run over the same files. A
document that a rule rejects is measured for none after it: filters stand in that order, each above the measures that it is the
first to need, or branches of one CASE WHEN. The order changes the time, never the verdict.

Defined results: a null or empty text has no words and fails ``min_words``. Null ids, ties, repeated rows and empty
tables need no rule of their own: every row is judged by itself. Columns of the input are kept; a clash with a measure's
name is solved by a prefix of underscores.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, free_name, text_or_empty

SYMBOLS = "#*$%&|<>"
#: The sample on which costs and rejections are estimated: so many rows at most, of so many files at most, one of so many
#: rows there; only the order of the rules follows from it.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_STEP = 2000, 16, 10
WINDOW = 8
#: A word before an equal one.
ECHO = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?:[\x20\x09-\x0D]|\z))"


@dataclass(frozen=True)
class Rule:
    """A document fails if the sum of weight * measure is above the bound. base: one of the contract's two base rules."""

    name: str
    weights: dict[str, int]
    bound: int = 0
    base: bool = False

    def sql(self) -> str:
        return " + ".join(f"({w}) * {m}" for m, w in self.weights.items()) + f" > {self.bound}"


RULES = (
    Rule("min_words", {"n_words": -1}, -20, base=True),
    Rule("repeated_words", {"n_repeat_words": 100, "n_words": -30}, base=True),
    Rule("symbols", {"n_symbols": 10, "n_words": -1}),
    Rule("short_words", {"n_words": 2, "word_chars": -1}),
    Rule("long_words", {"word_chars": 1, "n_words": -15}),
    Rule("echoes", {"n_echoes": 10, "n_words": -3}),
    Rule("duplicate_lines", {"n_dup_lines": 2, "n_lines": -1}),
    Rule("shouting", {"n_upper": 2, "word_chars": -1}),
    Rule("letters", {"word_chars": 6, "n_letters": -10}),
)
#: Measures of the contract, in every row of judge().
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: str, windows: str, n: int = WINDOW) -> tuple[Column, Column]:
    """(hashes of all n-word windows, words in windows that occur twice or more): the second reads the first as column windows.

    Hashes are sorted with their places, so equal windows are neighbours; the places of those are sorted again, and each
    covers n words or as many as there are up to the next.
    """
    count = F.size(words)
    hashes = F.when(
        count >= n, F.transform(F.sequence(F.lit(1), count - (n - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, n)))
    ).otherwise(F.array().cast("array<bigint>"))
    by_hash = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.transform(F.array(by_hash), lambda s: F.sort_array(F.array_compact(F.transform(
        s, lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])))))
    covered = F.transform(pairs, lambda p: F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - i, F.lit(n)))), F.lit(0).cast("bigint"), lambda a, x: a + x))
    once = F.size(F.array_distinct(F.col(windows))) == F.size(F.col(windows))
    return hashes, F.when(once, F.lit(0).cast("bigint")).otherwise(F.element_at(covered, 1))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


#: Measures that are one expression over the text.
_PLAIN = {
    "n_words": lambda t: F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))),
    "word_chars": lambda t: F.length(F.translate(t, SEPARATORS, "")),
    "n_symbols": lambda t: F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
    "n_lines": lambda t: F.size(_lines(t)),
    "n_echoes": lambda t: F.regexp_count(t, F.lit(ECHO)),
    "n_upper": lambda t: F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")),
    "n_letters": lambda t: F.length(F.regexp_replace(t, "[^\\p{L}]+", "")),
}


def _once(measure: Column) -> Column:
    """The measure as a column that the optimizer doesn't write out again in each filter and expression above it."""
    return F.when(F.monotonically_increasing_id() < 0, F.lit(0).cast("bigint")).otherwise(measure)


class Measures:
    """A table, its text and the measures taken so far, by the name of their column."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.the_text = free_name(docs, "the_text")
        self.df = docs.withColumn(self.the_text, text_or_empty(docs, text))
        self.columns: dict[str, str] = {}

    def expression(self, name: str) -> Column:
        """A measure as a column if it has been taken, else as an expression that is evaluated where it stands."""
        return F.col(self.columns[name]) if name in self.columns else _PLAIN[name](F.col(self.the_text)).cast("bigint")

    def take(self, names: Iterable[str]) -> None:
        t = F.col(self.the_text)
        for name in names:
            if name in self.columns:
                continue
            own, a, b = (free_name(self.df, x) for x in (name, "the_parts", "the_windows"))
            if name == "n_repeat_words":
                self.df = self.df.withColumn(a, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
                hashes, repeats = repeated_words(a, b)
                self.df = self.df.withColumn(b, hashes).withColumn(own, _once(repeats)).drop(a, b)
            elif name == "n_dup_lines":
                dups = F.size(a) - F.size(F.array_distinct(a))
                self.df = self.df.withColumn(a, _lines(t)).withColumn(own, _once(dups.cast("bigint"))).drop(a)
            else:
                self.df = self.df.withColumn(own, _once(self.expression(name)))
            self.columns[name] = own

    def lacking(self, rule: Rule) -> Iterable[str]:
        """What can't stand inside an expression."""
        return [m for m in rule.weights if m not in _PLAIN]

    def fails(self, rule: Rule) -> Column:
        terms = [F.lit(w) * self.expression(m) for m, w in rule.weights.items()]
        return sum(terms[1:], terms[0]) > rule.bound


#: Nanoseconds that a measure takes for each character and each word, as measure_costs() gave them on one core.
COSTS = {
    "n_words": (43.0, 0.0),
    "word_chars": (56.6, 0.0),
    "n_symbols": (60.2, 0.0),
    "n_lines": (2.4, 0.0),
    "n_echoes": (62.0, 0.0),
    "n_upper": (20.3, 0.0),
    "n_letters": (37.6, 0.0),
    "n_dup_lines": (6.1, 0.0),
    "n_repeat_words": (0.0, 1810.0),
}


def _spread(docs: DataFrame) -> DataFrame:
    """The rows of SAMPLE_FILES of the files that docs are read from, evenly spread; docs itself if it isn't read from more."""
    files = sorted({unquote(f).rsplit("/", 1)[-1] for f in docs.inputFiles()})
    if len(files) <= SAMPLE_FILES:
        return docs
    chosen = [files[k * len(files) // SAMPLE_FILES] for k in range(SAMPLE_FILES)]
    try:
        return docs.filter(F.col("_metadata.file_name").isin(chosen))
    except AnalysisException:  # what is read has been joined or summed up since
        return docs


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, highest first. take() reads no more partitions than it needs, and only verdicts and two
    sizes of each sampled row come to the driver."""
    sampled = _spread(docs).select(docs[text].alias("text"))
    rows = _estimates(sampled.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_STEP)) == 0), rules, sample_rows) or _estimates(sampled, rules, sample_rows)
    characters, words = (sum(r[c] for r in rows) for c in ("characters", "words"))
    ranked = []
    for k, rule in enumerate(rules):
        cost = sum(characters * COSTS[m][0] + words * COSTS[m][1] for m in rule.weights) + 1
        rejected = sum(bool(r[f"r{k}"]) for r in rows)
        ranked.append((-(rejected + 1) / cost, k, rule))
    return [rule for _, _, rule in sorted(ranked, key=lambda x: x[:2])]


def _estimates(texts: DataFrame, rules: tuple[Rule, ...], most: int) -> list:
    m = Measures(texts)
    m.take(dict.fromkeys(["n_words", *(x for rule in rules for x in rule.weights)]))
    verdicts = [m.fails(rule).alias(f"r{k}") for k, rule in enumerate(rules)]
    return m.df.select(F.length(m.the_text).alias("characters"), m.expression("n_words").alias("words"), *verdicts).take(most)


def measure_costs(texts: DataFrame, repeats: int = 20, times: int = 5) -> dict[str, tuple[float, float]]:
    """COSTS anew, from a table with a column text: each measure over repeats of a kept sample, the least of several times less
    that of the same job without a measure. Sorting measures count by words, others by characters."""
    kept = texts.select("text").persist()
    size = kept.agg(F.sum(F.length("text")).alias("c"), F.sum(_PLAIN["n_words"](F.col("text"))).alias("w")).first()
    many = kept.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def least(name: str | None) -> float:
        seconds = []
        for _ in range(times):
            m = Measures(many)
            m.take([name] if name else [])
            began = time.perf_counter()
            m.df.agg(F.sum(m.expression(name) if name else F.length(m.the_text))).collect()
            seconds.append(time.perf_counter() - began)
        return min(seconds)

    try:
        empty, out = least(None), {}
        for name in [*_PLAIN, "n_dup_lines", "n_repeat_words"]:
            ns = max(0.0, least(name) - empty) * 1e9 / repeats
            out[name] = (0.0, round(ns / size["w"], 2)) if name == "n_repeat_words" else (round(ns / size["c"], 2), 0.0)
        return out
    finally:
        kept.unpersist()


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the reported measures, base_failed and kept. The measures of other rules are taken where they are needed."""
    ordered = order_rules(docs, rules, text)
    m = Measures(docs, text)
    m.take(REPORTED)
    rejects = F.lit(False)
    for rule in rules:
        if rule.base:
            rejects = rejects | m.fails(rule)
    base_failed, kept = free_name(m.df, "base_failed"), free_name(m.df, "kept")
    verdict = F.when(F.col(base_failed), F.lit(False))
    for rule in ordered:
        if not rule.base:
            m.take(m.lacking(rule))
            verdict = verdict.when(m.fails(rule), F.lit(False))
    return m.df.withColumn(base_failed, rejects).withColumn(kept, verdict.otherwise(F.lit(True))).drop(m.the_text)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    m = Measures(docs, text)
    for rule in order_rules(docs, rules, text):
        m.take(rule.weights)
        m.df = m.df.filter(~m.fails(rule))
    return m.df.select(*(F.col(f"`{c}`") for c in docs.columns))
