"""Quality rules: learned decision lists, as ordered Spark conditions.

The statistics of a text are built-in SQL expressions. A decision list is learned from labelled rows by
sequential covering: a rule starts empty and grows by the threshold (statistic at least or at most a value)
that gains most on one part of the rows, is pruned by dropping its last thresholds while that helps on the
other part, and is kept if it is precise there, and that is not likely by chance; the rows it covers are then set
aside and the next rule is grown, until no bad row is left to grow from. Rules name bad texts; the default is to
keep. The list becomes one ``CASE`` expression, in order.

Learning uses the ``SAMPLE`` labelled rows with the smallest hash of their doc_id (a documented bound: at
most that many rows of a dozen numbers reach the driver). Everything else covers all rows and whole texts.

Defined results: a null text has no words; a null doc_id is an id like any other and has no label; repeated
rows each get a row; an empty table gives no rows; without labels of both kinds the list is empty and the
base rule alone decides. Columns of ``docs`` other than doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE, SPACE_CLASS, hashed_sample

SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"  # fixed value
MARKS = r"!?=+@/\\^~_{}\[\]"
WORD_CLASS = SPACE_CLASS.replace("[", "[^")

#: Statistics that rules may test: shares and means, so that a rule holds for texts of any length.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_word_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _without_space(text: Column) -> Column:
    """``text`` without white space; replacing a plain string is far cheaper than a regular expression."""
    for character in SPACE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def _count(characters: str) -> Column:
    """How many characters of the text are in a class."""
    return F.regexp_count("text", F.lit(f"[{characters}]")).cast("long")


def with_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and the statistics of every whole text; with ``carry`` also the whole row, as ``__row``.

    Repeated windows are found by sorting (hash of three words, position): equal neighbours repeat, and the
    words in repeated windows are counted from the distances between their positions in order. No window is
    compared with all others, however long or repetitive the text is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")] if carry else []
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *row)
    carried = ["doc_id"] + ["__row"] * carry
    split = base.select(
        *carried,
        "text",
        F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(WORD_CLASS))).alias("lines"),
    )
    hashed = split.select(
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(_without_space(F.col("text"))).cast("long").alias("word_chars"),
        _count(SYMBOLS).alias("n_symbols"),
        _count(MARKS).alias("n_marks"),
        _count("A-Z").alias("n_upper"),
        F.size("lines").cast("long").alias("n_word_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    hashes = F.col("hashes")
    rest = [c for c in hashed.columns if c != "hashes"]
    windows = hashed.select(
        *rest,
        F.when(
            F.size(hashes) >= 3,
            F.transform(
                F.slice(hashes, 1, F.size(hashes) - 2),
                lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
            ),
        ).alias("windows"),
    )
    sorted_windows = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Most texts repeat no window; counting distinct ones is much cheaper than sorting.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = windows.select(*rest, F.when(repeats, sorted_windows).alias("ranked"))
    ranks = F.col("ranked")
    repeated = ranked.select(
        *rest,
        F.sort_array(
            F.transform(
                F.filter(
                    ranks, lambda w, i: (w["h"] == F.get(ranks, i + 1)["h"]) | (w["h"] == F.get(ranks, i - 1)["h"])
                ),
                lambda w: w["i"],
            )
        ).alias("places"),
    )
    places = F.col("places")
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    counted = repeated.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # A filter on these columns must not be pushed below: there it would hold the expressions themselves, one
    # inside the other, and evaluate them anew for every element. Predicates do not pass a generator.
    return counted.select(F.inline(F.array(F.struct(*counted.columns))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """A threshold on one statistic."""

    feature: str
    at_least: bool
    value: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x >= self.value if self.at_least else x <= self.value

    def condition(self) -> Column:
        x = F.col(self.feature)
        return x >= F.lit(self.value) if self.at_least else x <= F.lit(self.value)


Rule = tuple[Test, ...]


def covers(rule: Rule, columns: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(columns.values()))), bool)
    for test in rule:
        held &= test.holds(columns)
    return held


def _best_test(columns: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> Test | None:
    """The threshold with the largest information gain among the rows the rule still covers."""
    positives, total = bad[held].sum(), held.sum()
    if not positives or positives == total:
        return None
    before, best, found = np.log2(positives / total), 1e-9, None
    for feature, column in columns.items():
        x, y = column[held], bad[held]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cut = np.flatnonzero(x[1:] > x[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(y)[cut - 1]
        for at_least, p, n in ((True, positives - below, total - cut), (False, below, cut)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                middle = float((x[cut[i] - 1] + x[cut[i]]) / 2)
                best, found = gain[i], Test(feature, at_least, middle)
    return found


def _by_chance(hits: int, total: int, share: float) -> float:
    """A bound (Chernoff's) on the chance that so many of ``total`` rows are bad if each is with probability ``share``."""
    p = hits / total if total else 0.0
    if p <= share:
        return 1.0
    apart = p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return float(np.exp(-total * apart))


def learn(
    columns: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.97,
    support: int = 5,
    chance: float = 0.01,
    seed: int = 7,
) -> list[Rule]:
    """Sequential covering with grown and pruned rules; deterministic for the same rows in the same order.

    A grown rule that is not kept has its growing rows set aside, and the next is grown from the others, until no bad
    row is left to grow from; neither rules nor thresholds are limited in number. The more rules were tried, the less
    likely by chance a rule's success on the other part has to be, so trying many does not let noise in.
    """
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, fresh, rules, tried = np.ones(len(bad), bool), grow.copy(), [], 0
    while True:
        rule: Rule = ()
        while (test := _best_test(columns, bad, covers(rule, columns) & fresh)) is not None:
            rule += (test,)
        if not rule:
            return rules

        def worth(candidate: Rule) -> float:
            held = covers(candidate, columns) & left & ~grow
            p = bad[held].sum()
            return (p + 1) / (held.sum() + 2) if candidate else 0.0

        grown = covers(rule, columns)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        held = covers(rule, columns) & left
        other = held & ~grow
        tried += 1
        share = bad[left & ~grow].mean() if (left & ~grow).any() else 1.0
        likely = _by_chance(int(bad[other].sum()), int(other.sum()), share) * tried * (tried + 1) > chance
        if likely or bad[held].sum() < support or bad[other].mean() < precision or bad[held].mean() < precision:
            fresh &= ~grown
            continue
        rules.append(rule)
        left &= ~held
        fresh &= ~held


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from at most ``sample`` labelled rows; ``labels`` has doc_id and quality (0 is bad)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    by_doc = known.groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.min("quality").alias("quality"))
    chosen = hashed_sample(by_doc, "l_doc", sample, by_doc.count())
    of_label = F.col("doc_id") == F.col("l_doc")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), of_label, "left_semi")
    held = with_statistics(texts).join(F.broadcast(chosen), of_label).where(~base_failed())
    shares = [F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()]
    rows = held.select("doc_id", "quality", *shares).distinct().orderBy("doc_id", *FEATURES).limit(sample).collect()
    if not rows:
        return []
    bad = np.array([row["quality"] == 0 for row in rows])
    if bad.all() or not bad.any():
        return []
    return learn({name: np.array([row[name] for row in rows]) for name in FEATURES}, bad)


def verdict(rules: list[Rule]) -> Column:
    """True where the list keeps a text: the first rule that holds rejects it."""
    keep: Column | None = None
    for rule in rules:
        condition = rule[0].condition()
        for test in rule[1:]:
            condition = condition & test.condition()
        keep = F.when(condition, False) if keep is None else keep.when(condition, False)
    return F.lit(True) if keep is None else keep.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, its statistics, base_failed and kept (and the row itself)."""
    rules = learn_rules(docs, labels, sample)
    shares = [F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()]
    scored = with_statistics(docs, carry).select("*", base_failed().alias("base_failed"), *shares)
    return scored.select("*", (~F.col("base_failed") & verdict(rules)).alias("kept")).drop(*FEATURES)


def kept_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. No join and no shuffle of texts."""
    return judged(docs, labels, sample, carry=True).where("kept").select("__row.*")
