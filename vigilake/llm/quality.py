"""Quality rules as weak supervision: votes, EM accuracies, posterior probability.

Columns and SQL functions only. The driver sees no documents: EM runs over the
histogram of vote patterns, which has at most 3 ** len(RULES) rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import SPACE, let
from vigilake.session import cut

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
GOOD, BAD, NONE = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """A measure that votes bad above `bad`, good up to `good`, else abstains
    (the other way round if `bad` is below `good`)."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        x = F.col(self.measure)
        low = self.bad > self.good
        bad, good = (x > self.bad, x <= self.good) if low else (x < self.bad, x >= self.good)
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


#: Several views of each fault, so that EM can tell rules that agree from a stray vote.
RULES = (
    Rule("length", "n_words", good=100, bad=50),
    Rule("distinct_words", "n_distinct", good=60, bad=25),
    Rule("symbols", "symbols_per_word", good=0.02, bad=0.1),
    Rule("symbol_characters", "symbol_share", good=0.005, bad=0.02),
    Rule("symbol_ends", "symbol_ends_per_word", good=0.02, bad=0.1),
    Rule("duplicate_lines", "dup_line_share", good=0.1, bad=0.3),
    Rule("repeats", "repeat_share", good=0.15, bad=0.5),
    Rule("variety", "distinct_share", good=0.35, bad=0.15),
    Rule("capitals", "capital_share", good=0.15, bad=0.4),
    Rule("capital_pairs", "capital_pairs_per_word", good=0.2, bad=0.8),
    Rule("shouting", "shout_per_word", good=0.02, bad=0.1),
    Rule("long_words", "word_length", good=10.0, bad=16.0),
    Rule("digits", "digit_share", good=0.15, bad=0.5),
)
ROUNDS = 50
#: A rule calls at most this share of good documents bad, and at least this share of bad ones.
FALSE_ALARM, LEAST_HIT = 0.02, 0.2
#: Share of good documents.
PRIOR = (0.5, 0.95)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by 64-bit hash with their places, so equal ones are neighbours,
    and neighbours are compared word by word: n log n for any text, however repetitive.
    """

    def windows(hashes: Column) -> Column:
        three = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        # Without a repeat, which a set of hashes tells, nothing is sorted.
        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), three), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    def covered(h: Column) -> Column:
        def again(s: Column) -> Column:
            word = lambda i, j: F.get(words, i) == F.get(words, j)
            alike = lambda i, j: word(i, j) & word(i + 1, j + 1) & word(i + 2, j + 2)
            near = lambda x, k: F.coalesce((F.get(s, k)["h"] == x["h"]) & alike(F.get(s, k)["i"], x["i"]), F.lit(False))
            twice = F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1))
            first = F.transform(twice, lambda x: x["i"])
            return F.size(F.array_distinct(F.concat(first, F.transform(first, lambda i: i + 1), F.transform(first, lambda i: i + 2))))

        # sort_array compares natively, array_sort by an expression for each pair.
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    some = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) >= 3, some).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    chars = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    counted = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), _repeated(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        (F.length(text) - chars(SPACES)).cast("long").alias("word_chars"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        chars("!").alias("n_shouts"),
        chars("0123456789").alias("n_digits"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count(text, F.lit(r"\p{Lu}\p{Lu}")).alias("n_capital_pairs"),
        F.regexp_count(text, F.lit(rf"[{SYMBOLS}](?={SPACE}|$)")).alias("n_symbol_ends"),
    )
    n = F.col("n_words")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counted.select(
        "doc_id", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), F.col("w.d").alias("n_distinct"),
        "n_shouts", "n_digits", "n_capitals", "n_capital_pairs", "n_symbol_ends",
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("n_symbols"), n).alias("symbols_per_word"), share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"), share(F.col("n_capitals"), F.col("word_chars")).alias("capital_share"),
        share(F.col("word_chars"), n).alias("word_length"), share(F.col("n_shouts"), n).alias("shout_per_word"),
        share(F.col("n_digits"), F.col("word_chars")).alias("digit_share"), share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("n_symbol_ends"), n).alias("symbol_ends_per_word"), share(F.col("n_capital_pairs"), n).alias("capital_pairs_per_word"),
        share(F.col("n_distinct"), n).alias("distinct_share"), "n_distinct",
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over (votes, count): the prior of good and, for each rule and vote,
    P(vote | good) and P(vote | bad). The start says that rules are mostly right
    and that most documents are good; the bounds keep that meaning of the two
    classes. Sums run over sorted patterns, so that reruns agree; a round is a few
    array operations, however many patterns there are."""
    patterns = sorted(patterns)
    kinds = (GOOD, BAD, NONE)
    votes = np.array([v for v, _ in patterns], np.int64).reshape(len(patterns), n_rules)
    counts = np.array([c for _, c in patterns], float)
    cast = np.stack([votes == k for k in kinds], axis=2).astype(float)  # pattern, rule, kind of vote
    prior, good, bad = 0.85, np.tile([0.9, 0.01, 0.09], (n_rules, 1)), np.tile([0.4, 0.4, 0.2], (n_rules, 1))
    for _ in range(rounds):
        z = math.log(prior / (1 - prior)) + np.einsum("prk,rk->p", cast, np.log(good / bad))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        prior = min(max(float((p * counts).sum() / (counts.sum() or 1)), PRIOR[0]), PRIOR[1])
        good = 1 + np.einsum("prk,p->rk", cast, p * counts)
        bad = 1 + np.einsum("prk,p->rk", cast, (1 - p) * counts)
        alarm = np.minimum(good[:, 1] / good.sum(axis=1), FALSE_ALARM)
        hit = np.maximum(bad[:, 1] / bad.sum(axis=1), LEAST_HIT)
        good = _with_bad(good, alarm)
        bad = _with_bad(bad, hit)
    return prior, [{k: (float(good[j, i]), float(bad[j, i])) for i, k in enumerate(kinds)} for j in range(n_rules)]


def _with_bad(sums: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of votes (good, bad, none) with that of bad votes as given."""
    rest = (1 - share) / (sums[:, 0] + sums[:, 2])
    return np.stack([sums[:, 0] * rest, share, sums[:, 2] * rest], axis=1)


def posterior(votes: tuple[int, ...], prior: float, odds: list[dict[int, tuple[float, float]]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(o[v][0] / o[v][1]) for o, v in zip(odds, votes, strict=True))
    return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality (posterior probability).

    Null and empty texts have no words, fail the base rule and are not kept. An
    empty table gives an empty result; repeated rows are judged alike.
    """
    voted = cut(measures(docs).withColumn("votes", F.array(*[r.vote() for r in rules])), "votes")
    seen = voted.groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    prior, odds = fit([(tuple(r["votes"]), r["count"]) for r in seen], len(rules))
    z = F.lit(math.log(prior / (1 - prior)))
    for j, o in enumerate(odds):
        weight = {v: math.log(o[v][0] / o[v][1]) for v in o}
        vote = F.get("votes", F.lit(j))
        z = z + F.when(vote == GOOD, weight[GOOD]).when(vote == BAD, weight[BAD]).otherwise(weight[NONE])
    quality = 1 / (1 + F.exp(-z))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"))
