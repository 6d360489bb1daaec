"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes. Three transducers are composed into
one machine: reported speech, negation and target each rewrite the insults and
threats that they reach, so that an arc of the composition puts out a match such as
"insult at a target" or "negated threat" and carries its weight. The weight of a
clause is the sum over the arcs of its path, and a document scores by the weights of
its clauses, each further pass of arcs that put out the same match weighing less;
words alone never score.

Learned from labels (on at most about `max_fit` labelled documents, the documented
bound of the fit): which words are insults, and the weights of the arcs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import fold, per_document, sized_broadcast
from vigilake.session import cut, ship

MAX_FIT = 20_000
#: Evidence (G-test) that a word or stem needs to count as an insult, and how much
#: more often it must stand in toxic texts than in others, in LEAST of them or more.
EVIDENCE, LIFT, LEAST = 20.0, 20, 3
#: Lengths of the word beginnings that are tried as stems (written `stem*`).
STEMS = range(4, 9)

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n\"“”«»]+")

#: Closed word classes in the languages of the corpus.
TARGETS = frozenset("you your you're youre u they them their he she him her his these those everyone people du dich dir dein ihr euch sie tu toi te vous votre ton ils elles usted ustedes tú ti ellos ellas vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't ain't neither nor hardly nicht kein keine keiner niemals nie pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say wrote writes quoted quotes claimed claims reported alleged called sagte sagt schrieb behauptet dit disait écrit prétend dijo dice escribió afirma".split())
THREATS = frozenset("kill hurt destroy shoot stab burn beat strangle murder töten verletzen zerstören tuer frapper détruire matar golpear destruir".split())
INSULTS = frozenset("idiot moron scum stupid worthless pathetic".split())

REACH = 4  # words
KINDS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
#: Weights and intercept before any label is seen; also what the fit leans to.
PRIOR = (3.0, 4.0, 0.5, 1.0, 1.0, 4.0, 0.2, 0.5)
INTERCEPT = -3.0


@dataclass(frozen=True)
class Transducer:
    """Deterministic: `arcs[state, symbol]` is (next state, output, weight); other
    symbols follow `default[state]`, come out as they are and weigh nothing."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    default: dict[int, int]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.default[state], symbol, 0.0)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """The output and the weight of each arc of the path."""
        state, out = 0, []
        for s in symbols:
            state, *arc = self.step(state, s)
            out.append(tuple(arc))
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: what comes out of this goes into `other`; weights add up.
        States are pairs, those that can be reached, in the order they are found."""
        symbols = sorted({s for _, s in self.arcs} | {s for _, s in other.arcs})
        known, arcs, default, queue = {(0, 0): 0}, {}, {}, [(0, 0)]

        def number(pair: tuple[int, int]) -> int:
            if pair not in known:
                known[pair] = len(known)
                queue.append(pair)
            return known[pair]

        for p, q in queue:  # grows as pairs are found
            here = known[p, q]
            default[here] = number((self.default[p], other.default[q]))
            for s in symbols:
                p2, o, w = self.step(p, s)
                q2, o2, w2 = other.step(q, o)
                arcs[here, s] = (number((p2, q2)), o2, w + w2)
        return Transducer(arcs, default)

    def weighted(self, weights: dict[str, float]) -> Transducer:
        """The same machine, each arc with the weight of the match it puts out."""
        return Transducer({k: (n, o, weights.get(o, 0.0)) for k, (n, o, _) in self.arcs.items()}, self.default)


def within(trigger: str, mark: str, reach: int | None, over: tuple[str, ...]) -> Transducer:
    """Marks symbols of `over` that follow `trigger` within `reach` symbols, or
    anywhere after it in the clause."""
    steps = range(1, (reach or 1) + 1)
    after = lambda n: 0 if reach and n == reach else (n + 1 if reach else n)
    arcs = {(n, trigger): (1, trigger, 0.0) for n in (0, *steps)}
    arcs |= {(n, s): (after(n), f"{s}_{mark}", 0.0) for n in steps for s in over}
    return Transducer(arcs, {0: 0} | {n: after(n) for n in steps})


HOT = ("insult", "threat")
REPORTED = within("REPORT", "reported", None, HOT)
NEGATED = within("NEGATION", "negated", REACH, HOT)
TARGETED = within("TARGET", "target", REACH, HOT)
#: Forwards; a target may also follow, which the last machine finds backwards.
CONTEXT = REPORTED.then(NEGATED).then(TARGETED)
#: So that an arc can weigh for its match, also where no target comes near it.
PASSING = Transducer({(0, k): (0, k, 0.0) for k in KINDS}, {0: 0})
BACKWARDS = TARGETED.then(PASSING)


class Classes:
    """Word classes by a lexicon of insults (words and `stem*`), with a bounded memo."""

    def __init__(self, insults: frozenset[str], most: int = 200_000):
        fixed = {w: "TARGET" for w in TARGETS} | {w: "NEGATION" for w in NEGATIONS} | {w: "REPORT" for w in REPORTS}
        self.insults, self.most = insults, most
        self.fixed = fixed | {w: "threat" for w in THREATS} | {w: "insult" for w in insults}
        self.memo = dict(self.fixed)

    def of(self, word: str) -> str:
        found = self.memo.get(word)
        if found is None:
            found = "insult" if any(word[:n] + "*" in self.insults for n in STEMS if n < len(word)) else "-"
            if len(self.memo) >= self.most:
                self.memo = dict(self.fixed)
            self.memo[word] = found
        return found


def passes(text: str | None, classes: Classes, last: Transducer = BACKWARDS) -> Counter[tuple[str, float]]:
    """How often the paths of the whole text's clauses pass arcs of each (match, weight)."""
    found: Counter[tuple[str, float]] = Counter()
    lowered = (text or "").lower()
    hot = {w for w in set(WORD.findall(lowered)) if classes.of(w) in HOT}
    for clause in CLAUSE.split(lowered) if hot else ():
        words = WORD.findall(clause)
        if not hot.isdisjoint(words):
            marked = [o for o, _ in CONTEXT.run([classes.of(w) for w in words])]
            found.update(arc for arc in last.run(marked[::-1]) if arc[0] in KINDS)
    return found


def matches(text: str | None, classes: Classes) -> np.ndarray:
    """How often each of KINDS is matched in the whole text."""
    found = Counter()
    for (kind, _), n in passes(text, classes).items():
        found[kind] += n
    return np.array([found[k] for k in KINDS], float)


@dataclass(frozen=True)
class Grammar:
    """A lexicon, the last machine with weights on its arcs, and the weight of a text
    without any match."""

    insults: frozenset[str]
    last: Transducer
    intercept: float

    @classmethod
    def of(cls, insults: frozenset[str], weights: np.ndarray) -> Grammar:
        return cls(insults, BACKWARDS.weighted(dict(zip(KINDS, weights[1:].tolist(), strict=True))), float(weights[0]))

    def weight(self, text: str | None, classes: Classes) -> float:
        """The arcs of all paths, n passes of one kind of arc counting log(1 + n) fold."""
        found = passes(text, classes, self.last)
        return self.intercept + sum(w * math.log1p(n) for (_, w), n in sorted(found.items()))

    def scores(self, texts: Iterable[str | None], classes: Classes) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array([self.weight(t, classes) for t in texts], float), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, max_fit: int) -> DataFrame:
    """Distinct training texts with their label, about `max_fit` of them, the same
    ones each time."""
    marks = labels.where((fold("doc_id") != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = max(marks.count(), 1)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.where(order < max_fit / rows)
    joined = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(sized_broadcast(picked, 2 * max_fit), "doc_id")
    return cut(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def evidence(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """G-test of a form's texts against the label, 0 unless it leans to toxic."""
    n, rate = toxic + clean, all_toxic / max(all_toxic + all_clean, 1)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return F.when(toxic > n * rate, 2 * (part(toxic, n * rate) + part(clean, n * (1 - rate)))).otherwise(0.0)


def learn_insults(rows: DataFrame) -> frozenset[str]:
    """Words and stems that set toxic texts apart.

    Candidates come from counts of texts; what is then weighed is the number of
    different neighbours (word before, word after) that a candidate has in toxic
    texts, so that words of one text that was copied often do not pass for insults.
    Every candidate is weighed; only those with EVIDENCE come to the driver.
    """
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    all_toxic, all_clean = int(totals["t"] or 0), int(totals["n"] - (totals["t"] or 0))
    if not all_toxic:
        return INSULTS
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    split = rows.select("toxic", words.alias("words"))
    held = F.array_distinct(F.flatten(F.array("words", *[_stems(F.col("words"), n) for n in STEMS])))
    toxic, clean = F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    counts = split.select(F.explode(held).alias("w"), "toxic").groupBy("w").agg(toxic, clean)
    leaning = counts.where((F.col("t") >= LEAST) & (F.col("t") * (all_clean + 1) > LIFT * F.col("c") * all_toxic))
    leaning = cut(leaning.select("w", "c"), "leaning")
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    near = F.transform("words", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, word(i - 1)).alias("before"), word(i + 1).alias("after")))
    places = split.where("toxic = 1").select(F.explode(near).alias("x")).select("x.*").distinct()
    one = F.array("w")
    forms = places.select(F.explode(F.flatten(F.array(one, *[_stems(one, n) for n in STEMS]))).alias("w"), "before", "after")
    seen = forms.join(sized_broadcast(leaning), "w").distinct().groupBy("w", "c").agg(F.count("*").alias("n"))
    found = seen.where(evidence(F.col("n"), F.col("c"), all_toxic, all_clean) >= EVIDENCE)
    return INSULTS | {r["w"] for r in found.select("w").collect()}


def _stems(words: Column, n: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def features_of(docs: DataFrame, insults: frozenset[str]) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(insults)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "f": [matches(t, classes).tolist() for t in batch["text"]]})

    return docs.select("text", "toxic").mapInPandas(read, "toxic int, f array<double>")


def learn_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, leaning to the prior weights."""
    prior = np.array([INTERCEPT, *PRIOR])
    a, w = np.hstack([np.ones((len(x), 1)), np.log1p(x)]), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w)), a.T @ (y - p) - strength * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Grammar:
    """Learn from labelled rows outside fold 0; without any, the built-in lexicon and
    weights hold. Null texts and null labels are not learned from; equal texts count
    once, as toxic if any of their labels says so; texts count whole, however long."""
    ship(docs.sparkSession)
    rows = labelled(docs, labels, max_fit)
    insults = learn_insults(rows)
    seen = sorted((r["toxic"], r["f"]) for r in features_of(rows, insults).collect())  # sums of floats in one order
    if not seen:
        return Grammar.of(insults, np.array([INTERCEPT, *PRIOR]))
    return Grammar.of(insults, learn_weights(np.array([f for _, f in seen]), np.array([t for t, _ in seen], float)))


def judge(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learns from labelled rows outside fold 0 only. Null and empty texts match
    nothing and get the base score; null labels are not learned from, and a
    document labelled twice counts as toxic if any label says so; without labels
    the built-in weights hold. Repeated rows are scored alike.
    """
    return predict(docs, fit(docs, labels, max_fit))


def predict(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts get the base score; repeated rows are scored alike; an empty
    table gives an empty result. A score of exactly 0.5 counts as toxic."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(grammar.insults)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": grammar.scores(batch["text"], classes)})

    scored = per_document(docs.select("doc_id", "text"), read, "score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
