"""License scans: a positional index of rare licence words.

The index has a row per posting (word, template, position). A file is looked up by
the licence words it holds: a template's mandatory phrases must stand whole, so the
rarest word of theirs opens the template. For each template opened, the file's own
highest-IDF words of it are taken, their postings intersected by relative position
(with a tolerance, so inserted or lost words do not hide a notice), and the places
found are verified: every mandatory phrase, and enough words near their places.

Columns and SQL functions only. The one shuffle is of ids; texts never move. The
plan does not grow with the templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import let, sized_broadcast
from vigilake.llm.license_texts import BASE, NOTICES, SPDX
from vigilake.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII other than digits and letters (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Highest-IDF words of a file that are intersected for a template, how many of them
#: must agree, and the share of a template's words that must stand near their places.
LOOKUPS, AGREE = 3, 2
MATCH = 0.6
#: Places may differ by a quarter of the template's length, within these bounds.
TOLERANCE = (2, 12)


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and phrases that must stand in it."""

    label: str
    text: str
    key_phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.text.lower()) if w]

    @property
    def key_words(self) -> set[str]:
        return {w for p in self.key_phrases for w in p.split()}

    @property
    def tolerance(self) -> int:
        return min(max(len(self.words) // 4, TOLERANCE[0]), TOLERANCE[1])


def identifier(name: str, label: str) -> Template:
    text = f"SPDX-License-Identifier: {name}"
    return Template(label, text, (" ".join(w for w in re.split(GAP, text.lower()) if w),))


TEMPLATES = tuple(Template(*n) for n in NOTICES) + tuple(identifier(k, v) for k, v in SPDX.items())


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def listed(words: list[str]) -> Column:
    """An array as one literal, however long."""
    return F.split(F.lit(" ".join(words)), " ")


def _places(words: Column, word: Column) -> Column:
    """Positions of a word."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def _phrase_places(words: Column, phrase: list[str]) -> Column:
    """Positions at which the phrase's words stand one after another."""

    def here(w: Column, i: Column) -> Column:
        hit = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def vocabulary_of(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def row_key() -> Column:
    """128 bits of a text; with the id, rows alike in it are scanned alike."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def base_columns(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, key, n, places, held): the words, the places of each base phrase and
    the licence words of every text."""
    ends = sorted({p.split()[-1] for p, _ in BASE})

    def read(words: Column) -> Column:
        phrases = F.array(*[_phrase_places(words, p.split()) for p, _ in BASE])
        nowhere = F.array(*[F.array().cast("array<int>")] * len(BASE))
        places = F.when(F.arrays_overlap(words, listed(ends)), phrases).otherwise(nowhere)
        return F.struct(F.size(words).alias("n"), places.alias("places"), F.array_intersect(words, listed(vocabulary)).alias("held"))

    return docs.select("doc_id", row_key().alias("key"), let(words_of(F.col("text")), read).alias("f")).select("doc_id", "key", "f.*")


def rarity_of(held: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each licence word, over all documents (a row per word of
    the templates at most)."""
    each = held.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = {r["w"]: r["n"] for r in each.collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def index(spark: SparkSession, templates: tuple[Template, ...], rarity: dict[str, int]) -> DataFrame:
    """A row per template under the word that opens it: (opener, label, listed, rare,
    phrases, tolerance), with its words in order and by IDF."""
    by_idf = lambda words: sorted(words, key=lambda w: (rarity[w], w))
    rows = [(by_idf(t.key_words)[0], t.label, t.words, by_idf(set(t.words)), list(t.key_phrases), t.tolerance) for t in templates]
    kinds = "opener string, label string, listed array<string>, rare array<string>, phrases array<string>, tolerance int"
    return spark.createDataFrame(rows, kinds)


def intersected(words: Column, template: Column, rare: Column, tolerance: Column) -> Column:
    """Windows, numbered by their first position over the tolerance, in which the
    template may start: those where AGREE of the file's LOOKUPS rarest words (all,
    if it holds fewer) have postings. Each start falls in two windows, so that any
    two that differ by the tolerance share one. Sorted, not compared pair by pair."""

    def windows(found: Column) -> Column:
        def starts(word: Column, n: Column) -> Column:
            def of_place(i: Column) -> Column:
                at = lambda k: F.floor((i - k) / tolerance).cast("int")
                both = lambda k: F.array(F.struct(at(k).alias("w"), n.alias("n")), F.struct((at(k) - 1).alias("w"), n.alias("n")))
                return F.flatten(F.transform(_places(template, word), both))

            return F.flatten(F.transform(_places(words, word), of_place))

        def agreeing(s: Column) -> Column:
            several = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + AGREE - 1)["w"] == x["w"], F.lit(False)))
            return F.array_distinct(F.transform(F.when(F.size(found) >= AGREE, several).otherwise(s), lambda x: x["w"]))

        return let(F.sort_array(F.array_distinct(F.flatten(F.transform(found, starts)))), agreeing)

    return let(F.slice(F.array_intersect(rare, words), 1, LOOKUPS), windows)


def verified(words: Column, window: Column, template: Column, phrases: Column, tolerance: Column) -> Column:
    """Share of the template's words that stand near their places, 0 below MATCH or
    where a mandatory phrase does not stand near by."""
    first = window * tolerance - tolerance
    span = 4 * tolerance + 1

    def part(at: Column, n: Column) -> Column:
        lo = F.greatest(at, F.lit(0))
        return F.slice(words, lo + 1, F.greatest(n - (lo - at), F.lit(0)))

    near = F.concat(F.lit(" "), F.array_join(part(first, F.size(template) + span), " "), F.lit(" "))
    whole = F.forall(phrases, lambda p: F.contains(near, F.concat(F.lit(" "), p, F.lit(" "))))
    hits = F.filter(template, lambda w, k: F.array_contains(part(first + k, span), w))
    share = F.size(hits) / F.size(template).cast("double")
    return F.when(whole, let(share, lambda s: F.when(s >= MATCH, s).otherwise(0.0))).otherwise(0.0)


def matches(docs: DataFrame, templates: tuple[Template, ...], rarity: dict[str, int]) -> DataFrame:
    """(doc_id, key, found, best): the labels of the templates that texts hold and
    the best share."""
    postings = index(docs.sparkSession, templates, rarity)
    openers = sorted({r["opener"] for r in postings.select("opener").collect()})  # from the templates
    rows = docs.select("doc_id", row_key().alias("key"), words_of(F.col("text")).alias("words"))
    opened = rows.withColumn("opener", F.explode(F.array_intersect("words", listed(openers))))
    each = opened.join(sized_broadcast(postings), "opener")
    windows = intersected(F.col("words"), F.col("listed"), F.col("rare"), F.col("tolerance"))
    check = lambda w: verified(F.col("words"), w, F.col("listed"), F.col("phrases"), F.col("tolerance"))
    scored = each.select("doc_id", "key", "label", F.array_max(F.transform(windows, check)).alias("share")).where("share > 0")
    return scored.groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    `labels` holds the base labels and those of templates found; score is the best
    share of a template's words near their places, 1 where a base phrase stands.
    Null and empty texts have no words, no places, empty labels and score 0. Words of
    equal IDF rank by the word, so ties are decided alike in every run; repeated rows
    are scanned alike; an empty table gives an empty result.
    """
    vocabulary = vocabulary_of(templates)
    base = cut(base_columns(docs, vocabulary), "base")
    found = cut(matches(docs, templates, rarity_of(base, vocabulary)), "matches").withColumnRenamed("doc_id", "id").withColumnRenamed("key", "text_key")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key"))
    row = base.join(sized_broadcast(found), same, "left")
    own = F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(k))) > 0, label) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    more = F.coalesce("found", F.array().cast("array<string>"))
    spots = F.flatten("places")
    return row.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"), F.array_max(spots).cast("long").alias("last_word"),
        text(own).alias("base_labels"), text(F.concat(own, more)).alias("labels"),
        F.when(F.size(spots) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same in SQL: postings and places as joined rows."""
    rows = [f"({t}, {k}, '{w}', {w in x.key_words})" for t, x in enumerate(templates) for k, w in enumerate(x.words)]
    heads = [f"({t}, '{x.label}', {len(x.words)}, {x.tolerance})" for t, x in enumerate(templates)]
    phrases = [f"({t}, ' {p} ')" for t, x in enumerate(templates) for p in x.key_phrases]
    base = ", ".join(f"('{label}', {k}, '{w}', {len(p.split())})" for p, label in BASE for k, w in enumerate(p.split()))
    return rf"""
WITH template(t, k, w, is_key) AS (VALUES {", ".join(rows)}),
head(t, label, size, tol) AS (VALUES {", ".join(heads)}),
phrase(t, p) AS (VALUES {", ".join(phrases)}),
base(label, k, w, size) AS (VALUES {base}),
docs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
vocabulary AS (SELECT DISTINCT w FROM template UNION SELECT w FROM base),
places AS (SELECT r, u.w, u.i FROM (SELECT r, unnest(list_transform(words, lambda x, i: {{'w': x, 'i': i - 1}})) AS u FROM docs) WHERE u.w IN (SELECT
  w FROM vocabulary)),
held AS (SELECT DISTINCT r, w FROM places),
rarity AS (SELECT w, count(*) AS n FROM held GROUP BY w),
ranked AS (SELECT DISTINCT t, template.w, is_key, coalesce(n, 0) AS n FROM template LEFT JOIN rarity USING (w)),
openers AS (SELECT t, arg_min(w, (n, w)) AS w FROM ranked WHERE is_key GROUP BY t),
opened AS (SELECT h.r, o.t FROM held h JOIN openers o USING (w)),
looked AS (
  SELECT *, count(*) OVER (PARTITION BY r, t) AS many FROM (
    SELECT o.r, o.t, x.w, row_number() OVER (PARTITION BY o.r, o.t ORDER BY x.n, x.w) AS place
    FROM opened o JOIN ranked x ON x.t = o.t JOIN held h ON h.r = o.r AND h.w = x.w) WHERE place <= {LOOKUPS}),
starts AS (
  SELECT l.r, l.t, l.w, l.many, CAST(floor((p.i - m.k) / CAST(head.tol AS DOUBLE)) AS BIGINT) AS b
  FROM looked l JOIN head ON head.t = l.t JOIN template m ON m.t = l.t AND m.w = l.w JOIN places p ON p.r = l.r AND p.w = l.w),
windows AS (
  SELECT r, t, b FROM (SELECT * FROM starts UNION ALL SELECT r, t, w, many, b - 1 FROM starts)
  GROUP BY r, t, b HAVING count(DISTINCT w) >= least({AGREE}, any_value(many))),
whole AS (
  SELECT x.r, x.t, x.b, x.b * head.tol - head.tol AS lo, head.size, head.tol, head.label FROM windows x JOIN head USING (t) JOIN docs d USING (r)
  WHERE NOT EXISTS (SELECT 1 FROM phrase f WHERE f.t = x.t AND NOT contains(
    ' ' || array_to_string(d.words[greatest(x.b * head.tol - head.tol, 0) + 1 : x.b * head.tol - head.tol + head.size + 4 * head.tol + 1], ' ') ||
      ' ', f.p))),
scored AS (
  SELECT c.r, c.t, c.label, c.b, count(DISTINCT m.k) / CAST(any_value(c.size) AS DOUBLE) AS share
  FROM whole c JOIN template m ON m.t = c.t JOIN places p ON p.r = c.r AND p.w = m.w AND p.i BETWEEN c.lo + m.k AND c.lo + m.k + 4 * c.tol GROUP BY
    ALL),
found AS (SELECT r, label, max(share) AS share FROM scored WHERE share >= {MATCH} GROUP BY r, label),
spots AS (SELECT p.r, b.label, p.i - b.k AS start FROM places p JOIN base b USING (w) GROUP BY ALL HAVING count(*) = any_value(b.size)),
more AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT r, label, share FROM found UNION ALL
  SELECT r, label, 1.0 FROM spots) GROUP BY r),
own AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
  spots GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(o.n, 0) AS n_base, o.first_word, o.last_word, coalesce(o.labels, '') AS
  base_labels, coalesce(m.labels, '') AS labels, CAST(coalesce(m.share, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN own o USING (r) LEFT JOIN more m USING (r)
"""
