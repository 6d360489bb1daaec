"""Language ID: nearest of several clustered centroids per language.

Texts become TF-IDF vectors of hashed byte n-grams. Document frequencies cover
every training document; k-means within each language sees at most `per_language`
training documents (the documented bound of the fit). The model holds CENTROIDS
vectors a language (128 KB); languages are a closed set of at most a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import fold, per_document, sized_broadcast
from vigilake.session import cut, ship

BUCKETS = 4096
PER_LANGUAGE = 500
CENTROIDS = 4
#: A text is rejected where its distance to the nearest centroid exceeds this
#: many times the largest distance seen in that centroid's cluster.
SLACK = 1.25
#: A cluster of one text has radius 0; that text's own distance is 0 but for rounding.
ROUNDING = 1e-9
#: ASCII letters and every non-ASCII byte stay; the rest is a gap.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of byte 2- and 3-grams of the lower-cased text by hash bucket; runs
    of gaps count once. Whole text, in one pass of array operations."""
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep].astype(np.int64)
    two = (b[:-1] * 31 + b[1:] * 1_009) * 2 + 1
    three = (b[:-2] * 7_919 + b[1:-1] * 104_729 + b[2:] * 1_299_709) * 2
    return np.bincount(np.concatenate([two, three]) * 2_654_435_761 % (2**32) * buckets >> 32, minlength=buckets)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.linalg.norm(v) or 1.0)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of texts and, for each bucket, those that have it; every partition
    sends one array."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                df += ngram_counts(text, buckets) > 0
                n += 1
        yield pd.DataFrame({"bucket": np.append(np.arange(buckets), -1), "n": np.append(df, n)})

    ship(docs.sparkSession)
    sums = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in sums.collect()}  # buckets + 1 rows
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(buckets)], np.float64)


def sample(train: DataFrame, per_language: int) -> DataFrame:
    """At most `per_language` training documents of each language, the same ones
    each time: a hash threshold thins the large languages before ranking."""
    order = F.xxhash64("doc_id", "text")
    unit = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    sizes = sized_broadcast(cut(train.groupBy("lang").agg(F.count("*").alias("n_lang")), "sizes"))  # a row per language
    thin = train.join(sizes, "lang").where(unit < 2.0 * per_language / F.col("n_lang"))
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    return ranked.where(F.col("rank") <= per_language).select("lang", "doc_id", "text")


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and, for each, the
    largest cosine distance in its cluster."""
    centers = [vectors.mean(axis=0)]
    while len(centers) < min(k, len(vectors)):
        centers.append(vectors[int(np.argmin(np.max(vectors @ np.array(centers).T, axis=1)))])
    c = np.array(centers)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(vectors @ c.T, axis=1)
        c = np.array([vectors[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    sims = vectors @ c.T
    near = np.argmax(sims, axis=1)
    radius = np.array([1 - sims[near == i, i].min() if (near == i).any() else 0.0 for i in range(len(c))])
    return c, radius


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, buckets: int = BUCKETS):
    """(idf, languages, centroids, radii) from (doc_id, text, lang) rows.

    The caller leaves null texts and languages out; repeated rows count each; texts
    without an n-gram add nothing; no rows give no languages."""
    n, df = document_frequencies(train, buckets)
    idf = np.log((1 + n) / (1 + df)) + 1

    def of_language(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])  # the sum of floats must not depend on arrival
        c, radius = cluster(np.array([vector(ngram_counts(t, buckets), idf) for t in rows["text"]]), k)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": c.astype(np.float64).tolist(), "radius": radius})

    rows = sample(train, per_language).groupBy("lang").applyInPandas(of_language, "lang string, centroid array<double>, radius double").collect()
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    return idf, [r["lang"] for r in rows], np.array([r["centroid"] for r in rows]).reshape(len(rows), buckets), np.array([r["radius"] for r in rows])


def predict(docs: DataFrame, model, buckets: int = BUCKETS, slack: float = SLACK) -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected.

    `und` with score 0 where the text is null or has no letter, or where there is
    no centroid. `rejected` marks texts farther from every centroid than `slack`
    allows; their nearest language is given all the same. Of centroids equally near the
    first by language counts; repeated rows are predicted alike; an empty table gives an
    empty result.
    """
    idf, languages, centroids, radii = model

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text, letters in zip(batch["text"], batch["letters"], strict=True):
                if not letters or not languages:
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                sims = centroids @ vector(ngram_counts(text, buckets), idf)
                i = int(np.argmax(sims))
                langs.append(languages[i]), scores.append(float(min(max(sims[i], 0.0), 1.0)))
                rejected.append(bool(1 - sims[i] > slack * radii[i] + ROUNDING))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores, "rejected": rejected})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return per_document(docs.select("doc_id", "text", letters), nearest, "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the rows outside fold 0 and predict every row: doc_id, held_out,
    lang_pred, score, rejected.

    Rows with null text or lang are not learned from; a null id counts as the
    empty text when folds are dealt (fold 0). With nothing to learn from, every
    row is `und`. An empty table gives an empty result; repeated rows are
    predicted alike.
    """
    known = docs.where((fold("doc_id") != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = fit(known.select("doc_id", "text", "lang"), per_language)
    return predict(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")
