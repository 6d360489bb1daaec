"""From documents to token ids: quality, toxicity, near-duplicates, mix, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import bpe, mixing, near_dup, quality, toxicity
from vigilake.llm.common import sized_broadcast
from vigilake.session import cut, release, scratch_mark, scratch_path, table

def _key(docs: DataFrame) -> Column:
    """128 bits of a row's id and text; rows alike in both are decided alike."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(docs["doc_id"].cast("string"), F.lit("\x1e")), docs["text"]).cast("binary"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), docs["text"])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` less the rows whose key is rejected; the keys are broadcast only when
    they are counted and few. No column is added, so none can clash."""
    gone = sized_broadcast(cut(rejected.select(F.col("doc_id").alias("rejected_key")).distinct(), "rejected"), 200_000)
    return docs.join(gone, _key(docs) == gone["rejected_key"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not keep go.

    Null and empty texts fail the base rule and go; a null id is an id like others;
    repeated rows go or stay together; an empty table stays empty."""
    return _without(docs, quality.judge(_keyed(docs)).where(~F.col("kept")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the grammar is fitted on labelled ones.

    Null and empty texts score as texts without a match and stay; a score of exactly
    one half goes; repeated rows go or stay together; an empty table stays empty, and
    without labels the built-in weights decide."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.predict(_keyed(docs), model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Texts without words and rows with a null id stay; rows repeated with id and text
    stay once; of an id with several texts each is decided by its text; an empty table
    stays empty."""
    return near_dup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    A null source is a source of its own; null and empty texts weigh nothing; rows of
    one id are taken alike; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document taken.

    Null texts are empty texts: no ids; repeated rows come out alike; an empty table
    gives an empty result."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("order_minhash_dedup", near_duplicates),
    ("source_mixing", source_mix),
    ("byte_pair_encoding", token_ids),
]

#: EM, alignment and BPE are not SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next. What
    came before a stage's rows is removed once these are written."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        release(spark, mark, keep=path)
    return STAGES[-1][1](spark, docs, sf_dir)
