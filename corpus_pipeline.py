"""A corpus pipeline: language ID, near-duplicates, personal data, mixing and encoding, each on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, lsh_forest, mixing, pii, spm_wfst
from tessera.llm.common import Stow, made_since, open_stows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if at least this share of its grams belongs to the language predicted.
LEAST_SCORE = 0.3
#: Documents are near copies from this similarity of their sets of five words.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; lang becomes the predicted one. Goes: null text, no letter, too few known grams."""
    model = langid.train(langid.training_rows(docs).select("lang", "text"))
    kept = langid.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; null ids stay.

    A document is all rows of one id: if they have different texts, they stay or go together, and a row that is
    there several times with one text stays once.
    """
    gone = lsh_forest.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    named = docs.select(*COLUMNS).where("doc_id is not null").join(gone.hint("merge"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text; n_chars is counted anew where the text changed."""
    out = pii.pseudonymise(docs.select(*COLUMNS), pii.KEY, found_col="pii_found")
    return out.withColumn("n_chars", F.when(F.size("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in order of position: a document is there once for each time it is taken, as a whole."""
    return mixing.mix(docs.select(*COLUMNS), mixing.CURRICULUM, ratio=1.5, cap=2.0, boundary="whole").select("doc.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with each text's ids and their number."""
    return spm_wfst.encode(docs.select(*COLUMNS)).withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii_pseudonyms", pseudonyms),
    ("mixing", mixture),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express Bloom filters, Feistel networks and merges of pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and what it was made from deleted."""
    docs, stow = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stow(spark)
    for k, (name, stage) in enumerate(STAGES):
        before = set(open_stows())
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stow.put(docs, name)
            stow.only(name)
            for made in made_since(before):
                made.clear()
    return docs
