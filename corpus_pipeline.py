"""From raw documents to tokens: filter, deduplicate, pseudonymise, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and is written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from asterism.llm.bpe import default_vocabulary, encode_texts
from asterism.llm.mixing import mix_sources, word_count
from asterism.llm.near_duplicates import keep_one
from asterism.llm.pseudonyms import QUERY_KEY, pseudonymise
from asterism.llm.toxicity import fit_toxicity, held_out, score_toxicity
from asterism.shared import discard, kept, materialise, scratch
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of rows that pass to a Python worker at once, instead of Spark's 64 MB; workers and executors hold a few such batches.
BATCH_BYTES = "8m"


def _lean(spark: SparkSession) -> None:
    """Let the session pass batches of BATCH_BYTES, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    _lean(spark)
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs.filter(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    _lean(spark)
    return keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal values, under the session's own key if ``spark.asterism.pseudonymKey`` is set."""
    _lean(spark)
    found = pseudonymise(docs.select(*COLUMNS), spark.conf.get("spark.asterism.pseudonymKey", QUERY_KEY))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three rows each."""
    _lean(spark)
    mixed = mix_sources(docs.select(*COLUMNS, word_count().alias("_words")), "_words")
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    _lean(spark)
    coded = encode_texts(docs.select("doc_id", "source", "text"), default_vocabulary(), check=True)
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "exact")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):
            docs = kept(materialise(stage(spark, docs, sf_dir)))
        if last is not None:
            discard(last)
        last = docs
    return docs
