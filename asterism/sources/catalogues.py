"""Star catalogues and sampler chains: text scans, Parquet chains, and views over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_whitespace(spark: SparkSession, path: str, schema: T.StructType, names: list[str] | None = None) -> DataFrame:
    """A text catalogue whose columns are parted by runs of blanks, with a header line in each file.

    Columns are found by the header's names, which are read from the file's
    first line unless ``names`` gives them; a missing name is an error. Values
    that are no number of their type become null.
    """
    lines = spark.read.text(path)
    if names is None:
        first = lines.limit(1).collect()
        if not first:
            return spark.createDataFrame([], schema)
        names = first[0]["value"].split()
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"no columns {missing}")
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    header = " ".join(names)
    rows = lines.filter((F.trim("value") != "") & (F.trim(F.regexp_replace("value", r"\s+", " ")) != header)).select(parts.alias("p"))
    return rows.select(*(F.get("p", F.lit(names.index(f.name))).try_cast(f.dataType).alias(f.name) for f in schema))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A comma-separated catalogue with a header; columns are matched by name and pruned at the scan."""
    names = spark.read.csv(path, header=True).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"no columns {missing}")
    whole = T.StructType([next((f for f in schema if f.name == n), T.StructField(n, T.StringType())) for n in names])
    return spark.read.csv(path, header=True, schema=whole, enforceSchema=True).select(*(F.col(f"`{f.name}`") for f in schema))


def write_chain(chain: DataFrame, path: str, run_id: str, append: bool = False) -> None:
    """Store steps of a sampler run; a run is overwritten alone, other runs stay."""
    out = chain.withColumn("run_id", F.lit(run_id)).repartition("run_id").write.partitionBy("run_id")
    out = out.mode("append") if append else out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def read_chain(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Steps of one run, by partition pruning, or of all."""
    chain = spark.read.parquet(path)
    return chain if run_id is None else chain.filter(F.col("run_id").cast("string") == run_id)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with positions, bands, membership, flags and proper motions, from the vectors of ``embeddings``."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(8)]
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(
        F.col("vec_id").alias("star_id"),
        (290 + e[0] * 0.08).alias("ra"), (2 + e[1] * 0.08).alias("dec"), (e[0] * 1000).alias("x"), (e[1] * 1000).alias("y"),
        (22 + 6 * e[2]).alias("band1"), (22 + 6 * e[2] - (1.75 + 1.5 * e[3])).alias("band2"), (1 - F.col("label") / 20).alias("membership"),
        F.when(F.col("label") == 9, 0).otherwise(1).alias("oktot"), (F.col("label") < 6).alias("is_cluster"), (F.col("label") >= 4).alias("is_field"),
        (-3 + 2 * e[4]).alias("pm_ra"), (-6 + 2 * e[5]).alias("pm_dec"), (0.1 + F.abs(e[6])).alias("epm_ra"), (0.1 + F.abs(e[7])).alias("epm_dec"),
    )


def photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger catalogue with positions, bands and membership, from ``orders``."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mag = 14 + F.col("o_totalprice").cast("double") / 40000
    return t.select(
        F.col("o_orderkey").alias("star_id"),
        (F.col("o_orderkey") * 7919 % 10007).cast("double").alias("x"), (F.col("o_orderkey") * 104729 % 10009).cast("double").alias("y"),
        mag.alias("band1"), (mag - (0.5 + (F.col("o_custkey") % 300) / 100)).alias("band2"), ((F.col("o_orderkey") % 101) / 100).alias("membership"),
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of many walkers, from ``events``: one walker for each user, steps in order of time."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.select(F.col("user_id").alias("walker"), step.alias("step"), F.col("value").cast("double").alias("theta0"), (-F.col("value").cast("double")).alias("log_prob"))
