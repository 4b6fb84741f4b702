"""A bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """``docs`` (id, text) with the label of ``chosen`` (id, label; ``most`` rows at most): at most ``most`` rows, equal ones once.

    Where ids repeat with different texts, the rows of least hash are taken, so
    an id that holds a third of all rows can't fill the driver.
    """
    docs = docs.withColumn("_content", F.xxhash64("text"))
    slim = docs.select("id", "_content").join(F.broadcast(chosen), "id").distinct()
    slim = slim.orderBy(F.xxhash64("id", "_content"), "id", "_content").limit(most)
    return docs.join(F.broadcast(slim), ["id", "_content"]).dropDuplicates(["id", "_content"]).select("id", "text", "label")
