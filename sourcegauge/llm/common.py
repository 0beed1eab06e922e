"""What the text operators share: reading tables, keys of documents, the split into training and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and its complement, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): a key that never is null and differs for different texts of one doc_id.

    Rows equal in doc_id and text share a key; whatever is joined by it is the same for each of them.
    """
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"),
                       F.xxhash64(text_of()).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the documents, by crc32 of the id as text. A null id is held out: nothing is learned from it."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(True))


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions: the measure by which keyed work is cut into pieces."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
