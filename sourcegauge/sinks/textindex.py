"""Which files of a table may hold a text: bitmaps of the trigrams of each file."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, publish

#: Bits of one of Spark's bitmaps, and how many such rows a file has at most. A file of 100,000 different trigrams fills a sixth of them.
BITS, BUCKETS = 32768, 16
#: Trigrams of a wanted text that are looked up; more would hardly rule out more files.
LOOKED_UP = 32
#: The bucket of the row that says a file was indexed, whatever it holds.
WHOLE_FILE = -1
SCHEMA = "file STRING, bucket INT, bits BINARY"


def _trigrams(text: Column) -> Column:
    """All runs of three characters of the lower-cased text, overlapping, in time proportional to its length."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))


def _place(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS * BUCKETS))


def file_name(path: str) -> str:
    """Folder and name: a task that writes several partitions gives their files one name."""
    return "/".join(path.rsplit("/", 2)[-2:])


class TextIndex:
    """Bitmaps beside a table, in ``folder``. A file goes by its last folder and its name, which must not repeat within the table.

    Each update writes a part of its own and then publishes a note of it; parts without a note, left by failures, are not read.
    A file without a row in the index may hold anything.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _rows(self) -> DataFrame:
        notes = f"{self.folder}/notes"
        if not path_exists(self.spark, notes):
            return self.spark.createDataFrame([], SCHEMA)
        parts = [r[0] for r in self.spark.read.text(notes).distinct().collect()]
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/parts/{p}" for p in parts])

    def indexed(self) -> set[str]:
        """Names of all files that have bitmaps: as many as Spark's own listing of the table holds."""
        return {r[0] for r in self._rows().where(F.col("bucket") == WHOLE_FILE).select("file").collect()}

    def add(self, rows: DataFrame, files: Sequence[str], columns: Sequence[str]) -> None:
        """Index the texts of ``columns``; ``rows`` are read from just these files. A null text is empty."""
        texts = F.concat(*[_trigrams(F.coalesce(c, F.lit(""))) for c in columns])
        places = rows.select(F.substring_index("_metadata.file_path", "/", -2).alias("file"), F.explode(texts).alias("trigram"))
        # A file has at most BITS * BUCKETS places; repeats go before the shuffle.
        places = places.select("file", _place(F.col("trigram")).alias("place")).distinct()
        bitmaps = places.groupBy("file", F.floor(F.col("place") / BITS).cast("int").alias("bucket")).agg(
            F.bitmap_construct_agg(F.col("place") % BITS).alias("bits"))
        whole = self.spark.createDataFrame([(file_name(f), WHOLE_FILE, None) for f in files], SCHEMA)
        part = uuid.uuid4().hex
        bitmaps.unionByName(whole).write.parquet(f"{self.folder}/parts/{part}")
        publish(self.spark, f"{self.folder}/notes/{part}.txt", part)

    def ruled_out(self, text: str) -> set[str]:
        """Names of indexed files that cannot hold the text in any case. A text of fewer than three characters rules out none."""
        wanted = self.spark.range(1).select(F.explode(_trigrams(F.lit(text))).alias("t")).select(_place(F.col("t")).alias("p")).distinct()
        places = sorted(r[0] for r in wanted.collect())[:LOOKED_UP]
        if not places:
            return set()

        def has(bit: int) -> Column:
            byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
            return byte.bitwiseAND(1 << bit % 8) != 0

        buckets = sorted({p // BITS for p in places})
        tests = {b: reduce(Column.__and__, [has(p % BITS) for p in places if p // BITS == b]) for b in buckets}
        met = reduce(lambda rest, b: rest.when(F.col("bucket") == b, tests[b]), buckets, F.when(F.col("bucket") == WHOLE_FILE, F.lit(False)))
        rows = self._rows().where(F.col("bucket").isin([WHOLE_FILE, *buckets]))
        found = rows.groupBy("file").agg(F.count_distinct(F.when(met, F.col("bucket"))).alias("n"))
        return {r[0] for r in found.where(F.col("n") < len(buckets)).select("file").collect()}
