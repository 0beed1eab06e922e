"""Views stored in their order, so that any page and any source's place is found by reading a file or two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.views import view_order
from ..session import path_exists, publish

#: Rows of a file at most: what a page costs, however long the view.
ROWS_PER_FILE = 100_000


def _in_ranges(rows: DataFrame, order: list[Column], path: str, most: int) -> None:
    """Write rows in order: each task one range of it, in files of at most ``most`` rows. AQE merges small ranges, neighbours only."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", most).parquet(path)


class StoredView:
    """One view in one folder: ``rows`` in view order; ``files``, how many rows lie before each of its files; ``places``, each source's first
    position, by sub_id; ``place_files``, from which to which sub_id each of these files goes. It is there once ``ready`` is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def write(cls, view: DataFrame, folder: str, direction: str | None = "desc", rows_per_file: int = ROWS_PER_FILE) -> StoredView:
        """Store ``view`` in a folder that does not exist yet. The view must have ``ord``, which no two of its rows share."""
        stored = cls(view.sparkSession, folder)
        at = stored.folder
        order = view_order(direction)
        _in_ranges(view, order, f"{at}/rows", rows_per_file)
        rows = stored._read("rows")
        # Any row of a file tells its place among the files, as their ranges do not meet. One row a file from here on.
        some = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count("*").alias("n"), F.min(F.struct("ord", "total_revenue")).alias("row")).select("file", "n", "row.*")
        before = F.coalesce(F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        some.select("file", "n", before.alias("before")).coalesce(1).write.parquet(f"{at}/files")
        placed = rows.where(F.col("sub_id").isNotNull()).select(
            "sub_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        placed = placed.join(stored._read("files"), "file").groupBy("sub_id").agg(F.min(F.col("before") + F.col("row")).alias("position"))
        _in_ranges(placed, [F.col("sub_id")], f"{at}/places", rows_per_file)
        stored._read("places").groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min("sub_id").alias("low"), F.max("sub_id").alias("high")).coalesce(1).write.parquet(f"{at}/place_files")
        publish(stored.spark, f"{at}/ready", direction or "input order")
        return stored

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _files(self, table: str, names: list[str]) -> DataFrame:
        """Rows of the named files only: those of one page, or of one list of sources."""
        whole = self._read(table)
        paths = [f"{self.folder}/{table}/{name}" for name in names]
        return self.spark.read.schema(whole.schema).parquet(*paths) if paths else whole.limit(0)

    def _checked(self) -> None:
        if not path_exists(self.spark, f"{self.folder}/ready"):
            raise FileNotFoundError(f"no whole view in {self.folder}")

    def count(self, size: int = 25) -> DataFrame:
        """One row: how many records and pages the view has."""
        self._checked()
        n = F.coalesce(F.sum("n"), F.lit(0))
        return self._read("files").agg(n.alias("records"), F.ceil(n / size).alias("pages"))

    def page(self, number: int = 1, size: int = 25) -> DataFrame:
        """One page, in view order. A page beyond the last is empty."""
        self._checked()
        first = (number - 1) * size
        files = self._read("files")
        met = files.where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
        starts = met.collect()  # a page's rows over ROWS_PER_FILE, and two more, at most
        rows = self._files("rows", [r.file for r in starts])
        if not starts:
            return rows
        start = reduce(lambda rest, r: rest.when(F.col("_metadata.file_name") == r.file, F.lit(r.before)), starts, F.when(F.lit(False), F.lit(0)))
        # A struct beside the row: no column of the view can have a clashing name.
        placed = rows.select(F.struct(*rows.columns).alias("row"), (F.col("_metadata.row_index") + start).alias("position"))
        return placed.where(F.col("position").between(first, first + size - 1)).orderBy("position").select("row.*")

    def locate(self, sub_ids: list[str] | DataFrame, size: int = 25) -> DataFrame:
        """Zero-based position and page of the first row of each wanted sub_id. A list is answered from the files that its ids lie in."""
        self._checked()
        if isinstance(sub_ids, DataFrame):
            found = self._read("places").join(sub_ids.select("sub_id").distinct(), "sub_id", "left_semi")
        else:
            within = reduce(Column.__or__, [F.lit(x).between(F.col("low"), F.col("high")) for x in sub_ids], F.lit(False))
            names = [r[0] for r in self._read("place_files").where(within).select("file").collect()]
            found = self._files("places", names).where(F.col("sub_id").isin(sub_ids))
        return found.withColumn("page", F.floor(F.col("position") / size) + 1)
