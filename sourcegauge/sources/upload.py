"""Uploads: CSV scan, header mapping, parsing into source rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import parse_number
from ..schema import MEASURES, ORD, SOURCE_ROW, SOURCE_TEXTS
from ..settings import HEADER_ALIASES, REQUIRED_COLUMNS
from .records import first_record, lines_of, records


SEPARATORS = (",", "\t", "|", ";")


def guess_separator(header: str) -> str:
    """The separator that splits the header record into most cells."""
    return max(SEPARATORS, key=lambda s: len(next(csv.reader(io.StringIO(header, newline=""), delimiter=s), [])))


def header_names(header: str, sep: str) -> list[str]:
    """Names for Spark: of headers that repeat, also but for case, the first keeps its name, others are named by position."""
    names: list[str] = []
    seen = {ORD}
    for i, cell in enumerate(next(csv.reader(io.StringIO(header.removeprefix("\ufeff"), newline=""), delimiter=sep), [])):
        names.append(cell if cell.strip() and cell.lower() not in seen else f"_c{i}")
        seen.add(cell.lower())
    return names


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True, sep: str | None = None) -> DataFrame:
    """All cells as strings, plus ``ord``: file, block and place within the block.

    The header is the first record with text: blank lines before it do not count, and its cells may hold line breaks. All files of an
    upload have one header. ``sep``: guessed from it if not given. Blank lines are left out.

    Files are split among tasks either way. Cells may hold line breaks inside quotes; ``multi_line=False`` says that none does, which
    saves the pass that looks for them.
    """
    first = first_record(lines_of(spark, path), guess_separator if sep is None else lambda line: sep)
    if first is None:
        raise ValueError("no data provided")
    sep, header = first
    names = header_names(header, sep)
    if not multi_line:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        raw = spark.read.schema(schema).options(header=True, sep=sep, escape='"').csv(path)
        # The number grows in read order inside a block; blocks are told apart by the fields before it.
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("line"))
        return raw.withColumn(ORD, place)
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    cells = F.from_csv(F.rtrim("record", F.lit("\r")), schema, {"sep": sep, "escape": '"', "multiLine": "true"})
    read = records(spark, path, sep).select(cells.alias("cells"), F.struct("file", "block", "line").alias(ORD))
    return read.select(*[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)], ORD)


def auto_map(columns: list[str]) -> dict[str, str]:
    """Canonical key -> first header, in file order, that is one of its aliases."""
    normal = [("_".join(c.lower().split()) if c.strip() else "", c) for c in columns]
    mapping = {}
    for key, aliases in HEADER_ALIASES.items():
        hits = [c for n, c in normal if n in aliases]
        if hits:
            mapping[key] = hits[0]
    return mapping


def check_mapping(mapping: Mapping[str, str]) -> None:
    missing = [key for key in REQUIRED_COLUMNS if not mapping.get(key)]
    if missing:
        raise ValueError(f"column mapping required for: {', '.join(missing)}")


def parse_rows(raw: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Source rows from string cells. Rows without sub_id, vertical or traffic_type are dropped.

    Rates, current classification and the unmapped flag of an upload are not read: they are
    computed again from the counts.
    """
    mapping = dict(mapping or auto_map(raw.columns))
    check_mapping(mapping)

    def cell(key: str) -> Column:
        header = mapping.get(key)
        if not header:
            return F.lit(None).cast("string")
        return F.col("`" + header.replace("`", "``") + "`").cast("string")

    def text(key: str) -> Column:
        return F.coalesce(cell(key), F.lit(""))

    rows = raw.select(
        F.col(ORD),
        text("subid").alias("sub_id"),
        text("vertical").alias("vertical"),
        text("traffic_type").alias("traffic_type"),
        F.nullif(cell("internal_channel"), F.lit("")).alias("internal_channel"),
        *[text(key).alias(key) for key in SOURCE_TEXTS],
        *[parse_number(cell(key)).alias(name) for name, key in MEASURES.items()],
    )
    return rows.where((F.col("sub_id") != "") & (F.col("vertical") != "") & (F.col("traffic_type") != ""))


def require_rows(raw: DataFrame) -> DataFrame:
    """Refuse an upload without data."""
    if raw.isEmpty():
        raise ValueError("no data provided")
    return raw


def rows_of_report(report: DataFrame) -> DataFrame:
    """Source rows straight from a report, in its listing's order; ``ord`` is unique, as the facts' vertical is in it."""
    numbers = [F.coalesce(F.col(key).cast("double"), F.lit(0.0)).alias(name) for name, key in MEASURES.items()]
    return report.select(
        F.struct((-F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0))).alias("revenue"), "sub_id", "vertical", "fact_vertical").alias(ORD),
        "sub_id", "vertical", "traffic_type",
        F.nullif(F.col("internal_channel"), F.lit("")).alias("internal_channel"),
        *[F.coalesce(F.col(key), F.lit("")).alias(key) for key in SOURCE_TEXTS],
        *numbers,
    ).select(*SOURCE_ROW).where("sub_id <> '' AND vertical <> '' AND traffic_type <> ''")
