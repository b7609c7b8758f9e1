"""Product exports: CSV files of any of three encodings, with their own headers."""

from __future__ import annotations

import csv
import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import fixed

# Fixed value: bytes that Windows-1252 leaves undefined, seen as Latin-1 characters.
NOT_IN_1252 = "[\x81\x8d\x8f\x90\x9d]"


@dataclass
class Export:
    """Raw rows (all strings) and what is known about their files."""

    rows: DataFrame
    encodings: dict[str, str] = field(default_factory=dict)
    unknown_columns: list[str] = field(default_factory=list)


def header_name(name: str) -> str:
    """One header cell as a column name. Runs on the driver: it is metadata."""
    text = html.unescape(re.sub(r"<[^>]+>", " ", unicodedata.normalize("NFKC", name)))
    text = re.sub(r"[\x00-\x1f\x7f​﻿]", " ", text)
    return re.sub(r"[\s\-]+", "_", text.strip().lower()).strip("_")


def file_facts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per file: its encoding and its header line.

    The files are read as plain lines, which split and spread over tasks whatever
    their size. Line breaks never fall inside a UTF-8 sequence, so a file is valid
    exactly when all its lines are.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
        "value",
    )
    raw = F.col("value").cast("binary")
    return (
        lines.groupBy("file")
        .agg(
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
            F.bool_or(F.decode(raw, "ISO-8859-1").rlike(NOT_IN_1252)).alias("odd"),
            F.min_by(raw, "position").alias("header"),
        )
        .select(
            "file",
            F.when(F.col("utf8"), "UTF-8")
            .when(~F.col("odd"), "windows-1252")
            .otherwise("ISO-8859-1")
            .alias("encoding"),
            "header",
        )
    )


def check_columns(names: list[str]) -> list[str]:
    """Raise when a required column is missing; return the unknown ones."""
    missing = [name for name in fixed.REQUIRED_COLUMNS if name not in names]
    if missing:
        raise ValueError(
            f"missing required column(s): {', '.join(missing)}. Found: {', '.join(names)}"
        )
    return sorted(set(names) - set(fixed.REQUIRED_COLUMNS) - set(fixed.OPTIONAL_COLUMNS))


def _ragged(n_columns: int) -> Column:
    """Spark keeps the text of a record whose cell count differs from the header."""
    bare = F.regexp_replace("_corrupt", r'"([^"]|"")*"', "")
    cells = F.length(F.regexp_replace(bare, "[^,]", "")) + 1
    return F.when(
        F.col("_corrupt").isNotNull(),
        F.when(cells > n_columns, "extra columns").otherwise("missing columns"),
    )


def _scan(
    spark: SparkSession, files: list[str], encoding: str, names: list[str], multi_line: bool
) -> DataFrame:
    # Spark reads no Windows-1252, which differs from Latin-1 in 32 control characters.
    upper = [chr(code) for code in range(0x80, 0xA0)]
    windows = "".join(bytes([ord(c)]).decode("cp1252", "replace") for c in upper)

    def text(name: str) -> Column:
        if encoding == "windows-1252":
            return F.translate(name, "".join(upper), windows)
        return F.col(name)

    # Of two columns with one name the later counts.
    kept = {name: position for position, name in enumerate(names)}
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) + ", `_corrupt` string"
    scanned = (
        spark.read.schema(schema)
        .options(
            header=True,
            multiLine=multi_line,
            escape='"',
            mode="PERMISSIVE",
            columnNameOfCorruptRecord="_corrupt",
            encoding="UTF-8" if encoding == "UTF-8" else "ISO-8859-1",
            # A parser that skips cells cannot tell a ragged row.
            columnPruning=False,
        )
        .csv(files)
    )
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    known = fixed.REQUIRED_COLUMNS + fixed.OPTIONAL_COLUMNS
    return scanned.select(
        order.alias("_ord"),
        _ragged(len(names)).alias("_ragged"),
        *[
            (text(f"c{kept[name]}") if name in kept else F.lit(None).cast("string")).alias(name)
            for name in known
        ],
    )


def read_export(
    spark: SparkSession, paths: list[str] | str, multi_line: bool = True
) -> Export:
    """Read product exports; the files may differ in encoding and header.

    Only one row per file reaches the driver, to group the files by layout.
    ``_ord`` orders the rows as they stand in their files. Quoted line breaks need
    ``multi_line``, which makes each file one task; pass False for huge files that
    hold none, and Spark splits them.
    """
    layouts: dict[tuple, list[str]] = {}
    encodings, unknown = {}, set()
    for fact in file_facts(spark, paths).collect():
        codec = {"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(fact.encoding, "latin-1")
        names = [header_name(n) for n in next(csv.reader([bytes(fact.header).decode(codec)]), [])]
        unknown |= set(check_columns(names))
        encodings[fact.file] = fact.encoding
        layouts.setdefault((fact.encoding, tuple(names)), []).append(fact.file)
    if not layouts:
        raise ValueError(f"{paths} has no header row")
    parts = [
        _scan(spark, files, encoding, list(names), multi_line)
        for (encoding, names), files in sorted(layouts.items())
    ]
    return Export(reduce(DataFrame.unionByName, parts), encodings, sorted(unknown))
