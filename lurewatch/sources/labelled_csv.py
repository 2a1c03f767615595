"""Labelled CSV corpora in several layouts -> one canonical email table.

The listing is driver-side metadata.  The header lines of all files are read by one distributed
job, and files with the same header and options by one scan, whatever their number.  Where the
rows of a file come from is told by its own path, so rows meet no listing and are not moved.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.labels import pandas_missing
from lurewatch.operators.cleaning import (
    CANONICAL_COLUMNS,
    CANONICAL_SCHEMA,
    ORDER_COLUMNS,
    keep_first,
    to_canonical,
)
from lurewatch.sources.message_files import file_at


LOCAL_SCHEME = "^file:/+"
# Bytes that are read at a time until a header line has ended.
HEADER_BYTES = 64 << 10


@dataclass(frozen=True)
class CsvConfig:
    """One file.  ``layout`` is a key of :data:`LAYOUTS`, or None to go by the header.

    ``root`` is set by discovery: the source is then what :func:`source_name` makes of the path.
    """

    path: str
    source: str
    layout: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    root: str | None = None


# --- layouts --------------------------------------------------------------------------------


def _named(df: DataFrame, name: str | None) -> Column:
    """A column looked up without regard to case (surrounding blanks do count), null if absent."""
    if name is not None:
        for present in df.columns:
            if present.lower() == name.lower():
                return F.col(f"`{present.replace('`', '``')}`")
    return F.lit(None).cast("string")


def _layout_columns(
    df: DataFrame, sender=None, subject=None, body=None, label=None, has_url=None
) -> dict[str, Column]:
    return {
        "from_address": _named(df, sender),
        "subject": _named(df, subject),
        "body": _named(df, body),
        "label": _named(df, label),
        "has_url": _named(df, has_url),
    }


def seven_column(df: DataFrame, label_col: str = "label") -> dict[str, Column]:
    """sender, receiver, date, subject, body, urls and a label column."""
    return _layout_columns(df, "sender", "subject", "body", label_col, "urls")


def email_text_type(
    df: DataFrame, text_col: str = "Email Text", label_col: str = "Email Type"
) -> dict[str, Column]:
    return _layout_columns(df, body=text_col, label=label_col)


def subject_body_label(
    df: DataFrame, subj_col: str = "subject", body_col: str = "body", label_col: str = "label"
) -> dict[str, Column]:
    return _layout_columns(df, subject=subj_col, body=body_col, label=label_col)


def text_combined(
    df: DataFrame, text_col: str = "text_combined", label_col: str = "label"
) -> dict[str, Column]:
    """All text in one column: it becomes the body, and the combined text is built anew."""
    return _layout_columns(df, body=text_col, label=label_col)


# Users may register further layouts here.
LAYOUTS: dict[str, Callable[..., dict[str, Column]]] = {
    "seven_column": seven_column,
    "email_text_type": email_text_type,
    "subject_body_label": subject_body_label,
    "text_combined": text_combined,
}


def choose_layout(header: Sequence[str]) -> str:
    """Layout that fits a header line."""
    names = {h.lower() for h in header}
    if {"email text", "email type"} <= names:
        return "email_text_type"
    if names == {"subject", "body", "label"}:
        return "subject_body_label"
    if {"text_combined", "label"} <= names:
        return "text_combined"
    return "seven_column"


# --- discovery ------------------------------------------------------------------------------


def source_name(path: Column, root: str) -> Column:
    """Folders below the root and the file stem, joined by underscores."""
    relative = F.substring_index(path, root.rstrip("/") + "/", -1)
    return F.regexp_replace(F.regexp_replace(relative, r"\.[^./]*$", ""), "/", "_")


def discover_csv(spark: SparkSession, raw_dir: str) -> list[CsvConfig]:
    """All ``*.csv`` below a folder, sorted by path parts."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(raw_dir)
        .select("path", source_name(F.col("path"), raw_dir).alias("source"))
        .orderBy(F.split("path", "/"))
    )
    # One entry per file: metadata, like the listing the driver already holds.
    return [CsvConfig(r["path"], r["source"], root=raw_dir) for r in files.collect()]


# --- loading --------------------------------------------------------------------------------


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def _file_path() -> Column:
    """The path of the file a row comes from, as listings write it; the metadata are encoded."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, LOCAL_SCHEME, "/")


def first_line(file, step: int = HEADER_BYTES) -> bytes | None:
    """The first line of an open file without its end, read in ranges; None for an empty file."""
    held = b""
    while True:
        block = file.read(step)
        held += block
        end = re.search(rb"[\r\n]", held)
        if end:
            return held[: end.start()]
        if not block:
            return held or None


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The column names of every file that has a header line, by path.

    Tasks open the files through Arrow's file systems and read no further than the line, so the
    size of a file plays no part.  Files on systems that Arrow does not reach are scanned by Spark.
    """
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or ""
    default = "" if default.startswith("file:") else default.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, reached = [], []
            for path in batch.column("path").to_pylist():
                at = path if ":/" in path else f"{default}{path}"
                try:
                    system, inner = file_at(at)
                except (ImportError, NotImplementedError, OSError, ValueError):
                    lines.append(None)
                    reached.append(False)
                    continue
                with system.open_input_file(inner) as file:
                    lines.append(first_line(file))
                reached.append(True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array(lines, pa.binary()), pa.array(reached, pa.bool_())],
                ["path", "line", "reached"],
            )

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    # One line per file.
    found = listed.mapInArrow(read, "path string, line binary, reached boolean").collect()
    headers = {
        re.sub(LOCAL_SCHEME, "/", r["path"]): _names(bytes(r["line"]).decode("utf-8", "replace"))
        for r in found if r["line"] is not None
    }
    rest = [r["path"] for r in found if not r["reached"]]
    return headers | scan_headers(spark, rest) if rest else headers


def scan_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The same by a scan of the first block of every file."""

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for row, path in enumerate(batch.column("path").to_pylist()):
                if path != last:
                    rows.append(row)
                    last = path
            yield batch.take(pa.array(rows, pa.int64()))

    lines = spark.read.text(list(paths)).filter("_metadata.file_block_start = 0")
    lines = lines.select(_file_path().alias("path"), "value").mapInArrow(first_lines, "path string, value string")
    return {r["path"]: _names(r["value"]) for r in lines.collect()}


def _names(line: str) -> tuple[str, ...]:
    """Column names of a header line; empty and repeated ones are told apart by their place."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    lowered = [n.lower() for n in names]
    return tuple(
        f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)
    )


def load_csv(
    spark: SparkSession,
    configs: Sequence[CsvConfig],
    multi_line: bool = True,
    na_values: bool = True,
) -> DataFrame:
    """Canonical rows of all files, with load-order columns.

    Quoted line breaks, which CSV allows anywhere, need ``multi_line``; a file is then read in
    one task.  Files without them can be split with ``multi_line=False``.  Empty files have no
    rows.
    """
    schema = CANONICAL_SCHEMA + ", source_ord array<string>, block_ord long, row_ord long"
    if not configs:
        return spark.createDataFrame([], schema)
    headers = read_headers(spark, [c.path for c in configs])
    # Configurations of the caller's own making are few; their names and order are written out.
    given = [c for c in configs if c.root is None]
    groups: dict[tuple, list[CsvConfig]] = {}
    for config in configs:
        header = headers.get(re.sub(LOCAL_SCHEME, "/", config.path))
        if header is not None:
            layout = config.layout or choose_layout(header)
            key = (header, layout, tuple(sorted(config.options.items())), config.root)
            groups.setdefault(key, []).append(config)

    parts = []
    for (header, layout, options, root), members in groups.items():
        columns = ", ".join(f"`{h.replace('`', '``')}` string" for h in header)
        raw = _reader(spark, multi_line).schema(columns).csv([c.path for c in members])
        found = LAYOUTS[layout](raw, **dict(options))
        path = _file_path()
        if root is not None:
            source = source_name(path, re.sub(LOCAL_SCHEME, "/", root))
        else:
            source = _lookup(path, {c.path: c.source for c in members})
        order = F.split(path, "/")
        if given:
            order = F.array(_lookup(path, {c.path: f"{n:012d}" for n, c in enumerate(configs)}))
        rows = raw.select(
            *[(pandas_missing(c) if na_values else c).alias(name) for name, c in found.items()],
            source.alias("source"), order.alias("source_ord"),
            F.col("_metadata.file_block_start").alias("block_ord"),
            F.monotonically_increasing_id().alias("row_ord"),
        )
        parts.append(to_canonical(rows, keep=ORDER_COLUMNS))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _lookup(path: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for p, v in values.items() for x in (re.sub(LOCAL_SCHEME, "/", p), v)]
    return F.element_at(F.create_map(*pairs), path)


def load_all(
    spark: SparkSession, configs: Sequence[CsvConfig], dedupe: bool = True, **options
) -> DataFrame:
    """All corpora in one table; optionally the first row per combined text only."""
    rows = load_csv(spark, configs, **options)
    if dedupe:
        rows = keep_first(rows, ORDER_COLUMNS)
    return rows.select(*CANONICAL_COLUMNS)
