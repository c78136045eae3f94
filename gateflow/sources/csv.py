"""Wide CSV deliveries: header detection, scan, stacking, cleaning to one shape.

A path is one delivery: a file, or a folder or pattern of files that share one
header. Files with different headers are different deliveries, see read_many.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateflow.config import DATE_WORD, SLOTS, TOTAL_WORD
from gateflow.functions.dates import parse_date
from gateflow.functions.headers import (
    distinct_names,
    key_columns,
    quoted,
    slot_columns,
    strip_name,
)
from gateflow.functions.names import line_label
from gateflow.functions.numbers import clean_counts, row_total
from gateflow.sinks.tables import scratch_path, write_table

# order of a row within a delivery: file, start of the block, row in the block
ORDER = ("_file", "_block", "_row")


#: Lines whose quotes are counted together.
STRETCH = 4096
_BOM = "\ufeff"
_CSV = {"quote": '"', "escape": '"'}


@dataclass(frozen=True)
class Header:
    line: int  # 0 or 1
    text: str  # the header line as delivered
    title: str | None  # the line above it

    @property
    def cells(self) -> list[str]:
        return next(csv.reader([self.text]))

    def names(self, strip: str = "ends") -> list[str]:
        return distinct_names([strip_name(c, strip) for c in self.cells])


def _header_of(lines: Sequence[str], marker: str) -> Header:
    """Header among the first two lines that are not blank: line 0 if it holds the
    marker word, else line 1."""
    lines = [x.lstrip(_BOM) for x in lines]
    if marker in lines[0] or len(lines) == 1:
        return Header(0, lines[0], None)
    return Header(1, lines[1], lines[0])


def detect_header(spark: SparkSession, path: str, marker: str = DATE_WORD) -> Header:
    """Header of a delivery: line 0 if it holds the marker word, else line 1.

    Only the first two lines of one file reach the driver, the first by path that
    has any.
    """
    for file in sorted(spark.read.text(path).inputFiles()):
        first = spark.read.text(file).where(F.trim("value") != "").take(2)
        if first:
            return _header_of([r.value for r in first], marker)
    raise ValueError(f"no header in {path}")


# --- catalogue of headers ---------------------------------------------------------------


def _plain(file: str) -> str:
    """Name of a file with one slash after a scheme, however a listing writes it."""
    return re.sub(r"^([a-z0-9+.-]+):/+", r"\1:/", file)


@dataclass(frozen=True)
class Delivered:
    """Files that share a header and a title line, in order of their names."""

    header: Header
    files: tuple[str, ...]


def catalogue(spark: SparkSession, paths: Sequence[str], marker: str = DATE_WORD) -> list[Delivered]:
    """Files below the paths by their header, found in one job whatever their number.

    Each task opens one file and asks for no more than it needs to see two lines. Files
    without any line are left out. What reaches the driver is a row per header with the
    names of its files, which the scan's own list of files holds too.
    """
    if not paths:
        raise ValueError("no files")
    probe = spark.newSession()  # settings of its own: no task gets two files
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    probe.conf.set("spark.sql.files.maxPartitionBytes", most)
    probe.conf.set("spark.sql.files.openCostInBytes", most)
    lines = probe.read.text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, []
        for batch in batches:
            if batch.num_rows and batch.column(2)[0].as_py() > 0:
                break  # not the beginning of its file
            for value, path in zip(batch.column(0), batch.column(1), strict=True):
                if len(seen) < 2 and value.as_py().strip(" "):
                    seen.append(value.as_py())
                    file = path.as_py()
            if len(seen) == 2:
                break
        columns = [pa.array([file] if seen else [], pa.string()), pa.array([seen] if seen else [], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "top"])

    first, second = (F.regexp_replace(F.try_element_at("top", F.lit(i)), f"^{_BOM}+", "") for i in (1, 2))
    at_once = first.contains(marker) | second.isNull()
    kinds = lines.mapInArrow(top, "file string, top array<string>").select(
        "file", F.when(at_once, first).otherwise(second).alias("text"), F.when(~at_once, first).alias("title")
    )
    found = kinds.groupBy("text", "title").agg(F.collect_list("file").alias("files")).collect()
    groups = [Delivered(Header(int(r["title"] is not None), r["text"], r["title"]), tuple(sorted(map(unquote, r["files"])))) for r in found]
    return sorted(groups, key=lambda g: g.files)


def delivered(spark: SparkSession, paths: Sequence[str], marker: str = DATE_WORD) -> list[tuple[str, Delivered]]:
    """(path, files of it that share a header) of several paths; headers from one job."""
    header_of = {_plain(f): g.header for g in catalogue(spark, paths, marker) for f in g.files}
    out = []
    for path in sorted(paths):
        by_header: dict[Header, list[str]] = {}
        for file in sorted(unquote(f) for f in spark.read.text(path).inputFiles()):
            if (header := header_of.get(_plain(file))) is not None:
                by_header.setdefault(header, []).append(file)
        if not by_header:
            raise ValueError(f"no header in {path}")
        out += [(path, Delivered(h, tuple(files))) for h, files in by_header.items()]
    return out


def _data_lines(header: Header, marker: str, path: str, strict: bool, multi_line: bool) -> Column:
    """Condition on the text line: neither blank, header nor title."""
    value = F.col("value")
    tops = [t for t in (header.text, header.title) if t is not None]
    keep = F.when(value.isin(*tops, *[_BOM + t for t in tops]) | (F.trim(value) == ""), False)
    if strict and marker in header.text:
        # another header has most of the same cells; a name with the marker word hasn't
        cells = [c for c in dict.fromkeys(header.cells) if c.strip()]
        # a function of an array is not compiled, so its many terms don't lengthen the method of the scan
        shared = F.exists(F.array(value), lambda v: row_total([v.contains(c).cast("int") for c in cells]) * 2 >= len(cells))
        other = F.raise_error(F.lit(f"files below {path} differ in their header"))
        keep = keep.when(value.contains(marker) & shared, other.cast("boolean"))
    if strict and not multi_line:
        quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
        broken = F.raise_error(F.lit(f"a quoted cell below {path} has a line break: read with multi_line"))
        keep = keep.when(quotes % 2 == 1, broken.cast("boolean"))
    return keep.otherwise(True)


def _ordered(df: DataFrame, with_order: bool) -> DataFrame:
    if not with_order:
        return df
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def whole_records(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Lines (value and ORDER) as records: a quoted cell that goes on in the next lines
    is one value again. Files stay splittable.

    A line that has an odd number of quotes opens or closes a cell. Their numbers are
    counted per stretch of lines, summed over the stretches of a file block and over the
    blocks of a file; so each stretch knows how many stand before it, and whether it
    begins inside a cell. Stretches without such a line, outside a cell, are passed on
    where they were read. Only the others are sorted, and of those lines the ones of a
    cell come together under the number of the cell in its file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumns({"_odd": quotes % 2, "_stretch": F.floor(F.col("_row") / stretch)})
    block, at = ["_file", "_block"], ["_file", "_block", "_stretch"]
    counts = lines.groupBy(*at).agg(F.sum("_odd").alias("_n"))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    all_in = Window.partitionBy("_file")
    open_end = F.raise_error(F.concat(F.lit("a quoted cell is never closed in "), "_file")).cast("bigint")
    blocks = counts.groupBy(*block).agg(F.sum("_n").alias("_sum")).select(
        *block,
        F.when(F.sum("_sum").over(all_in) % 2 == 1, open_end)
        .otherwise(F.coalesce(F.sum("_sum").over(before(["_file"], "_block")), F.lit(0))).alias("_of_block"),
    )
    within = F.coalesce(F.sum("_n").over(before(block, "_stretch")), F.lit(0))
    based = counts.withColumn("_within", within).join(blocks, block).withColumn("_base", F.col("_within") + F.col("_of_block"))
    touched = based.where((F.col("_n") > 0) | (F.col("_base") % 2 == 1)).select(*at, "_base")
    # written, so that its size is known when lines are joined to it
    touched = write_table(touched, scratch_path(lines.sparkSession, "quoted-stretches"))
    alone = lines.join(touched, at, "left_anti").select("value", *ORDER)
    told = F.col("_base") + F.coalesce(F.sum("_odd").over(before(at, "_row")), F.lit(0))
    marked = lines.join(touched, at).withColumn("_before", told)
    inside = (F.col("_before") % 2 == 1) | (F.col("_odd") == 1)
    cell = F.when(inside, F.floor(F.col("_before") / 2))
    one = F.when(~inside, F.col("_row"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))
    joined = marked.groupBy("_file", cell.alias("_cell"), one.alias("_one")).agg(parts.alias("_parts")).select(
        F.array_join("_parts.value", "\n").alias("value"), "_file", F.col("_parts")[0]["_block"].alias("_block"), F.col("_parts")[0]["_row"].alias("_row")
    )
    records = alone.unionByName(joined)
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_wide_csv(
    spark: SparkSession,
    path: str,
    strip: str = "ends",
    marker: str = DATE_WORD,
    with_order: bool = False,
    strict: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """One delivery as text columns, header and title lines removed.

    Every file of the delivery may start with the header. With strict, a file
    with another header stops the read instead of being stacked by position, and
    so does a quoted cell that goes on in the next line; multi_line reads those, with
    two more scans of the lines, and files stay splittable.
    Lines are filtered as text and then parsed: a condition over all the cells
    would be a constraint that the optimizer rewrites for each renamed column. Cells come
    out of a generator, below which no condition on them is pushed: a pushed one would
    hold the parser once for every place where it names a cell.
    """
    return _read(spark, path, detect_header(spark, path, marker), strip, marker, with_order, strict, multi_line)


def _read(
    spark: SparkSession,
    files: str | Sequence[str],
    header: Header,
    strip: str = "ends",
    marker: str = DATE_WORD,
    with_order: bool = False,
    strict: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """One scan of files whose header is known."""
    names = header.names(strip)
    places = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{p} string" for p in places)
    order = ORDER if with_order else ()
    files = files if isinstance(files, str) else list(files)
    if multi_line:
        lines = whole_records(_ordered(spark.read.text(files, lineSep="\n"), True), STRETCH)
    else:
        lines = _ordered(spark.read.text(files), with_order)
    cells = F.from_csv("value", schema, {**_CSV, "multiLine": str(multi_line).lower()})
    return (
        lines.where(_data_lines(header, marker, str(files), strict, multi_line))
        .select(F.inline_outer(F.array(cells)), *order)
        .select(*[F.col(p).alias(n) for p, n in zip(places, names)], *order)
    )


def read_delivered(spark: SparkSession, group: Delivered, strip: str = "ends", marker: str = DATE_WORD, **how) -> DataFrame:
    """One scan of all files that share a header; options as in read_wide_csv."""
    return _read(spark, group.files, group.header, strip, marker, **how)


def read_many(
    spark: SparkSession,
    paths: Sequence[str],
    strip: str = "all",
    marker: str = DATE_WORD,
    with_order: bool = False,
) -> DataFrame:
    """Files below the paths stacked by column name, those of the first by name first;
    absent columns are null. One job finds all headers, and each header is one scan."""
    out = None
    for group in catalogue(spark, paths, marker):
        df = read_delivered(spark, group, strip, marker, with_order=with_order)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header below {list(paths)}")
    return out


def direction_columns(df: DataFrame, words: Sequence[str]) -> dict[str, str | None]:
    """Per word the first column in which any value holds it, in one pass."""
    found = df.agg(
        *[
            F.bool_or(F.coalesce(F.col(quoted(c)).contains(w), F.lit(False))).alias(f"{i}_{j}")
            for i, c in enumerate(df.columns)
            for j, w in enumerate(words)
        ]
    ).first()
    return {
        w: next((c for i, c in enumerate(df.columns) if found[f"{i}_{j}"]), None)
        for j, w in enumerate(words)
    }


def filter_direction(df: DataFrame, word: str, column: str | None = None) -> DataFrame:
    """Rows of one direction; none when no column holds the word.

    Finding the column reads the delivery once; pass it when it is known.
    """
    column = column or direction_columns(df, [word])[word]
    if column is None:
        return df.where(F.lit(False))
    return df.where(F.col(quoted(column)).contains(word))


def align_slots(
    df: DataFrame,
    id_cols: Sequence[str | Column],
    slots: Sequence[str],
    canonical: Sequence[str] = SLOTS,
    keep: Column | None = None,
) -> DataFrame:
    """Slots by position under the canonical names: absent ones 0, surplus ones dropped.

    `keep` is a condition on the id columns; cells of other rows are not cleaned.

    Cells are cleaned as one array: the rule stands in the plan once, not once per slot,
    where it grew to methods that the JVM would not compile.
    """
    cells = F.array(*[F.col(quoted(s)) for s in slots[: len(canonical)]]).cast("array<string>")
    cleaned = df.select(*id_cols, cells.alias("_cells"))
    ids = [F.col(quoted(c)) for c in cleaned.columns[:-1]]
    if keep is not None:
        # no condition moves below a column that is not the same each time; moved, it would
        # hold the rule of each column it names again, and more than once
        cleaned = cleaned.withColumn("_task", F.spark_partition_id()).where(keep & (F.col("_task") >= 0))
    cleaned = cleaned.select(*ids, clean_counts(F.col("_cells"), keep_null=True).alias("_counts"))
    absent = F.lit(0).cast("bigint")
    values = [F.coalesce(F.col("_counts")[i], absent) if i < len(slots) else absent for i in range(len(canonical))]
    return cleaned.select(*ids, *[v.alias(name) for v, name in zip(values, canonical)])


def ingest_wide(
    df: DataFrame,
    word: str,
    column: str | None = None,
    canonical: Sequence[str] = SLOTS,
    keep_rejects: bool = False,
) -> DataFrame:
    """One direction of a delivery in the fixed wide shape.

    Columns: base_date, line, station_no, station, the slots and their sum.
    Rows without a readable date are left out; quality.reject_counts counts them.
    """
    names, ids = _ids(df)
    keep = None if keep_rejects else F.col("base_date").isNotNull()
    wide = align_slots(filter_direction(df, word, column), ids, slot_columns(names, "clock"), canonical, keep)
    total = row_total([F.col(quoted(c)) for c in canonical])
    return wide.withColumn(f"{word}{TOTAL_WORD}", total)


def _ids(df: DataFrame) -> tuple[list[str], list[Column]]:
    """Names of a delivery's columns, and its key columns in the fixed shape."""
    names = [n for n in df.columns if n not in ORDER]
    keys = key_columns(names)
    missing = [role for role, name in keys.items() if name is None]
    if missing:
        raise ValueError(f"no column for {missing}")
    return names, [
        parse_date(F.col(quoted(keys["base_date"]))).alias("base_date"),
        line_label(F.col(quoted(keys["line"]))).alias("line"),
        F.col(quoted(keys["station_no"])).alias("station_no"),
        F.col(quoted(keys["station"])).alias("station"),
    ]


def ingest_directions(
    df: DataFrame, words: Sequence[str], column: str | None = None, canonical: Sequence[str] = SLOTS
) -> DataFrame:
    """Rows of several directions in the fixed wide shape, from one pass.

    The column `direction` holds the word; a value with several words takes the first.
    """
    column = column or next((c for c in direction_columns(df, words).values() if c), None)
    if column is None:
        raise ValueError(f"no column with any of {list(words)}")
    names, ids = _ids(df)
    kinds = [F.when(F.col(quoted(column)).contains(w), w) for w in words]
    keep = F.col("base_date").isNotNull() & F.col("direction").isNotNull()
    return align_slots(df, [*ids, F.coalesce(*kinds).alias("direction")], slot_columns(names, "clock"), canonical, keep)


def ingest_many(
    spark: SparkSession,
    paths: Sequence[str],
    word: str,
    canonical: Sequence[str] = SLOTS,
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Several deliveries of one direction; each is aligned by its own header."""
    out = None
    for path, group in delivered(spark, paths):
        wide = ingest_wide(read_delivered(spark, group), word, (columns or {}).get(path), canonical)
        out = wide if out is None else out.unionByName(wide)
    return out


def with_default(df: DataFrame, column: str, value: str) -> DataFrame:
    """Add the column with a default value when the delivery lacks it."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))
