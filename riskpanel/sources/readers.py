"""Readers for landed files: CSV in several encodings, JSON record lists, filtered tables.

CSV columns are bound by header name, not by position: the header lines of all
files are read first in one job, files are grouped by their header, and the
declared types are applied to the columns found. Missing-value tokens become null
in the scan's projection.

Line breaks within quotes do not bind a file to one task: the blocks of a file are
reduced to the parity of their quotes, a carry table tells each block whether it
begins inside quotes, and blocks then put their lines together to records. Only
the records that cross a block's edge are shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.text import MISSING_TOKENS, missing_to_null
from ..operators.columns import quoted
from ..session import cut_to_table, ship_package

# Byte order mark as text, and as it looks after a wrong decoding.
_MARKS = ("\ufeff", "\u00ef\u00bb\u00bf", "\u00ef..")


def clean_header(name: str | None, position: int) -> str:
    """Header text without a byte order mark; an empty header gets a positional name."""
    name = (name or "").strip()
    for mark in _MARKS:
        name = name.removeprefix(mark)
    return name or f"Unnamed: {position}"


def csv_header(spark: SparkSession, path, encoding: str, sep: str) -> list[str]:
    # Spark reads an unparsed line as one text column, so only the first split is touched.
    reader = spark.read.option("header", "false").option("encoding", encoding).option("sep", sep)
    first = reader.csv(path).first()
    return [clean_header(value, i) for i, value in enumerate(first or [])]


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First line of every file among lines with their file's path, block start and length, and size."""
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).to_pylist()
        starts = [0] + [i for i in range(1, len(files)) if files[i] != files[i - 1]]
        new = [i for i in starts if files[i] != current and batch.column(1)[i].as_py() == 0]
        current = files[-1]
        if new:
            yield pa.RecordBatch.from_arrays([pa.array([files[i] for i in new]), batch.column(4).take(pa.array(new))], names=["file", "line"])
        start, length, size = (batch.column(k)[batch.num_rows - 1].as_py() for k in (1, 2, 3))
        if start + length < size:
            return  # a block inside a file fills its task alone: no other file follows


def headers(spark: SparkSession, path: str | Sequence[str], encoding: str, sep: str) -> list[tuple[list[str], list[str]]]:
    """(header, files) for every different header among the files of a path, by one job over all files.

    Tasks on later blocks of large files stop after their first lines.
    """
    ship_package(spark)
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length", "_metadata.file_size", F.col("value").cast("binary")
    )
    first = lines.mapInArrow(_first_lines, "file string, line binary")
    groups: dict[tuple, list[str]] = {}
    for row in first.orderBy("file").collect():
        names = next(csv.reader([bytes(row["line"]).decode(encoding, "replace")], delimiter=sep), [])
        groups.setdefault(tuple(clean_header(value, i) for i, value in enumerate(names)), []).append(unquote(row["file"]))
    return [(list(header), found) for header, found in groups.items() if header] or [([], paths)]


def line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one block within a batch: file, block start, rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]), len(files)]
        for lo, hi in zip(edges, edges[1:]):
            yield files[lo], blocks[lo], batch.slice(lo, hi - lo)


def _parities(lines: pa.Array) -> np.ndarray:
    """Number of quotes modulo 2 up to the end of every line."""
    counts = pc.count_substring(lines.cast(pa.string()), '"').to_numpy(zero_copy_only=False)
    return np.cumsum(counts) % 2


def _quote_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of lines of a block: quotes modulo 2, and whether some line ends after an even or an odd number."""
    for file, block, part in line_blocks(batches):
        parity = _parities(part.column(2))
        row = [file, block, int(parity[-1]), bool((parity == 0).any()), bool((parity == 1).any())]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["file", "block", "parity", "even", "odd"])


PART = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("first", pa.bool_()), ("whole", pa.bool_()), ("text", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of a block, and the pieces at its edges under the block that their record began in."""

    def piece(whole: bool, lines: list[str], owner: int) -> tuple:
        return file, owner, block, first, whole, "\n".join(lines)

    held: tuple | None = None
    open_: list[str] = []
    for file, block, part in line_blocks(batches):
        out = []
        if held is None or held[:2] != (file, block):
            if held is not None and open_:
                out.append((held[0], held[2], held[1], held[4], False, "\n".join(open_)))
            inside, owner = bool(part.column(3)[0].as_py()), part.column(4)[0].as_py()
            # The owner of what is open: the block itself, or an earlier one until a record has ended.
            held, open_, state, first = (file, block, owner if inside else block, inside, block == 0), [], int(inside), block == 0
        owner = held[2]
        texts = part.column(2).cast(pa.string()).to_pylist()
        ends = np.flatnonzero((_parities(part.column(2)) + state) % 2 == 0)
        at = 0
        for end in ends.tolist():
            lines = open_ + texts[at : end + 1]
            out.append(piece(owner == block, lines, owner))
            open_, at, owner = [], end + 1, block
            first = False
        open_ += texts[at:]
        state = int((_parities(part.column(2))[-1] + state) % 2)
        held = (file, block, owner, held[3], first)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PART)], schema=PART)
    if held is not None and open_:
        out = [(held[0], held[2], held[1], held[4], False, "\n".join(open_))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PART)], schema=PART)


def quoted_records(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Records of CSV files as text, header records left out, and the files whose last quote is not closed.

    A file of any size is read by a task per block. Records keep line breaks
    within quotes, as ``\\n``. An unclosed quote makes the rest of its file one
    record.
    """
    ship_package(spark)
    # Lines keep their bytes until they are decoded.
    line = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")
    )
    found = lines.mapInArrow(_quote_blocks, "file string, block bigint, parity bigint, even boolean, odd boolean")
    # A block may come in several runs of lines; their order is that of the reading task.
    runs = found.withColumn("at", F.monotonically_increasing_id())
    run_order = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("parity").over(run_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    runs = runs.withColumn("before", before)
    even = F.when(F.col("before") == 0, F.col("even")).otherwise(F.col("odd"))
    odd = F.when(F.col("before") == 0, F.col("odd")).otherwise(F.col("even"))
    blocks = runs.groupBy("file", "block").agg((F.sum("parity") % 2).alias("parity"), F.max(even).alias("even"), F.max(odd).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumn("inside", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1)
    carry = carry.withColumn("ends", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    # A record that is open at a block's end began in the last block that is not in the midst of one throughout.
    begins = ~F.col("inside") | F.col("ends")
    owner = F.coalesce(F.last(F.when(begins, F.col("block")), ignorenulls=True).over(earlier), F.lit(0).cast("bigint"))
    carry = cut_to_table(carry.select("file", "block", "inside", owner.alias("owner"), (F.col("inside") != (F.col("parity") == 1)).alias("open")))
    # Only blocks that begin inside quotes; blocks are planned by the driver one by one anyway.
    inside = carry.where("inside").select("file", "block", "inside", "owner")
    placed = lines.join(F.broadcast(inside), ["file", "block"], "left").select("file", "block", "line", F.coalesce("inside", F.lit(False)), "owner")
    parts = cut_to_table(placed.mapInArrow(_records, "file string, owner bigint, block bigint, first boolean, whole boolean, text string"))
    joined = parts.where("not whole").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first")
    )
    records = parts.where("whole and not first").select("text").unionByName(joined.where("not first").select("text"))
    last = carry.groupBy("file").agg(F.max_by("open", "block").alias("open")).where("open").select("file")
    return records, last


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    encoding: str = "UTF-8",
    sep: str = ",",
    missing: Sequence[str] = MISSING_TOKENS,
    multi_line: bool = False,
    select_declared: bool = False,
) -> DataFrame:
    """CSV with a header line. Columns absent from ``schema`` are text.

    Files may order their columns differently and may have columns of their own,
    null elsewhere. A declared column that a file lacks is an error.
    ``select_declared`` returns only the declared columns, which prunes the
    scan. ``multi_line`` reads line breaks within quotes, a large file by many
    tasks; a header is one line.
    """
    types = {f.name: f.dataType for f in schema.fields} if schema else {}

    def typed(name: str) -> Column:
        value = missing_to_null(quoted(name), missing) if missing else quoted(name)
        kind = types.get(name, T.StringType())
        if isinstance(kind, T.StringType):
            return value.alias(name)
        if isinstance(kind, T.LongType):
            # Integer columns with missing cells are often written as 2014.0.
            return value.try_cast("decimal(38,6)").try_cast("bigint").alias(name)
        return value.try_cast(kind).alias(name)

    parts = []
    for names, files in headers(spark, path, encoding, sep):
        absent = [n for n in types if n not in names]
        if absent:
            raise ValueError(f"{files}: columns not found: {absent}")
        # Everything is scanned as text, then cast, so a token such as "NA" in a number column is null.
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        options = {"header": "true", "enforceSchema": "true", "encoding": encoding, "sep": sep, "quote": '"', "escape": '"'}
        if multi_line and names:
            records, _ = quoted_records(spark, files, encoding)
            cells = F.from_csv(F.col("text"), ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep, "quote": '"', "escape": '"'})
            raw = records.where("text <> ''").select(cells.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
        else:
            raw = spark.read.schema(text).options(**options).csv(files)
        parts.append(raw.select(*[typed(n) for n in (list(types) if select_declared else names)]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_two_line_csv(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """CSV whose data starts with a second header line; both stay for ``promote_header``.

    Columns are named by position so that repeated or dotted codes do no harm;
    the code line itself is the file header and is skipped.
    """
    names = csv_header(spark, path, encoding, ",")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    return (
        spark.read.schema(schema).option("header", "true").option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower()).csv(path)
    )


def read_json_records(
    spark: SparkSession,
    path: str,
    record_schema: T.StructType,
    at: str = "result.records",
    one_per_file: bool = False,
) -> DataFrame:
    """Rows of a record list inside JSON documents, one per line or one per file.

    One document per line lets a large file be split. With ``one_per_file`` a
    document may span lines, and each file is read by one task.
    """
    schema: T.DataType = T.ArrayType(record_schema)
    for name in reversed(at.split(".")):
        schema = T.StructType([T.StructField(name, schema)])
    return (
        spark.read.schema(schema).option("multiLine", str(one_per_file).lower()).json(path)
        .select(F.explode(F.col(at)).alias("record")).select("record.*")
    )


def table_from_spec(records: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Project records by a column spec, output name to a path such as ``owner.name``."""
    return records.select(*[F.col(path).alias(name) for name, path in spec.items()])


def json_fields(df: DataFrame, column: str, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add fields of a JSON text column; the spec maps a name to (path, type)."""
    return df.select(
        "*",
        *[
            F.get_json_object(quoted(column), f"$.{path}").try_cast(kind).alias(name)
            for name, (path, kind) in spec.items()
        ],
    )


def filtered_scan(
    source: DataFrame, condition: Column | str, columns: Sequence[str] = ()
) -> DataFrame:
    """Filtered, pruned scan; both reach a Parquet or JDBC source."""
    found = source.where(condition)
    return found.select(*[quoted(c) for c in columns]) if columns else found
