"""Records of JSON documents of any size and line shape, read by a task per block.

The text is read in pieces that end at a closing brace, so a document in one
line is split like any text. A block is reduced to what it does to the reading
state for either state it may begin in: whether a string is open, and the depth of
brackets. A carry table over the blocks gives every block its true state, and in the
same way the list that the depth belongs to. Blocks then cut out their records; only
those across a block's edge are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..session import cut_to_table, ship_package
from .readers import line_blocks

_TEXT = r'(?:[^"\\]|\\.)*'
# An open bracket with its key, a string that may go on in the next piece, or a bracket.
_TOKEN = re.compile(rf'"({_TEXT})"\s*:\s*([{{\[])|"{_TEXT}("|\Z)|([{{}}\[\]])', re.DOTALL)
_STRING_END = re.compile(rf'{_TEXT}"', re.DOTALL)


def _brackets(text: Column) -> Column:
    opened = F.length(text) - F.length(F.translate(text, "{[", ""))
    return opened - (F.length(text) - F.length(F.translate(text, "}]", "")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of pieces of a block: quotes modulo 2, and the change of depth if it begins outside or inside a string."""
    for file, block, part in line_blocks(batches):
        odd, outside, inside = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4))
        before = (np.cumsum(odd) - odd) % 2
        row = [file, block, int(odd.sum() % 2), *(int(np.where(before == s, outside, inside).sum()) for s in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["file", "block", "parity", "outside", "inside"])


class _Reader:
    """The reading state within one block, and what the pieces of the block open."""

    def __init__(self, path: Sequence[str], inside: bool, depth: int, flags: Sequence[bool | None]):
        self.path, self.inside, self.depth, self.flags = path, inside, depth, list(flags)

    @property
    def in_record(self) -> bool:
        return self.depth > len(self.path) + 1 and all(self.flags)

    def _open(self, key: str | None, bracket: str) -> bool:
        """Whether a record begins: every container on the way bears its name, the last is a list, and an object opens in it."""
        level = self.depth
        self.depth += 1
        if level > len(self.path) + 1:
            return False
        named = level in (0, len(self.path) + 1) or key == self.path[level - 1]
        self.flags[level] = named and bracket == ("[" if level == len(self.path) else "{")
        return level == len(self.path) + 1 and all(self.flags)

    def read(self, piece: str) -> Iterator[tuple[bool, int]]:
        """Places in the piece where a record begins (True, start) or ends (False, end)."""
        at = 0
        if self.inside:
            end = _STRING_END.match(piece)
            if end is None:
                return
            self.inside, at = False, end.end()
        for token in _TOKEN.finditer(piece, at):
            bracket = token[2] or token[4]
            if bracket is None:
                self.inside = token[3] == ""
            elif bracket in "{[":
                if self._open(token[1], bracket):
                    yield True, token.end() - 1
            else:
                self.depth -= 1
                if bracket == "}" and self.depth == len(self.path) + 1 and all(self.flags):
                    yield False, token.end()


def _opened(path: Sequence[str]):
    """Per block: whether the container last opened in it at a level is the one of the path, null where none was."""

    def row(held: tuple, reader: _Reader) -> pa.RecordBatch:
        flags = pa.array([reader.flags], pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), flags], names=["file", "block", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for file, block, part in line_blocks(batches):
            if held != (file, block):
                if held is not None:
                    yield row(held, reader)
                held = file, block
                reader = _Reader(path, bool(part.column(3)[0].as_py()), part.column(4)[0].as_py(), [None] * (len(path) + 2))
            for piece in part.column(2).to_pylist():
                for _ in reader.read(piece + "}"):
                    pass
        if held is not None:
            yield row(held, reader)

    return run


_PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("head", pa.bool_()), ("ended", pa.bool_()), ("text", pa.string())])


def _cut(path: Sequence[str]):
    """Whole records of a block, and the parts of records that began in an earlier block (head) or do not end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, parts, head, going = None, None, [], False, False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PART)], schema=_PART)
            out.clear()
            return batch

        for file, block, part in line_blocks(batches):
            if held != (file, block):
                if held is not None and parts:
                    out.append((*held, head, False, "".join(parts)))
                held = (file, block)
                reader = _Reader(path, bool(part.column(3)[0].as_py()), part.column(4)[0].as_py(), part.column(5)[0].as_py())
                parts, head = [], reader.in_record
                going = head
            for piece in part.column(2).to_pylist():
                piece += "}"
                start = 0
                for begins, place in reader.read(piece):
                    if begins:
                        start, going = place, True
                    elif going:
                        out.append((file, block, head, True, "".join([*parts, piece[start:place]])))
                        parts, head, going = [], False, False
                if going:
                    parts.append(piece[start:])
            if out:
                yield flush()
        if held is not None and parts:
            out.append((*held, head, False, "".join(parts)))
            yield flush()

    return run


def json_document_records(spark: SparkSession, path: str | Sequence[str], at: str = "result.records") -> DataFrame:
    """The objects of the list ``at`` of every document of the files, as JSON texts in a column ``text``.

    Documents may span lines or share one, and a file may hold several. An empty ``at``
    takes documents that are lists themselves. Where a file holds no such list, or the list
    is empty, there are no rows; elements that are no objects are left out. Keys are
    compared as written, so a key of the path written with escapes is not found. A
    document that is cut off raises.
    """
    names = at.split(".") if at else []
    if any(c in name for name in names for c in '}"\\'):
        raise ValueError(f"{at}: quotes, backslashes and closing braces are not supported in the path")
    ship_package(spark)
    pieces = spark.read.option("lineSep", "}").text([path] if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece")
    )
    # Without escapes, a piece's parts between quotes are in turn of either state.
    cells = F.split(F.regexp_replace(F.concat("piece", F.lit("}")), r"(?s)\\.", ""), '"')
    turn = [F.array_join(F.filter("cells", of), "") for of in (lambda _, i: i % 2 == 0, lambda _, i: i % 2 == 1)]
    counted = pieces.select("file", "block", cells.alias("cells")).select("file", "block", (F.size("cells") - 1) % 2, *[_brackets(x) for x in turn])
    found = counted.mapInArrow(_runs, "file string, block bigint, parity bigint, outside bigint, inside bigint")
    # A block may come in several runs of pieces; their order is that of the reading task.
    order = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.withColumn("at", F.monotonically_increasing_id()).withColumn("odd", F.coalesce(F.sum("parity").over(order), F.lit(0)) % 2 == 1)
    either = [F.sum(F.when(F.col("odd"), b).otherwise(F.col(a))).alias(a) for a, b in (("outside", F.col("inside")), ("inside", F.col("outside")))]
    blocks = runs.groupBy("file", "block").agg((F.sum("parity") % 2).alias("parity"), *either)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumn("open", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    carry = carry.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    # One row per block; blocks are planned by the driver one by one anyway.
    carry = cut_to_table(carry.select("file", "block", "open", "depth", "change"))
    # The last piece is read as closed, so a whole document ends at depth 0 or below.
    cut = carry.groupBy("file").agg(F.sum("change").alias("depth")).where("depth > 0").orderBy("file").limit(5).collect()
    if cut:
        raise ValueError(f"documents are cut off: {[row['file'] for row in cut]}")
    carry = carry.drop("change")
    placed = pieces.join(F.broadcast(carry), ["file", "block"]).select("file", "block", "piece", "open", "depth")
    opened = placed.mapInArrow(_opened(names), "file string, block bigint, flags array<boolean>")
    levels = [F.coalesce(F.last(F.get("flags", F.lit(k)), ignorenulls=True).over(earlier), F.lit(False)) for k in range(len(names) + 2)]
    lists = cut_to_table(opened.select("file", "block", F.array(*levels).alias("flags")))
    placed = placed.join(F.broadcast(lists), ["file", "block"])
    parts = cut_to_table(placed.mapInArrow(_cut(names), "file string, block bigint, head boolean, ended boolean, text string"))
    # A record that goes on began in the last block before that has an open one of its own.
    edges = parts.where("head or not ended")
    before = Window.partitionBy("file").orderBy("block", F.col("head").desc())
    owner = F.last(F.when(~F.col("head"), F.col("block")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owners = edges.select("file", "block", "head", owner.alias("owner"))
    joined = edges.join(F.broadcast(owners), ["file", "block", "head"]).groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"),
        F.max("ended").alias("ended"),
    )
    return parts.where("ended and not head").select("text").unionByName(joined.where("ended").select("text"))


def read_json_document(spark: SparkSession, path: str | Sequence[str], record_schema: T.StructType, at: str = "result.records") -> DataFrame:
    """Rows of a record list inside JSON documents, a large document by many tasks; see ``json_document_records``."""
    records = json_document_records(spark, path, at)
    return records.select(F.from_json("text", record_schema).alias("record")).select("record.*")
