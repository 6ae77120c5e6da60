"""WARC archives as a Spark data source.

Writing makes one archive per task and a manifest of the committed ones, so a
repeated or lost task leaves nothing that is read. Reading plans partitions of
whole files, takes filters on header columns into the scan, parses a record's
headers first, and seeks past payloads that no kept row needs.

The module is pickled by value when it is registered, so it needs no import on
the executors and uses installed libraries only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import sys
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

NAME = "riskpanel_warc"
MANIFEST = "_MANIFEST.json"
# Header names by column, and the profile of a revisit.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length bigint, payload binary"
)
COLUMNS = [*HEADERS, "payload"]
# A partition reads files of about this many bytes together.
PARTITION_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder name with or without a scheme."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def record(row: dict) -> bytes:
    """One record. A revisit has no payload; its digest and length are those of the full payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status if revisit else status + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"])]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool):
        self.path, self.compress = path, compress

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}", None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
                    data = record(row)
                    out.write(gzip.compress(data, 6, mtime=0) if self.compress else data)  # a member per record
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(m.file for m in messages if m is not None and m.file)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/{m.file}")


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


def header_test(f: Filter):
    """A test of a parsed header row for a pushed filter, or None if it stays with Spark."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in HEADERS:
        return None
    value = getattr(f, "value", None)
    known = lambda ok: lambda row: row[column] is not None and ok(row[column])
    tests = {
        EqualTo: lambda: known(lambda x: x == value), EqualNullSafe: lambda: lambda row: row[column] == value,
        In: lambda: known(lambda x: x in value), IsNull: lambda: lambda row: row[column] is None,
        IsNotNull: lambda: lambda row: row[column] is not None, GreaterThan: lambda: known(lambda x: x > value),
        GreaterThanOrEqual: lambda: known(lambda x: x >= value), LessThan: lambda: known(lambda x: x < value),
        LessThanOrEqual: lambda: known(lambda x: x <= value), StringStartsWith: lambda: known(lambda x: x.startswith(value)),
        StringEndsWith: lambda: known(lambda x: x.endswith(value)), StringContains: lambda: known(lambda x: value in x),
    }
    make = tests.get(type(f))
    return make() if make else None


def parse_head(file) -> dict | None:
    """Header fields of the next record, names folded; None at the end. A broken record raises."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := file.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("archive ends within headers")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def header_row(fields: dict) -> dict:
    row = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            row[column] = row[column].strip("<>")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] is not None else None
    return row


def payload_of(fields: dict, block: bytes) -> bytes | None:
    """The block, behind its HTTP head where it has one; none for a revisit."""
    if fields.get("warc-type") == "revisit":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if header_test(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, folder = file_system(self.path)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(folder)) if i.base_name.endswith((".warc", ".warc.gz"))]
        if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as manifest:
                committed = set(json.loads(manifest.read()))
            infos = [i for i in infos if i.base_name in committed]
        groups, size = [[]], 0
        for info in sorted(infos, key=lambda i: -i.size):
            if groups[-1] and size + info.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(info.base_name)
            size += info.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(self.path)
        tests = [header_test(f) for f in self.filters]
        rows: list[dict] = []
        size = 0
        for name in partition.value:
            with fs.open_input_file(f"{folder}/{name}") as raw:
                file = io.BufferedReader(raw, 1 << 18)
                if name.endswith(".gz"):
                    file = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 18)
                while (fields := parse_head(file)) is not None:
                    length = int(fields["content-length"])
                    row = header_row(fields)
                    if not all(test(row) for test in tests):
                        file.seek(length, io.SEEK_CUR)
                        continue
                    if self.with_payload:
                        block = file.read(length)
                        if len(block) < length:
                            raise ValueError(f"archive {name} ends within a record")
                        row["payload"] = payload_of(fields, block)
                        size += length
                    else:
                        file.seek(length, io.SEEK_CUR)
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        types = {"payload_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)


class WarcSource(DataSource):
    """Options: ``path``, ``payload`` (false: never decode payloads), ``compress`` (a gzip member per record)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compress", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Register the source and let filters reach it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder: those the manifest names, or all where there is none."""
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, compress: bool = False) -> None:
    """Write rows (record_type, record_id, target_uri, date, refers_to, payload) to a new folder of archives."""
    register(records.sparkSession)
    records.write.format(NAME).option("compress", str(compress).lower()).mode("append").save(path)
