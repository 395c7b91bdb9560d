"""Landing folders: their files, and the first records of each.

Listing is a Python data source with one partition per folder, so that file
names never gather on the driver; it only resolves the folders of a pattern.
The first records of a file are read by a task that stops after them, quoted
line breaks included. Both go through Arrow's file systems: local paths, and
the URIs that Arrow opens (hdfs, viewfs, s3 and s3a, gs, abfs).
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, file_name string, length long, modification_time timestamp, uri string"
LINE_CHARS = 1 << 20       # characters of the longest line of a readable file
_WILD = re.compile(r"[*?\[{]")
_URI_SAFE = "/-_.!~'()*,;:$&+=@"


def _base(pattern: str) -> str:
    """What stands before the path in a pattern: ``file:``, or scheme and authority."""
    parts = urlsplit(pattern)
    return f"{parts.scheme}://{parts.netloc}" if parts.netloc else "file:"


def open_store(pattern: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a pattern, and the pattern as this file system's path."""
    parts = urlsplit(pattern)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), re.sub("^file:/*", "/", pattern)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    store, root = arrow_fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}/")
    return store, root.rstrip("/") + pattern[pattern.index(parts.netloc) + len(parts.netloc):]


def _name_pattern(glob: str) -> re.Pattern:
    """One path level of a glob (``*``, ``?``, ``[...]``, ``{a,b}``) as a regular expression."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        char, close = glob[at], glob.find("]", at + 1)
        if char == "[" and close > 0:
            out, at = out + re.sub(r"^\[[!^]", "[^", glob[at:close + 1].replace("\\", r"\\")), close
        elif char in "*?":
            out += {"*": "[^/]*", "?": "[^/]"}[char]
        elif char == "{":
            out, depth = out + "(?:", depth + 1
        elif char == "}" and depth:
            out, depth = out + ")", depth - 1
        elif char == "," and depth:
            out += "|"
        else:
            out += re.escape(char)
        at += 1
    return re.compile(out + r"\Z")


def _entries(store: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    return store.get_file_info(arrow_fs.FileSelector(folder or "/", allow_not_found=True))


def _folders(store: arrow_fs.FileSystem, pattern: str) -> list[str]:
    """The folders that hold a pattern's files; only levels with wildcards are listed."""
    *levels, _ = pattern.split("/")
    found = [levels[0]]
    for level in levels[1:]:
        if _WILD.search(level):
            name = _name_pattern(level)
            found = [x.path.rstrip("/") for f in found for x in _entries(store, f)
                     if x.type == arrow_fs.FileType.Directory and name.match(x.base_name)]
        else:
            found = [f"{f}/{level}" for f in found]
    return found


def _encoded(path: str) -> str:
    """A path as Hadoop writes it in a URI: reserved ASCII characters in per cent form, others as they are."""
    return re.sub(r"[^\x80-\U0010ffff]+", lambda m: quote(m[0], safe=_URI_SAFE), path)


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)


class LandingFiles(DataSource):
    """``spark.read.format("landing_files").load(pattern)``: a row per file, contents unread."""

    @classmethod
    def name(cls) -> str:
        return "landing_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _LandingReader(self.options["path"])


class _LandingReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f) for f in _folders(*open_store(self.pattern))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, pattern = open_store(self.pattern)
        base, root, name = _base(self.pattern), open_store(f"{_base(self.pattern)}/")[1], _name_pattern(pattern.rsplit("/", 1)[1])
        for info in _entries(store, partition.value):
            # Hidden names are left out, as Spark's readers do.
            if info.type == arrow_fs.FileType.File and name.match(info.base_name) and info.base_name[0] not in "._":
                path = "/" + info.path[len(root):].lstrip("/")
                yield base + path, info.base_name, info.size, info.mtime, base + _encoded(path)


def list_landing(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per landing file matching ``pattern`` (S7), without reading contents.

    Columns: path, file_name, length, modification_time, and uri, the path in
    the encoded form that ``_metadata.file_path`` has. Zero-byte files, which
    Spark's file sources skip, are listed too. The folder is listed whenever
    the result is computed.
    """
    spark.dataSource.register(LandingFiles)
    return spark.read.format("landing_files").load(pattern)


def head_records(stream, records: int) -> list[list[str]]:
    """The first CSV records of a byte stream, which is read no further than they need; blank lines do not count.

    Raises on text that is not UTF-8 and on lines above ``LINE_CHARS``.
    """
    text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
    csv.field_size_limit(LINE_CHARS)

    def lines() -> Iterator[str]:
        while line := text.readline(LINE_CHARS):
            if len(line) == LINE_CHARS and not line.endswith(("\n", "\r")):
                raise ValueError("line too long")
            yield line

    found: list[list[str]] = []
    for fields in csv.reader(lines(), strict=False):
        if len(fields) > 1 or (fields and fields[0].strip(" ")):
            found.append(fields)
            if len(found) == records:
                break
    return found


def read_heads(files: DataFrame, records: int) -> DataFrame:
    """(uri, line_no, fields): the first ``records`` CSV records of every file of a listing.

    Files that cannot be read give no rows. Every task takes a bundle of files.
    """
    spark = files.sparkSession
    # The listing is tiny: without a count of its own, AQE would leave it to one task.
    bundles = files.select("path", "uri").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = open_store(path)
                try:
                    with store.open_input_stream(name, buffer_size=0) as stream:
                        found = head_records(stream, records)
                except (OSError, ValueError, csv.Error):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()),
                     pa.array(found, pa.list_(pa.string()))], ["uri", "line_no", "fields"])

    return bundles.mapInArrow(run, "uri string, line_no int, fields array<string>")
