"""Day archives of trades as a data source of Spark's, `trade_archives`: one task an archive, streamed in Arrow batches, archives out of range never opened."""

from __future__ import annotations

import csv
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from fnmatch import fnmatchcase
from typing import IO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, InputPartition, LessThan, WriterCommitMessage

from tickspark.functions.scalars import day_of

#: The seven columns of a trade file, in order, with their types.
TRADE_COLUMNS = {"agg_trade_id": "bigint", "price": "double", "quantity": "double", "first_trade_id": "bigint", "last_trade_id": "bigint", "timestamp": "bigint", "buyer_is_maker": "boolean"}
STAMPED = r"(\d{8}_\d{6})__(\d{8}_\d{6})(?:\.[^/]*)?$"
DATED = r"(\d{4}-\d{2}-\d{2})(?:\.[^/]*)?$"
#: The span of an archive whose name tells none, so that it is in every range.
EVER = (-(2**63), 2**63 - 1)
FORMAT = "trade_archives"
ROWS = ", ".join(f"{c} string" for c in TRADE_COLUMNS) + ", path string, first_ms bigint, last_ms bigint"


def span_of(name: str) -> tuple[int, int]:
    """[first, last) in milliseconds from a file's name: start__end or one UTC day at its end; EVER without either, or where it is no time."""
    try:
        if m := re.search(STAMPED, name):
            first, last = (datetime.strptime(t, "%Y%m%d_%H%M%S").replace(tzinfo=UTC) for t in m.groups())
        elif m := re.search(DATED, name):
            first = datetime.strptime(m[1], "%Y-%m-%d").replace(tzinfo=UTC)
            last = first + timedelta(days=1)
        else:
            return EVER
    except ValueError:
        return EVER
    return round(first.timestamp() * 1000), round(last.timestamp() * 1000)


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    path = re.sub("^file:/+", "/", path)
    return pa_fs.FileSystem.from_uri(path)


def archives_at(path: str) -> list[str]:
    """The .zip files that path names: itself, those in a folder, or those that its wildcards match, sorted."""
    system, plain = file_system(path)
    parts = plain.rstrip("/").split("/")
    wild = next((i for i, part in enumerate(parts) if re.search(r"[*?\[]", part)), None)
    if wild is None:
        if system.get_file_info(plain).type == pa_fs.FileType.File:
            return [plain]
        found = system.get_file_info(pa_fs.FileSelector(plain))
        return sorted(f.path for f in found if f.type == pa_fs.FileType.File and f.base_name.lower().endswith(".zip") and f.base_name[0] not in "._")
    found = system.get_file_info(pa_fs.FileSelector("/".join(parts[:wild]) or "/", recursive=wild < len(parts) - 1))
    fits = lambda p: len(p.split("/")) == len(parts) and all(fnmatchcase(a, b) for a, b in zip(p.split("/"), parts, strict=True))
    return sorted(f.path for f in found if f.type == pa_fs.FileType.File and f.base_name[0] not in "._" and fits(f.path))


def text_batches(data: IO[bytes], rows: int, block: int) -> Iterator[pa.RecordBatch]:
    """The seven texts of each line, header or not: a block is parsed at a time. Lines of fewer fields get nulls, further fields are ignored; order isn't kept."""
    names = list(TRADE_COLUMNS)
    odd: list[str] = []

    def aside(row: pa_csv.InvalidRow) -> str:
        odd.append(row.text)
        return "skip"

    try:
        parsed = pa_csv.open_csv(
            data, pa_csv.ReadOptions(column_names=names, block_size=block, use_threads=False), pa_csv.ParseOptions(newlines_in_values=True, invalid_row_handler=aside), pa_csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()))
        )
    except pa.ArrowInvalid as e:
        if "Empty CSV" not in str(e):
            raise
        parsed = iter(())
    for batch in parsed:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        if odd:
            yield salvaged(odd)
            odd.clear()
    if odd:
        yield salvaged(odd)


def salvaged(lines: list[str]) -> pa.RecordBatch:
    """Lines of too few or too many fields as seven texts."""
    n = len(TRADE_COLUMNS)
    fields = [[*row[:n], *[None] * (n - len(row))] for row in csv.reader(lines)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*fields, strict=True)], list(TRADE_COLUMNS))


@dataclass
class Archive(InputPartition):
    path: str
    first_ms: int
    last_ms: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, rows: int, block: int):
        self.path, self.rows, self.block = path, rows, block
        self.first_below, self.last_above = 2**63, -(2**63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """first_ms < x and last_ms > x choose archives by name, wholly; Spark does the rest."""
        for f in filters:
            if isinstance(f, LessThan) and f.attribute == ("first_ms",):
                self.first_below = min(self.first_below, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("last_ms",):
                self.last_above = max(self.last_above, f.value)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        found = [Archive(p, *span_of(p)) for p in archives_at(self.path)]
        if not found:
            raise ValueError(f"no archive at {self.path}")
        return [a for a in found if a.first_ms < self.first_below and a.last_ms > self.last_above]

    def read(self, archive: Archive | None) -> Iterator[pa.RecordBatch]:
        if archive is None:  # no archive is in range
            return
        system, _ = file_system(self.path)
        with system.open_input_file(archive.path) as held, zipfile.ZipFile(held) as content:
            inner = next((n for n in content.namelist() if n.lower().endswith(".csv")), None)
            if inner is None:
                raise ValueError(f"no .csv in {archive.path}")
            with content.open(inner) as data:
                for batch in text_batches(data, self.rows, self.block):
                    n = batch.num_rows
                    extra = [pa.array([archive.path] * n, pa.string()), pa.array([archive.first_ms] * n, pa.int64()), pa.array([archive.last_ms] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*TRADE_COLUMNS, "path", "first_ms", "last_ms"])


@dataclass
class Moves(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class ArchiveWriter(DataSourceArrowWriter):
    """An archive for each run of equal (symbol, day) in a task's rows, written under a hidden name and renamed once all tasks are done.

    A task that is lost leaves hidden files at most, which readers pass over.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        pairs: list[tuple[str, str]] = []
        key, closing = None, []
        for batch in iterator:
            keys = list(zip(batch["symbol"].to_pylist(), batch["day"].to_pylist(), strict=True))
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key or not closing:
                    for c in reversed(closing):
                        c.close()
                    key = keys[start]
                    name = "-".join(quote(str(part), safe="") for part in (key[0], key[1] or "undated"))
                    pairs.append((f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}.zip"))
                    stream = system.open_output_stream(pairs[-1][0])
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    closing = [stream, archive, archive.open(f"{name}.csv", "w", force_zip64=True)]
                pa_csv.write_csv(batch.select(list(TRADE_COLUMNS)).slice(start, end - start), closing[-1], pa_csv.WriteOptions(include_header=False))
        for c in reversed(closing):
            c.close()
        return Moves(pairs)

    def commit(self, messages: list[Moves | None]) -> None:
        system, _ = file_system(self.path)
        for before, after in (pair for m in messages if m for pair in m.pairs):
            system.move(before, after)

    def abort(self, messages: list[Moves | None]) -> None:
        system, _ = file_system(self.path)
        for before, _ in (pair for m in messages if m for pair in m.pairs):
            system.delete_file(before)


class TradeArchives(DataSource):
    """Options: path; rows, at most in a batch; block, the bytes of text parsed at a time, which a line mustn't exceed."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rows", 250_000)), int(self.options.get("block", 4 << 20)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added, or replaced by name; use append")
        return ArchiveWriter(self.options["path"])


def read_archives(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, rows: int = 250_000) -> DataFrame:
    """The seven texts of every line of the first .csv in each archive, its path and the span that its name tells; with a range, only archives whose span overlaps [start_ms, end_ms) are opened.

    The range is a filter on the span, and the source takes it over, so any filter on first_ms and last_ms that a caller adds later does the same. An archive
    without .csv is an error once read, and so is a place without archives.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default, and an error for a source that asks for filters
    spark.dataSource.register(TradeArchives)
    found = spark.read.format(FORMAT).option("rows", rows).load(path)
    if start_ms is not None:
        found = found.where(F.col("last_ms") > start_ms)
    return found if end_ms is None else found.where(F.col("first_ms") < end_ms)


def write_archives(raw: DataFrame, path: str) -> None:
    """raw (symbol and the seven texts) as an archive for each symbol and UTC day, named after both; rows without a readable time are `undated`. An archive of the same name is replaced.

    An archive can't be split, so a symbol's day is one task, which passes it on batch by batch.
    """
    raw.sparkSession.dataSource.register(TradeArchives)
    texts = [F.col(c).cast("string").alias(c) for c in TRADE_COLUMNS]
    day = day_of(F.trim(F.col("timestamp").cast("string")).try_cast("bigint")).cast("string")
    rows = raw.select(*texts, F.col("symbol").cast("string").alias("symbol"), day.alias("day"))
    rows.repartition("symbol", "day").sortWithinPartitions("symbol", "day").write.format(FORMAT).mode("append").save(path)
