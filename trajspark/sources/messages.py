"""Recorded messages as a Spark data source, in batches and as a stream.

``register(spark)``, then ``spark.read.format("bag_messages").option("path", root)`` or ``spark.readStream`` likewise. A bag is a
folder below the root (its name, or bag=name as Spark writes it), with its decoded messages in Parquet files of the columns ``SCHEMA`` (those that a file lacks are
null; decoding of recordings stays outside). Files in the root itself are shared by many bags, and their column ``bag`` tells
them; catalogues of very many short bags are written so, as a folder each costs more than its messages. Partitions are row
groups, by bag and file; small ones share a partition where they are many. The options ``topics`` and
``bags``, JSON lists, limit what is read: folders of other bags are not opened, row groups that by their statistics hold none
of the topics or, in shared files, of the bags are not read, other messages don't leave the reader. They are options and not filters that Spark pushes, as
Spark 4.1 keeps one reader for all scans of a DataFrame: a filter pushed into one scan of a plan would limit the others.
A stream's offset is the last file by time of change and name, so every file
is read once, whichever bag it belongs to; files must not change once they are there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "bag string, topic string, msg_type string, ts_ns long, seq long, names array<string>, positions array<double>, payload binary"
ARROW = pa.schema([
    ("bag", pa.string()), ("topic", pa.string()), ("msg_type", pa.string()), ("ts_ns", pa.int64()), ("seq", pa.int64()),
    ("names", pa.list_(pa.string())), ("positions", pa.list_(pa.float64())), ("payload", pa.binary()),
])
NAME = "bag_messages"
#: Up to FEW row groups are a partition each; more are put together to PACK bytes, or less where that would give fewer than
#: FEW partitions. Opening a file counts as so many bytes.
FEW, PACK, OPEN = 64, 16 << 20, 64 << 10


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    spark.dataSource.register(Messages)


def read_messages(spark: SparkSession, root: str, topics: list[str] | None = None, bags: list[str] | None = None, stream: bool = False) -> DataFrame:
    """The messages of the bags below ``root``, of some topics and bags where they are given."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(NAME)
    for name, values in (("topics", topics), ("bags", bags)):
        reader = reader.option(name, json.dumps(values)) if values is not None else reader
    return reader.load(root)


@dataclass
class Part(InputPartition):
    """A row group; ``bag`` is None in a shared file, of which ``bags`` limits the rows."""

    bag: str | None
    path: str
    group: int
    topics: tuple[str, ...] | None
    bags: tuple[str, ...] | None = None


@dataclass
class Pack(InputPartition):
    parts: tuple[Part, ...]


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _listed(root: str) -> list[tuple[int, str, str | None]]:
    """(time of change, path, bag) of all message files, in order; no bag for shared ones."""
    from pyarrow import fs

    files, base = _filesystem(root)
    found = []
    for f in files.get_file_info(fs.FileSelector(base, recursive=True)):
        inner = f.path[len(base.rstrip("/")) + 1 :]
        if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
            found.append((int(f.mtime_ns or 0), f.path, inner.rpartition("/")[0].removeprefix("bag=") if "/" in inner else None))
    return sorted(found, key=lambda x: x[:2])


def _parts(root: str, listed: list[tuple[int, str, str | None]], topics: tuple[str, ...] | None, bags: set[str] | None = None) -> list[Part | Pack]:
    """A partition for each row group that may hold one of the topics and bags, by its statistics, or for some of them."""
    import pyarrow.parquet as pq

    files, _ = _filesystem(root)
    some = None if bags is None else tuple(sorted(bags))

    def may_hold(meta, names: list[str], g: int, name: str, values: tuple[str, ...] | None) -> bool:
        known = meta.row_group(g).column(names.index(name)).statistics if values is not None and name in names else None
        return values is None or known is None or not known.has_min_max or any(known.min <= v <= known.max for v in values)

    def groups(file: tuple[int, str, str | None]) -> list[tuple[int, Part]]:
        _, path, bag = file
        if bag is not None and bags is not None and bag not in bags:
            return []
        with files.open_input_file(path) as source:
            meta = pq.ParquetFile(source).metadata
        names = meta.schema.names
        if bag is None and "bag" not in names:
            return []
        mine = some if bag is None else None
        kept = [g for g in range(meta.num_row_groups) if may_hold(meta, names, g, "topic", topics) and may_hold(meta, names, g, "bag", mine)]
        return [(meta.row_group(g).total_byte_size + OPEN, Part(bag, path, g, topics, mine)) for g in kept]

    with ThreadPoolExecutor(16) as pool:
        found = [x for of_file in pool.map(groups, listed) for x in of_file]
    return [part for _, part in found] if len(found) <= FEW else _packed(found)


def _packed(found: list[tuple[int, Part]]) -> list[Pack]:
    """Parts with their bytes, put together in order."""
    limit, out, held = min(PACK, sum(n for n, _ in found) // FEW), [[]], 0
    for n, part in found:
        if out[-1] and held + n > limit:
            out.append([])
            held = 0
        out[-1].append(part)
        held += n
    return [Pack(tuple(parts)) for parts in out]


def _read(root: str, partition: Part | Pack | None) -> Iterator[pa.RecordBatch]:
    # Spark asks without a partition where there are none
    for part in () if partition is None else partition.parts if isinstance(partition, Pack) else (partition,):
        yield from _read_group(root, part)


def _read_group(root: str, part: Part) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    files, _ = _filesystem(root)
    with files.open_input_file(part.path) as source:
        f = pq.ParquetFile(source)
        have = [c for c in ARROW.names if c in f.schema_arrow.names]
        for b in f.iter_batches(row_groups=[part.group], columns=have):
            if part.topics is not None and "topic" in have:
                b = b.filter(pc.is_in(b.column("topic"), pa.array(part.topics, pa.string())))
            if part.bags is not None:
                b = b.filter(pc.is_in(b.column("bag"), pa.array(part.bags, pa.string())))
            columns = [pa.array([part.bag] * b.num_rows, pa.string()) if x.name == "bag" and part.bag is not None else b.column(x.name).cast(x.type) if x.name in have else pa.nulls(b.num_rows, x.type) for x in ARROW]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, root: str, topics: tuple[str, ...] | None, bags: set[str] | None):
        self.root, self.topics, self.bags = root, topics, bags

    def partitions(self) -> list[Part | Pack]:
        return _parts(self.root, _listed(self.root), self.topics, self.bags)

    def read(self, partition: Part | Pack | None) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, topics: tuple[str, ...] | None, bags: set[str] | None):
        self.root, self.topics, self.bags = root, topics, bags

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        listed = _listed(self.root)
        return {"time": listed[-1][0], "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part | Pack]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _parts(self.root, [x for x in _listed(self.root) if low < x[:2] <= high], self.topics, self.bags)

    def read(self, partition: Part | Pack | None) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class Messages(DataSource):
    """Options: ``path``, the root of the bags; ``topics`` and ``bags``. S12."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _limits(self) -> tuple[str, tuple[str, ...] | None, set[str] | None]:
        topics, bags = (json.loads(self.options[k]) if k in self.options else None for k in ("topics", "bags"))
        return self.options["path"], None if topics is None else tuple(topics), None if bags is None else set(bags)

    def reader(self, schema) -> Reader:
        return Reader(*self._limits())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._limits())
