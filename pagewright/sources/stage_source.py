"""Stage artifacts as a Spark data source: spark.read.format("pagewright_stage") and df.write.format("pagewright_stage")."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright import schemas

NAME = "pagewright_stage"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it, of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _held(store: fs.FileSystem, folder: str, stage: str) -> list[str]:
    """The stage's shards in data/, else in the folder itself."""
    for place in (f"{folder}/data", folder):
        found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
        if own := sorted(f.path for f in found if f.is_file and f.base_name.startswith(f"{stage}-") and f.base_name.endswith(".parquet")):
            return own
    return []


def _pointed(path: str, stage: str | None) -> tuple[list[str], str]:
    """The shards that a path means, and their stage: a file, or a folder, where the first stage that has shards counts unless one is named."""
    store, place = _store(path)
    if store.get_file_info(place).is_file:
        name = place.rpartition("/")[2].partition("-")[0]
        return [place], stage or (name if name in schemas.STAGES else schemas.STAGES[0])
    for own in [stage] if stage else schemas.STAGES:
        if found := _held(store, place, own):
            return found, own
    return [], stage or schemas.STAGES[0]


@dataclass
class _Shard(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, shards: list[str], schema):
        self.path, self.shards, self.schema = path, shards, schema

    def partitions(self) -> list[InputPartition]:
        return [_Shard(x) for x in self.shards]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        """The columns that the shard has, the others null, batch by batch."""
        kind = to_arrow_schema(self.schema)
        if partition is None:
            return
        with _store(self.path)[0].open_input_file(partition.path) as held:
            file = pq.ParquetFile(held)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(columns=[n for n in kind.names if n in there]):
                columns = [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in kind]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """Tasks write shards aside; commit moves those of the tasks that counted into data/ and publishes a manifest, abort leaves nothing."""

    def __init__(self, path: str, stage: str, schema, rows: int, overwrite: bool):
        self.path, self.stage, self.schema, self.rows, self.overwrite, self.job = path, stage, schema, rows, overwrite, uuid.uuid4().hex[:12]

    def _aside(self) -> tuple[fs.FileSystem, str, str]:
        store, place = _store(self.path)
        return store, place, f"{place}/_pending-{self.job}"

    def write(self, iterator) -> _Written:
        store, _, aside = self._aside()
        store.create_dir(aside, recursive=True)
        kind, files, held = to_arrow_schema(self.schema), [], []

        def flush() -> None:
            name = f"{self.stage}-{uuid.uuid4().hex}.parquet"
            columns = [pa.array([r[i] for r in held], f.type) for i, f in enumerate(kind)]
            with store.open_output_stream(f"{aside}/{name}") as out:
                pq.write_table(pa.Table.from_arrays(columns, schema=kind), out, compression="zstd")
            files.append([name, len(held)])
            held.clear()

        for row in iterator:
            held.append(tuple(row))
            if len(held) == self.rows:
                flush()
        if held:
            flush()
        return _Written(files)

    def commit(self, messages) -> None:
        store, place, aside = self._aside()
        earlier = _held(store, place, self.stage) if self.overwrite else []
        store.create_dir(f"{place}/data", recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        for name, _ in files:
            store.move(f"{aside}/{name}", f"{place}/data/{name}")
        with store.open_output_stream(f"{place}/data/_manifest-{self.stage}-{self.job}.json") as out:
            out.write(json.dumps({"stage": self.stage, "shards": sorted(files), "rows": sum(n for _, n in files)}).encode())
        for old in earlier:
            store.delete_file(old)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _, aside = self._aside()
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


class StageSource(DataSource):
    """Options: path; stage (pages, layout, raw, train, volumes), else the first that has shards; shard_rows of the shards that are written."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schemas.ddl(_pointed(self.options["path"], self.options.get("stage"))[1])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], _pointed(self.options["path"], self.options.get("stage"))[0], schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("stage") or schemas.STAGES[0], schema, int(self.options.get("shard_rows", 1000)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StageSource)
