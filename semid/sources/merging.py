"""A Parquet sink whose repeated tasks leave one copy, and the merging of its files.

``spark.dataSource.register(MergedSink)``, then ``df.write.format("merged").mode("append").save(path)``.
Tasks write files of their own into a hidden folder; only the files of attempts that the
driver heard of are moved into ``path`` when all are done, and an aborted write leaves
nothing. ``merge_files`` is a Spark job that rewrites what is there as files of a size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

HIDDEN = "_staged"


def _store(path: str):
    """The file system of ``path`` and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the Parquet files in ``path``, those in hidden folders not."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".parquet"))


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.job = path, replace, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        import pyarrow.parquet as pq

        store, base = _store(self.path)
        writer, name, rows = None, None, 0
        for batch in iterator:
            if writer is None:
                store.create_dir(f"{base}/{HIDDEN}/{self.job}", recursive=True)
                name = f"part-{uuid.uuid4().hex}.parquet"
                writer = pq.ParquetWriter(f"{base}/{HIDDEN}/{self.job}/{name}", batch.schema, filesystem=store)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer:
            writer.close()
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _store(self.path)
        old = files(self.path) if self.replace else []
        for m in messages:
            if m and m.name:
                store.move(f"{base}/{HIDDEN}/{self.job}/{m.name}", f"{base}/{m.name}")
        for path, _ in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{HIDDEN}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{HIDDEN}/{self.job}")


class MergedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "merged"

    def writer(self, schema, overwrite: bool) -> _Writer:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return _Writer(options["path"], overwrite or options.get("replace") == "true")


def write_merged(df: DataFrame, path: str, post: tuple[Callable[[DataFrame], DataFrame], ...] = (), file_bytes: int = 128 << 20, mode: str = "overwrite") -> DataFrame:
    """Writes ``df`` through the sink, merges its files and runs the ``post`` functions, in order, on what is stored; their result."""
    spark = df.sparkSession
    spark.dataSource.register(MergedSink)
    df.write.format("merged").mode(mode).save(path)
    merge_files(spark, path, file_bytes)
    if files(path):
        out = spark.read.parquet(*[_uri(path, f) for f, _ in files(path)])
    else:
        out = spark.createDataFrame([], df.schema)
    for f in post:
        out = out.transform(f)
    return out


def _uri(path: str, file: str) -> str:
    return f"{path.rstrip('/')}/{file.rpartition('/')[2]}"


def merge_files(spark: SparkSession, path: str, file_bytes: int = 128 << 20) -> int:
    """Rewrites the files of ``path`` as few of about ``file_bytes``, if that makes fewer; how many there are then. Rows and their number stay."""
    held = files(path)
    wanted = max(1, -(-sum(n for _, n in held) // file_bytes))
    if len(held) <= wanted:
        return len(held)
    spark.dataSource.register(MergedSink)
    spark.read.parquet(*[_uri(path, f) for f, _ in held]).coalesce(wanted).write.format("merged").mode("append").option("replace", "true").save(path)
    return len(files(path))
