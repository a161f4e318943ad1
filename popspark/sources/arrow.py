"""Arrow IPC and Feather files, read and written by batches on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


class ArrowFiles(DataSource):
    """Files on a path that driver and executors share: one file, or a folder of them. A file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _paths(self) -> list[str]:
        import os

        path = self.options["path"].removeprefix("file://")
        if os.path.isdir(path):
            return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".arrow", ".ipc", ".feather")))
        return [path]

    def schema(self):
        paths = self._paths()
        if not paths:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        with pa.memory_map(paths[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema) -> DataSourceReader:
        return ArrowReader(self._paths())


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.value) as f:
            file = pa.ipc.open_file(f)
            for i in range(file.num_record_batches):
                yield file.get_batch(i)


def write_arrow(df: DataFrame, folder: str, compression: str | None = None) -> int:
    """A file for each partition in a shared folder, uncompressed or ``zstd`` (Feather); gives the rows.

    A file is written beside its place and moved, so a task that runs again leaves one file.
    """
    import os

    target = folder.removeprefix("file://")
    os.makedirs(target, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, rows, writer = TaskContext.get(), 0, None
        end = "feather" if compression else "arrow"
        path = os.path.join(target, f"part-{task.partitionId():05d}.{end}")
        tmp = f"{path}.{task.taskAttemptId()}.tmp"
        for batch in batches:
            if writer is None:
                writer = pa.ipc.new_file(tmp, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            os.replace(tmp, path)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    return int(df.mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0)
