"""Document files as a data source of Spark: spark.read.format("document_files").load(path)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptoria.sources.files import PARTS, opened_file, parted_blocks


def store_of(path: str):
    """The file system of a path (a plain one is this machine's, which has to be shared) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class OneFile(InputPartition):
    path: str


class DocumentReader(DataSourceReader):
    """A partition for each file, so that one that is slow or broken holds up no other; the largest files begin first."""

    def __init__(self, path: str, endings: set[str]):
        self.path, self.endings = path, endings

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        store, root = store_of(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        files = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        wanted = [f for f in files if not self.endings or f.base_name.rpartition(".")[2].lower() in self.endings]
        return [OneFile(prefix + f.path) for f in sorted(wanted, key=lambda f: (-f.size, f.path))]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        try:
            store, path = store_of(partition.path)
            with store.open_input_stream(path) as file:
                row = opened_file(partition.path, file.read())
        except OSError as e:
            row = {"path": partition.path, "error": f"{type(e).__name__}: {e}"[:200], "form": None, "parts": []}
        parts = [(p["page"], p["kind"], p["level"], p["body"]) for p in row["parts"]]
        yield row["path"], row["error"], row["form"], parts


class DocumentFiles(DataSource):
    """Options: path, a folder that is searched whole, and endings, by commas, to read files of these only. Rows: path, error,
    form and parts; a file that cannot be read is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> DocumentReader:
        if not self.options.get("path"):
            raise ValueError("document_files needs a path")
        return DocumentReader(self.options["path"], {e.strip().lower().removeprefix(".") for e in self.options.get("endings", "").split(",") if e.strip()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def read_document_files(spark: SparkSession, path: str, endings: str = "") -> DataFrame:
    """The same blocks as files.read_blocks, by the data source."""
    register(spark)
    return parted_blocks(spark.read.format("document_files").option("endings", endings).load(path))
