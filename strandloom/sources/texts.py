"""Named text files in any store, written together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandloom.sources import store
from strandloom.sources.staged import StagedWriter


class TextWriter(StagedWriter, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = []
        for batch in iterator:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                if not name or text is None:
                    raise ValueError("a file needs a name and a text")
                done.append(self.put(name, [text.encode()]))
        return self.message(done)

    def complete(self, files: list[tuple]) -> None:
        names = sorted(f[1] for f in files)
        twice = [a for a, b in zip(names, names[1:]) if a == b]
        if twice:
            raise ValueError(f"two files would be named {twice[0]}")


class TextFiles(DataSource):
    """Writes ``(name, text)`` rows as files, see ``write_texts``."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(dict(self.options))


def write_texts(texts: DataFrame, path: str) -> None:
    """One file per row of ``(name, text)``; names are relative to ``path`` and differ."""
    spark = texts.sparkSession
    spark.dataSource.register(TextFiles)
    rows = texts.select("name", "text")
    rows.write.format("text_files").mode("append").option("folder", store.qualified(spark, path)).save()
