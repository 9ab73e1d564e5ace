"""Writers whose files appear together when the whole job has succeeded."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import WriterCommitMessage

from strandloom.sources import store


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: ``(staged, name, ...)`` each."""

    files: list


class StagedWriter:
    """Tasks write below ``_staging-...``; the driver moves their files, or removes all.

    Only files that a finished task reported are moved, so what a lost or repeated task has
    left never shows.
    """

    def __init__(self, options: dict):
        self.folder = options["folder"].rstrip("/")
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def put(self, name: str, parts: list[bytes]) -> tuple[str, str]:
        staged = f"{self.staging}/{uuid.uuid4().hex}"
        store.write(staged, *parts)
        return staged, name

    def message(self, files: list[tuple]) -> Written:
        return Written(files)

    def complete(self, files: list[tuple]) -> None:
        """Raise if the files of all tasks are not the whole result."""

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        try:
            self.complete(files)
            for staged, name, *_ in files:
                store.move(staged, f"{self.folder}/{name}")
        finally:
            store.remove_folder(self.staging)

    def abort(self, messages: list) -> None:
        store.remove_folder(self.staging)
