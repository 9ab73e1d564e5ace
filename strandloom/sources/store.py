"""Files in any store that Arrow reaches (local and mounted disks, HDFS, S3, GCS, Azure).

Paths are made whole on the driver with Spark's own settings, so that a plain path means the
same store everywhere; tasks open them by URI, read ranges and write parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

ZSTD = ".zst"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its store, as a URI."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = store.makeQualified(place).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _found(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class File:
    uri: str
    size: int


def files(uri: str, endings: tuple[str, ...]) -> list[File]:
    """The file at ``uri``, its compressed twin, or the files of the folder in name order.

    Where a file and its compressed twin are both there, the plain one counts.  Names that
    begin with a dot or an underscore are left out.
    """
    store, path = _found(uri)
    info = store.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        listed = [x for x in store.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File]
        listed = [x for x in listed if x.base_name[0] not in "._" and x.base_name.endswith(endings)]
        names = {x.base_name for x in listed}
        plain = [x for x in listed if not (x.base_name.endswith(ZSTD) and x.base_name[: -len(ZSTD)] in names)]
        return [File(f"{uri.rstrip('/')}/{x.base_name}", x.size) for x in sorted(plain, key=lambda x: x.base_name)]
    if info.type != pafs.FileType.File:
        info, uri = store.get_file_info(path + ZSTD), uri + ZSTD
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(uri.removesuffix(ZSTD))
    return [File(uri, info.size)]


def opened(uri: str):
    """The file as it lies there, for reads at any place."""
    store, path = _found(uri)
    return store.open_input_file(path)


def stream(uri: str):
    """The content from its beginning, unpacked if the name says it is compressed."""
    handle = opened(uri)
    if not uri.endswith(ZSTD):
        return handle
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(handle, read_across_frames=True)


def write(uri: str, *parts: bytes) -> None:
    store, path = _found(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)


def move(source: str, target: str) -> None:
    store, path = _found(source)
    goal = _found(target)[1]
    store.create_dir(goal.rsplit("/", 1)[0], recursive=True)
    store.move(path, goal)


def remove_folder(uri: str) -> None:
    store, path = _found(uri)
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def frames(uri: str, size: int) -> Iterator[tuple[int, int, int]]:
    """``(start, stop, content)`` of the zstd frames of a file; content is -1 if not stated.

    Only headers of frames and of their blocks are read.
    """
    import zstandard

    with opened(uri) as handle:
        at = 0
        while at < size:
            handle.seek(at)
            head = handle.read(18)
            if 0x184D2A50 <= int.from_bytes(head[:4], "little") <= 0x184D2A5F:
                at += 8 + int.from_bytes(head[4:8], "little")  # a frame to skip
                continue
            facts = zstandard.get_frame_parameters(head)
            start, at = at, at + zstandard.frame_header_size(head)
            last = False
            while not last:
                handle.seek(at)
                block = int.from_bytes(handle.read(3), "little")
                last, kind, length = block & 1, (block >> 1) & 3, block >> 3
                at += 3 + (1 if kind == 1 else length)  # kind 1 repeats one byte
            at += 4 * facts.has_checksum
            unknown = facts.content_size in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
            yield start, at, -1 if unknown else facts.content_size


def unpacked(uri: str, start: int, stop: int | None = None):
    """Stream of the content of the frames from ``start`` on, a frame boundary."""
    import zstandard

    handle = opened(uri)
    handle.seek(start)
    return zstandard.ZstdDecompressor().stream_reader(handle, read_across_frames=True)
