"""File access of the binary data sources, the same on local, object and cluster storage."""

from __future__ import annotations

import posixpath
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import WriterCommitMessage


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def natural_key(path: str) -> list:
    """Sort key that orders numbers in a path by value: part-99999 comes before part-100000."""
    return [int(piece) if piece.isdigit() else piece for piece in re.split(r"([0-9]+)", path)]


def data_files(path: str) -> list[tuple[str, int]]:
    """``(path, size)`` of a file, or of the visible files of a folder in name order, numbers by value."""
    filesystem, target = resolve(path)
    info = filesystem.get_file_info(target)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = filesystem.get_file_info(pafs.FileSelector(target, recursive=True))
    visible = [
        (i.path, i.size)
        for i in listed
        if i.type == pafs.FileType.File and not posixpath.basename(i.path).startswith(("_", "."))
    ]
    return sorted(visible, key=lambda file: natural_key(file[0]))


@dataclass
class PartFiles(WriterCommitMessage):
    """Files one finished task has written, as (temporary, final) paths."""

    moves: list[tuple[str, str]]


class PartCommit:
    """Commit of part files: tasks write hidden files, the job renames them at its end.

    A lost or repeated task leaves hidden files only, which readers skip.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def new_part(self, partition: int, number: int, suffix: str) -> tuple[str, str]:
        _, target = resolve(self.path)
        name = f"part-{partition:05d}-{number:05d}{suffix}"
        return (
            posixpath.join(target, f".{name}.{self.job}.{uuid.uuid4().hex[:8]}"),
            posixpath.join(target, name if self.overwrite else f"{self.job}-{name}"),
        )

    def commit(self, messages: list) -> None:
        filesystem, target = resolve(self.path)
        filesystem.create_dir(target, recursive=True)
        moves = [m for message in messages if message for m in message.moves]
        if self.overwrite:
            final = {new for _, new in moves}
            for path, _ in data_files(self.path):
                if path not in final:
                    filesystem.delete_file(path)
        with ThreadPoolExecutor(16) as pool:  # renames wait for the storage, not for us
            list(pool.map(lambda move: filesystem.move(*move), moves))
        with filesystem.open_output_stream(posixpath.join(target, "_SUCCESS")):
            pass

    def abort(self, messages: list) -> None:
        filesystem, _ = resolve(self.path)
        for message in messages:
            for old, _ in message.moves if message else []:
                if filesystem.get_file_info(old).type == pafs.FileType.File:
                    filesystem.delete_file(old)
