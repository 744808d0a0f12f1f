"""Files of any store that Arrow opens: listing, ranged reads, writes under another name."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; without a scheme, or with ``file``, this machine's."""
    if re.match(r"file:/", path) or "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/+", "/", path))
    return fs.FileSystem.from_uri(path)


def listed(folder: str) -> list[tuple[str, int]]:
    """(path, size) of the files right in a folder, by name."""
    files, at = opened(folder)
    head = folder.rstrip("/")
    return sorted((f"{head}/{x.base_name}", x.size) for x in files.get_file_info(fs.FileSelector(at)) if x.is_file)


def read(path: str, at: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes from ``at`` on, or all the rest."""
    files, name = opened(path)
    with files.open_input_file(name) as f:
        f.seek(at)
        return f.read() if size is None else f.read(size)


def write_aside(folder: str, content: bytes) -> str:
    """Writes a file under a name that nothing reads and returns it."""
    files, at = opened(folder)
    files.create_dir(at, recursive=True)
    name = f".{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(f"{at}/{name}") as f:
        f.write(content)
    if isinstance(files, fs.LocalFileSystem):
        with open(f"{at}/{name}", "rb") as f:
            os.fsync(f.fileno())
    return f"{folder.rstrip('/')}/{name}"


def rename(before: str, after: str) -> None:
    files, a = opened(before)
    files.move(a, opened(after)[1])


def remove(path: str) -> None:
    files, name = opened(path)
    if files.get_file_info(name).type != fs.FileType.NotFound:
        files.delete_file(name)
