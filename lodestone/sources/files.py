"""Files of the shared folders, opened from tasks: any file system that pyarrow knows by its URI."""

from __future__ import annotations

import hashlib
import re
from typing import BinaryIO
from urllib.parse import quote

READ = 1 << 20


def safe_path(path: str) -> str:
    """The path, if it is relative, clean and stays below its root."""
    if not path or "\\" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"unsafe path {path!r}")
    return path


def _at(path: str):
    from pyarrow import fs

    # Spark gives paths as they are; a URI has its odd characters encoded.
    return fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe="/:@"))


def opened(path: str) -> BinaryIO:
    system, at = _at(path)
    return system.open_input_stream(at, compression=None)


def created(path: str) -> BinaryIO:
    system, at = _at(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def exists(path: str) -> bool:
    from pyarrow import fs

    system, at = _at(path)
    return system.get_file_info(at).type == fs.FileType.File


def listed(folder: str) -> list[str]:
    """The names of the files in one folder that are not hidden, in order."""
    from pyarrow import fs

    system, at = _at(folder)
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def moved(path: str, to: str) -> None:
    """Rename a file; what an earlier attempt has moved already stays moved."""
    system, at = _at(path)
    _, target = _at(to)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    if exists(path) or not exists(to):
        system.move(at, target)


def removed(path: str) -> None:
    system, at = _at(path)
    system.delete_file(at)


class Digested:
    """Passes bytes on, to a file or to none, and keeps their sha256 and number."""

    def __init__(self, out: BinaryIO | None = None):
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def write(self, data: bytes) -> int:
        self.digest.update(data)
        self.size += len(data)
        if self.out is not None:
            self.out.write(data)
        return len(data)

    def flush(self) -> None:
        return None

    @property
    def sha256(self) -> str:
        return self.digest.hexdigest()


def passed(source: BinaryIO, out: Digested) -> Digested:
    """Read a stream to its end in pieces."""
    while data := source.read(READ):
        out.write(data)
    return out


def summed(path: str) -> tuple[str, int]:
    with opened(path) as f:
        out = passed(f, Digested())
    return out.sha256, out.size
