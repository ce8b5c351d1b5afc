"""Files of any file system that pyarrow opens, for data sources that read byte ranges: local paths and URIs (file, hdfs, s3, gs, abfs), or a resolver's own."""

from __future__ import annotations

import fnmatch
import hashlib
import importlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

#: Bytes at a file's start, and before a place in it, that tell whether it is still the same file.
HEAD, TAIL = 256, 64


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int  # nanoseconds


class Files:
    """resolver names a function ('module:function') that gives (pyarrow file system, path in it) of a path; without one, pyarrow resolves URIs."""

    def __init__(self, resolver: str = ""):
        self.resolver = resolver
        self._systems: dict[str, fs.FileSystem] = {}

    def __getstate__(self) -> dict:
        return {"resolver": self.resolver, "_systems": {}}

    def _of(self, path: str) -> tuple[fs.FileSystem, str]:
        if self.resolver:
            module, _, name = self.resolver.partition(":")
            return getattr(importlib.import_module(module), name)(path)
        scheme, mark, rest = path.partition("://")
        if not mark or scheme == "file":
            return self._systems.setdefault("", fs.LocalFileSystem()), rest if mark else path
        root = f"{scheme}://{rest.partition('/')[0]}"
        if root not in self._systems:
            self._systems[root] = fs.FileSystem.from_uri(path)[0]
        return self._systems[root], fs.FileSystem.from_uri(path)[1]

    def info(self, path: str) -> Found | None:
        system, inner = self._of(path)
        found = system.get_file_info(inner)
        return Found(path, found.size, found.mtime_ns or 0) if found.type == fs.FileType.File else None

    def size(self, path: str) -> int:
        found = self.info(path)
        return found.size if found else 0

    def list(self, roots: list[str], glob: str) -> Iterator[Found]:
        """Files under the roots (or the roots themselves), each once; their contents are not opened."""
        seen = set()
        for root in roots:
            system, inner = self._of(root)
            if (own := self.info(root)) is not None:
                found = [own]
            else:
                inner = inner.rstrip("/")
                below = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
                found = [Found(root.rstrip("/") + f.path[len(inner) :], f.size, f.mtime_ns or 0) for f in below if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob)]
            for f in found:
                if f.path not in seen:
                    seen.add(f.path)
                    yield f

    def children(self, folder: str) -> tuple[list[Found], list[str]]:
        """(files, folders) right under a folder; those that can't be read have none."""
        system, inner = self._of(folder)
        inner = inner.rstrip("/") or "/"
        try:
            below = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        except OSError:
            return [], []
        own = lambda f: f"{folder.rstrip('/')}/{f.base_name}"
        return [Found(own(f), f.size, f.mtime_ns or 0) for f in below if f.type == fs.FileType.File], [own(f) for f in below if f.type == fs.FileType.Directory]

    def real(self, path: str) -> str:
        """Where a local path leads, links resolved; other paths as they are."""
        system, inner = self._of(path)
        return os.path.realpath(inner) if isinstance(system, fs.LocalFileSystem) else path

    def open(self, path: str):
        system, inner = self._of(path)
        return system.open_input_file(inner)

    def digest(self, path: str, at: int, n: int) -> str:
        with self.open(path) as f:
            f.seek(at)
            return hashlib.sha256(f.read(n)).hexdigest()[:32]

