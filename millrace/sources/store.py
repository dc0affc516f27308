"""Objects by key under a root URI, on the driver and in tasks alike.

Any file system that pyarrow knows serves (local, s3, hdfs, gs). Writes go to a temporary name and
are moved into place, so a reader never sees half an object; listings hide temporary names.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs

PART = ".part"


class Store:
    def __init__(self, root: str, cache_dir: str | None = None) -> None:
        self.root = root.rstrip("/")
        self.cache_dir = cache_dir
        self._fs: fs.FileSystem | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_fs": None}

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" not in self.root:
            self.root = os.path.abspath(self.root)
        if self._fs is None:
            self._fs, self._base = fs.FileSystem.from_uri(self.root if "://" in self.root else Path(self.root).as_uri())
        return self._fs, self._base

    def _path(self, key: str) -> str:
        return f"{self._open()[1]}/{key}"

    def uri(self, key: str = "") -> str:
        """What Spark reads and writes."""
        self._open()
        base = self.root if "://" in self.root else Path(self.root).as_uri()
        return f"{base}/{key}" if key else base

    def put(self, key: str, data: bytes) -> str:
        f, path = self._open()[0], self._path(key)
        f.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}{PART}"
        with f.open_output_stream(part) as out:
            out.write(data)
        f.move(part, path)
        return key

    def get(self, key: str) -> bytes:
        with self._open()[0].open_input_stream(self._path(key)) as f:
            return f.read()

    def exists(self, key: str) -> bool:
        return self._open()[0].get_file_info(self._path(key)).type != fs.FileType.NotFound

    def list(self, prefix: str) -> list[str]:
        """Keys of the objects below a prefix, sorted."""
        f, base = self._open()
        found = f.get_file_info(fs.FileSelector(self._path(prefix).rstrip("/"), recursive=True, allow_not_found=True))
        return sorted(x.path[len(base) + 1 :] for x in found if x.type == fs.FileType.File and not x.path.endswith(PART))

    def put_json(self, key: str, value: object) -> str:
        return self.put(key, json.dumps(value, default=str).encode())

    def get_json(self, key: str):
        return json.loads(self.get(key))

    def put_file(self, key: str, path: str) -> str:
        return self.put(key, Path(path).read_bytes())

    def get_file(self, key: str, path: str | None = None) -> str:
        """A local copy of an object. Copies are cached by root, key, size and time of change, so neither another
        root's object nor an older one of the same name is ever given."""
        f, found = self._open()[0], self._path(key)
        info = f.get_file_info(found)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri(key))
        version = hashlib.sha256(f"{self.root}\n{info.size}\n{info.mtime_ns}".encode()).hexdigest()[:24]
        kept = Path(self.cache_dir or Path(tempfile.gettempdir()) / "millrace-cache") / version / key
        if not kept.exists():
            kept.parent.mkdir(parents=True, exist_ok=True)
            part = kept.with_name(f"{kept.name}.{uuid.uuid4().hex}{PART}")
            part.write_bytes(self.get(key))
            os.replace(part, kept)
        if path:
            shutil.copyfile(kept, path)
        return str(path or kept)
