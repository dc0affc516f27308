"""What a Python stage sees of its chunk, inside a task."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from ..ckpt import Checkpoint
from ..sources.store import Store
from .chunks import Chunk
from .parts import PartWriter


class Context:
    def __init__(self, config: Any, stage: str, chunk: Chunk, records: list[dict], store: Store, out: PartWriter) -> None:
        self.config, self.stage, self.chunk, self.store = config, stage, chunk, store
        self._records = records
        self.out = out
        self.outputs: list[str] = []

    @property
    def chunk_id(self) -> str:
        return self.chunk.id

    @property
    def params(self) -> dict:
        return self.chunk.params

    @property
    def members(self) -> list[dict]:
        """Parameters of the upstream chunks in this one."""
        return [m.params for m in self.chunk.members]

    @property
    def out_prefix(self) -> str:
        """Where this chunk's blobs go; records go to the stage's table."""
        return f"blobs/{self.stage}/{self.chunk.id}"

    @property
    def cache_dir(self) -> str:
        return tempfile.mkdtemp(prefix=f"millrace-{self.stage}-")

    def input(self) -> list[dict]:
        return self._records

    def input_df(self):
        import pandas as pd

        return pd.DataFrame(self._records)

    def aux(self, key: str) -> bytes:
        return self.store.get(key)

    def write(self, records) -> None:
        """A record, any number of records, a pandas frame or an Arrow table; they are written out as they come."""
        self.out.add(records)

    def write_bytes(self, name: str, data: bytes) -> str:
        self.outputs.append(self.store.put(f"{self.out_prefix}/{name}", data))
        return self.outputs[-1]

    def write_model(self, model, name: str = "model.json") -> str:
        if not hasattr(model, "save_model"):
            return self.write_bytes(name, json.dumps(model).encode())
        path = os.path.join(self.cache_dir, name)
        model.save_model(path)
        with open(path, "rb") as f:
            return self.write_bytes(name, f.read())

    @property
    def checkpoint(self) -> Checkpoint:
        return Checkpoint(self.store, f"{self.stage}/{self.chunk.id}")
