"""Run status: rows appended once per wave, of which the latest of each chunk counts.

A row exists per chunk and attempt, so the table is plan-sized. Rows are written after the data they
speak of; a chunk is done only if a success row names a wave whose data is there.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Store

SCHEMA = "seq long, run_id string, stage string, chunk_id string, key string, state string, wave string, fingerprint string, attempt int, error string, traceback string, peak_mem_mb double, limit_mb double, wall_seconds double, n_records long, outputs array<string>, parts string, chunk string, ts double"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class Status:
    def __init__(self, store: Store, pipeline: str) -> None:
        self.store, self.prefix = store, f"status/{pipeline}"
        self._rows: list[dict] = []
        self._latest: dict[str, dict] = {}
        for key in store.list(self.prefix):  # names are their first row's number, so they come in order
            self._take(store.get_json(key))
        self._seq = max((r["seq"] for r in self._rows), default=0)

    def _take(self, rows: list[dict]) -> None:
        self._rows += rows
        self._latest.update((r["key"], r) for r in rows)

    def append(self, rows: list[dict]) -> None:
        """Adds rows in order, as one object."""
        if not rows:
            return
        out = []
        for r in rows:
            self._seq += 1
            out.append({k: None for k in FIELDS} | r | {"seq": self._seq, "ts": time.time()})
        self.store.put_json(f"{self.prefix}/{out[0]['seq']:012d}.json", out)
        self._take(out)

    def latest(self) -> dict[str, dict]:
        """The latest row of each key; a later success hides an earlier failure."""
        return self._latest

    def frame(self, spark: SparkSession) -> DataFrame:
        """All rows as a DataFrame."""
        return spark.createDataFrame([tuple(r.get(k) for k in FIELDS) for r in self._rows], SCHEMA)
