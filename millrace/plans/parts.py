"""A chunk's records as typed Parquet parts, written from the task that makes them.

Records go to Arrow with the stage's declared schema, or with the types they have; nothing passes
through text. A part is written whenever ``cap`` rows have come, so a chunk of any size is held a part
at a time. Parts count only when the status row that lists them does, so what a lost or repeated
attempt leaves behind is never read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..sources.store import Store

CHUNK, PLACE = "_chunk_id", "_row"


def columns_of(records: list[dict]) -> pa.Table:
    """Records as columns, of all the keys that any has; columns without a value are left out."""
    names = dict.fromkeys(k for r in records for k in r)
    table = pa.table({k: pa.array([r.get(k) for r in records]) for k in names})
    return table.select([f.name for f in table.schema if not pa.types.is_null(f.type)])


class PartWriter:
    def __init__(self, store: Store, prefix: str, chunk_id: str, schema: T.StructType | None, cap: int) -> None:
        self.store, self.prefix, self.chunk_id, self.cap = store, prefix, chunk_id, cap
        self.schema = to_arrow_schema(schema) if schema is not None else None
        self.parts: list[dict] = []
        self.rows = 0
        self._held: list[dict] = []

    def add(self, records: Any) -> None:
        """A record, records, a pandas frame or an Arrow table."""
        if isinstance(records, pa.Table):
            self._flush()
            for at in range(0, records.num_rows, self.cap):
                self._write(records.slice(at, self.cap))
        elif hasattr(records, "to_dict"):
            self.add(pa.Table.from_pandas(records, schema=self.schema, preserve_index=False))
        else:
            one: Iterable[dict] = [records] if isinstance(records, dict) else records
            for r in one:
                self._held.append(r)
                if len(self._held) >= self.cap:
                    self._flush()

    def close(self) -> list[dict]:
        self._flush()
        return self.parts

    def _flush(self) -> None:
        if self._held:
            held, self._held = self._held, []
            self._write(pa.Table.from_pylist(held, self.schema) if self.schema is not None else columns_of(held))

    def _write(self, table: pa.Table) -> None:
        if self.schema is not None:
            table = table.select(self.schema.names).cast(self.schema)
        if not table.num_rows:
            return
        kinds = str(table.schema.remove_metadata())
        table = table.append_column(CHUNK, pa.array([self.chunk_id] * table.num_rows, pa.string())).append_column(PLACE, pa.array(range(self.rows, self.rows + table.num_rows), pa.int64()))
        sink = io.BytesIO()
        pq.write_table(table.replace_schema_metadata(None), sink, coerce_timestamps="us", allow_truncated_timestamps=True)
        key = self.store.put(f"{self.prefix}/{uuid.uuid4().hex}.parquet", sink.getvalue())
        self.rows += table.num_rows
        self.parts.append({"key": key, "rows": table.num_rows, "schema": kinds, "arrow": table.schema.serialize().to_pybytes().hex()})


def read_parts(spark: SparkSession, store: Store, parts: list[dict], schema: T.StructType | None) -> DataFrame | None:
    """All parts as one DataFrame with the chunk and row columns.

    Without a declared schema it is that which all parts' types widen to. Parts of like schema are one scan.
    """
    if not parts:
        return None
    by: dict[str, list[dict]] = {}
    for p in parts:
        by.setdefault(p["schema"], []).append(p)
    if schema is None:
        own = [pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(group[0]["arrow"]))) for group in by.values()]
        schema = from_arrow_schema(pa.unify_schemas(own, promote_options="permissive"))
        schema = T.StructType([f for f in schema.fields if f.name not in (CHUNK, PLACE)])
    full = T.StructType([*schema.fields, T.StructField(CHUNK, T.StringType()), T.StructField(PLACE, T.LongType())])

    def scan(group: list[dict]) -> DataFrame:
        df = spark.read.parquet(*[store.uri(p["key"]) for p in group])
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in full.fields])

    return reduce(DataFrame.unionByName, [scan(g) for g in by.values()])
