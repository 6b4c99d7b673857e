"""A store as a folder of snapshots: Parquet tables beside a pointer to the current one.

A commit writes a new snapshot folder with the changed tables and the others by reference, then swaps the pointer in one
rename. Readers see one snapshot throughout. There is one writer, as in any store of this kind."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.schemas import TABLES, VERSION


class Store:
    """path is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        state = self._pointer()
        if state["version"] > VERSION:
            raise ValueError(f"the store has version {state['version']}, this library {VERSION}")

    def _pointer(self) -> dict:
        place = f"{self.path}/CURRENT"
        if not os.path.exists(place):
            return {"version": VERSION, "tables": {}}
        with open(place, encoding="utf-8") as f:
            return json.load(f)

    def tables(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def table(self, name: str) -> DataFrame:
        """The table, or an empty one of its schema."""
        place = self._pointer()["tables"].get(name)
        if place is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(f"{self.path}/{place}")

    def commit(self, changed: dict[str, DataFrame], dropped: tuple[str, ...] = ()) -> None:
        """Makes a new snapshot with these tables in place of their old ones."""
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        state, snapshot = self._pointer(), uuid.uuid4().hex
        for name, df in changed.items():
            df.write.parquet(f"{self.path}/{snapshot}/{name}")
            state["tables"][name] = f"{snapshot}/{name}"
        for name in dropped:
            state["tables"].pop(name, None)
        os.makedirs(self.path, exist_ok=True)
        with open(f"{self.path}/CURRENT.{snapshot}", "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(f"{self.path}/CURRENT.{snapshot}", f"{self.path}/CURRENT")
