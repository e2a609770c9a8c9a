"""Tables that are kept between runs and grow by batches.

A state is a folder with numbered manifests. A batch writes what it adds under new names and then publishes the next manifest, which
says what belongs to the state; until then nothing has changed, so a batch that fails can be run again. Two batches that start from
the same manifest can't both be published. A batch that has a name is merged once, however often it is run.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession

from assayline.sources.files import Files


class State:
    """The published contents of a state folder, and the way to the next ones."""

    def __init__(self, spark: SparkSession, folder: str, **settings: Any):
        """``settings`` are kept from the first batch on; a state is not continued with others."""
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        numbers = [int(m[1]) for name, _ in self.files.listed(self.folder) if (m := re.fullmatch(r"state_(\d+)\.json", name))]
        self.number = max(numbers, default=0)
        empty = {"batches": [], "settings": settings, "tables": {}}
        self.contents = json.loads(self.files.text(self._manifest(self.number))) if numbers else empty
        if settings and self.contents["settings"] != json.loads(json.dumps(settings)):
            raise ValueError(f"the state was begun with {self.contents['settings']}, not {settings}")

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/state_{number:08d}.json"

    def paths(self, table: str) -> list[str]:
        return self.contents["tables"].get(table, [])

    def has(self, batch: str | None) -> bool:
        return batch is not None and batch in self.contents["batches"]

    def new_path(self, table: str) -> str:
        return f"{self.folder}/{table}/{uuid.uuid4().hex}"

    def publish(self, batch: str | None = None, **tables: list[str]) -> None:
        """Makes the paths of some tables the state's; the other tables stay as they are."""
        batches = self.contents["batches"] + ([] if batch is None else [batch])
        contents = {**self.contents, "batches": batches, "tables": {**self.contents["tables"], **tables}}
        text = json.dumps(contents, indent=1, sort_keys=True)
        if not self.files.publish_new(self._manifest(self.number + 1), text):
            raise RuntimeError("another batch was published in the meantime; run this one again")
        self.number, self.contents = self.number + 1, contents
