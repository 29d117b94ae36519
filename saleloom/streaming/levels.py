"""Partial sums of a stream in levels, so that reading them stays bounded.

Every micro-batch leaves its sums in a folder of its own. Once FANOUT batches are closed they are merged
into one entry of level 1, FANOUT entries of a level into one of the next. A manifest says which entries
count and up to which batch they reach; its newest line is the truth, and it is written last, so a merge
that dies changes nothing. A batch that runs again writes to its own folder, which nobody reads any more
if it was merged. Folders of merged batches go one merge later, when no reader can still be told of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from saleloom.session import remove

FANOUT = 10
MANIFEST = "number long, covered long, before long, entries array<struct<level: int, first: long, last: long, path: string>>"


@dataclass(frozen=True)
class PartialSums:
    """Sums by ``keys`` below one folder; ``schema`` names keys and sums."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    fanout: int = FANOUT

    def put(self, rows: DataFrame, batch: int) -> None:
        """The sums of one batch; a repeated batch replaces its own."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/batches/batch={batch}")

    def manifest(self) -> Row:
        """The newest line: its number, the last merged batch (covered), that of the line before, and the entries."""
        try:
            lines = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            newest = lines.orderBy(F.desc("number")).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        return newest or Row(number=0, covered=-1, before=-1, entries=[])

    def _of(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in self.keys])

    def _merged(self, level: int, first: int, last: int, folders: list[str]) -> Row:
        path = f"{self.folder}/levels/{uuid.uuid4().hex}"
        self._of(folders).write.parquet(path)
        return Row(level=level, first=first, last=last, path=path)

    def compact(self, closed: int) -> bool:
        """Merge the batches up to ``closed``, which must not run again, if there are FANOUT of them."""
        line = self.manifest()
        if closed - line["covered"] < self.fanout:
            return False
        entries = list(line["entries"])
        batches = range(line["covered"] + 1, closed + 1)
        entries.append(self._merged(1, batches[0], closed, [f"{self.folder}/batches/batch={b}" for b in batches]))
        level = 1
        while len(mine := [e for e in entries if e["level"] == level]) >= self.fanout:
            entries = [e for e in entries if e["level"] != level]
            entries.append(self._merged(level + 1, mine[0]["first"], mine[-1]["last"], [e["path"] for e in mine]))
            level += 1
        row = (line["number"] + 1, closed, line["covered"], [tuple(e) for e in entries])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for batch in range(line["before"] + 1, line["covered"] + 1):  # the line before this one named none of them either
            remove(self.spark, f"{self.folder}/batches/batch={batch}")
        return True

    def read(self, upto: int) -> DataFrame:
        """All sums so far: the entries and the batches after them, ``upto`` the newest."""
        line = self.manifest()
        folders = [e["path"] for e in line["entries"]]
        return self._of(folders + [f"{self.folder}/batches/batch={b}" for b in range(line["covered"] + 1, upto + 1)])

    def newest_batch(self) -> int:
        """The number of the newest batch that is there, -1 before the first."""
        try:
            found = self.spark.read.option("basePath", f"{self.folder}/batches").parquet(f"{self.folder}/batches")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.manifest()["covered"]
        newest = found.agg(F.max("batch")).first()[0]
        return max(self.manifest()["covered"], -1 if newest is None else newest)
