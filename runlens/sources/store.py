"""Versions of the tables: touched days are written beside the old ones, and one small file makes them current.

    data/<table>/version=<n>/date_dir=<day>/   rows of a day, written once and never changed
    snapshots/<n>.json                          for each table the version of each day, and its schema

A reader follows the last snapshot. Until a new one stands there, nothing that it reads has changed, so a failure between two tables, or
between two days of one, leaves the old state whole; what was written by then is overwritten or swept away later.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FORMAT_VERSION, RUN

#: The folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Snapshot:
    """A committed state: for each table the version that wrote each day, and the table's schema."""

    version: int
    days: dict[str, dict[str, int]]
    schemas: dict[str, dict]


def day_key(day: object) -> str:
    """A day as its folder names it."""
    return NO_DAY if day is None else str(day)


class Store:
    """Tables by day below a folder of any store that Spark reads. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str) -> tuple[object, object]:
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        own, files = self._at(path)
        return [x.getPath().getName() for x in files.listStatus(own)] if files.exists(own) else []

    def _snapshots(self) -> list[int]:
        return sorted(int(m[1]) for x in self._names(f"{self.root}/snapshots") if (m := re.fullmatch(r"(\d+)\.json", x)))

    def _snapshot(self, version: int) -> Snapshot | None:
        told = json.loads(self.spark.read.text(f"{self.root}/snapshots/{version:012d}.json", wholetext=True).first()[0])
        return Snapshot(version, told["days"], told["schemas"]) if told["format"] == FORMAT_VERSION else None

    def current(self) -> Snapshot | None:
        """The last committed state; None without one, or if it has another format and must be built from the files again."""
        found = self._snapshots()
        return self._snapshot(found[-1]) if found else None

    def read(self, table: str, of: Snapshot, days: set[str] | None = None) -> DataFrame:
        """A table as of a snapshot; of some of its days only, if they are given. Other days are not even listed."""
        schema, base = T.StructType.fromJson(of.schemas[table]), f"{self.root}/data/{table}"
        paths = [f"{base}/version={v}/date_dir={d}" for d, v in of.days[table].items() if days is None or d in days]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths).select(*schema.names)

    def commit(self, rows: dict[str, DataFrame], touched: DataFrame | None = None, base: Snapshot | None = None) -> Snapshot:
        """Puts rows in place of those of the touched runs in every table, drops what else these runs had, and makes it all current at once.

        rows: tables with the keys of runs and date_dir, which may be null. touched: (run, date_dir), all days on which the replaced or dropped runs
        stand in base or in rows. Rows of other runs on these days are written again with them; other days stay as files.
        Without base, rows are all there is.
        """
        last = self._snapshots()
        version = (last[-1] if last else 0) + 1
        if base is not None and (not last or base.version != last[-1]):
            raise ValueError(f"version {base.version} is no longer current")
        days = set() if base is None else {day_key(r[0]) for r in touched.select("date_dir").distinct().collect()}
        told, schemas = {}, {}
        for table, new in rows.items():
            new = new.withColumn("date_dir", F.col("date_dir").cast("date"))
            known = base is not None and table in base.days
            if known:
                stay = self.read(table, base, days).join(touched.select(*RUN).distinct(), RUN, "left_anti")
                new = stay.unionByName(new, allowMissingColumns=True)
            path = f"{self.root}/data/{table}/version={version}"
            new.hint("rebalance", "date_dir").write.mode("overwrite").partitionBy("date_dir").parquet(path)
            written = [x.removeprefix("date_dir=") for x in self._names(path) if x.startswith("date_dir=")]
            kept = {d: v for d, v in base.days[table].items() if d not in days} if known else {}
            told[table] = kept | dict.fromkeys(written, version)
            schemas[table] = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema.fields]).jsonValue()
        done = Snapshot(version, (base.days if base else {}) | told, (base.schemas if base else {}) | schemas)
        self._publish(done)
        return done

    def _publish(self, done: Snapshot) -> None:
        final, files = self._at(f"{self.root}/snapshots/{done.version:012d}.json")
        draft, _ = self._at(f"{self.root}/snapshots/.{done.version:012d}.draft")
        out = files.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"format": FORMAT_VERSION, "days": done.days, "schemas": done.schemas}).encode()))
        finally:
            out.close()
        if files.exists(final) or not files.rename(draft, final):
            raise ValueError(f"version {done.version} was committed by another writer")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` snapshots, and the folders of days that those don't read; the paths that went.

        Readers of an older snapshot must be done."""
        versions = self._snapshots()
        if not versions:
            return []
        stay = [s for v in versions[-keep:] if (s := self._snapshot(v))]
        used = {(t, v, d) for s in stay for t, days in s.days.items() for d, v in days.items()}
        gone = [f"{self.root}/snapshots/{v:012d}.json" for v in versions[:-keep]]
        for table in self._names(f"{self.root}/data"):
            for name in self._names(f"{self.root}/data/{table}"):
                v = int(name.removeprefix("version="))
                own = [d for x in self._names(f"{self.root}/data/{table}/{name}") if x.startswith("date_dir=") and (table, v, d := x.removeprefix("date_dir=")) not in used]
                if v <= versions[-1]:  # a later one is being written
                    gone += [f"{self.root}/data/{table}/{name}/date_dir={d}" for d in own]
        for path in gone:
            own, files = self._at(path)
            files.delete(own, True)
        return gone
