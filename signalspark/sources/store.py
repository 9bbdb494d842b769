"""Step tables that are built once, token state with a rule log, and counts by chunk (SRC4, SRC8, TOK16-17, AGG1-2)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signal, tables_of_rules
from ..operators.tokens import Rule, applied, finished_and_left


class Folder:
    """A folder of tables that count once they are committed: data first, then a marker beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, name: str) -> bool:
        fs, path = self._fs(f"{self.path}/{name}/marker/_SUCCESS")
        return fs.exists(path)

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes over whatever an attempt without a marker, or an earlier one, has left."""
        self.drop_marker(name)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}/data")
        marker = json.dumps({"name": name, "schema": df.schema.jsonValue()})
        self.spark.createDataFrame([(marker,)], "marker string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/marker")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/data")

    def drop_marker(self, name: str) -> None:
        fs, path = self._fs(f"{self.path}/{name}/marker")
        fs.delete(path, True)

    def names(self, under: str) -> list[str]:
        """Committed tables right under a folder, in order."""
        fs, path = self._fs(f"{self.path}/{under}")
        found = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return [f"{under}/{x}" for x in found if self.committed(f"{under}/{x}")]

    def fingerprint(self, df: DataFrame) -> str:
        """Of the files that a DataFrame reads: names, lengths and times. One that reads none is told by its rows' hashes."""
        files = sorted(df.inputFiles())
        if not files:
            return str(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
        out, folders = hashlib.sha256(), sorted({x.rpartition("/")[0] for x in files})
        wanted = {x.rpartition("/")[2] for x in files}
        for folder in folders:
            fs, path = self._fs(folder)
            for s in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
                if s.getPath().getName() in wanted:
                    out.update(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}".encode())
        return out.hexdigest()


class Steps:
    """Named steps, each a table known by its parameters and inputs: one that is there is read back, another is built. A changed
    parameter or input file gives a table of its own; whatever a broken attempt has left is written over."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder, self.built, self.held = Folder(spark, path), [], []

    def step(self, name: str, build: Callable[[], DataFrame], inputs: list[DataFrame], params: dict | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
        key = json.dumps([name, params or {}, list(partition_by), [self.folder.fingerprint(x) for x in inputs]], sort_keys=True, default=str)
        table = f"{name}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
        self.held.append(table)
        if self.folder.committed(table):
            return self.folder.read(table)
        self.built.append(name)
        return self.folder.write(table, build(), partition_by)


class TokenState:
    """Rows under rules, kept in a folder: a log of rules, the position up to which it has been applied, rows still pending, and
    rows that are finished. Every application is a version; a finished row is in the version that finished it, once."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def start(self, rows: DataFrame) -> None:
        """Rows (name, tokens, active) with an empty log."""
        empty = self.folder.spark.createDataFrame([], tables_of_rules.SCHEMA)
        self._commit(0, rows.select("name", "tokens", "active"), None, empty, 0)

    def _commit(self, version: int, pending: DataFrame, finished: DataFrame | None, log: DataFrame, position: int) -> None:
        at = f"{version:06d}"
        self.folder.write(f"pending/{at}", pending)
        if finished is not None:
            self.folder.write(f"finished/{at}", finished)
        self.folder.write(f"log/{at}", log)
        # the state comes last: an attempt that breaks off before it doesn't count
        self.folder.write(f"state/{at}", self.folder.spark.createDataFrame([(version, position)], "version int, position int"))

    def state(self) -> tuple[int, int]:
        """(version, position in the log)."""
        return tuple(self.folder.read(self.folder.names("state")[-1]).first())

    def log(self) -> list[Rule]:
        return tables_of_rules.from_table(self.folder.read(f"log/{self.state()[0]:06d}"))

    def pending(self) -> DataFrame:
        return self.folder.read(f"pending/{self.state()[0]:06d}")

    def finished(self) -> DataFrame:
        """All finished rows with the version that finished them."""
        versions = [v for v in range(1, self.state()[0] + 1) if self.folder.committed(f"finished/{v:06d}")]
        parts = [self.folder.read(f"finished/{v:06d}").withColumn("version", F.lit(v)) for v in versions]
        out = self.pending().limit(0).withColumn("version", F.lit(0))
        for part in parts:
            out = out.unionByName(part)
        return out

    def record(self, rules: list[Rule]) -> None:
        """Puts rules at the end of the log without applying them."""
        version, position = self.state()
        log = tables_of_rules.as_table(self.folder.spark, self.log() + rules)
        self._commit(version + 1, self.pending(), None, log, position)

    def apply(self, rules: list[Rule] | None = None, everything: bool = False) -> None:
        """Applies ``rules`` after the recorded ones that wait (or, with ``everything``, after the whole log again) to the
        pending rows, cleans them, and sets aside those without tokens."""
        version, position = self.state()
        log = self.log() + (rules or [])
        done, left = finished_and_left(applied(self.pending(), log if everything else log[position:]))
        self._commit(version + 1, left, done, tables_of_rules.as_table(self.folder.spark, log), len(log))


class CountsByChunk:
    """Pair counts of chunks of rows, each kept under its id, and their sum: a chunk that comes again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, dims: list[str], drug: str, event: str):
        self.folder, self.dims, self.drug, self.event = Folder(spark, path), dims, drug, event

    def add(self, rows: DataFrame, chunk: int | str) -> None:
        """Counts the rows of a chunk; as ``lambda rows, batch: counts.add(rows, batch)`` it serves ``foreachBatch``."""
        self.folder.write(f"chunks/{chunk}", rows.groupBy(*self.dims, self.drug, self.event).agg(F.count("*").alias("n")))

    def base(self) -> DataFrame:
        """(dims, drug, event, n) over all chunks."""
        names = self.folder.names("chunks")
        if not names:
            raise ValueError("no chunk has been added")
        rows = self.folder.spark.read.parquet(*(f"{self.folder.path}/{x}/data" for x in names))
        return rows.groupBy(*self.dims, self.drug, self.event).agg(F.sum("n").alias("n"))

    def cube(self) -> DataFrame:
        """``signal.pair_counts`` of all rows so far."""
        return signal.cubed(self.base(), self.dims, self.drug, self.event)


def exploded_pairs(reports: DataFrame, keys: list[str], drugs: str, events: str) -> DataFrame:
    """(keys, drug, event): every drug of a report's list with every event of its other list; reports without either give none."""
    return reports.select(*keys, F.explode(drugs).alias("drug"), events).select(*keys, "drug", F.explode(events).alias("event"))
