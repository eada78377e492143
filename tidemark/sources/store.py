"""Tables of Parquet files with insert-if-absent and upsert by key, for many writers.

A version of a table is a manifest (a Parquet table: file, rows, smallest and largest
first key) and an entry ``_log/<number>`` that names it. A writer makes new data files
and a manifest, then creates the entry of the next number, which only one writer can:
the others look at what was committed meanwhile. If that left their files alone and
added none in their range of keys, they put their files on top of it; else they do
their work anew on the newer version, so no writer's rows are lost. A job that dies
leaves files that no version names, which ``expire`` deletes when they are old.

A merge reads the keys of files whose range meets the batch's, rewrites those that hold
a key of the batch and leaves the others, under their names. Rows are written in ranges
of the keys, so that such files are few. Only paths and counts reach the driver.

A commit can carry a mark, (name, number): the last number of each name is handed on from
version to version, and a write whose mark is not beyond it changes nothing. So a step of
a run or a batch of a stream that comes twice is done once.

Rows with a null in a key equal no row: they are added. The entry is created by a rename
that fails if the target exists (HDFS) or a hard link (local files); a store without
either needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _one_of(batch: DataFrame, keys: list[str], pick) -> DataFrame:
    """One row for each key, pre-aggregated before the shuffle."""
    return batch.groupBy(*keys).agg(pick(F.struct(*batch.columns)).alias("_row")).select("_row.*")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the target, and of the batch those whose key is new; in a batch the first row by ``order`` wins."""
    first = _one_of(batch, keys, lambda row: F.min_by(row, order))
    return target.unionByName(first.join(target, keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch replace those with their key; in a batch the last row by ``order`` wins; columns it lacks become null."""
    last = _one_of(batch, keys, lambda row: F.max_by(row, order))
    return target.join(last, keys, "left_anti").select(*target.columns).unionByName(last.select(*[c for c in target.columns if c in last.columns]), allowMissingColumns=True)


def append_log(log: DataFrame, events: DataFrame) -> DataFrame:
    """An event log with more events; columns that either lacks become null."""
    return log.unionByName(events, allowMissingColumns=True)


def backfill(target: DataFrame, source: DataFrame, key: str, column: str, default) -> DataFrame:
    """``column`` of every row set to the source's value for its key, or ``default`` without one."""
    found = source.groupBy(key).agg(F.max(column).alias("_found"))
    return target.drop(column).join(found, key, "left").withColumn(column, F.coalesce("_found", F.lit(default))).drop("_found")


def clean_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def watchlist_changed(watched: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """A watchlist (ticker, added_at, note) after additions that are new, removals and changed notes, by cleaned ticker."""
    by_ticker = lambda df: df.withColumn("ticker", clean_ticker(F.col("ticker")))
    out = watched if add is None else insert_ignore(watched, by_ticker(add), ["ticker"], "added_at")
    if remove is not None:
        out = out.join(by_ticker(remove).select("ticker").distinct(), "ticker", "left_anti")
    if notes is not None:
        new = by_ticker(notes).groupBy("ticker").agg(F.max("note").alias("_note"))
        out = out.join(new, "ticker", "left").withColumn("note", F.coalesce("_note", "note")).drop("_note")
    return out.select(*watched.columns)


@dataclass
class Version:
    """One committed state: its number, manifest folder, schema, keys and marks."""

    number: int
    manifest: str
    schema: StructType
    keys: list[str]
    marks: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """What a write would commit: files that go, the folder of new ones, the range of first keys that it looked at."""

    removed: list[str]
    added: str | None
    schema: StructType
    keys: list[str]
    span: tuple | None = None
    replaces_all: bool = False


def _is_done(v: Version | None, mark: tuple[str, int] | None) -> bool:
    return v is not None and mark is not None and v.marks.get(mark[0], mark[1] - 1) >= mark[1]


class TableStore:
    """Named tables under a folder of any store that Spark reads."""

    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    # --- the log

    def _numbers(self, name: str) -> list[int]:
        at = self._path(f"{self.folder}/{name}/_log")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, name: str, number: int | None = None) -> Version | None:
        """The last version, or that of a number; None if there is none."""
        numbers = self._numbers(name)
        number = (numbers[-1] if numbers else None) if number is None else number
        if number not in numbers:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/{name}/_log/{number:012d}"))
        try:
            entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, entry["manifest"], StructType.fromJson(entry["schema"]), entry["keys"], entry["marks"])

    def _publish(self, name: str, v: Version) -> bool:
        """Creates the log entry of ``v``; False if another writer has that number."""
        log = f"{self.folder}/{name}/_log"
        self._fs.mkdirs(self._path(log))
        draft, target = self._path(f"{log}/draft-{uuid.uuid4().hex}"), self._path(f"{log}/{v.number:012d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"manifest": v.manifest, "schema": v.schema.jsonValue(), "keys": v.keys, "marks": v.marks}).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        if self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    # --- files

    def files(self, name: str, number: int | None = None) -> DataFrame:
        """The manifest: file, n_rows, low, high."""
        return self.spark.read.parquet(self.version(name, number).manifest)

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def _rows(self, v: Version, files: list[str]) -> DataFrame:
        return self.spark.read.schema(v.schema).parquet(*files) if files else self.spark.createDataFrame([], v.schema)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        v = self.version(name, number)
        if v is None:
            raise ValueError(f"there is no table {name} of that version in {self.folder}")
        return self._rows(v, [r.file for r in self.spark.read.parquet(v.manifest).select("file").collect()])

    def _write_files(self, name: str, df: DataFrame, keys: list[str]) -> str:
        at = f"{self.folder}/{name}/data/{uuid.uuid4().hex}"
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.parquet(at)
        return at

    def _described(self, at: str, schema: StructType, keys: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(at).withColumn("file", F.input_file_name())
        low, high = (f(keys[0]) if keys else F.lit(None).cast("string") for f in (F.min, F.max))
        return rows.groupBy("file").agg(F.count("*").alias("n_rows"), low.alias("low"), high.alias("high"))

    # --- commits

    def _commit(self, name: str, plan: Callable[[Version | None], Change], mark: tuple[str, int] | None) -> int:
        """Carries out ``plan`` on the last version and commits it, anew if another writer was in its way."""
        for _ in range(self.ATTEMPTS):
            base = self.version(name)
            if _is_done(base, mark):
                return base.number
            change = plan(base)
            on = base
            while True:
                number = on.number + 1 if on else 1
                manifest = f"{self.folder}/{name}/manifests/{uuid.uuid4().hex}"
                self._manifest(on, change).write.parquet(manifest)
                marks = {**(on.marks if on else {}), **(dict([mark]) if mark else {})}
                if self._publish(name, Version(number, manifest, change.schema, change.keys, marks)):
                    return number
                self._fs.delete(self._path(manifest), True)
                on = self.version(name)
                if _is_done(on, mark) or not self._fits(change, base, on):
                    break
            if change.added:
                self._fs.delete(self._path(change.added), True)
        raise RuntimeError(f"{name}: {self.ATTEMPTS} attempts met other writers' commits")

    def _manifest(self, on: Version | None, change: Change) -> DataFrame:
        new = self._described(change.added, change.schema, change.keys) if change.added else None
        if on is None or change.replaces_all:
            return new
        kept = self.spark.read.parquet(on.manifest)
        if change.removed:
            kept = kept.join(self.spark.createDataFrame([(f,) for f in change.removed], "file string"), "file", "left_anti")
        return kept if new is None else kept.withColumns({c: F.col(c).cast(new.schema[c].dataType) for c in ("low", "high")}).unionByName(new)

    def _fits(self, change: Change, base: Version | None, newer: Version) -> bool:
        """Whether a change planned on ``base`` holds on ``newer`` too."""
        if base is None or change.replaces_all or newer.schema != base.schema:
            return False
        before, after = (self.spark.read.parquet(v.manifest) for v in (base, newer))
        if change.removed:
            gone = before.join(after, "file", "left_anti").where(F.col("file").isin(change.removed))
            if gone.limit(1).count():
                return False
        added = after.join(before, "file", "left_anti")
        return change.span is None or not self._overlapping(added, change.span).limit(1).count()

    @staticmethod
    def _overlapping(manifest: DataFrame, span: tuple) -> DataFrame:
        return manifest.where(F.col("low").isNull() | ((F.col("low") <= F.lit(span[1])) & (F.col("high") >= F.lit(span[0]))))  # null: written without keys

    def write(self, name: str, df: DataFrame, keys: tuple[str, ...] | list[str] = (), mark: tuple[str, int] | None = None) -> int:
        """The rows of ``df`` replace all rows."""
        return self._commit(name, lambda base: Change([], self._write_files(name, df, list(keys)), df.schema, list(keys), replaces_all=True), mark)

    def _merge(self, name: str, batch: DataFrame, keys: list[str], order: str, replace: bool, mark: tuple[str, int] | None) -> int:
        pick = F.max_by if replace else F.min_by
        blank = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0
        one = _one_of(batch.where(~blank), keys, lambda row: pick(row, order))
        if _is_done(self.version(name), mark):
            return self.version(name).number
        staged = f"{self.folder}/{name}/staged/{uuid.uuid4().hex}"
        one.unionByName(batch.where(blank)).drop("_content").write.parquet(staged)  # read several times, and again if another writer is in the way
        rows = self.spark.read.schema(batch.drop("_content").schema).parquet(staged)
        one = rows.where(~blank)

        def plan(base: Version | None) -> Change:
            if base is None:
                return Change([], self._write_files(name, rows, keys), rows.schema, keys)
            asked = rows.select(*[c for c in base.schema.names if c in rows.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name not in rows.columns]).select(*base.schema.names)
            span = one.agg(F.min(keys[0]), F.max(keys[0])).first()
            if span[0] is None:
                return Change([], self._write_files(name, asked, keys), base.schema, keys)
            near = [r.file for r in self._overlapping(self.spark.read.parquet(base.manifest), span).select("file").collect()]
            if not near:
                return Change([], self._write_files(name, asked, keys), base.schema, keys, tuple(span))
            there = self._rows(base, near)
            if not replace:
                return Change([], self._write_files(name, asked.join(there.select(*keys), keys, "left_anti").select(*base.schema.names), keys), base.schema, keys, tuple(span))
            held = there.select(*keys, F.input_file_name().alias("_file")).join(one.select(*keys), keys, "left_semi")
            touched = [r._file for r in held.select("_file").distinct().collect()]
            kept = self._rows(base, touched).join(one.select(*keys), keys, "left_anti").select(*base.schema.names)
            return Change(touched, self._write_files(name, kept.unionByName(asked), keys), base.schema, keys, tuple(span))

        try:
            return self._commit(name, plan, mark)
        finally:
            self._fs.delete(self._path(staged), True)

    def insert_ignore(self, name: str, batch: DataFrame, keys: list[str], order: str, mark: tuple[str, int] | None = None) -> int:
        """Adds the rows whose key is new; of a batch the first by ``order``. No file is rewritten."""
        return self._merge(name, batch, keys, order, False, mark)

    def upsert(self, name: str, batch: DataFrame, keys: list[str], order: str, mark: tuple[str, int] | None = None) -> int:
        """Rows of the batch, the last by ``order``, replace those of their key."""
        return self._merge(name, batch, keys, order, True, mark)

    def is_done(self, name: str, mark: tuple[str, int]) -> bool:
        return _is_done(self.version(name), mark)

    # --- care

    def compact(self, name: str, least_rows: int) -> int:
        """Files of fewer rows become few, in ranges of the keys; the others stay."""

        def plan(base: Version) -> Change:
            small = [r.file for r in self.spark.read.parquet(base.manifest).where(F.col("n_rows") < least_rows).select("file").collect()]
            rows = self._rows(base, small)
            return Change(small, self._write_files(name, rows, base.keys) if len(small) > 1 else None, base.schema, base.keys) if len(small) > 1 else Change([], None, base.schema, base.keys)

        return self._commit(name, plan, None)

    def expire(self, name: str, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Forgets all versions but the last ``keep``; deletes what no version names, if older than so many seconds. Returns the number of deleted data files."""
        numbers = self._numbers(name)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{name}/_log/{n:012d}"), False)
        kept = [self.version(name, n) for n in numbers[-keep:]]
        manifests = {self._path(v.manifest).getName() for v in kept}
        named = {tuple(r.file.rsplit("/", 2)[-2:]) for v in kept for r in self.spark.read.parquet(v.manifest).select("file").collect()}
        limit, deleted = (time.time() - older_than) * 1000, 0
        for status in self._listed(f"{self.folder}/{name}/manifests"):
            if status.getPath().getName() not in manifests and status.getModificationTime() < limit:
                self._fs.delete(status.getPath(), True)
        for folder in self._listed(f"{self.folder}/{name}/data"):
            parts = [f for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            loose = [f for f in parts if (folder.getPath().getName(), f.getPath().getName()) not in named and f.getModificationTime() < limit]
            for f in loose:
                self._fs.delete(f.getPath(), False)
            deleted += len(loose)
            if parts and len(loose) == len(parts):
                self._fs.delete(folder.getPath(), True)
        return deleted

    def _listed(self, at: str) -> list:
        return list(self._fs.listStatus(self._path(at))) if self._fs.exists(self._path(at)) else []

    def health(self, names: list[str]) -> DataFrame:
        """Rows of each table, from the manifests."""
        counts = [self.files(n).agg(F.lit(n).alias("table"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")) for n in names]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out


# --- the savers


@dataclass(frozen=True)
class Saved:
    """How rows of a table are saved: by which key, replacing or not, with which generated id."""

    keys: tuple[str, ...]
    replace: bool
    id: str | None = None


#: Unique keys of the tables, and whether a row with a known key replaces or is ignored.
TABLES = {
    "stocks": Saved(("ticker",), True),
    "prices_clean": Saved(("ticker", "date"), True),
    "fundamentals_clean": Saved(("ticker", "fiscal_date", "fiscal_period"), True),
    "monthly_features": Saved(("feature_date", "ticker"), True),
    "targets": Saved(("feature_date", "ticker"), True),
    "realized_performance": Saved(("prediction_date", "ticker"), True),
    "provider_availability": Saved(("provider", "variable_name"), True),
    "prices_raw": Saved(("provider", "ticker", "date"), False),
    "benchmark_prices": Saved(("benchmark_ticker", "date"), False),
    "fundamentals_raw": Saved(("provider", "ticker", "fiscal_date", "fiscal_period"), False),
    "model_training_runs": Saved(("model_version",), False),
    "predictions": Saved(("prediction_id",), False, "prediction_id"),
    "prediction_snapshots": Saved(("prediction_date", "ticker"), False, "snapshot_id"),
    "backtest_results": Saved(("backtest_id",), False, "backtest_id"),
}


def with_id(df: DataFrame, name: str) -> DataFrame:
    """Fills ``name`` where it is absent, null or empty with a UUID of the row's content.

    The digest of the other columns, so a task that runs again gives the same id and a
    batch that is saved again is known.
    """
    others = [c for c in df.columns if c != name]
    h = F.substring(F.sha2(F.to_json(F.struct(*sorted(others)), {"ignoreNullFields": "false"}), 256), 1, 32)
    # Version 5 and the variant of RFC 4122.
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    given = F.when(F.trim(F.col(name)) != "", F.col(name)) if name in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(given, made))


def save(store: TableStore, table: str, rows: DataFrame, order: str | None = None, mark: tuple[str, int] | None = None) -> int:
    """Saves rows of one of ``TABLES`` as its entry says; returns the version. Of rows with one key the last (or first) by ``order``, else by their content, counts."""
    how = TABLES[table]
    made = with_id(rows, how.id) if how.id else rows
    by = order or "_content"
    made = made if order else made.withColumn("_content", F.to_json(F.struct(*made.columns)))
    merge = store.upsert if how.replace else store.insert_ignore
    return merge(table, made, list(how.keys), by, mark)
