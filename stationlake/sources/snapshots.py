"""Tables of folders that are never changed, under a manifest that is swapped last.

A table is a folder with

    batch=<label>/<partition>=<value>/   parquet files, written once
    _snapshots/<version>.json            the folders that make up this version

Rows are written to a new ``batch`` folder first. The commit is one rename of the finished manifest to
the next version's name, which fails if another writer took that name: a job that ends
anywhere before it leaves the table as it was, readers always see one whole version, and old versions
stay readable until ``vacuum``. Manifests list folders, a handful for each partition value and level,
never rows.

A landed micro-batch is remembered with the number that its source gave it, so a batch that runs
again after its commit adds nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stationlake.sources.joins import match_keys
from stationlake.sources.shared import staged

LOG, NULL_NAME = "_snapshots", "__HIVE_DEFAULT_PARTITION__"
#: So many folders of one partition value and level are merged to one of the next level.
FAN = 8
TARGET_BYTES = 128 << 20


class Conflict(RuntimeError):
    """The table was changed by somebody else since it was read."""


@dataclass(frozen=True)
class Entry:
    """A folder of files of one partition value; ``level`` counts the merges behind it."""

    folder: str
    value: str | None
    level: int = 0
    files: int = 0
    size: int = 0


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    entries: tuple[Entry, ...] = ()
    landed: dict[str, int] = field(default_factory=dict)

    def of(self, values: Iterable[str | None] | None = None) -> list[Entry]:
        """Entries of the wanted partition values (all without)."""
        wanted = None if values is None else set(values)
        return [e for e in self.entries if wanted is None or e.value in wanted]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, whatever store it lies in."""
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def text_of(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions in order."""
    log = f"{path}/{LOG}"
    fs = _files(spark, log)
    if not fs.exists(_path(spark, log)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, log))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """A version of the table, the last one by default; None where nothing was ever committed."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"no version {version}, only {known}")
    if not known:
        return None
    version = known[-1] if version is None else version
    held = json.loads(text_of(spark, f"{path}/{LOG}/{version:012d}.json"))
    return Snapshot(version, tuple(Entry(**e) for e in held["entries"]), held["landed"])


def _publish(spark: SparkSession, path: str, new: Snapshot) -> None:
    """Give the finished manifest its name; ``Conflict`` if the version exists."""
    log = f"{path}/{LOG}"
    fs = _files(spark, log)
    fs.mkdirs(_path(spark, log))
    made, final = _path(spark, f"{log}/.{new.version}-{uuid.uuid4().hex}"), _path(spark, f"{log}/{new.version:012d}.json")
    out = fs.create(made, False)
    text = json.dumps({"entries": [asdict(e) for e in new.entries], "landed": new.landed})
    out.write(text.encode("utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(made), fs.makeQualified(final), none)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
            raise
        fs.delete(made, False)
        raise Conflict(f"version {new.version} of {path} exists") from failed


def commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None], tries: int = 20) -> Snapshot:
    """Apply ``change`` to the last version and publish the result as the next one.

    When another writer was first, the change is applied to their version; it raises ``Conflict``
    itself where it cannot hold there, and returns None where there is nothing to do.
    """
    for left in range(tries, 0, -1):
        base = snapshot(spark, path) or Snapshot()
        new = change(base)
        if new is None:
            return base
        new = replace(new, version=base.version + 1)
        try:
            _publish(spark, path, new)
            return new
        except Conflict:
            if left == 1:
                raise
    raise ValueError("no tries")


def write_folder(rows: DataFrame, path: str, label: str, partition: str, level: int = 0) -> list[Entry]:
    """Write rows to the folder of ``label``, in place of an earlier try, and list what was written."""
    spark = rows.sparkSession
    folder = f"{path}/batch={label}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(folder)
    fs = _files(spark, folder)
    found = []
    for status in fs.listStatus(_path(spark, folder)):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{partition}="):
            held = fs.getContentSummary(status.getPath())
            value = unquote(name.split("=", 1)[1])
            found.append(Entry(
                f"batch={label}/{name}", None if value == NULL_NAME else value, level, held.getFileCount(), held.getLength()
            ))
    return found


def read_entries(spark: SparkSession, path: str, schema: T.StructType, entries: Iterable[Entry]) -> DataFrame:
    """Rows of some folders, with the columns of ``schema``."""
    folders = [f"{path}/{e.folder}" for e in entries]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def adopted(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> Snapshot:
    """The last version; files that lie in the folder without any manifest are copied into the first one."""
    held = snapshot(spark, path)
    if held is not None:
        return held
    try:
        before = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Snapshot()
    entries = write_folder(before.select(*schema.names), path, f"adopted-{uuid.uuid4().hex}", partition)

    def first(base: Snapshot) -> Snapshot:
        if base.version:
            raise Conflict(f"{path} was adopted by another writer")
        return replace(base, entries=tuple(entries))

    return commit(spark, path, first) if entries else Snapshot()


def land(spark: SparkSession, path: str, rows: DataFrame, partition: str, source: str, number: int) -> bool:
    """Add the rows of a source's numbered batch, once. False if that batch was committed before."""
    held = snapshot(spark, path) or Snapshot()
    if held.landed.get(source, -1) >= number:
        return False
    entries = write_folder(rows, path, f"{number}-{source}", partition)

    def add(base: Snapshot) -> Snapshot | None:
        if base.landed.get(source, -1) >= number:
            return None
        return replace(base, entries=(*base.entries, *entries), landed={**base.landed, source: number})

    commit(spark, path, add)
    return True


def write(
    rows: DataFrame,
    path: str,
    schema: T.StructType,
    partition: str,
    order: list[str],
    series: list[str],
    mode: str = "replace",
) -> Snapshot:
    """Write rows as the next version, ranged on partition and ``order``.

    ``replace`` replaces the series (equal values of partition and ``series``) present in ``rows`` and keeps all
    others, ``overwrite`` replaces whole partition values, ``append`` adds. Only folders of partition
    values present are read and written again. If another writer changed the same ones meanwhile,
    ``Conflict`` is raised.
    """
    if mode not in ("replace", "overwrite", "append"):
        raise ValueError(f"no mode {mode}")
    spark = rows.sparkSession
    held = adopted(spark, path, schema, partition)
    rows = rows.select(*schema.names)
    if mode == "replace":
        rows = staged(rows, "snapshot-new")
        present = [r[0] for r in rows.select(partition).distinct().collect()]  # each is a folder to be written
        keys = [partition, *series]
        before = read_entries(spark, path, schema, held.of(present))
        rows = rows.unionByName(match_keys(before, rows.select(*keys).distinct(), keys, "left_anti"))
    ranged = rows.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order)
    made = write_folder(ranged, path, uuid.uuid4().hex, partition)
    values = {e.value for e in made}

    def change(base: Snapshot) -> Snapshot | None:
        if not made:
            return None
        if mode == "append":
            return replace(base, entries=(*base.entries, *made))
        if base.of(values) != held.of(values):
            raise Conflict(f"values {sorted(map(str, values))} of {path} were changed by another writer")
        return replace(base, entries=(*[e for e in base.entries if e.value not in values], *made))

    return commit(spark, path, change)


def crowded(held: Snapshot, fan: int) -> list[Entry]:
    """The folders to merge next: per partition value those of its lowest level that has ``fan`` of them."""
    by_level: dict[tuple, list[Entry]] = {}
    for e in held.entries:
        by_level.setdefault((e.value, e.level), []).append(e)
    lowest: dict[str | None, int] = {}
    for (value, level), own in by_level.items():
        if len(own) >= fan:
            lowest[value] = min(level, lowest.get(value, level))
    return [e for value, level in lowest.items() for e in by_level[value, level]]


def compact(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition: str,
    order: list[str],
    fan: int = FAN,
    merge: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Merge small folders until no partition value has ``fan`` of one level; returns the rounds.

    A row is written again once a level, so a table of n batches rewrites each row about log(n) times
    and keeps fewer than ``fan`` folders a level and value. ``merge`` reduces the rows of the
    folders, for tables of sums. Rows are ranged on partition and ``order`` to files of about
    ``TARGET_BYTES``; folders of several values are merged by one job.
    """
    rounds = 0
    while True:
        held = snapshot(spark, path) or Snapshot()
        old = crowded(held, fan)
        if not old:
            return rounds
        rows = read_entries(spark, path, schema, old)
        if merge is not None:
            rows = merge(rows).select(*schema.names)
        values = len({e.value for e in old})
        files = max(values, -(-sum(e.size for e in old) // TARGET_BYTES))
        keys = [partition, *order]
        ranged = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
        level = {e.value: e.level + 1 for e in old}
        made = [replace(e, level=level[e.value]) for e in write_folder(ranged, path, f"merged-{uuid.uuid4().hex}", partition)]
        gone = set(old)

        def swap(base: Snapshot) -> Snapshot:
            if not gone <= set(base.entries):  # noqa: B023
                raise Conflict(f"folders of {path} were replaced while they were merged")
            return replace(base, entries=(*[e for e in base.entries if e not in gone], *made))  # noqa: B023

        commit(spark, path, swap)
        rounds += 1


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than_hours: float = 24.0) -> int:
    """Delete manifests but the last ``keep``, and folders that none of those names; returns the folders.

    Folders younger than ``older_than_hours`` stay: a writer may be about to commit them.
    """
    known = versions(spark, path)
    if not known:
        return 0
    kept = known[-max(keep, 1):]
    live = {e.folder.split("/")[0] for v in kept for e in snapshot(spark, path, v).entries}
    fs = _files(spark, path)
    before = (time.time() - 3600 * older_than_hours) * 1000
    for v in known[:-max(keep, 1)]:
        fs.delete(_path(spark, f"{path}/{LOG}/{v:012d}.json"), False)
    gone = 0
    for status in fs.listStatus(_path(spark, path)):
        name = status.getPath().getName()
        if name.startswith("batch=") and name not in live and status.getModificationTime() < before:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
