"""S-5: the stored state of the six tables, written whole or only where a job changed it.

Plain Parquet has no UPDATE. ``write_state`` writes whole tables as ``root/v=<version>``, each
partitioned by ``part`` (a month of its date, or a run of ids), which a row never leaves.
``write_changes`` brings that state forward by a job's result and touches only the parts concerned:

1. What will be written rests in a folder of ``root/_changes`` first: the complete new content of
   every part that holds a changed or deleted row, and the added rows of all other parts.
2. The log ``root/_versions`` says that the version is staged.
3. The staged parts replace theirs (dynamic partition overwrite) and the added rows whose keys are
   not there yet are appended. Both come from the staged files alone and may be done again.
4. The log says that the version is applied.

A writer that dies before 2 leaves the old state. After 2, ``read_state`` refuses to read a state that
may be half applied and ``recover`` finishes step 3. Versions are whole numbers that grow. One writer
at a time. A change costs its parts, not the tables: a receipt writes its month of batches and movements
as appended rows, and the parts of the products it credits.

Every write counts, in the pass that writes, NULLs in NOT NULL columns and values outside the enum
domains of the rows it writes (I-3, I-4); the counts are in the returned ``Written``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans import checks
from shelfwise.plans.jobs import JobResult
from shelfwise.session import shuffles_cleaned
from shelfwise.sources import schemas
from shelfwise.sources.tables import Inventory, conform, load

# The range columns each stored table is laid out by, the ones its reports filter on: files hold
# consecutive ranges, so file and row-group statistics skip most of them. The key after it
# splits a day that holds very many rows.
CLUSTER_ON = {"products": ("product_id",), "product_batches": ("expiry_date", "batch_id"),
              "batch_movements": ("movement_date", "movement_id"), "sales": ("sale_date", "sale_id"),
              "sale_items": ("demand_date", "sale_item_id"), "users": ("id",)}
# What a part holds: the rows of a month of this date, or a run of ids. Neither changes in a row's life.
MONTH_OF = {"product_batches": "received_date", "batch_movements": "movement_date", "sales": "sale_date",
            "sale_items": "demand_date"}
IDS_OF = {"products": "product_id", "users": "id"}
IDS_PER_PART = 1_000
MONTH = "'m'yyyy-MM"
PACKED = "zstd"     # what the stored tables and staged changes are compressed with
LOG = "version long, name string, step string"


@dataclass
class Written:
    """What a write did: its folder, rows per table, and rows that break a rule, per (table, column)."""

    path: str
    rows: dict[str, int] = field(default_factory=dict)
    nulls: dict[tuple[str, str], int] = field(default_factory=dict)
    outside: dict[tuple[str, str], int] = field(default_factory=dict)

    def violations(self) -> dict[tuple[str, str], int]:
        return {k: n for d in (self.nulls, self.outside) for k, n in d.items() if n}


def part_of(table: str) -> Column:
    if table in MONTH_OF:
        return F.coalesce(F.date_format(MONTH_OF[table], MONTH), F.lit("none"))
    return F.coalesce(F.concat(F.lit("k"), F.floor(F.col(IDS_OF[table]) / IDS_PER_PART).cast("string")), F.lit("none"))


def _key(table: str) -> list[str]:
    return list(schemas.UNIQUE_KEYS[table][0])


def _audit(name: str, df: DataFrame, new: Column) -> list[Column]:
    """The audit's counts over the ``new`` rows."""
    counts = [F.count(F.when(new, 1)).alias("rows")]
    counts += [F.count(F.when(new & checks.missing(df, c), 1)).alias(f"null:{c}") for c in schemas.NOT_NULL[name]]
    return counts + [F.count(F.when(new & checks.outside(c, domain), 1)).alias(f"outside:{c}")
                     for table, c, domain in schemas.DOMAINS if table == name]


def _write(done: Written, name: str, df: DataFrame, path: str, parts: bool = True, new: Column | None = None) -> None:
    """Write a table's rows by range, in one folder per part, and count in the same pass.

    The counts are taken last of all, of the sorted rows, where no optimizer rule drops them.
    """
    new = F.lit(True) if new is None else new
    by = [*(["part"] if parts else []), *(CLUSTER_ON[name] if parts or name in MONTH_OF else [])]
    if parts:
        df = df.withColumn("part", part_of(name))
    if by:
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    seen = Observation(f"{name}-audit")
    # The stored types are the schema's, whatever a job's sums have grown to; open keys stay as they are.
    columns = [F.col(f.name) if f.name in schemas.OPEN_KEYS else F.col(f.name).cast(f.dataType)
               for f in schemas.SCHEMAS[name]] + ["part"] * parts
    writer = df.observe(seen, *_audit(name, df, new)).select(*columns).write.option("compression", PACKED).mode("errorifexists")
    with shuffles_cleaned(df.sparkSession):
        (writer.partitionBy("part") if parts else writer).parquet(path)
    got = seen.get
    done.rows[name] = done.rows.get(name, 0) + got["rows"]
    for label, n in got.items():
        kind, _, column = label.partition(":")
        if column:
            counts = done.nulls if kind == "null" else done.outside
            counts[name, column] = counts.get((name, column), 0) + n


def write_tables(inv: Inventory, target: str, parts: bool = False) -> Written:
    """Write the six tables as ``target/<table>.parquet``, each range-partitioned and sorted on its
    range columns, with ``parts`` in one folder per part. A table that is already there is an error:
    readers may still use it."""
    done = Written(target)
    for name, df in inv.as_dict().items():
        _write(done, name, df, f"{target}/{name}.parquet", parts)
        if parts and not done.rows[name]:  # no part, so no file that tells the columns
            conform(name, df).limit(0).write.parquet(f"{target}/{name}.parquet/part=none")
    return done


def _log(spark: SparkSession, root: str) -> list:
    """The log's rows in order: one to three small rows a write."""
    try:
        return sorted(tuple(r) for r in spark.read.schema(LOG).parquet(f"{root}/_versions").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _note(spark: SparkSession, root: str, number: int, name: str, step: str) -> None:
    spark.createDataFrame([(number, name, step)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/_versions")


def _next(log: list, version: str | int) -> int:
    number = int(version)
    if log and number <= log[-1][0]:
        raise ValueError(f"version {number} is not greater than {log[-1][0]}")
    return number


def _waiting(log: list) -> list:
    """The log's rows of changes that are staged but not applied."""
    applied = {n for n, _, step in log if step == "applied"}
    return [r for r in log if r[2] == "staged" and r[0] not in applied]


def _base(log: list, root: str) -> str:
    return f"{root}/v={max((n, name) for n, name, step in log if step == 'base')[1]}"


def _current(log: list, root: str) -> str:
    """The folder of the newest whole state; an error if a staged change waits to be applied."""
    if _waiting(log):
        raise RuntimeError(f"version {_waiting(log)[0][0]} is staged but not applied: call recover")
    return _base(log, root)


def write_state(spark: SparkSession, inv: Inventory, root: str, version: str | int) -> Written:
    """Write all six tables as ``root/v=<version>/<table>.parquet`` and make them the current state. A
    crash leaves the old state current. ``version`` is a whole number (text may have leading zeros)."""
    number = _next(_log(spark, root), version)
    done = write_tables(inv, f"{root}/v={version}", parts=True)
    _note(spark, root, number, str(version), "base")
    return done


def read_state(spark: SparkSession, root: str) -> Inventory:
    """The current tables."""
    return load(spark, _current(_log(spark, root), root))


def _stage(spark: SparkSession, done: Written, name: str, base: str, staged: str, result: JobResult) -> set[str]:
    """Write what a table will get: ``parts`` (complete new parts) and ``more`` (rows to append)."""
    kinds = set()
    key = _key(name)
    added = result.added[name] if name in result.added else None
    touched = [d[name].select(*key) for d in (result.changed, result.deleted) if name in d]
    parts: list[str] = []
    if touched:
        keys = (touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])).distinct()
        old = spark.read.parquet(f"{base}/{name}.parquet")
        # At most the table's parts, which are months or runs of ids.
        parts = [r["part"] for r in old.select("part", *key).join(keys, key, "left_semi").select("part").distinct().collect()]
    if parts:
        rows = old.where(F.col("part").isin(parts)).join(keys, key, "left_anti").drop("part").withColumn("_new", F.lit(False))
        if name in result.changed:
            now = result.inventory.as_dict()[name].join(result.changed[name].select(*key).distinct(), key, "left_semi")
            rows = rows.unionByName(now.withColumn("_new", F.lit(True)))
        if added is not None:
            rows = rows.unionByName(added.where(part_of(name).isin(parts)).withColumn("_new", F.lit(True)))
        _write(done, name, rows, f"{staged}/parts/{name}", new=F.col("_new"))
        spark.createDataFrame([(p,) for p in parts], "part string").write.parquet(f"{staged}/touched/{name}")
        kinds.add("parts")
    if added is not None:
        _write(done, name, added.where(~part_of(name).isin(parts)) if parts else added, f"{staged}/more/{name}")
        kinds.add("more")
    return kinds


def _apply(spark: SparkSession, root: str, base: str, number: int, change: str) -> None:
    """Bring staged files into the tables; doing it again changes nothing."""
    what = json.loads(change)
    staged = f"{root}/_changes/{what['folder']}"
    for name in schemas.SCHEMAS:
        target = f"{base}/{name}.parquet"
        if name in what["parts"]:
            stored = spark.read.parquet(target).schema
            new = spark.read.schema(stored).parquet(f"{staged}/parts/{name}")
            with shuffles_cleaned(spark):
                (new.write.option("compression", PACKED).mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("part").parquet(target))
            # A part that lost its last row has no staged row that would overwrite it.
            touched = spark.read.parquet(f"{staged}/touched/{name}")
            for r in touched.join(new.select("part").distinct(), "part", "left_anti").collect():
                new.drop("part").limit(0).write.mode("overwrite").parquet(f"{target}/part={r['part']}")
        if name in what["more"]:
            stored = spark.read.parquet(target).schema
            more = spark.read.schema(stored).parquet(f"{staged}/more/{name}")
            parts = [r["part"] for r in more.select("part").distinct().collect()]
            there = spark.read.schema(stored).parquet(target).where(F.col("part").isin(parts)).select(*_key(name))
            # The keys that an interrupted run has appended are left out. The check reads keys of these parts only;
            # if there is none, the staged files, which lie by range already, are appended as they are.
            with shuffles_cleaned(spark):
                if there.take(1) and more.select(*_key(name)).join(there, _key(name), "left_semi").take(1):
                    more = more.join(there, _key(name), "left_anti").repartitionByRange("part", *CLUSTER_ON[name])
                (more.sortWithinPartitions("part", *CLUSTER_ON[name])
                 .write.option("compression", PACKED).mode("append").partitionBy("part").parquet(target))
    _note(spark, root, number, change, "applied")


def write_changes(spark: SparkSession, root: str, result: JobResult, version: str | int) -> Written:
    """Bring the current state forward by a job's result, whose tables must come from ``read_state``
    of that state. Only the parts of changed and deleted rows are written anew; added rows of other
    parts are appended."""
    log = _log(spark, root)
    base, number = _current(log, root), _next(log, version)
    folder = f"{number}-{uuid.uuid4().hex[:8]}"  # a try that died leaves its own folder behind
    done = Written(base)
    kinds = {name: _stage(spark, done, name, base, f"{root}/_changes/{folder}", result) for name in schemas.SCHEMAS
             if any(name in d for d in (result.added, result.changed, result.deleted))}
    change = json.dumps({"folder": folder, **{k: [n for n, some in kinds.items() if k in some] for k in ("parts", "more")}})
    _note(spark, root, number, change, "staged")
    _apply(spark, root, base, number, change)
    return done


def recover(spark: SparkSession, root: str) -> bool:
    """Finish a change that was staged but not applied; False if there is none."""
    log = _log(spark, root)
    for number, change, _ in _waiting(log):
        _apply(spark, root, _base(log, root), number, change)
    return bool(_waiting(log))
