"""Incremental processing: a work-item ledger with leases and fencing tokens.

A work item is one version of a record: (item, version). Ledger entries are append-only facts

``item string, version string, token bigint, at_ms bigint``

written by a run that holds the lease numbered ``token``. Lease numbers grow, so the number is also the fencing token:
among the entries of one item only that of the greatest *committed* token counts, a stale writer's entry is rejected
whenever it arrives. A lease is committed once its run has succeeded; it is live while the run is unfinished and younger
than ``lease_ms``; otherwise (failed, aborted, never reported, or unlisted) it has expired and its items are pending again.

:class:`Ledger` keeps such a ledger in a shared folder. Tokens and outcomes are files created only if they don't exist, so
two coordinators never share a token and a lease has one outcome; entries and results lie at paths made from the token.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut
from lodestone.sources.tables import canonical_hash, canonical_path, table

DONE, LEASED, PENDING = "done", "leased", "pending"


def lease_states(runs: DataFrame, now_ms: int | None = None, lease_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """``token, lease`` for each listed run: committed, live or expired.

    Without ``now_ms`` an unfinished run counts as expired (the batch view: the next run starts now, nothing else runs).
    Null run ids and null states give expired leases; a run listed twice takes its best state.
    """
    live = F.lit(False) if now_ms is None else (F.col("status").isNull() & F.col("finished_ms").isNull() & (F.col("started_ms") + lease_ms > F.lit(now_ms)))
    state = F.when(F.col("status") == "succeeded", 2).when(live, 1).otherwise(0)
    return (
        runs.where("run_id is not null")
        .groupBy(F.col("run_id").alias("token"))
        .agg(F.max(state).alias("lease"))
    )


def ledger_states(items: DataFrame, entries: DataFrame, leases: DataFrame) -> DataFrame:
    """State of each wanted (item, version): its row plus ``state`` and the deciding ``token``.

    ``items``: item, version and any other columns (kept as they are). Entries with a null item decide nothing; one with a null
    version decides like any other and equals no version.
    Entries of unlisted leases are dropped by the join with ``leases``, whose size Spark checks before it broadcasts it.
    Both aggregates fold rows before the shuffle, so an item that holds a third of all entries costs one row per task.
    """
    known = entries.where("item is not null").join(leases.where("lease > 0"), "token")
    newest = known.groupBy("item").agg(
        F.max_by(F.struct("version", "token"), F.when(F.col("lease") == 2, F.struct("token", "at_ms", "version"))).alias("done"),
        F.max_by(F.struct("version", "token"), F.when(F.col("lease") == 1, F.struct("token", "at_ms", "version"))).alias("held"),
    ).withColumnsRenamed({"item": "__item", "done": "__done", "held": "__held"})
    j = items.join(newest, items["item"] == newest["__item"], "left")
    done = F.coalesce(F.col("__done.version") == F.col("version"), F.lit(False))
    held = F.coalesce((F.col("__held.version") == F.col("version")) & (F.col("__held.token") > F.coalesce(F.col("__done.token"), F.lit(-1))), F.lit(False))
    return (
        j.withColumn("state", F.when(done, DONE).when(held, LEASED).otherwise(PENDING))
        .withColumn("token", F.when(done, F.col("__done.token")).when(held, F.col("__held.token")))
        .drop("__item", "__done", "__held")
    )


FENCED = "fenced"


class Ledger:
    """A ledger in a shared folder.

    ``leases/<token>``       when the lease was taken; created exclusively, which also hands out the token
    ``outcomes/<token>``     how it ended; created exclusively, so the first word on a lease is the last
    ``entries/t=<token>``    its items, ``results/t=<token>`` what its run wrote: paths made from the token alone, so a retry
                             overwrites its own output and nobody else's
    ``compact/c=<token>``    the deciding entries of all leases up to that token

    Whoever takes over the items of an expired lease first gives that lease the outcome ``fenced``: its stale writer can
    then neither commit nor write results. The file system must create files atomically (HDFS, local disks, object stores
    with conditional writes).
    """

    ENTRY = "item string, version string, token bigint, at_ms bigint"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # -- files ---------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, content: dict) -> bool:
        """Write a small file unless it is there already: False if it is."""
        p, fs = self._path(name)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(json.dumps(content).encode())
        out.close()
        return True

    def _numbers(self, name: str, prefix: str = "") -> list[int]:
        """Tokens that have a file or finished folder below ``name``: one per run, however many items a run holds."""
        p, fs = self._path(name)
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        found = [n[len(prefix) :] for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]
        return sorted(int(n) for n in found if not prefix or fs.exists(self._path(f"{name}/{prefix}{n}/_SUCCESS")[0]))

    def _folders(self, name: str, tokens: list[int], schema: str, prefix: str = "t=") -> DataFrame:
        if not tokens:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{name}/{prefix}{t}" for t in tokens])

    # -- views ---------------------------------------------------------------------------------------------------------

    def leases(self) -> DataFrame:
        """run_id, started_ms, finished_ms, status of every lease: one small file each, read in one job."""
        schema = "started_ms bigint, finished_ms bigint, status string"

        def read(name: str) -> DataFrame:
            ids = self._numbers(name)
            if not ids:
                return self.spark.createDataFrame([], "run_id bigint, " + schema)
            d = self.spark.read.schema(schema).json([f"{self.base}/{name}/{t}" for t in ids])
            return d.select(F.regexp_extract(F.input_file_name(), r"/(\d+)$", 1).cast("bigint").alias("run_id"), "started_ms", "finished_ms", "status")

        ends = read("outcomes").select("run_id", "finished_ms", "status")
        return read("leases").select("run_id", "started_ms").join(ends, "run_id", "left").select("run_id", "started_ms", "finished_ms", "status")

    def entries(self) -> DataFrame:
        done = max(self._numbers("compact", "c="), default=0)
        rest = self._folders("entries", [t for t in self._numbers("entries", "t=") if t > done], self.ENTRY)
        return rest.unionByName(self._folders("compact", [done], self.ENTRY, "c=")) if done else rest

    def states(self, items: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
        return ledger_states(items, self.entries(), lease_states(self.leases(), now_ms, lease_ms))

    def results(self, schema: str) -> DataFrame:
        """Rows written under committed leases; those of other leases don't exist for readers."""
        won = {r.run_id for r in self.leases().where("status = 'succeeded'").select("run_id").collect()}
        return self._folders("results", [t for t in self._numbers("results", "t=") if t in won], schema)

    # -- verbs ---------------------------------------------------------------------------------------------------------

    def lease(self, items: DataFrame, now_ms: int, lease_ms: int) -> tuple[int, DataFrame]:
        """Take every pending item: returns the token and the leased rows, read back from the token's own folder joined with
        ``items``' columns (cut from their lineage, so that a recomputed task can't see the lease it is part of)."""
        token = max(self._numbers("leases"), default=0) + 1
        while not self._create(f"leases/{token}", {"started_ms": now_ms}):
            token += 1
        known = self.leases()
        for r in known.where((F.col("run_id") < token) & F.col("status").isNull() & (F.col("started_ms") + lease_ms <= now_ms)).select("run_id").collect():
            self._create(f"outcomes/{r.run_id}", {"finished_ms": now_ms, "status": FENCED})
        # A smaller lease that is live but hasn't written its entries yet may be about to take anything: leave all to it.
        written, ended = set(self._numbers("entries", "t=")), set(self._numbers("outcomes"))
        busy = any(t < token and t not in written and t not in ended for t in self._numbers("leases") if t > max(self._numbers("compact", "c="), default=0))
        pending = self.states(items, now_ms, lease_ms).where(F.col("state") == PENDING).drop("state", "token")
        taken = cut(pending.limit(0) if busy else pending)
        taken.select("item", "version", F.lit(token).cast("bigint").alias("token"), F.lit(now_ms).cast("bigint").alias("at_ms")).write.mode("overwrite").parquet(f"{self.base}/entries/t={token}")
        return token, taken

    def write(self, token: int, rows: DataFrame) -> bool:
        """Results of a lease at its own path, overwritten by a retry; False once the lease has an outcome."""
        if token in self._numbers("outcomes"):
            return False
        rows.write.mode("overwrite").parquet(f"{self.base}/results/t={token}")
        return True

    def commit(self, token: int, now_ms: int, status: str = "succeeded") -> bool:
        """Report the end of a lease; False if it has ended already, also by being fenced when a later lease took its items."""
        return token in self._numbers("leases") and self._create(f"outcomes/{token}", {"finished_ms": now_ms, "status": status})

    def compact(self) -> int | None:
        """Fold the entries of the leases up to the last one before any undecided lease into one folder with one entry per
        item; returns that token. Older folders go only after the new one is complete, so readers and retries see either."""
        leased, ended = self._numbers("leases"), set(self._numbers("outcomes"))
        upto = 0
        for t in leased:
            if t not in ended:
                break
            upto = t
        before = max(self._numbers("compact", "c="), default=0)
        if upto <= before:
            return None
        won = self.leases().where("status = 'succeeded'").select(F.col("run_id").alias("token"))
        kept = self.entries().where(F.col("token") <= upto).join(won, "token", "left_semi")
        one = kept.groupBy("item").agg(F.max_by(F.struct("version", "token", "at_ms"), F.struct("token", "at_ms", "version")).alias("r")).select("item", "r.*")
        one.write.mode("overwrite").parquet(f"{self.base}/compact/c={upto}")
        for name in [f"entries/t={t}" for t in leased if t <= upto] + ([f"compact/c={before}"] if before else []):
            p, fs = self._path(name)
            fs.delete(p, True)
        return upto


def current_versions(files: DataFrame) -> DataFrame:
    """The current version of each path: item (canonical path), version (canonical hash), path and content_hash as stored.

    Only three columns are read. Rows with a null path are no record; a null hash is a version of its own (always pending).
    """
    f = files.where("path is not null").select("path", "content_hash", "last_scanned_ms")
    return (
        f.groupBy(canonical_path(F.col("path")).alias("item"))
        .agg(F.max_by(F.struct("path", "content_hash"), F.struct("last_scanned_ms", "content_hash", "path")).alias("r"))
        .select("item", canonical_hash(F.col("r.content_hash")).alias("version"), "r.path", "r.content_hash")
    )


def scan_entries(processed: DataFrame) -> DataFrame:
    """processed_files as ledger entries."""
    return processed.select(
        canonical_path(F.col("path")).alias("item"), canonical_hash(F.col("content_hash")).alias("version"),
        F.col("run_id").alias("token"), F.col("processed_ms").alias("at_ms"),
    )


def file_states(spark: SparkSession, root: str) -> DataFrame:
    """Ledger state of the current version of each file."""
    return ledger_states(current_versions(table(spark, root, "files")), scan_entries(table(spark, root, "processed_files")), lease_states(table(spark, root, "scan_runs")))
