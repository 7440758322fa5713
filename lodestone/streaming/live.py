"""Live maintenance with Structured Streaming: a folder of Parquet drops is applied batch by batch to a snapshot.

A snapshot is cut into buckets by the key's hash. A batch rewrites only the buckets its keys fall into, under a folder of its
own (``v=<batch>/b=<bucket>``), written whole before a reader can see it: readers take each bucket from the greatest complete
version that has it (Spark's ``_SUCCESS`` mark). A retried batch overwrites its own folder, so every record is applied once.
One query has one writer; batches are bounded by ``max_files``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.incremental import upsert

#: Buckets of a snapshot. A batch of n keys rewrites at most min(n, BUCKETS) / BUCKETS of it.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, base: str) -> dict[int, set[int]]:
    """Complete versions and their buckets."""
    p, fs = _fs(spark, base)
    out: dict[int, set[int]] = {}
    for st in fs.listStatus(p) if fs.exists(p) else ():
        name = st.getPath().getName()
        if name.startswith("v="):
            inside = [x.getPath().getName() for x in fs.listStatus(st.getPath())]
            if "_SUCCESS" in inside:
                out[int(name[2:])] = {int(x[2:]) for x in inside if x.startswith("b=")}
    return out


def snapshot(spark: SparkSession, base: str, schema, below: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """Each bucket (all, or those asked for) in its greatest complete version (below a batch id, for that batch's own retry);
    empty where there is none."""
    newest: dict[int, int] = {}
    for v, held in _versions(spark, base).items():
        for b in held if below is None or v < below else ():
            if buckets is None or b in buckets:
                newest[b] = max(v, newest.get(b, -1))
    paths = [f"{base}/v={v}/b={b}" for b, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, base: str, keep: int) -> None:
    """Remove buckets that a newer version replaced before the last ``keep`` versions: a retry of the last batch still finds
    what it read."""
    held = _versions(spark, base)
    old = sorted(held)[:-keep] if keep else sorted(held)
    for v in old:
        for b in held[v]:
            if any(b in held[w] for w in old if w > v):
                p, fs = _fs(spark, f"{base}/v={v}/b={b}")
                fs.delete(p, True)
                held[v] = held[v] - {b}
        if not held[v]:
            p, fs = _fs(spark, f"{base}/v={v}")
            fs.delete(p, True)


def follow(spark: SparkSession, source: str, schema, base: str, key: list[str], order: list[str], max_files: int = 100, trigger: dict | None = None, keep: int = 2, buckets: int = BUCKETS):
    """Start (and return) the query that applies files dropped at ``source`` to the snapshot at ``base``; stopping it pauses,
    starting it again resumes from the checkpoint with the files not yet applied.

    In a batch the row that is greatest by ``order`` wins per key, over the snapshot's own row too, so late files can't
    undo newer ones. ``buckets`` must stay the same over the snapshot's life.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def latest(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in key]
        return df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)

    def apply(batch: DataFrame, batch_id: int) -> None:
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        old = snapshot(spark, base, schema, below=batch_id, buckets=touched)
        latest(old.unionByName(batch)).withColumn("b", bucket).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{base}/v={batch_id}")
        vacuum(spark, base, keep)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/_checkpoint").trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def apply_commands(rows: DataFrame, commands: DataFrame, key: list[str]) -> DataFrame:
    """A snapshot after a batch of commands (``op``: upsert, delete or error). Deletes win over upserts of a lower ``seq``;
    an error keeps the last good row and stamps ``last_scan_error``."""
    last = commands.groupBy(*key).agg(F.max_by(F.struct(*[c for c in commands.columns if c not in key]), "seq").alias("c")).select(*key, "c.*")
    written = last.where("op = 'upsert'").select(*rows.columns)
    out = upsert(rows, written, key).join(last.where("op = 'delete'").select(*key), key, "left_anti")
    err = last.where("op = 'error'").select(*key, F.col("last_scan_error").alias("__e"))
    j = out.join(err, key, "left")
    return j.withColumn("last_scan_error", F.coalesce("__e", "last_scan_error")).select(*rows.columns)
