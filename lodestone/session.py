"""Session settings, shared storage and shipping of the package to executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the driver brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a folder of
    its own; anywhere else this raises, since other machines wouldn't see it."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return str(jsc.get()).rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    path = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: lineage ends in files of the shared folder and survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read again (columnar, prunable, survives executors)."""
    path = f"{shared_dir(df.sparkSession)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors that don't have it on their path: a zip in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return spark
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in {".py", ".peg", ".txt"}:
                z.write(p, f"{root.name}/{p.relative_to(root)}")
    where = f"{shared_dir(spark)}/lodestone-{app}-{uuid.uuid4().hex}/lodestone_pkg.zip"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(buf.getvalue())
    out.close()
    spark.sparkContext.addPyFile(where)
    _SHIPPED.add(app)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan over all cores when its files give fewer tasks than there are (few or unsplittable ones); else unchanged.

    For narrow plans over a scan only: asking for their partitions runs nothing. At scale, where splits outnumber cores,
    no row is moved.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots * 2, *keys)
