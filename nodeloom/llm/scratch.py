"""Written tables that cut lineage, kept in the folder which ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, str | None]] = []
_owner: list[str | None] = [None]


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where the setting is absent and all work is in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="nodeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/nodeloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, _owner[0]))
    return path


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and read it back: later plans start at the files and outlive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def owned(name: str):
    """Tables written inside are the owner's, to be released together."""
    before, _owner[0] = _owner[0], name
    try:
        yield
    finally:
        _owner[0] = before


def release(spark: SparkSession, keep: DataFrame | None = None, owner: str | None = None) -> None:
    """Delete the tables written so far, or the owner's, but for those that ``keep`` reads; other results must have been consumed."""
    files = keep.inputFiles()[:1] if keep is not None else []
    for entry in [x for x in _written if x[0] is spark and (owner is None or x[2] == owner)]:
        path = entry[1]
        if any(path.rsplit("/", 1)[1] in f for f in files):
            continue
        with contextlib.suppress(Exception):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _written.remove(entry)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _, _ in _written}.values():
        with contextlib.suppress(Exception):
            release(spark)


def light_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of the batches that Python functions get; long texts would make the default ones large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
