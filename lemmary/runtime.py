"""Session-level helpers: where intermediate tables live and how they are cut."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The application that has the package already.
_SENT: dict[str, str] = {}
_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset in
    local mode (tests) a folder of our own is made, set as checkpoint dir and removed
    with the driver; on a cluster that is an error, since each executor would write
    to its own disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lemmary-")
        sc.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named


def is_local(spark: SparkSession) -> bool:
    """True if all executors run on the driver's machine."""
    return spark.sparkContext.master.startswith("local")


def _packed(home: Path) -> bytes:
    """The package as a zip archive, the same bytes for the same files."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f.relative_to(home.parent).as_posix()), f.read_bytes())
    return held.getvalue()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started.

    On the driver's machine they get its path; on a cluster the package is written
    to the shared folder once a session and added to the session's Python files.
    """
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if not is_local(spark):
        if _SENT.get("to") != sc.applicationId:
            data = _packed(package)
            path = f"{shared_dir(spark).rstrip('/')}/lemmary/{hashlib.sha256(data).hexdigest()[:16]}-{sc.applicationId}/{package.name}.zip"
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
            out.write(bytearray(data))
            out.close()
            sc.addPyFile(path)
            _SENT["to"] = sc.applicationId
        return
    home = str(package.parent)
    env = sc.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables :func:`materialise` wrote (of one session); frames that read
    them are of no use afterwards. Happens by itself when the driver ends."""
    mine = [x for x in _OWN if spark is None or x[0] is spark]
    _OWN[:] = [x for x in _OWN if x not in mine]
    for spark, path in mine:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass


atexit.register(release)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing),
    keeps the table columnar and compressed, and gives the optimiser its true
    size. Files are removed when the driver ends.
    """
    spark = df.sparkSession
    for name, kind in df.dtypes:
        if kind == "void":  # has no Parquet type
            df = df.withColumn(name, F.col(name).cast("string"))
    path = f"{shared_dir(spark).rstrip('/')}/lemmary/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of a table that is broadcast.
MAX_BYTES = 32 << 20


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes of values;
    never reads further than that many rows. ``df`` should be a written table."""
    size = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        plain = kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
        held = F.lit(0) if plain else F.octet_length(value if kind in ("string", "binary") else F.to_json(F.struct(value)))
        size = size + 16 + F.coalesce(held, F.lit(0))
    found = df.limit(max_rows + 1).select(size.alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return found.n <= max_rows and (found.size or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Broadcast hint only when rows and bytes are counted and few; otherwise Catalyst chooses."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def fan_in(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Fewer, longer map tasks without a shuffle, for operators whose tasks each
    emit a summary of bounded size: the number of summaries follows the cores of
    the cluster, not the input."""
    sc = df.sparkSession.sparkContext
    return df.coalesce(max(1, sc.defaultParallelism * per_core))
