"""Tables that later jobs read again: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder until Python ends; any other raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="phasegrid-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, gives real sizes."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if folder.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") == root:
                p, fs = _path(spark, folder)
                fs.delete(p, True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when files at the paths do: their sizes, numbers and times."""
    parts = []
    for x in paths:
        p, fs = _path(spark, x)
        s = fs.getContentSummary(p)
        parts.append((x, s.getLength(), s.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


@functools.cache
def code_version() -> str:
    """Changes when the modules that make kept tables do."""
    here = Path(__file__).resolve().parents[1]
    files = [here / "config.py", *sorted(f for d in ("sources", "operators", "plans") for f in (here / d).glob("*.py"))]
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> DataFrame:
    """The table that build makes of the files at sources. Built once: later calls, of any application with this shared folder, read it, until sources or the library change.

    write puts a frame at a path, which appears as a whole or not at all; of two that build at once the first one stays.
    """
    path = f"{shared_dir(spark)}/kept-{name}-{code_version()[:12]}-{fingerprint(spark, *sources)[:24]}"
    p, fs = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        draft = f"{path}-{uuid.uuid4().hex}"
        frame = build()
        write(frame, draft)
        # an empty table has no files that would show its columns
        out = fs.create(_path(spark, f"{draft}/_schema")[0])
        out.write(bytearray(frame.schema.json().encode()))
        out.close()
        if not fs.rename(_path(spark, draft)[0], _path(spark, path)[0]) or fs.exists(_path(spark, f"{path}/{draft.rsplit('/', 1)[-1]}")[0]):
            for left in (draft, f"{path}/{draft.rsplit('/', 1)[-1]}"):
                fs.delete(_path(spark, left)[0], True)
    told = fs.open(_path(spark, f"{path}/_schema")[0])
    schema = StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(told, "UTF-8")))
    told.close()
    return spark.read.schema(schema).parquet(path).select(*schema.names)
