"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulselake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_apart(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of the same application with the settings of ``spark`` and, on top, ``conf`` (``_``
    for ``.``), but without its temporary views and functions."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and child.conf.isModifiable(key):
            child.conf.set(key, value)
    for key, value in conf.items():
        child.conf.set(key.replace("_", "."), str(value))
    return child


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def moved(df: DataFrame, session: SparkSession) -> DataFrame:
    """``df`` in another session of the application: it is planned and run under the settings of
    that, whoever runs it and whenever."""
    name = f"moved_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return session.table(f"global_temp.{name}")
    finally:
        session.catalog.dropGlobalTempView(name)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: what the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a temporary folder will do only if all
    tasks run on this machine; on a cluster this raises, since executors could not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.get(app) or _local_roots.setdefault(app, tempfile.mkdtemp(prefix="pulselake-"))
    return root.rstrip("/")


#: By application, where ``spark.checkpoint.dir`` is unset and all tasks run on this machine.
_local_roots: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder of this application. Inside ``scratch_scope`` what is
    there is deleted when the scope ends."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/pulselake-{app}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once, as a table in the shared scratch folder.

    This cuts the lineage, survives the loss of executors, and gives the planner the true
    size: joins with the result are broadcast only when the written files are below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffled otherwise. Inside
    ``scratch_scope`` the table is deleted when the scope ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what is materialised inside it; results must be written or collected inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has materialised."""
    _delete(spark, f"{scratch_root(spark)}/pulselake-{spark.sparkContext.applicationId}")
