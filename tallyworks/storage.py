"""Where a run keeps the files and tables it writes on the way.

Everything lies in the shared folder that ``spark.checkpoint.dir`` names, so that
any executor can read what another one wrote, also after that one was lost.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from tallyworks.operators.tables import create_database


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority Spark puts before it in ``path`` columns."""
    hadoop_path, fs = _file_system(spark, path)
    return fs.makeQualified(hadoop_path).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is only made where they are threads of the driver.

    On a cluster, of several processes on one machine too, it is ``spark.checkpoint.dir``, and the warehouse where none is named or
    executors do not share the named one. Whether a ``file:`` folder is the same one for all of them its name does not say: tasks write
    files there, and the folder is passed over unless all of them are found and read again. Without any that is, this fails.
    Where ``spark.tallyworks.mounted`` is ``true`` the first is taken for granted.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    # Executors of local-cluster are processes with temporary folders of their own.
    if context.master == "local" or context.master.startswith("local["):
        return named or _temporary_folder(context.applicationId)
    folders = [folder for folder in (named, spark.conf.get("spark.sql.warehouse.dir", None)) if folder]
    if not folders:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if spark.conf.get("spark.tallyworks.mounted", "false") == "true":
        return folders[0]
    refused = []
    for folder in folders:
        if not qualified_path(spark, folder).startswith("file:"):
            return folder
        try:
            _require_shared(spark, folder)
            return folder
        except RuntimeError as failed:
            refused.append(failed)
    raise refused[0]


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Fail unless what tasks write to a folder is found there by the driver and read by other tasks; leaves nothing behind."""
    trial = f"{folder.rstrip('/')}/tallyworks_trial_{uuid.uuid4().hex[:12]}"
    refusal = f"executors do not share {folder}; name another spark.checkpoint.dir or set spark.tallyworks.mounted"
    try:
        # A file for every core; files that only their writers see are neither listed nor read.
        files = spark.sparkContext.defaultParallelism
        spark.range(0, files, 1, files).write.parquet(trial)
        found = spark.read.schema("id BIGINT").parquet(trial).count()
    except Exception as failed:
        raise RuntimeError(refusal) from failed
    finally:
        hadoop_path, fs = _file_system(spark, trial)
        fs.delete(hadoop_path, True)
    if found < files:
        raise RuntimeError(refusal)


# Folders made for local sessions that name none, by application.
_temporary: dict[str, str] = {}


def _temporary_folder(application: str) -> str:
    if application not in _temporary:
        _temporary[application] = tempfile.mkdtemp(prefix="tallyworks-")
    return _temporary[application]


class Workspace:
    """One run's own folder and database below the shared folder."""

    _open: dict[str, Workspace] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"tallyworks_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_folder(spark).rstrip('/')}/{self.name}"
        self._has_database = False

    @classmethod
    def of(cls, spark: SparkSession) -> Workspace:
        application = spark.sparkContext.applicationId
        if application not in cls._open:
            cls._open[application] = cls(spark)
            atexit.register(cls._open[application]._close_at_exit)
        return cls._open[application]

    def path(self, label: str) -> str:
        """A path nothing was written to yet; repeated calls never share one."""
        return f"{self.root}/files/{label}-{uuid.uuid4().hex[:12]}"

    def table(self, label: str) -> str:
        """A qualified table name not used yet, in a database kept in the shared folder."""
        if not self._has_database:
            create_database(self.spark, self.name, f"{self.root}/tables")
            self._has_database = True
        return f"{self.name}.{label}_{uuid.uuid4().hex[:12]}"

    def _close_at_exit(self) -> None:
        """Remove what a run left, if its session still runs when the program ends."""
        if self in self._open.values():
            try:
                self.close()
            except Exception:  # the session is gone, and its tables with it
                pass

    def close(self) -> None:
        """Drop the run's tables and delete its folder. Frames reading from it end here."""
        if self._has_database:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
        hadoop_path, fs = _file_system(self.spark, self.root)
        fs.delete(hadoop_path, True)
        for application, workspace in list(self._open.items()):
            if workspace is self:
                del self._open[application]


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
