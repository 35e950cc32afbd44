"""What every operator needs of the session: the shared folder, lineage cuts, size estimates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
BROADCAST_LIMIT = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-JVM session
    (tests, notebooks) may go without; it then gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="epochal-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions and their row order survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (file sizes for scans)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only if the estimate is within ``limit``; otherwise Spark shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def floor_div(x, n) -> Column:
    """Exact floor division of a long column by a positive long (negative values included)."""
    x = F.col(x) if isinstance(x, str) else x
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, n), n)


def ceil_to(x, n) -> Column:
    """Smallest multiple of ``n`` that is not below ``x``, exact for longs."""
    x = F.col(x) if isinstance(x, str) else x
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    return x + F.pmod(-x, n)


class Files:
    """Small files on any Hadoop file system, the local one included."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm, self._conf = jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self.local = self._fs.getScheme() == "file"

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getLen()

    def write_new(self, path: str, text: str) -> bool:
        """Writes a whole file under a name that is not taken yet; False if another writer has taken it.

        The content is written aside and given its name in one step that fails if the name exists:
        a hard link on a local file system, elsewhere a rename that never replaces.
        """
        import os

        final, aside = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        try:
            if self.local:
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            else:
                never = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
                never[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, never)
                return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(aside.toString())
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))
