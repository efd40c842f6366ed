"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a single machine gets a new temporary folder; on a cluster, whose machines would each have their own,
    the job is refused.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (the master is {master})")
        place = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


class Workspace:
    """Tables of one operator run.  ``keep`` writes a table and returns it reread; ``drop`` removes tables no longer read.

    Tables that the returned DataFrame still reads must stay until it has been written.  ``Workspace.mark`` and
    ``Workspace.drop_since`` then remove what operators left behind, as ``corpus_pipeline.run`` does after each stage.
    """

    _made = threading.local()  # workspaces that this thread made, for drop_since

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: list[tuple[DataFrame, str]] = []
        self._all().append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def keep_seen(self, df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
        """``keep``, and aggregates of the rows, named by their aliases, that are taken as they are written."""
        seen = Observation()
        return self.keep(df.observe(seen, *figures)), seen.get

    def drop(self, *tables: DataFrame) -> None:
        self._delete([t for t in self.tables if any(t[0] is x for x in tables)])

    def drop_all_but(self, *tables: DataFrame) -> None:
        self._delete([t for t in self.tables if not any(t[0] is x for x in tables)])

    def _delete(self, tables: list[tuple[DataFrame, str]]) -> None:
        for _, name in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gone = {name for _, name in tables}
        self.tables = [t for t in self.tables if t[1] not in gone]

    @classmethod
    def _all(cls) -> list[Workspace]:
        if not hasattr(cls._made, "spaces"):
            cls._made.spaces = []
        return cls._made.spaces

    @classmethod
    def mark(cls) -> int:
        """What ``drop_since`` is to spare."""
        return len(cls._all())

    @classmethod
    def drop_since(cls, mark: int) -> None:
        """Removes the tables of all workspaces made after the mark; no DataFrame that reads them may be used any more."""
        for space in cls._all()[mark:]:
            space.drop_all_but()
        del cls._all()[mark:]
