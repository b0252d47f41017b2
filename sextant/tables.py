"""Tables in the shared folder: steps that are written and read again, and keyed tables that grow by runs.

A step that is written cuts lineage and is worked out once; a lost executor costs that step.  ``scratch`` deletes what was
written within it.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one, in local mode only (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = sc.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sextant-")
        path = _own_dirs[app]
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder, which the innermost open scratch deletes; outlives: the one around that does."""
    path = f"{shared_dir(spark)}/sextant/{name}-{uuid.uuid4().hex}"
    if around := _open[:-1] if outlives else _open:
        around[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    return saved(df, fresh_path(df.sparkSession, name))


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet to a new path and read again; its shuffle files end with the writing, not when the driver collects its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end: results that still read them have to be written or collected before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            Folder(spark, path).delete()


class Folder:
    """A path in whatever file system it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str = "") -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def names(self) -> list[str]:
        fs, p = self._at()
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def bytes(self, name: str = "") -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength()

    def delete(self, name: str = "") -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def read_text(self, name: str) -> str:
        fs, p = self._at(name)
        s = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def write_text(self, name: str, text: str) -> None:
        fs, p = self._at(name)
        s = fs.create(p, True)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()


class Runs:
    """A table by key as runs: each change writes its own rows as one more run, hashed by key into bucket files.

    The newest run that holds a key decides; a row with _removed takes the key away.  After a change the newest runs
    are merged with the ones before them as long as those are not more than half again as large, so run sizes
    fall by a factor from old to new: there are about as many runs, and a row is rewritten about as often, as
    the logarithm of the table's size over a change's.  A run is visible once it is complete, and a merged one
    covers the runs it came from, so a job that dies changes nothing.  Covered runs are deleted by the next
    merge, so that readers may end.  One writer at a time.

    Files are read as a bucketed table: what is joined or looked up by key moves to the large runs' buckets, and
    the large runs do not move; a lookup of few keys opens the files of their buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 8, bucket_bytes: int = 128 << 20, cluster: tuple[str, ...] = ()):
        self.spark, self.folder, self.key, self.schema = spark, Folder(spark, path), key, schema
        self.buckets, self.bucket_bytes, self.cluster = buckets, bucket_bytes, cluster

    def current(self) -> list[tuple[int, int, int]]:
        """(first change, last change, buckets) of the runs that count, oldest first."""
        every = [tuple(map(int, n[4:].split("-"))) for n in self.folder.names() if n.startswith("run=") and self.folder.exists(f"{n}/_SUCCESS")]
        return sorted(r for r in every if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in every))

    @staticmethod
    def _name(run: tuple[int, int, int]) -> str:
        return "run=" + "-".join(map(str, run))

    def table(self, run: tuple[int, int, int]) -> DataFrame:
        """The rows of a run, with _removed."""
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in self.schema)
        at = f"{self.folder.path}/{self._name(run)}".replace("\\", "\\\\").replace("'", "\\'")
        name = f"sextant_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({fields}, _removed boolean) USING parquet CLUSTERED BY (`{self.key}`) INTO {run[2]} BUCKETS LOCATION '{at}'")
        try:
            return self.spark.table(name).select("*")
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay, and so does what the frame knows of them

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        name = f"sextant_{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f"`{f.name}`") for f in self.schema], "_removed").repartition(run[2], self.key).sortWithinPartitions(*self.cluster, self.key)
        try:
            rows.write.mode("overwrite").option("path", f"{self.folder.path}/{self._name(run)}").bucketBy(run[2], self.key).format("parquet").saveAsTable(name)
        finally:
            rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")

    def overlaid(self, runs: list[tuple[int, int, int]], where: Column | None = None) -> DataFrame:
        """Rows of some runs, of each key those of the newest; where: a test on the key alone."""
        of = lambda r: self.table(r) if where is None else self.table(r).filter(where)
        parts, newer = [], None
        for r in reversed(runs):
            parts.append(of(r) if newer is None else of(r).join(newer, self.key, "left_anti"))
            ids = of(r).select(self.key)
            newer = ids if newer is None else newer.unionByName(ids)
        return reduce(DataFrame.unionByName, [p.select(*self.schema.names, "_removed") for p in parts])

    def read(self, where: Column | None = None) -> DataFrame:
        """What the table holds; where: a test on the key, which the scans get."""
        runs = self.current()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.overlaid(runs, where).filter(~F.col("_removed")).drop("_removed")

    def get(self, keys: DataFrame, few: int = 1000) -> DataFrame:
        """Rows by a frame of keys (a column of the key's name): few of them are looked up in their buckets, more are joined."""
        keys = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        some = [r[0] for r in keys.limit(few + 1).collect()]
        if len(some) <= few:
            return self.read(F.col(self.key).isin(some))
        return self.read().join(keys, self.key, "left_semi")

    def append(self, rows: DataFrame) -> None:
        """One more run of rows (of each key one; with _removed), then the merges that are due."""
        at = max((int(n[4:].split("-")[1]) for n in self.folder.names() if n.startswith("run=")), default=0) + 1
        self._write(rows, (at, at, self.buckets))
        runs = self.current()
        sizes = [self.folder.bytes(self._name(r)) for r in runs]
        first = len(runs) - 1
        while first and sizes[first - 1] <= 1.5 * sum(sizes[first:]):
            first -= 1
        self._merge(runs, first)

    def compact(self) -> None:
        """All runs as one."""
        self._merge(self.current(), 0)

    def _merge(self, runs: list[tuple[int, int, int]], first: int) -> None:
        old = runs[first:]
        if len(old) < 2:
            return
        covered = [n for n in self.folder.names() if n.startswith("run=") and n not in map(self._name, runs)]
        rows = self.overlaid(old)
        size = sum(self.folder.bytes(self._name(r)) for r in old)
        n = max(self.buckets, *(r[2] for r in old), 1 << math.ceil(math.log2(max(1, size / self.bucket_bytes))))
        # Where nothing is older, a removed key need not be remembered.
        self._write(rows if first else rows.filter(~F.col("_removed")), (old[0][0], old[-1][1], n))
        for name in covered:
            self.folder.delete(name)
