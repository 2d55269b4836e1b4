"""What the operators of this subpackage have in common: cutting lineage, files in the shared folder, words."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local one is used in local mode alone; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quire-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs one read and not the whole lineage."""
    shared_dir(ship(df.sparkSession))
    return df.checkpoint()


#: Rows of a few numbers that may be sent to every executor.
SMALL = 50_000


def within(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has no more than `rows` rows; else as it is, for a join by shuffle. df: a cut one, as it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def swept(spark: SparkSession) -> None:
    """Executors' JVMs collect their garbage and give the system back what the heap no longer needs. A heap that one stage has filled
    stays as large as it was, beside the Python workers of the next."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


class Store:
    """A new folder of binary files below the shared one. It is pickled to the executors; put() replaces a file at once, so a repeated task is harmless."""

    #: Those that this driver made, in order.
    made: list[Store] = []

    def __init__(self, spark: SparkSession, kind: str):
        ship(spark)
        Store.made.append(self)
        self.uri = f"{shared_dir(spark).rstrip('/')}/quire-{kind}-{uuid.uuid4().hex}"

    def fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def path(self, name: str) -> str:
        return f"{self.fs()[1]}/{name}"

    def put(self, name: str, data: bytes) -> None:
        with self.writer(name) as out:
            out.write(data)

    def writer(self, name: str):
        return _Replacing(*self.fs(), name)

    def get(self, name: str) -> bytes | None:
        system, top = self.fs()
        try:
            with system.open_input_file(f"{top}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def drop(self) -> None:
        system, top = self.fs()
        try:
            system.delete_dir(top)
        except FileNotFoundError:
            pass


class _Replacing:
    """Writes beside the file and moves it into place at the end."""

    def __init__(self, system, top: str, name: str):
        self.system, self.to = system, f"{top}/{name}"
        self.held = f"{top}/.{uuid.uuid4().hex}.tmp"
        system.create_dir(top, recursive=True)

    def __enter__(self):
        self.out = self.system.open_output_stream(self.held)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.system.move(self.held, self.to)
        else:
            self.system.delete_file(self.held)


def written(df: DataFrame, store: Store, name: str) -> DataFrame:
    """df as a table of files in the store, which holds less than a checkpoint does."""
    df.write.parquet(f"{store.uri}/{name}")
    return df.sparkSession.read.parquet(f"{store.uri}/{name}")


def words_of(text: Column) -> Column:
    """The words of a text, as an array of strings; null and blank texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def picked(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """`k`, `t`: key and text alone, a null text as an empty one, and `more`; ready for Python functions on executors."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *more)


def rereadable(docs: DataFrame) -> bool:
    """Whether a table comes straight from files, so that reading it again gives the same rows in the same order."""
    names, todo = set(), [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        names.add(node.nodeName())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return all(n in ("Project", "Filter") or n.startswith(("LogicalRelation", "Relation")) for n in names)


def placed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """`k` (a long), `t`, `spot` (a number of each row's own, also of repeated rows) and `more`, to be read several times with the same result.
    Parquet files are read again, by the same splits (spark.sql.files.minPartitionNum is set if it wasn't, as the default follows the
    executors that are alive); anything else is written to the shared folder once."""
    conf = ship(docs.sparkSession).conf
    mine = F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    if rereadable(docs):
        try:
            rows = docs.select(*mine, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("spot"), *more)
        except AnalysisException:  # other formats don't number their rows
            pass
        else:
            if conf.get("spark.sql.files.minPartitionNum", None) is None:
                conf.set("spark.sql.files.minPartitionNum", str(docs.sparkSession.sparkContext.defaultParallelism))
            return rows
    return cut(docs.select(*mine, F.monotonically_increasing_id().alias("spot"), *more))


def distinct_names(*names: str) -> None:
    """Raises if a column that is to be kept has the name of one that is made."""
    if len(set(names)) < len(names):
        raise ValueError(f"columns to keep have names of columns that are made: {sorted(n for n in set(names) if names.count(n) > 1)}")


def rest_of(keep: tuple[str, ...], *but: str) -> Column:
    """The columns `keep` as one column, `rest`, without key and text."""
    return F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep if c not in but)).alias("rest")
