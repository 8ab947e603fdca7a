"""What the operators of this subpackage share: reading tables, the shared folder, cutting lineage, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where no such folder is configured (a local session in tests) a temporary one is set.
    """
    context = spark.sparkContext
    where = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def set_aside(df: DataFrame, *made: str, keep: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that have the name of a made one (in any case) renamed by underscores at their end, and these new names by the old ones."""
    taken = {c.lower() for c in (*df.columns, *made)}
    wanted, names = {m.lower() for m in made}, {}
    for c in df.columns:
        if c.lower() in wanted and c not in keep:
            new = c
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            names[c] = new
    return (df.withColumnsRenamed(names) if names else df), names


def put_back(df: DataFrame, columns: Iterable[str], names: Mapping[str, str]) -> DataFrame:
    """The columns that a table had before set_aside()."""
    return df.select(*(F.col(names.get(c, c)).alias(c) for c in columns))


#: What a Python worker keeps from task to task: one thing at a time, so that stages which follow each other don't add up.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """What make gave for this key the last time, if nothing else was asked for since."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end memory that its arrays used goes back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Paths of the tables that this process has written to the shared folder and not deleted.
_tables: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a new table in the shared folder, which sweep() knows."""
    _tables.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _tables[-1]


def tables_so_far() -> int:
    return len(_tables)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables written since a count of tables_so_far(), but those to keep: for use where what reads them is written itself."""
    kept = {getattr(df, "written_path", None) for df in keep}
    for path in [p for p in _tables[since:] if p not in kept]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _tables:
        _tables.remove(path)


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in frames:
        if df is not None and getattr(df, "written_path", None):
            _delete(df.sparkSession, df.written_path)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph, by contraction to smaller neighbours.

    edges: columns a, b (long, not null; order, repeats and loops don't matter). Returns (node, root): every
    node that has an edge, with the smallest node that it reaches. In each round every node that isn't
    the smallest of its neighbourhood merges into its smallest neighbour, so the contracted graph loses at least half of
    its nodes; a hub is only ever aggregated (partially first) or the probe side of a join on unique keys.
    An empty table gives an empty table.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    left = written(ordered(edges), "edges")
    labels = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parents = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "parents")
        up = parents.where("root <> node")
        pa, pb = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        merged = left.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        after = written(ordered(merged), "edges")
        if labels is None:
            now = parents
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("to"))
            now = written(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            forget(parents)
        forget(left, labels)
        left, labels = after, now
    else:
        raise RuntimeError("components did not settle")
    forget(left)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
