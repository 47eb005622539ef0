"""Session helpers shared by every job: a shared scratch folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error, as its machines don't share such a folder.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can read")
        path = tempfile.mkdtemp(prefix="muster-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/muster-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._muster_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``; only for tables that no later plan reads."""
    path = getattr(df, "_muster_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark ``df`` for broadcast only after counting that it has at most ``max_rows`` rows.

    Beyond that the plan keeps its shuffle join. Pass a materialised frame: the count is an action.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Prepare for Python workers that read whole texts: few rows an Arrow batch, and this package on their path."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, path) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def packed(df: DataFrame, name: str = "__row") -> Column:
    """All columns of ``df`` as one struct, so that helper columns can't clash with the input's names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def ranked(df: DataFrame, order: list[Column], name: str, tag: str = "ranked") -> DataFrame:
    """``df`` with its place from 0 in the global ``order`` as ``name``, without a window over all rows.

    Rows are dealt to ranges of the order and sorted inside; a range's offset is the number of rows in the ranges before
    it, one small row a range. ``order`` must tell all rows apart for reruns to agree.
    """
    at = "__at"
    done = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), tag)
    part = F.shiftright(at, 33)
    sizes = sorted((r["p"], r["n"]) for r in done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, f"__part long, {name}_start long")
    joined = done.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part")
    place = F.col(f"{name}_start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    out = joined.withColumn(name, place).drop(at, "__part", f"{name}_start")
    out._muster_path = done._muster_path  # for release
    return out


def running_sums(df: DataFrame, order: list[Column], values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``upto_<value>``: sums over the rows up to and with its own in ``order``, within ``by``.

    Rows are dealt to ranges of the order; a window sees one range, and a range's sum goes to those after it, one small row
    a range. Rows equal in ``order`` have sums in any order among themselves.
    """
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__range", F.spark_partition_id())
    done = materialize(ranged, "ranges")
    per = done.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    if by:
        before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    else:
        rows, total = [], [0] * len(values)
        for r in sorted(per.collect(), key=lambda r: r["__range"]):
            rows.append((r["__range"], *total))
            total = [t + (r[f"__{v}"] or 0) for t, v in zip(total, values)]
        kinds = dict(per.dtypes)
        schema = ", ".join(["__r int", *[f"__{v} {kinds[f'__{v}']}" for v in values]])
        offsets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row a range
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = done.withColumns({f"upto_{v}": F.sum(v).over(inside) for v in values})
    met = F.col("__range") == F.col("__r")
    for b in by:
        met = met & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    out = out.join(offsets, met)
    return out.withColumns({f"upto_{v}": F.col(f"upto_{v}") + F.col(f"__{v}") for v in values}).select(*df.columns, *[f"upto_{v}" for v in values])
