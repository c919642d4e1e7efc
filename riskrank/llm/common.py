"""Helpers shared by the corpus operators: written tables in the shared folder,
Arrow batch slicing, row keys and distributed connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII white space; the same set as ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts the lineage
    and survives lost executors; empty tables keep their schema."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row. Rows equal in id and text share it (they are the same
    document); rows that only share the id do not."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\x00"), F.col(text_col))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hash of ``key`` (all, if fewer). A hash bound
    from the row count comes first, so that only about twice as many rows are ordered."""
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    bound = int((1 << 40) * min(1.0, 2 * rows / max(1, df.count())))
    return df.where(spot <= bound).orderBy(spot, key).limit(rows)


def sliced(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = 2 << 20,
           max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of the string column at
    position ``text`` (one row at least, whatever its length)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def byte_texts(column: pa.Array) -> list:
    """The texts of an Arrow string column as UTF-8 bytes (None for null)."""
    return column.cast(pa.large_binary()).to_pylist()


def map_texts(df: DataFrame, fn: Callable, schema: str, max_bytes: int = 2 << 20) -> DataFrame:
    """``fn(batch) -> RecordBatch`` over slices of ``df``; the last column is the text."""
    at = len(df.columns) - 1

    def run(batches):
        import pyarrow.compute  # noqa: F401 - binds pa.compute on the worker
        for batch in sliced(batches, at, max_bytes):
            yield fn(batch)
    return df.mapInArrow(run, schema)


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(a, b)`` of longs: ``(node, root)`` with
    the smallest node of each component, for nodes that have a link.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Minima are
    aggregated before the shuffle and written first, so that both sides of each join
    are plain exchanges and a hot node is split by the skew-join rule. Each round is a
    written table; nothing but a count and a checksum reaches the driver."""
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges
        low = written(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select(F.col("a").alias("k"), F.least("a", "m").alias("m")), name)
        joined = both.join(low, both["a"] == low["k"])
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
                        .union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                 F.least("a", "b").alias("b")).distinct(), name)

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = state(edges)
    if not last[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        edges = written(stars(written(stars(edges, True), name), False), name)
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
