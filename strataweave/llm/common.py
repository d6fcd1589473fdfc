"""Pieces the corpus operators share: staged tables, connected components, vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that part words, U+0020 and U+0009 to U+000D.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A join's smaller side is broadcast up to so many values (some 16 bytes each), and shuffled beyond.
SMALL = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The files go when the driver's JVM ends, or earlier by :func:`unstage`. Rows of each value of the column ``by`` have a folder of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the write's shuffle files go with its end, not when the driver happens to collect its garbage
    try:
        df.write.option("compression", codec).parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame, part: str = "") -> None:
    """Delete a table written by :func:`stage`, or its folder ``part``, once nothing will read it again."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        path = f"{path}/{part}" if part else path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``(doc struct, row struct<file bigint, at bigint>)``: each row's columns and a key of its own.

    The key is the row's place in its Parquet file, so it is the same in every scan, however the files are split among
    executors; paths are told apart by 64-bit hashes. A table that isn't a plain scan of Parquet files is
    staged first. Columns of any name are carried inside ``doc``.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or "row_index" not in _metadata_fields(docs):
        docs = stage(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias("row"))


def _metadata_fields(docs: DataFrame) -> list[str]:
    try:
        return docs.select(docs.metadataColumn("_metadata").alias("m")).schema["m"].dataType.names
    except AnalysisException:  # not a file source
        return []


def release() -> None:
    """Give a worker's spare memory back at the end of a partition: workers are used again by later stages."""
    for base in [b for b, x in _powers.items() if len(x[0]) > 1 << 19]:
        del _powers[base]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def nullable(rows: pa.Array) -> pa.Array:
    """A struct column whose fields may be null, as Spark declares them."""
    if not pa.types.is_struct(rows.type):
        return rows
    fields = [pa.field(f.name, f.type) for f in rows.type]
    return pa.StructArray.from_arrays(rows.flatten(), fields=fields)


def join_small(large: DataFrame, small: DataFrame, key: str | list[str], values: Column, how: str = "inner") -> DataFrame:
    """A join that broadcasts ``small`` if its ``values``, summed over its rows, are SMALL or fewer, and shuffles otherwise."""
    size = small.agg(F.coalesce(F.sum(values), F.lit(0)).alias("n")).first()["n"]
    return large.join(F.broadcast(small) if size <= SMALL else small, key, how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint): one row ``(node, root)`` per node on an edge.

    ``root`` is the smallest node id reachable. Alternates large-star and small-star steps: a step joins
    each node's links with their minimum, so a node of any degree is spread by its links and no group is
    ever gathered. Every round is a staged table; the driver sees a count and a checksum of it only.
    Self-links, repeated links and links with a null end add nothing; no links give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current, seen = stage(pairs.distinct(), "links"), None
    for _ in range(max_rounds):
        sign = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if sign == seen or sign["n"] == 0:
            break
        seen = sign
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each greater neighbour goes to the least: of a hub's links only those to greater nodes meet here
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = stage(small, "links")
        unstage(current)
        current = after
    else:
        raise RuntimeError("components: no fixed point within max_rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None

#: Bytes of text that are hashed at once.
HASHED = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; kept, and grown by doubling."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        ups = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            ups.append(np.multiply.accumulate(a, dtype=np.uint64))
        got = _powers[int(base)] = (ups[0], ups[1])
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the maximal runs without SPACE_BYTES."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of tabulated bytes; no Python object per word. Memory is some 60 times HASHED, or the longest word."""
    raw, out, at = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = powers(_BASE, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))
