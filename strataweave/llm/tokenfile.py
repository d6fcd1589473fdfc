"""Token counts of documents in flat token files (operator 4).

A flat token file is a run of little-endian ids of fixed width, each document closed by an end-of-document
id, with no index. It is scanned in blocks that know nothing of documents: in each, one vectorised comparison
finds the separators. A prefix scan over the blocks' summaries then stitches documents that span blocks: the
running sum of separators numbers the documents, the running maximum of separator positions gives each
block's first document its start. The scan has two levels: inside ranges of SPAN blocks, and over the ranges' totals, so a
file of any size is scanned by many tasks.

Blocks come from a table of blocks (:func:`write`) or from binary files (:func:`blocks_of_files`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.bpe import text_slices, vocabulary
from strataweave.llm.common import release, stage

#: Ids in one block.
BLOCK = 1 << 16
#: Blocks in a range of the scan.
SPAN = 1024
#: Bytes of one id by the file's width.
WIDTHS = {2: "<u2", 4: "<u4"}


def _writer(path: str, end: int, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, kind = vocabulary(path), np.dtype(WIDTHS[width])
        held, size, file, number, ordinal = [], 0, 0, 0, 0

        def row(**x) -> pa.RecordBatch:
            schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_pylist([x], schema)

        for batch in batches:
            if batch.num_rows:
                file = int(batch.column(2)[0].as_py())
            for at, to, data, bounds in text_slices(batch, 1):
                ids, cuts = v.encode(data, bounds, specials=False)
                stream = np.insert(ids, cuts[1:], end).astype(kind)
                yield row(file=file, block=None, tokens=None, first=ordinal, ids=batch.column(0).slice(at, to - at).to_pylist())
                ordinal += to - at
                held.append(stream)
                size += len(stream)
                while size >= block:
                    whole = np.concatenate(held)
                    yield row(file=file, block=number, tokens=whole[:block].tobytes(), first=None, ids=None)
                    held, size, number = [whole[block:]], size - block, number + 1
        if size:
            yield row(file=file, block=number, tokens=np.concatenate(held).tobytes(), first=None, ids=None)
        release()

    return run


def write(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, block: int = BLOCK) -> DataFrame:
    """Token files of ``docs``, one for each partition, as rows to store.

    Rows with ``tokens`` are a file's blocks ``(file, block, tokens binary)``; the others say which document
    each ordinal of a file is: ``(file, first, ids array<bigint>)``. Strings of special tokens are encoded as
    ordinary text, so ``end`` stands between documents only. Null and empty texts are documents of no tokens; repeated rows and
    null ids are documents of their own. An empty table gives no rows.
    """
    highest = max(int(vocabulary(path).ids.max()), end)
    if highest >= 1 << (8 * width):
        raise ValueError(f"ids up to {highest} don't fit {width} bytes")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("bigint").alias("file"))
    return rows.mapInArrow(_writer(path, end, width, block), "file bigint, block bigint, tokens binary, first bigint, ids array<bigint>")


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks ``(file string, block bigint, tokens binary)`` of the flat binary files below ``path``.

    The reader takes one file at a time into an executor, 2 GB at most; keep files to what fits there.
    """
    step = width * block
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    cut = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("length") - 1) / step).cast("bigint"))).alias("block"))
    return cut.select("file", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("tokens"))


def _scan(end: int, width: int):
    kind = np.dtype(WIDTHS[width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for raw in batch.column("tokens"):
                tokens = np.frombuffer(raw.as_buffer(), kind)
                n.append(len(tokens))
                found.append(np.flatnonzero(tokens == end))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), lists], names=["file", "block", "n", "ends"])

    return run


def token_counts(blocks: DataFrame, end: int, width: int = 2, span: int = SPAN) -> DataFrame:
    """``(file, ordinal bigint, n_tokens bigint)``: the length of each document, separators not counted.

    Documents are numbered from 0 in their file. Tokens after a file's last separator are a document that
    isn't closed; a file that ends with a separator has none. Empty documents count 0. Blocks with null
    ``tokens`` and other columns are passed over; ``file`` may be of any type, ``block`` orders its blocks. A
    block repeated in the table would count twice. No blocks give no rows.
    """
    kind = dict(blocks.dtypes)["file"]
    summary = blocks.where("tokens is not null").select("file", "block", "tokens").mapInArrow(_scan(end, width), f"file {kind}, block bigint, n bigint, ends array<int>")
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.withColumn("span", F.floor(F.col("block") / span)).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = inner.withColumn("last", F.col("base") + F.get("ends", F.size("ends") - 1)).withColumn("number", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    inner = stage(inner.withColumn("open", F.max("last").over(before)), "block-places")
    spans = inner.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("ends"), F.max("last").alias("last"), F.max("block").alias("top"))
    # one short row for each range of a file
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("docs", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    spans = spans.withColumn("left", F.coalesce(F.max(F.col("from") + F.col("last")).over(earlier), F.lit(-1)))
    spans = spans.withColumn("ahead", F.lead("span").over(Window.partitionBy("file").orderBy("span")))
    spans = stage(spans.select("file", "span", "from", "docs", "left", F.when(F.col("ahead").isNull(), F.col("top")).alias("final")), "block-spans")
    place = inner.join(spans, ["file", "span"]).select(
        "file", "block", "n", "ends", (F.col("base") + F.col("from")).alias("base"), (F.col("last") + F.col("from")).alias("last"), (F.col("number") + F.col("docs")).alias("number"),
        F.coalesce(F.col("open") + F.col("from"), F.col("left")).alias("open"), F.coalesce(F.col("block") == F.col("final"), F.lit(False)).alias("final"),
    )
    closed = place.where(F.size("ends") > 0).select(
        "file",
        F.posexplode(
            F.transform("ends", lambda e, i: e + F.col("base") - F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1)) - 1)
        ).alias("i", "n_tokens"),
        "number",
    )
    left = F.col("base") + F.col("n") - 1 - F.coalesce("last", "open")
    unclosed = place.where(F.col("final") & (left > 0)).select("file", (F.col("number") + F.size("ends")).alias("ordinal"), left.alias("n_tokens"))
    return closed.select("file", (F.col("number") + F.col("i")).alias("ordinal"), "n_tokens").unionByName(unclosed)


def document_ids(table: DataFrame) -> DataFrame:
    """``(file, ordinal, id)`` of what :func:`write` gave: one row for each row written, null ids and all; none of an empty table."""
    rows = table.where("ids is not null").select("file", "first", F.posexplode("ids").alias("i", "id"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "id")
