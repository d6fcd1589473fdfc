"""Packing of token pieces into sequences: first-fit decreasing with a tournament tree (operator 9).

Documents are cut from their start into full sequences and a rest, so pieces are known before they are
placed. Pieces are dealt into random groups of GROUP, each packed by one task on its own: longest first, each into the
first open sequence with room, found by descending a tournament tree over the rooms.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.bpe import text_slices, vocabulary
from strataweave.llm.common import release, stage

LENGTH = 2048
#: Pieces packed together, on average.
GROUP = 20_000


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each size, in the given order, each put into the first bin with room."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    best = [room] * (2 * leaves)  # best[i]: the most room below node i
    bins, offsets = [], []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if best[at] < size:
                at += 1
        bins.append(at - leaves)
        offsets.append(room - best[at])
        best[at] -= size
        while at > 1:
            at //= 2
            most = max(best[2 * at], best[2 * at + 1])
            if best[at] == most:
                break
            best[at] = most
    return bins, offsets


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("length").to_numpy()
        order = np.lexsort((group.column("piece").to_numpy(), -sizes))
        bins, offsets = first_fit(sizes[order].tolist(), length)
        part = (group.column("group")[0].as_py() << 32) if len(sizes) else 0
        where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        where[order], offset[order] = np.array(bins, np.int64) + part, offsets
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id bigint`` and ``offset bigint``, one row for each row.

    ``pieces`` has ``piece bigint``, unique and not null, and ``length bigint`` from 1 to ``length``; other columns
    are carried, but for the names group, sequence_id and offset. Offsets in a sequence leave no gap. Groups are
    dealt by a hash of ``piece``, so no key of the data can fill one. Empty tables give no rows.
    """
    clash = {"group", "sequence_id", "offset"} & set(pieces.columns)
    if clash:
        raise ValueError(f"rename {sorted(clash)}")
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInArrow(_pack(length), f"{schema}, sequence_id bigint, offset bigint")


def _pieces(path: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number, part = vocabulary(path), 0, 0
        for batch in batches:
            if batch.num_rows:
                part = int(batch.column(2)[0].as_py()) << 36
            for at, to, data, bounds in text_slices(batch, 1):
                ids, cuts = v.encode(data, bounds)
                stream = np.insert(ids, cuts[1:], end).astype("<u4")
                raw, cuts = memoryview(stream.tobytes()), cuts + np.arange(len(cuts))
                sizes = np.diff(cuts)
                each = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), each)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * length
                size = np.minimum(length, sizes[doc] - start)
                first = ((cuts[doc] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(first, size.tolist(), strict=True)]
                owner = batch.column(0).slice(at, to - at).take(pa.array(doc))
                cols = [pa.array(part + number + np.arange(len(doc))), owner, *(pa.array(np.asarray(x, np.int64)) for x in (start, size, crc, sizes[doc]))]
                number += len(doc)
                yield pa.RecordBatch.from_arrays(cols, names=["piece", "id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return run


def pack_documents(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row for each piece of ``docs``.

    A document is the ids of its whole text and then ``end``. Null and empty texts are documents of ``end`` alone.
    Null and repeated ids and rows are documents like any other; other columns aren't read; an empty table
    gives no rows. A sequence is to be padded to ``length``, unless it holds a power of two of ids.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("bigint").alias("part"))
    schema = "piece bigint, id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = stage(rows.mapInArrow(_pieces(path, end, length), schema), "pieces")
    return pack(pieces, length, group).drop("piece")
