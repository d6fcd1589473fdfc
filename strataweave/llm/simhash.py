"""SimHash near-duplicates by covering locality-sensitive hashing (operator 1).

A covering family for radius 2 has one bit mask for each non-zero v of {0,1}^3: bit i belongs to the mask of
v if v and m(i) have odd parity, m dealing the non-zero vectors out to the bits in turn. Two or fewer
differing bits leave some v orthogonal to all their m(i), so the pair agrees on that mask: each pair
within the radius shares a bucket of one of seven tables, without exception.

Fingerprints are made distinct first, so copies cost one row. A bucket of more than BUCKET fingerprints is
dealt anew by a second covering of the bits its mask left free; that fixes at least 52 of 64 bits, so such a
bucket can't hold more than 4,096, whatever the data. In a bucket, links are reduced to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.bpe import text_slices
from strataweave.llm.common import components, release, stage

RADIUS = 2
#: Fingerprints compared with each other in one bucket at most.
BUCKET = 4096
_LANES = np.uint64(0x0101010101010101)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` of which any two fingerprints within ``radius`` agree on one at least."""
    full = (1 << (radius + 1)) - 1
    vector = {b: 1 + i % full for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, full + 1)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bit 0 first."""
    out = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    tail = -len(hashes) % 255
    rows = np.concatenate((hashes, np.zeros(tail, np.uint64))).reshape(-1, 255)
    for j in range(8):
        lanes = ((rows >> np.uint64(j)) & _LANES).sum(axis=1, dtype=np.uint64)  # eight counters of 8 bits each
        out[j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out.T.reshape(64)


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text: A-Z lower-cased, word shingles hashed by XXH64, strict majority of each bit."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[-n:].tolist() if len(words) >= shingle else [len(flat)]
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first = starts[:n].tolist()
    for at in range(0, n, 1 << 18):
        part = [h(flat[a:b], seed) for a, b in zip(first[at : at + (1 << 18)], last[at : at + (1 << 18)], strict=True)]
        counts += bit_counts(np.array(part, np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in text_slices(batch, 1):
                found = np.array([fingerprint(data[a:b], shingle, seed) for a, b in zip(bounds, bounds[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(found.view(np.int64))], names=["id", "fp"])
        release()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp bigint)`` for every row: fp is the fingerprint's 64 bits. Null and empty texts have fp 0."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "id bigint, fp bigint")


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins ``values`` at ``radius`` or fewer differing bits."""
    rest, out = np.asarray(values).astype(np.int64).view(np.uint64), []
    while len(rest) > 1:
        seeds, rest = rest[:1], rest[1:]
        while len(seeds) and len(rest):
            near = np.bitwise_count(rest ^ seeds[0]) <= radius
            out += [(int(seeds[0]), int(x)) for x in rest[near]]
            seeds, rest = np.concatenate((seeds[1:], rest[near])), rest[~near]
    return out


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            links = [x for a, b in zip(offsets, offsets[1:]) for x in forest(values[a:b], radius)]
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``distinct(fp)`` that join all pairs within ``radius``.

    A bucket over ``bucket`` is dealt anew; its parts hold what twelve free bits allow.
    """
    masks = covering(list(range(64)), radius)
    finer = [[m | k for k in covering([b for b in range(64) if not m >> b & 1], radius)] for m in masks]
    rows = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("x")
    ).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, ["t", "key"])
    inner = F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in finer])
    hot = shared.where(F.col("n") > bucket).select("fp", "t", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("s", "mask"))
    parts = [
        shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps"),
        hot.groupBy("t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_list("fp").alias("fps")).select("fps"),
    ]
    found = reduce(DataFrame.unionByName, parts).where(F.size("fps") > 1)
    return found.mapInArrow(_forests(radius), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(id, fp bigint, component bigint)``, one row for each row of ``docs``.

    ``component`` is the smallest id among the rows reachable over links of ``radius`` or fewer differing
    bits. Null and empty texts have fingerprint 0 and are linked by it like any other. A row whose id is null
    takes part; it gets the smallest known id of its component, null if there is none. Repeated ids and rows
    stay as they are. An empty table gives no rows; other columns aren't read.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    by_fp = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = stage(components(links(by_fp.select("fp"), radius, bucket)), "roots")
    linked = roots.join(by_fp.withColumnRenamed("fp", "node"), "node")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(lowest, "root").select(F.col("node").alias("fp"), "component")
    # staged, so that the join's sides are plain exchanges: Spark splits a fingerprint of many copies only then
    classes = stage(by_fp.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component")), "classes")
    return marked.join(classes, "fp").select("id", "fp", "component")
