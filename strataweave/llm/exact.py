"""Exact duplicates by a tree merge of sorted digest runs (operator 2).

Each partition of the digest table sorts its digests into runs. Runs meet in ceil(log2 partitions) binomial rounds: in round
k, partitions whose numbers differ in bit k exchange halves of their digest range, and each merges the runs that
it then has, several ways. Equal digests fall together in the merge; the row that stays survives with a count, so every
level carries each text once and no task ever holds more than about one partition's digests: digests spread
evenly, and copies are gone after the first merge that sees them. "Equal" is verified at every level: SHA-256, XXH64 and byte
length all agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import release, stage

#: Digests in one sorted run of the first level at most.
RUN_ROWS = 1 << 16
_RUN = "run bigint, prefix bigint, rows binary"
#: Of a run: the digest in four big-endian words, the check hash, the length; the staying row's id (and whether it has one) and number; the count.
_FIELDS, _KEY, _ID, _KNOWN, _ROW, _COUNT = 10, 6, 6, 7, 8, 9


def _keys(rows: np.ndarray) -> np.ndarray:
    """What tells texts apart, as fixed strings in the order of the run."""
    return np.ascontiguousarray(rows[:, :_KEY].astype(">u8")).view("S48").ravel()


def _worse(a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """Where ``b`` stays rather than ``a``: a known id goes before none, then the wanted id, then the lowest row."""
    x, y = a[:, _ID].view(np.int64), b[:, _ID].view(np.int64)
    known, other = a[:, _KNOWN], b[:, _KNOWN]
    better = (y > x) if largest else (y < x)
    return (other > known) | ((other == known) & (better | ((x == y) & (b[:, _ROW] < a[:, _ROW]))))


def sorted_run(rows: np.ndarray, largest: bool) -> np.ndarray:
    """One row for each text, sorted: the staying row kept, counts added."""
    if not len(rows):
        return rows
    wish = rows[:, _ID].view(np.int64) if largest else ~rows[:, _ID].view(np.int64)
    # of equal texts the row that stays comes last
    order = np.lexsort((~rows[:, _ROW], wish, rows[:, _KNOWN], *(rows[:, i] for i in range(_KEY - 1, -1, -1))))
    rows = rows[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:, :_KEY] != rows[:-1, :_KEY]).any(axis=1))))
    out = rows[np.concatenate((new[1:], [len(rows)])) - 1]
    out[:, _COUNT] = np.add.reduceat(rows[:, _COUNT], new)
    return out


def merge_two(a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """Two sorted runs as one; a text of both keeps the row that stays."""
    at = np.searchsorted(_keys(a), _keys(b), "right") + np.arange(len(b))
    out, mine = np.empty((len(a) + len(b), _FIELDS), np.uint64), np.ones(len(a) + len(b), bool)
    mine[at] = False
    out[at], out[mine] = b, a
    second = np.flatnonzero((out[1:, :_KEY] == out[:-1, :_KEY]).all(axis=1)) + 1
    if not len(second):
        return out
    total = out[second, _COUNT] + out[second - 1, _COUNT]
    better = _worse(out[second - 1], out[second], largest)
    out[second[better] - 1] = out[second[better]]
    out[second - 1, _COUNT] = total
    return np.delete(out, second, axis=0)


def merge(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Sorted runs merged several ways: the two shortest first."""
    heap = [(len(r), i, r) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both, number = merge_two(a, b, largest), number + 1
        heapq.heappush(heap, (len(both), number, both))
    return heap[0][2] if heap else np.empty((0, _FIELDS), np.uint64)


def pieces(run: int, prefix: int, rows: np.ndarray, level: int, rounds: int) -> list[tuple[int, int, bytes]]:
    """The run cut in two by the digest's bit ``level``, addressed to the merges of that round; whole after the last."""
    if level >= rounds:
        return [(run, prefix, rows.tobytes())] if len(rows) else []
    cut = int(np.count_nonzero(~(rows[:, 0] >> np.uint64(63 - level)) & np.uint64(1)))
    return [(run >> 1, prefix << 1 | half, part.tobytes()) for half, part in enumerate((rows[:cut], rows[cut:])) if len(part)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["run", "prefix", "rows"])


def _runs(largest: bool, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def out(part: int) -> pa.RecordBatch:
            return _batch(pieces(part, 0, sorted_run(np.concatenate(held.pop(part)), largest), 0, rounds))

        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.empty((batch.num_rows, _FIELDS), np.uint64)
            t[:, :4] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            for i, c in ((4, "check"), (5, "size"), (_ID, "id"), (_ROW, "row")):
                t[:, i] = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            t[:, _KNOWN], t[:, _COUNT] = batch.column("id").is_valid().to_numpy(zero_copy_only=False), 1
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                held.setdefault(part, []).append(t[parts == part])
                if sum(map(len, held[part])) >= RUN_ROWS:
                    yield out(part)
        for part in list(held):
            yield out(part)
        release()

    return run


def _round(largest: bool, level: int, rounds: int):
    def run(group: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, _FIELDS) for x in group.column("rows")]
        number, prefix = group.column("run")[0].as_py(), group.column("prefix")[0].as_py()
        return pa.Table.from_batches([_batch(pieces(number, prefix, merge(runs, largest), level, rounds))])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            t = np.frombuffer(raw.as_buffer(), np.uint64).reshape(-1, _FIELDS)
            t = t[t[:, _COUNT] > 1]
            digests = np.ascontiguousarray(t[:, :4]).astype(">u8").tobytes()
            numbers = [pa.array(np.ascontiguousarray(t[:, i]).view(np.int64), mask=t[:, _KNOWN] == 0 if i == _ID else None) for i in (4, 5, _ID, _ROW, _COUNT)]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()), *numbers], names=["digest", "check", "size", "keep_id", "keep_row", "group_size"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``(id, digest binary, keep_id, group_size bigint, kept boolean)``, one row for each row of ``docs``.

    Of the rows with one text, that with the smallest id stays, with ``keep="largest"`` that with the largest;
    among rows of that very id, one. Null text counts as empty. A null id loses to any other; a group of null
    ids has a null keep_id and one row stays. Other columns aren't read; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t")).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("bigint").alias("size"),
    )
    # numbers of rows and partitions are stored with the digests: later scans may be split otherwise
    table = stage(rows.withColumn("part", F.spark_partition_id().cast("bigint")), "digests")
    rounds = int(table.agg(F.coalesce(F.max("part"), F.lit(0)).alias("n")).first()["n"]).bit_length()
    level = table.mapInArrow(_runs(largest, rounds), _RUN)
    for k in range(1, rounds + 1):
        level = level.groupBy("run", "prefix").applyInArrow(_round(largest, k, rounds), _RUN)
    if not rounds:
        level = level.groupBy("run", "prefix").applyInArrow(_round(largest, 0, 0), _RUN)
    repeated = level.select("rows").mapInArrow(_unpack, "digest binary, check bigint, size bigint, keep_id bigint, keep_row bigint, group_size bigint")
    joined = table.join(stage(repeated, "repeated"), ["digest", "check", "size"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )
