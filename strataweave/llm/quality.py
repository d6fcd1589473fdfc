"""Quality rules with an isolation forest over their statistics (operator 6).

The rules' statistics of each text are made scale-free and scored by an isolation forest: trees of random
splits over small samples of known good rows, where an odd document parts from the others after few splits.
The score that rejects is calibrated on labelled rows. The forest is fitted on a bounded sample (SAMPLE) of
labelled rows, the ones with the smallest hashes of their ids; every statistic covers the whole text of every
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.bpe import text_slices
from strataweave.llm.common import nullable, release, run_hashes, word_bounds, word_hashes

#: Labelled rows that the forest and its threshold are fitted on, at most.
SAMPLE = 4000
TREES = 128
TREE_ROWS = 256
SEED = 7
#: The share of good labelled rows that the forest may reject.
GOOD_LOST = 0.002
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: The base rule.
MIN_WORDS, MAX_REPEAT = 50, 50

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean word length", "symbols a word", "repeated lines", "repeated words", "words (log)")


def statistics(data: bytes) -> tuple[int, int, int, int, int, int]:
    """STATS of one UTF-8 text. Words lie between U+0020, U+0009 to U+000D; lines between U+000A."""
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return 0, 0, 0, 0, 0, 0
    raw = np.frombuffer(data, np.uint8)
    lead = int(np.count_nonzero((raw & 0xC0) != 0x80))
    chars = lead - (len(data) - int((ends - starts).sum()))
    symbols = sum(data.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    repeat = 0
    if n >= 3:
        runs = run_hashes(word_hashes(data, starts, ends), 3)
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(runs), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : j + len(runs)] |= twice
        repeat = int(covered.sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeat


def batch_statistics(batch: pa.RecordBatch, column: int) -> dict[str, np.ndarray]:
    """STATS of each text of a string column, as arrays."""
    found = [statistics(data[a:b]) for _, _, data, bounds in text_slices(batch, column) for a, b in zip(bounds, bounds[1:], strict=False)]
    return dict(zip(STATS, np.ascontiguousarray(np.array(found, np.int64).reshape(-1, len(STATS)).T), strict=True))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    # rates are measured against what a text of that length may have by chance
    few = 1 + 5 / np.sqrt(words)
    return np.column_stack(
        [
            np.clip(s["word_chars"] / words, 2, 16),
            np.log1p(20 * s["n_symbols"] / words),
            s["n_dup_lines"] / (lines + 2),
            s["n_repeat_words"] / words / few,
            np.log(words).clip(np.log(MIN_WORDS), np.log(20_000)),
        ]
    )


def depth(n: float) -> float:
    """The mean path of an unsuccessful search among n: what a leaf of n rows adds."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Isolation trees as flat tables: ``feature`` -1 marks a leaf, ``length`` its path."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, near 1 for odd rows and under 0.5 for common ones."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows[inner], f[inner]] >= self.cut[t, at[inner]]
                at[inner] = self.child[t, at[inner]] + go
            total += self.length[t, at]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def fit_forest(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Trees of random splits, each over ``rows`` rows of ``x`` at most. Splits range some way beyond the rows, so that what lies outside all of them parts early."""
    rng = np.random.default_rng(seed)
    size = min(rows, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    lo, hi = x.min(axis=0), x.max(axis=0)
    room = 0.25 * np.maximum(hi - lo, 0.2)
    tables = []
    for _ in range(trees):
        part = x[rng.choice(len(x), size, replace=False)]
        tree: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, part, 0, lo - room, hi + room)]
        while todo:
            at, p, d, low, high = todo.pop()
            if d >= limit or len(p) <= 1:
                tree[at] = [-1, 0.0, 0, d + depth(len(p))]
                continue
            f = int(rng.integers(x.shape[1]))
            c = float(rng.uniform(low[f], high[f]))
            tree[at] = [f, c, len(tree), 0.0]
            tree += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            right = p[:, f] >= c
            for k, (q, bound) in enumerate(((p[~right], high), (p[right], low))):
                edge = bound.copy()
                edge[f] = c
                todo.append((tree[at][2] + k, q, d + 1, low if k == 0 else edge, edge if k == 0 else high))
        tables.append(tree)
    width = max(map(len, tables))
    full = np.array([t + [[-1, 0.0, 0, 0.0]] * (width - len(t)) for t in tables])
    return Forest(full[:, :, 0].astype(int), full[:, :, 1], full[:, :, 2].astype(int), full[:, :, 3], max(depth(size), 1.0))


@dataclass
class Model:
    forest: Forest
    threshold: float

    def odd(self, x: np.ndarray) -> np.ndarray:
        return self.forest.scores(x) > self.threshold


def fit(x: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> Model | None:
    """A forest over the good rows; the threshold rejects the most bad rows, with at most a share ``lost`` of the good ones. None without good rows."""
    if not good.any():
        return None
    forest = fit_forest(x[good])
    s = forest.scores(x)
    fine, bad = np.sort(s[good]), np.sort(s[~good])
    floor = fine[-1 - int(lost * len(fine))]
    above = bad[bad > floor]
    # halfway to the first bad row beyond the good ones
    return Model(forest, float((floor + above[0]) / 2) if len(above) else float(max(floor, fine[-1]) + 1e-9))


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    words = np.asarray(stats["n_words"])
    return (words < MIN_WORDS) | (100 * np.asarray(stats["n_repeat_words"]) > MAX_REPEAT * words)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on ``sample`` labelled rows at most, ``labels(id_col, quality)``; rows that fail the base rule don't count.

    Null ids or labels are passed over; of an id with several labels the least counts. None without good rows.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")  # at most ``sample`` rows
    # rows of one id and label are pooled to their least statistics, so the driver gets ``sample`` rows at most
    rows = texts.select("id", "text", "quality").mapInArrow(_sampled, "id bigint, quality int, " + ", ".join(f"{s} bigint" for s in STATS))
    rows = rows.groupBy("id").agg(F.min(F.struct(*STATS, "quality")).alias("x")).select("id", "x.*").orderBy("id").toPandas()
    stats = {s: rows[s].to_numpy() for s in STATS}
    use = ~base_failed(stats) if len(rows) else np.zeros(0, bool)
    return fit(features(stats)[use], rows["quality"].to_numpy()[use] == 1) if use.any() else None


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = batch_statistics(batch, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *map(pa.array, stats.values())], names=["id", "quality", *STATS])
    release()


def _verdicts(model: Model | None, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows fail the base rule, and which are kept."""
    failed = base_failed(stats)
    odd = model.odd(features(stats)) if model and len(failed) else np.zeros(len(failed), bool)
    return failed, ~failed & ~odd


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, STATS, base_failed, kept)`` for each row of ``docs``, in one pass without a shuffle.

    ``kept`` is false where the base rule fails (under MIN_WORDS words, or more than MAX_REPEAT percent of them in
    repeated runs of three) or the forest finds the statistics odd; without a model the base rule decides. Null
    and empty texts fail. Null and repeated ids and rows are carried; other columns aren't read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch_statistics(batch, 1)
            failed, kept = _verdicts(model, stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (*stats.values(), failed, kept))], names=["id", *STATS, "base_failed", "kept"])
        release()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, " + ", ".join(f"{s} bigint" for s in STATS) + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are: each text goes to Python and back once.

    Columns may have any name; null and empty texts fail; repeated rows are judged alike; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(_verdicts(model, batch_statistics(batch, at))[1]))
            yield pa.RecordBatch.from_arrays([nullable(c) for c in part.columns], names=part.schema.names)
        release()

    return docs.mapInArrow(run, docs.schema)
