"""Repeated passages across documents, by seed and extend (operator 5).

Seeds are winnowed anchors: 8-word grams, of which each span of 13 words holds one at least, picked by hash and so the
same in every document. Documents join on the anchors that several documents have. There each occurrence is extended both
ways, word by word, against the one in the document with the smallest id; every window of the threshold length
inside the match is a repeat. Windows that this leaves open are compared with all other occurrences of the anchor. Overlapping
repeats merge into maximal spans.

Documents travel in chunks. Per chunk and range of hashes, one packed row goes to the task of that range and an answer
for each key comes back: occurrences of an anchor with the same words around it count once a chunk, with their smallest id,
nothing is paired within a group, and a task holds one range's keys, whose number is set from the bytes of
text. An anchor of more than HOT chunks is dealt anew by its whole windows, so that a phrase of very many documents with
different words around it doesn't come to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.bpe import text_slices
from strataweave.llm.common import mix, nullable, release, run_hashes, stage, unstage, word_bounds, word_hashes

#: Words of an anchor; a window holds WINDOW - ANCHOR + 1 grams, of which the least is taken.
ANCHOR = 8
WINDOW = 13
#: Bytes of text in a chunk, beyond which a new one begins; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Rows in a chunk at most.
CHUNK_ROWS = 20_000
#: Bytes of text for each range of hashes: about a million anchors of some 60 bytes come together in a task.
RANGE_BYTES = 24 << 20
#: Chunks that share an anchor before it is dealt by its windows.
HOT = 64
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the grams that are the least of some ``span`` consecutive ones; ties all count."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + n], out=low)
    chosen = np.zeros(len(grams), bool)
    for j in range(span):
        chosen[j : j + n] |= grams[j : j + n] == low
    return np.flatnonzero(chosen)


class Chunk:
    """Documents with their words' hashes: one flat array, ``at`` bounds each document's words in it."""

    def __init__(self, ids: np.ndarray, data: bytes, bounds: np.ndarray, window: int, anchor: int):
        self.ids, self.data, self.bounds, self.window, self.anchor = ids, data, bounds, window, anchor
        starts, ends = [], []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            s, e = word_bounds(data[a:b])
            starts.append(s + a)
            ends.append(e + a)
        self.at = np.concatenate(([0], np.cumsum([len(s) for s in starts]))).astype(np.int64)
        self.starts, self.ends = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.words = word_hashes(data, self.starts, self.ends)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and document of every run of k words of one document."""
        h = run_hashes(self.words, k)
        sizes = np.maximum(np.diff(self.at) - k + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.at[:-1], sizes)
        return h[place] if len(place) else np.zeros(0, np.uint64), place, doc

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and document of the anchors."""
        h, place, doc = self.grams(self.anchor)
        span = self.window - self.anchor + 1
        cuts = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        got = [anchors(h[a:b], span) + a for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) if b - a >= span]
        got = np.concatenate(got) if got else np.zeros(0, np.int64)
        return h[got], place[got], doc[got]

    def around(self, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words around anchors, as 32-bit hashes in the order of the text (0 beyond the document), and which windows lie inside it.

        With r words beside the anchor, window l starts l words before it and takes columns r - l to 2 r - l.
        """
        r, n = self.window - self.anchor, len(self.words)
        words = np.concatenate((np.maximum(self.words >> np.uint64(32), np.uint64(1)).astype(np.uint32), [np.uint32(0)]))
        at = place[:, None] + np.concatenate((np.arange(-r, 0), np.arange(self.anchor, self.anchor + r)))
        lo, hi = self.at[doc], self.at[doc + 1]
        at = np.where((at >= lo[:, None]) & (at < hi[:, None]), at, n)
        l = np.arange(r + 1)
        inside = (place[:, None] - l >= lo[:, None]) & (place[:, None] - l + self.window <= hi[:, None])
        return words[at].reshape(-1, 2 * r), inside


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes of each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def cut_by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, for the ranges that have any."""
    if not len(keys):
        return []
    r = range_of(keys, ranges)
    new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    return list(zip(r[new].tolist(), new.tolist(), [*new[1:].tolist(), len(keys)], strict=True))


def least(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value among the rows with its key."""
    if not len(keys):
        return values
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(np.minimum.reduceat(values[order], new), np.diff(np.concatenate((new, [len(keys)]))))
    return out


_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) | 1 for i in range(64)], dtype=object)


def joined_hash(keys: np.ndarray, words: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each key with the words beside it."""
    factors = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in _MIX[: words.shape[1]]], np.uint64)
    return mix(mix(keys + np.uint64(salt)) + (mix((words.astype(np.uint64) + np.uint64(1)) * factors) * factors).sum(axis=1, dtype=np.uint64))


def pack(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["row"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(raw).read_all().column(0)


def _chunks(window: int, anchor: int, ranges: int, chunk_bytes: int):
    schema = pa.schema([(n, pa.int64()) for n in ("chunk", "range")] + [(n, pa.binary()) for n in ("keys", "ids", "text", "bounds", "rows")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = 0, zstandard.ZstdCompressor(level=3)
        held: list[tuple] = []
        size = part = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            data = b"".join(x[1] for x in held)
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held])))).astype(np.int64)
            chunk = (part << 32) | number
            hashes, _, _ = Chunk(ids, data, bounds, window, anchor).seeds()
            keys = np.unique(hashes)
            rows = [{"chunk": chunk, "range": r, "keys": keys[a:b].tobytes()} for r, a, b in cut_by_range(keys, ranges)]
            carried = pack(pa.concat_arrays([x[3] for x in held]))
            rows.append({"chunk": chunk, "ids": ids.tobytes(), "text": press.compress(data), "bounds": bounds.tobytes(), "rows": press.compress(carried)})
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for at, to, data, bounds in text_slices(batch, 1, chunk_bytes // 4):
                part = int(batch.column(2)[0].as_py())
                ids = batch.column(0).slice(at, to - at).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held.append((ids, data, bounds, batch.column(3).slice(at, to - at)))
                size += len(data)
                if size >= chunk_bytes or sum(len(x[0]) for x in held) >= CHUNK_ROWS:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()
        release()

    return run


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _answer(group: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "flags": pa.array([np.ascontiguousarray(x).tobytes() for x in flags], pa.binary())})


def _common(hot: int):
    def run(group: pa.Table) -> pa.Table:
        """For each chunk's anchors of one range: 1 if another chunk has it too, 2 if more than ``hot`` chunks have it, else 0."""
        lists = _arrays(group.column("keys"), np.uint64)
        every, which, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        flags = ((count > 1).astype(np.uint8) + (count > hot))[which]
        return _answer(group, np.split(flags, np.cumsum([len(x) for x in lists])[:-1]))

    return run


def extend(keys: np.ndarray, lows: np.ndarray, words: np.ndarray, reach: int) -> np.ndarray:
    """For each occurrence (anchor, smallest id, words around) a bit for each window: whether a smaller id has it too."""
    order = np.lexsort((lows, keys))
    key, low, side = keys[order], lows[order], words[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((new, [len(key)])))
    first = np.repeat(new, sizes)
    # against the first document: how many words match to the left and to the right of the anchor
    same = side == side[first]
    left = np.logical_and.accumulate(same[:, reach - 1 :: -1] if reach else same[:, :0], axis=1).sum(axis=1)
    right = np.logical_and.accumulate(same[:, reach:], axis=1).sum(axis=1)
    l = np.arange(reach + 1)
    found = (l <= left[:, None]) & (reach - l <= right[:, None]) & (low > low[first])[:, None]
    # what is open is compared with the others of the anchor
    open_ = np.repeat(np.add.reduceat(~found.all(axis=1), new) > 1, sizes)
    rest = np.flatnonzero(open_ & (np.repeat(sizes, sizes) > 2))
    for k in l.tolist() if len(rest) else []:
        window = joined_hash(key[rest], side[rest, reach - k : 2 * reach - k], k + 1)
        found[rest, k] |= least(window, low[rest]) < low[rest]
    bits = np.empty(len(key), np.uint16)
    bits[order] = (found.astype(np.uint16) << l.astype(np.uint16)).sum(axis=1)
    return bits


def _extend(reach: int):
    def run(group: pa.Table) -> pa.Table:
        """For each chunk's occurrences, and hot windows, of one range: the windows that a smaller id has."""
        keys, lows = _arrays(group.column("keys"), np.uint64), _arrays(group.column("lows"), np.int64)
        words = [x.reshape(-1, 2 * reach) for x in _arrays(group.column("words"), np.uint32)]
        sizes = [len(x) for x in words]
        cold = extend(*(np.concatenate(x) for x in ([k[:n] for k, n in zip(keys, sizes)], [k[:n] for k, n in zip(lows, sizes)], words)), reach) if sum(sizes) else np.zeros(0, np.uint16)
        hot, low = np.concatenate([k[n:] for k, n in zip(keys, sizes)]), np.concatenate([k[n:] for k, n in zip(lows, sizes)])
        warm = (least(hot, low) < low).astype(np.uint16)
        cold, warm = np.split(cold, np.cumsum(sizes)[:-1]), np.split(warm, np.cumsum([len(k) - n for k, n in zip(keys, sizes)])[:-1])
        return _answer(group, [np.concatenate(x) for x in zip(cold, warm)])

    return run


def _flags(answers: pa.Table, step: int, kind: type, cuts: dict[int, tuple[int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, kind)
    for s, r, raw in zip(answers.column("step").to_pylist(), answers.column("range").to_pylist(), answers.column("flags"), strict=True):
        if s == step:
            a, b = cuts[r]
            out[a:b] = np.frombuffer(raw.as_buffer(), kind)
    return out


def _open(chunk: pa.Table, window: int, anchor: int) -> Chunk:
    row = {n: chunk.column(n)[0] for n in ("ids", "text", "bounds")}
    data = zstandard.ZstdDecompressor().decompress(row["text"].as_py())
    ids, bounds = (np.frombuffer(row[n].as_buffer(), np.int64) for n in ("ids", "bounds"))
    return Chunk(ids, data, bounds, window, anchor)


class Seeds:
    """A chunk's occurrences of anchors that several documents have, reduced to classes with the same words around.

    Classes are sorted by anchor; each has the smallest id of its occurrences. Windows of hot anchors are classes by themselves.
    """

    def __init__(self, c: Chunk, answers: pa.Table, ranges: int):
        hashes, place, doc = c.seeds()
        keys, which = np.unique(hashes, return_inverse=True)
        said = _flags(answers, 1, np.uint8, {r: (a, b) for r, a, b in cut_by_range(keys, ranges)}, len(keys))
        order = np.lexsort((doc, which))
        several = np.zeros(len(keys), bool)
        w, d = which[order], doc[order]
        several[w[1:][(w[1:] == w[:-1]) & (d[1:] != d[:-1])]] = True
        kind = np.where(said == 2, 2, (said > 0) | several)[which]
        cold, hot = kind == 1, kind == 2
        self.place, self.doc, self.hashes = place[cold], doc[cold], hashes[cold]
        self.words, self.inside = c.around(self.place, self.doc)
        self.ids = c.ids[self.doc]
        _, self.cls, self.key, self.low, first = self._classes(joined_hash(self.hashes, self.words), self.hashes, self.ids)
        self.side = self.words[first]
        _, inside = c.around(place[hot], doc[hot])
        row, l = np.nonzero(inside)
        self.start, self.owner = place[hot][row] - l, doc[hot][row]
        h = run_hashes(c.words, c.window)[self.start] if len(row) else np.zeros(0, np.uint64)
        # a key apart from those of anchors
        h = mix(h ^ np.uint64(0x632BE59BD9B4E019))
        _, self.hot_cls, self.hot_key, self.hot_low, _ = self._classes(h, h, c.ids[self.owner])

    @staticmethod
    def _classes(names: np.ndarray, keys: np.ndarray, ids: np.ndarray):
        """Classes by ``names``: names, the class of each row, key, smallest id and a row of each, sorted by key."""
        name, first, cls = np.unique(names, return_index=True, return_inverse=True)
        low = np.empty(len(name), np.int64)
        low[cls] = least(names, ids)
        order = np.argsort(keys[first], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return name[order], back[cls], keys[first][order], low[order], first[order]


def _ask(window: int, anchor: int, ranges: int):
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("lows", pa.binary()), ("words", pa.binary())])

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s = Seeds(_open(chunk, window, anchor), answers, ranges)
        number = chunk.column("chunk")[0].as_py()
        cold, hot = ({r: (a, b) for r, a, b in cut_by_range(k, ranges)} for k in (s.key, s.hot_key))
        rows = []
        for r in sorted({*cold, *hot}):
            (a, b), (x, y) = cold.get(r, (0, 0)), hot.get(r, (0, 0))
            rows.append({"chunk": number, "range": r, "keys": s.key[a:b].tobytes() + s.hot_key[x:y].tobytes(), "lows": s.low[a:b].tobytes() + s.hot_low[x:y].tobytes(), "words": s.side[a:b].tobytes()})
        return pa.Table.from_pylist(rows, schema)

    return run


def _repeats(c: Chunk, answers: pa.Table, ranges: int) -> np.ndarray:
    """The starts, in words of the chunk, of the windows that a document with a smaller id has."""
    s = Seeds(c, answers, ranges)
    cold, hot = ({r: (a, b) for r, a, b in cut_by_range(k, ranges)} for k in (s.key, s.hot_key))
    bits, warm = np.zeros(len(s.key), np.uint16), np.zeros(len(s.hot_key), np.uint16)
    for step, r, raw in zip(answers.column("step").to_pylist(), answers.column("range").to_pylist(), answers.column("flags"), strict=True):
        if step == 2:
            said, (a, b), (x, y) = np.frombuffer(raw.as_buffer(), np.uint16), cold.get(r, (0, 0)), hot.get(r, (0, 0))
            bits[a:b], warm[x:y] = said[: b - a], said[b - a :]
    l = np.arange(s.inside.shape[1])
    found = ((bits[s.cls][:, None] >> l.astype(np.uint16)) & 1).astype(bool) | (s.ids > s.low[s.cls])[:, None]
    row, at = np.nonzero(found & s.inside)
    again = warm[s.hot_cls].astype(bool) | (c.ids[s.owner] > s.hot_low[s.hot_cls])
    return np.concatenate((s.place[row] - at, s.start[again]))


def _mark(window: int, anchor: int, ranges: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = _open(chunk, window, anchor)
        starts_at = np.unique(_repeats(c, answers, ranges))
        edge = np.zeros(len(c.words) + 1, np.int64)
        edge[starts_at] += 1
        edge[starts_at + window] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        ids, words, spans, kept, cut = [], [], [], [], []
        starts, ends, data = c.starts, c.ends, c.data
        for i in range(len(c.ids)):
            a, b = int(c.at[i]), int(c.at[i + 1])
            lo, hi = int(c.bounds[i]), int(c.bounds[i + 1])
            ids.append(None if c.ids[i] == NO_ID else int(c.ids[i]))
            words.append(b - a)
            turn = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False]))))
            begin, end = turn[0::2].tolist(), turn[1::2].tolist()
            spans.append([{"start": x, "length": y - x} for x, y in zip(begin, end, strict=True)])
            left = list(zip([0, *end], [*begin, b - a], strict=True))
            kept.append(b" ".join(w for x, y in left if y > x for w in data[starts[a + x] : ends[a + y - 1]].split()).decode())
            if begin:
                # white space stays with the word before it, so what is left keeps its lines
                at = [starts[a + x] if x < b - a else hi for x in (0, *end)]
                to = [starts[a + x] if x < b - a else hi for x in (*begin, b - a)]
                at[0] = lo
                cut.append(b"".join(data[x:y] for x, y in zip(at, to, strict=True)).decode())
            else:
                cut.append(data[lo:hi].decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        rows = unpack(zstandard.ZstdDecompressor().decompress(chunk.column("rows")[0].as_py()))
        columns = [nullable(pa.concat_arrays(rows.chunks)), pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string()), pa.array(cut, pa.string())]
        return pa.table(dict(zip(("row", "id", "n_words", "spans", "kept_text", "cut_text"), columns, strict=True)))

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, hot: int = HOT) -> DataFrame:
    """``(row struct, id, n_words, spans array<struct<start, length>>, kept_text, cut_text)`` for every row of ``docs``.

    ``spans`` are the maximal repeats, counted in words: the words covered by runs of ``window`` words that also
    start in a row with a smaller id. ``kept_text`` is the other words joined by one space; ``cut_text`` the
    text without the spans, white space and all. ``row`` holds the columns named in ``carry``.
    Null and empty texts have no words and no spans. A row with a null id comes after all others: it loses
    what they have and takes nothing from them; rows of equal ids, repeated rows included, take nothing from
    each other. Texts under ``window`` words are left alone. Columns outside ``carry`` aren't read, and clash
    with nothing. An empty table gives no rows. Anchors are compared by 64-bit hashes, the words around them by 32 bits each.
    """
    if not 0 < window - anchor < 16:
        raise ValueError("an anchor is 1 to 15 words shorter than the window")
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint")).alias("n")).first()["n"] or 0
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(True).alias("any"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.spark_partition_id().cast("bigint").alias("part"), row.alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    ranges = max(1, math.ceil(size / range_bytes))
    packed = "chunk bigint, range bigint, keys binary, ids binary, text binary, bounds binary, rows binary"
    # keys and texts lie apart, so that the keys' files go once they are answered
    table = stage(rows.mapInArrow(_chunks(window, anchor, ranges, chunk_bytes), packed).withColumn("kind", F.when(F.col("text").isNull(), "keys").otherwise("texts")), "chunks", by="kind")
    texts = table.where("kind = 'texts'").select("chunk", "ids", "text", "bounds", "rows")
    answer = "chunk bigint, range bigint, flags binary"
    first = table.where("kind = 'keys'").select("chunk", "range", "keys").groupBy("range").applyInArrow(_common(hot), answer)
    answers = stage(first.withColumn("step", F.lit(1)), "anchor-answers")
    unstage(table, "kind=keys")
    bare = texts.select("chunk", "ids", "text", "bounds")
    asked = bare.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ask(window, anchor, ranges), "chunk bigint, range bigint, keys binary, lows binary, words binary")
    second = asked.groupBy("range").applyInArrow(_extend(window - anchor), answer).withColumn("step", F.lit(2))
    answers = answers.unionByName(stage(second, "window-answers"))
    out = f"row {kind}, id bigint, n_words bigint, spans array<struct<start: bigint, length: bigint>>, kept_text string, cut_text string"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(window, anchor, ranges), out)
