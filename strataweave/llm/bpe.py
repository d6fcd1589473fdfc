"""Byte-level BPE encoding and decoding (operator 3).

Encoding is by backtracking. An Aho-Corasick automaton over the vocabulary gives the longest token at each
position of a pre-token. A candidate is kept if it is *compatible* with the token before it: taking both
apart by the merge table shows no merge across their border that would have come first. Where none fits,
the last token gives way to its next shorter prefix and the dead position is marked, so a position fails
once at most and the work is linear. Repeated merging gives the same tokens. Decoding is by an offset
table: all tokens' bytes lie in one buffer, and a gather copies them.

Texts are cut into pre-tokens by array operations over whole batches, and each distinct pre-token of a batch
is encoded once. Pre-tokens that a worker doesn't know are encoded side by side, a step of each at a time, with the longest
tokens from a walk down the vocabulary's trie; long ones, and the last few of a batch, one by one by the automaton.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import release, word_hashes

#: Bytes of text that are cut into pre-tokens at once; longer single texts make longer slices.
SLICE_BYTES = 1 << 20
#: Distinct pre-tokens, and tokens of theirs, that a worker remembers before it starts anew: some 40 MB with their table.
REMEMBERED, REMEMBERED_TOKENS = 240_000, 2_000_000
#: Pairs of tokens whose compatibility a worker remembers: some 30 MB.
PAIRS = 200_000
#: Places for pairs of tokens whose compatibility is remembered for pre-tokens side by side: some 5 MB.
PAIR_SLOTS = 1 << 19
#: Pre-tokens of more bytes are encoded one by one; others side by side, about so many bytes of them, until few are left.
LONG_PIECE, SIDE_BY_SIDE, FEW = 64, 1 << 17, 64

WHITE, LETTER, NUMBER, OTHER = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a pre-token of its own.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

_kinds: np.ndarray | None = None
_loaded: dict[str, "Vocabulary"] = {}


def kinds() -> np.ndarray:
    """The class of every code point."""
    global _kinds
    if _kinds is None:
        by = {"L": LETTER, "N": NUMBER}
        _kinds = np.fromiter((by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _kinds[WHITE_SPACE] = WHITE
    return _kinds


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + i)] = b
    return out


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Table:
    """A hash table from 64-bit integers to integers, not negative, put in and looked up by arrays; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.bits, self.used = max(4, 2 * max(len(keys), room) - 1).bit_length() + 1, 0
        self.keys, self.values = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.put(keys, values)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add ``keys``, each once and none of them in the table."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            there = self.values >= 0
            self.__init__(self.keys[there], self.values[there], self.used + len(keys))
        self.used += len(keys)
        at = self._places(keys)
        while len(keys):
            free = self.values[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of several at one place the last stays
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that aren't there."""
        at = self._places(keys)
        out, other = self.values[at], self.keys[at] != keys
        left = np.flatnonzero(other & (out >= 0))
        out[other] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            value, other = self.values[at], self.keys[at] != keys[left]
            out[left[~other]] = value[~other]
            on = other & (value >= 0)
            left, at = left[on], at[on]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary file (tokenizers' JSON). Inside, tokens are numbered by their merge's rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        byte, ids = printable_bytes(), model["vocab"]
        by_byte = {b: c for c, b in byte.items()}
        text = [by_byte[b] for b in range(256)]
        rank = {c: i for i, c in enumerate(text)}
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a + b in rank:
                raise ValueError(f"{path}: two merges make {a + b!r}")
            rank[a + b] = len(text)
            self.merged[rank[a], rank[b]] = len(text)
            self.left.append(rank[a])
            self.right.append(rank[b])
            text.append(a + b)
        self.words = [bytes(byte[c] for c in t).decode("latin-1") for t in text]
        self.sizes = [len(w) for w in self.words]
        self.ids = np.array([ids[t] for t in text], np.int32)
        at = {w: i for i, w in enumerate(self.words)}
        self.shorter = [next((at[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in at), -1) for w in self.words]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {int(i): w.encode("latin-1") for i, w in zip(self.ids, self.words, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        size = max(pieces) + 1
        self.blob = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(pieces.get(i, b"")) for i in range(size)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self._compatible: dict[int, bool] = {}
        self._arrays()
        self._forget()

    def _arrays(self) -> None:
        """What :meth:`encode_pieces` reads: the tables above as arrays, and the trie, whose first 256 nodes are the single bytes."""
        self._sizes, self._shorter, self._left, self._right = (np.array(x, np.int64) for x in (self.sizes, self.shorter, self.left, self.right))
        table = lambda pairs: Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self._merged = table({a << 32 | b: i for (a, b), i in self.merged.items()})
        edges, tokens = {}, list(range(256))
        for i, w in enumerate(self.words):
            node = ord(w[0])
            for c in w[1:]:
                key = node << 8 | ord(c)
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(tokens)
                    tokens.append(-1)
                node = child
            tokens[node] = i
        self._edges, self._token = table(edges), np.array(tokens, np.int64)
        self._second = self._edges.get(np.arange(1 << 16))
        self._pairs, self._pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self._slots = Table(none, none)
        self._counts, self._flat, self._used, self._filled = np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32), 0, 0
        self._starts = np.zeros(1 << 12, np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` can stand side by side in an encoding."""
        known = self._compatible.get(pair := a << 32 | b)
        if known is None:
            if len(self._compatible) >= PAIRS:
                self._compatible.clear()
            known = self._compatible[pair] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        # ``before``: merges of this rank or later come after those that built what lies at the border now
        before = len(self.sizes) + 1
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b and a > 255:
                before, a = a, self.right[a]
            elif b > 255 and b >= a:
                before, b = b + 1, self.left[b]
            elif a > 255:
                before, a = a, self.right[a]
            else:
                return True

    def _fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`compatible`, of arrays."""
        pair = a << 32 | b
        at = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_SLOTS
        new = np.flatnonzero(self._pairs[at] != pair)
        fits = self._pair_fits[at]
        if len(new):
            distinct, which = np.unique(pair[new], return_inverse=True)
            fits[new] = found = self._borders(distinct >> 32, distinct & 0xFFFFFFFF)[which]
            self._pairs[at[new]] = pair[new]
            # of several pairs at one place the last has it
            own = self._pairs[at[new]] == pair[new]
            self._pair_fits[at[new][own]] = found[own]
        return fits

    def _borders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`_border`, of arrays."""
        fits, place = np.ones(len(a), bool), np.arange(len(a))
        before = np.full(len(a), len(self.sizes) + 1)
        while len(place):
            rank = self._merged.get(a << 32 | b)
            bad = (rank >= 0) & (rank < before)
            fits[place[bad]] = False
            first = (a > 255) & (a > b)
            on = ~bad & (first | (b > 255))
            a, b, first, place = a[on], b[on], first[on], place[on]
            before = np.where(first, a, b + 1)
            a, b = np.where(first, self._right[a], a), np.where(first, b, self._left[b])
        return fits

    def _longest(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token at each byte of ``raw``, of those that end at or before the byte's place in ``ends``."""
        out = raw.astype(np.int64)
        node, place, depth = out, np.arange(len(raw)), 1
        while len(place):
            on = place + depth < ends[place]
            node, place = node[on], place[on]
            key = node << 8 | raw[place + depth]
            child = (self._second[key] if depth == 1 else self._edges.get(key)).astype(np.int64)
            on = child >= 0
            node, place = child[on], place[on]
            token = self._token[node]
            is_token = token >= 0
            out[place[is_token]] = token[is_token]
            depth += 1
        return out

    def encode_pieces(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, by rank, of the pre-tokens of ``data`` between ``starts`` and ``ends``, and how many each has: :meth:`encode_piece` of all of them side by side."""
        sizes = ends - starts
        to = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8)[spread(starts, sizes)]
        begin = to - sizes
        longest = self._longest(raw, np.repeat(to, sizes))
        # the tokens of a pre-token lie in ``out`` from its begin on, ``last`` is the place after them; places rise with them
        out, alive, last = np.zeros(len(raw), np.int64), np.ones(len(raw) + 1, bool), begin.copy()
        which, at = np.arange(len(sizes)), begin.copy()
        t = longest[at]
        while len(which) > FEW:
            end, top, first = at + self._sizes[t], last[which], begin[which]
            good = alive[end]
            ask = np.flatnonzero(good & (top > first))
            good[ask] = self._fitting(out[top[ask] - 1], t[ask])
            put = top[good]
            out[put] = t[good]
            last[which[good]] = put + 1
            at = np.where(good, end, at)
            shorter = self._shorter[t]
            back = np.flatnonzero(~good & (shorter < 0))
            t = np.where(good, longest[np.minimum(end, len(raw) - 1)], shorter)
            if len(back):
                alive[at[back]] = False
                last[which[back]] -= 1
                t[back] = out[last[which[back]]]
                at[back] -= self._sizes[t[back]]
            on = at < to[which]
            which, at, t = which[on], at[on], t[on]
        for i in which.tolist():
            got = self.encode_piece(data[starts[i] : ends[i]].decode("latin-1"))
            last[i] = begin[i] + len(got)
            out[begin[i] : last[i]] = got
        counts = last - begin
        return out[spread(begin, counts)], counts

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens, by rank, of one pre-token, whose bytes are ``piece``'s Latin-1 characters."""
        n, sizes = len(piece), self.sizes
        longest = [0] * n
        for end, t in self.automaton.iter(piece):
            longest[end + 1 - sizes[t]] = t  # ends rise, so the longest comes last
        out: list[int] = []
        alive, at, t = bytearray(b"\1") * (n + 1), 0, longest[0]
        while True:
            end = at + sizes[t]
            if alive[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                if end == n:
                    return out
                at, t = end, longest[end]
            elif self.shorter[t] >= 0:
                t = self.shorter[t]
            else:
                alive[at] = 0
                t = out.pop()
                at -= sizes[t]

    def _learn(self, keys: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode and remember the pre-tokens of ``data`` between ``starts`` and ``ends``."""
        sizes = ends - starts
        for i in np.flatnonzero(sizes > LONG_PIECE).tolist():
            got = self.encode_piece(data[starts[i] : ends[i]].decode("latin-1"))
            self._remember(keys[i : i + 1], np.array(got, np.int32), np.array([len(got)]))
        short = np.flatnonzero(sizes <= LONG_PIECE)
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(sizes[short]) // SIDE_BY_SIDE)) + 1):
            if len(part):
                self._remember(keys[part], *self.encode_pieces(data, starts[part], ends[part]))

    def _remember(self, keys: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        used, filled = self._used + len(keys), self._filled + len(tokens)
        if used > len(self._counts):
            self._counts, self._starts = np.resize(self._counts, 2 * used), np.resize(self._starts, 2 * used)
        if filled > len(self._flat):
            self._flat = np.resize(self._flat, 2 * filled)
        self._flat[self._filled : filled] = tokens
        self._counts[self._used : used], self._starts[self._used : used] = counts, self._filled + np.cumsum(counts) - counts
        self._slots.put(keys, np.arange(self._used, used))
        self._used, self._filled = used, filled

    def encode_plain(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts that lie in ``data`` between ``bounds``, special tokens' strings taken as text; the texts' bounds in the ids."""
        starts, ends = pre_tokens(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if self._used > REMEMBERED or self._filled > REMEMBERED_TOKENS:
            self._forget()
        hashes = word_hashes(data, starts, ends).view(np.int64)
        slots = self._slots.get(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            self._learn(keys, data, starts[new[first]], ends[new[first]])
            slots[new] = self._slots.get(hashes[new])
        counts = self._counts[slots]
        ids = self.ids[self._flat[spread(self._starts[slots], counts)]]
        before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        return ids, before[np.searchsorted(starts, bounds)]

    def encode(self, data: bytes, bounds: np.ndarray, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_plain`; with ``specials``, a special token's string becomes its id."""
        found = [(i, s) for s in self.special for i in occurrences(data, s.encode())] if specials else []
        if not found:
            return self.encode_plain(data, bounds)
        marks = []
        for i, s in sorted(found):
            n, k = len(s.encode()), int(np.searchsorted(bounds, i, "right"))
            if i + n <= bounds[k] and (not marks or i >= marks[-1][1]):
                marks.append((i, i + n, self.special[s]))
        edges = np.concatenate([bounds, [m[0] for m in marks], [m[1] for m in marks]]).astype(np.int64)
        cuts = np.unique(edges)
        ids, at = self.encode_plain(data, cuts)
        begin = {m[0]: m for m in marks}
        parts, filled, new = [], 0, np.zeros(len(cuts), np.int64)
        for k in range(len(cuts) - 1):
            new[k] = filled
            m = begin.get(int(cuts[k]))
            parts.append(np.array([m[2]], np.int32) if m else ids[at[k] : at[k + 1]])
            filled += len(parts[-1])
        new[len(cuts) - 1] = filled
        return np.concatenate(parts) if parts else ids[:0], new[np.searchsorted(cuts, bounds)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and where each token's begin and the last ends."""
        sizes = self.lengths[ids]
        return self.blob[spread(self.offsets[ids], sizes)], np.concatenate(([0], np.cumsum(sizes)))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def occurrences(data: bytes, s: bytes) -> Iterator[int]:
    at = data.find(s)
    while at >= 0:
        yield at
        at = data.find(s, at + len(s))


def pre_tokens(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of the UTF-8 texts in ``data`` between ``bounds``.

    A pre-token is a run of letters, of numbers or of other characters, with one U+0020 before it if there
    is one; an apostrophe with one of SUFFIXES; or white space, of which the last character is left to what
    follows.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    if data.isascii():
        codes, places = raw, None
    else:
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((raw & 0xC0) != 0x80)
    n, kind = len(codes), kinds()[codes]
    first = np.zeros(n + 1, bool)
    inner = bounds[bounds < len(data)]
    first[inner if places is None else np.searchsorted(places, inner)] = True
    first[0] = first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = runs[1:]
    white = kind[runs[:-1]] == WHITE
    led = ends[white]
    led = led[~first[led]]  # white space that something of the same text follows
    start[led - 1] = True
    start[led[codes[led - 1] == 0x20]] = False
    for i in np.flatnonzero((codes == 0x27) & start[:n]).tolist():
        if i + 1 < n and start[i + 1] and not first[i + 1] and kind[i + 1] == LETTER:
            ahead = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
            if (size := next((len(s) for s in SUFFIXES if ahead.startswith(s)), 0)) and not (size == 2 and first[i + 2]):
                start[i + 1], start[i + 1 + size] = False, True
    cuts = np.flatnonzero(start)
    if places is not None:
        cuts = np.concatenate((places, [len(data)]))[cuts]
    return cuts[:-1], cuts[1:]


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows from, rows to, UTF-8 and bounds of the texts of a string column, about ``most`` bytes at a time; null counts as empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, data.slice(lo, hi - lo).to_pybytes() if hi > lo else b"", offsets[at : to + 1] - lo
        at = to


def encoder(path: str, specials: bool = True, decode: bool = True):
    """A function for mapInArrow from (id, text) to (id, ids[, decoded])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at, to, data, bounds in text_slices(batch, 1):
                ids, cuts = v.encode(data, bounds, specials)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                out = [batch.column(0).slice(at, to - at), lists]
                if decode:
                    raw, ends = v.decode(ids)
                    whole = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(ends[cuts].astype(np.int64)), pa.py_buffer(raw.tobytes()))
                    try:
                        whole.validate(full=True)
                    except pa.ArrowInvalid:  # ids that part a character: as the library, U+FFFD
                        whole = pa.array([bytes(raw[ends[a] : ends[b]]).decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.large_string())
                    out.append(whole.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])
        release()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True, decode: bool = False) -> DataFrame:
    """``(id, ids array<int>[, decoded string])`` for every row of ``docs``, in one pass without a shuffle.

    Null and empty texts have no ids and decode to the empty text. Null, repeated and tied row ids are
    carried as they are, one row out for each row in; other columns are not read. An empty table gives none.
    Texts are taken whole; a batch's memory is some thirty times SLICE_BYTES or the longest text.
    """
    schema = "id bigint, ids array<int>" + (", decoded string" if decode else "")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoder(path, specials, decode), schema)
