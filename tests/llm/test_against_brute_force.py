"""Each operator against a plain version of its contract, on awkward rows and on a small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from strataweave.llm import bpe, exact, lines, packing, quality, queries, simhash, substring, tokenfile
from strataweave.llm.common import stage

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["awkward", "table", "empty"])
def docs(request, spark, awkward):
    if request.param == "awkward":
        return awkward
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table if request.param == "table" else table.limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute_fingerprint(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = pairs(docs)
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = Counter((d, f, low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fp, strict=True)))
    got = Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs, bucket=2).collect()) == want


def test_covering_finds_every_pair():
    masks = simhash.covering(list(range(64)))
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 5)
    values = np.unique(np.concatenate([base ^ (1 << int(b)) for b in rng.integers(0, 60, 40)]))
    links = simhash.forest(values)
    assert len(links) == len(values) - len({find_all(values, v) for v in values})


def find_all(values, v):
    seen, todo = {int(v)}, [int(v)]
    while todo:
        x = todo.pop()
        for y in map(int, values):
            if y not in seen and (x ^ y).bit_count() <= 2:
                seen.add(y)
                todo.append(y)
    return min(seen)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, keep):
    rows = [(d, t or "") for d, t in pairs(docs)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    pick = max if keep == "largest" else min
    got = exact.exact_duplicates(docs, keep=keep).collect()
    best = {t: pick((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = Counter((d, sha(t), best[t], len(groups[t])) for d, t in rows)
    assert Counter((r["id"], r["digest"].hex(), r["keep_id"], r["group_size"]) for r in got) == want
    stays = Counter(r["digest"].hex() for r in got if r["kept"])
    assert stays == Counter({sha(t): 1 for t in groups})
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_merge_over_many_runs(spark):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(23)
    got = exact.exact_duplicates(df, keep="largest").collect()
    assert {(r["id"], r["keep_id"]) for r in got} == {(i, max(j for j in range(500) if j % 37 == i % 37)) for i in range(500)}
    assert sum(r["kept"] for r in got) == 37


def test_bpe(docs):
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = Counter()
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.encode(docs, queries.TOKENIZER, decode=True).collect()
    assert Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


def test_decode_of_parted_characters():
    v = bpe.vocabulary(queries.TOKENIZER)
    raw, ends = v.decode(np.array([0, 50256, 220]))
    assert raw.tobytes() == b"!<|endoftext|> " and ends.tolist() == [0, 1, 14, 15]


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_token_counts(docs, block):
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.encode_special_tokens = True
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(docs))
    if block < 10 and len(want) > 50:
        block = 501
    files = tokenfile.write(docs, queries.TOKENIZER, queries.END_OF_DOCUMENT, block=block).cache()
    got = tokenfile.document_ids(files).join(tokenfile.token_counts(files, queries.END_OF_DOCUMENT), ["file", "ordinal"], "left").collect()
    assert Counter((r["id"], r["n_tokens"]) for r in got) == want


def test_token_counts_of_files(spark, tmp_path):
    for name, ids in {"a": [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9, 1], "b": [9], "c": [5, 5]}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "d").write_bytes(b"")
    for block, span in ((1, 1), (1, 3), (2, 2), (5, 1024), (100, 1)):
        got = tokenfile.token_counts(tokenfile.blocks_of_files(spark, str(tmp_path), block=block), 9, span=span).collect()
        assert sorted((r["file"][-1], r["ordinal"], r["n_tokens"]) for r in got) == [("a", 0, 2), ("a", 1, 0), ("a", 2, 6), ("a", 3, 1), ("b", 0, 0), ("c", 0, 2)]


def brute_repeats(rows, window=13):
    low = {}
    split = [WORD.findall(t or "") for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    for d, w in zip(key, split, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            low[g] = min(low.get(g, d), d)
    out = []
    for d, w in zip(key, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter((d, *o) for (d, _), o in zip(rows, out, strict=True))


@pytest.mark.parametrize(("chunk", "spread", "hot"), [(1, 1 << 20, 3), (4000, 20_000, 1), (4000, 20_000, 64), (substring.CHUNK_BYTES, substring.RANGE_BYTES, substring.HOT)])
def test_substring(docs, chunk, spread, hot):
    got = substring.repeated_passages(docs, chunk_bytes=chunk, carry=["n_chars", "text"], range_bytes=spread, hot=hot).collect()
    assert Counter((r["id"], r["n_words"], sum(s["length"] for s in r["spans"]), r["kept_text"]) for r in got) == brute_repeats(pairs(docs))
    for r in got:
        assert WORD.findall(r["cut_text"]) == WORD.findall(r["kept_text"])
        assert r["spans"] or r["cut_text"] == (r["row"]["text"] or "")


def brute_statistics(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    kept = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(kept), len(kept) - len(set(kept)), len(covered)


def test_quality(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.judge(docs, model).collect()
    want = Counter()
    for d, t in pairs(docs):
        s = brute_statistics(t)
        want[d, *s, s[0] < 50 or 100 * s[5] > 50 * s[0]] += 1
    assert Counter((r["id"], *(r[c] for c in quality.STATS), r["base_failed"]) for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id").where("not base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(line):
    return re.sub(r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ", line.lower()).strip(" ")


def mur(word):
    """Spark's hash of a string: Murmur3 over the UTF-8 bytes, the last ones one by one."""
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    data, h = word.encode(), 42
    whole = len(data) // 4 * 4
    for k in [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [(b - 256 if b > 127 else b) & m for b in data[whole:]]:
        h = (rot(h ^ (rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    return h ^ (h >> 16)


def brute_dropped(rows):
    """(row, line) of every line that isn't the first of its group; rows are (id, text) in their order of precedence."""
    found = [(k, p, normal(x)) for k, (_, t) in enumerate(rows) for p, x in enumerate((t or "").split("\n"))]
    found = [x for x in found if x[2]]
    words = {x: sorted({((15 - min(len(w), 15)) << 27) | (mur(w) & ((1 << 27) - 1)) for w in x.split(" ")})[: lines.WORDS] for _, _, x in found}
    words = {x: w if len(w) >= lines.MIN_WORDS else [] for x, w in words.items()}
    slots = Counter(h % lines.SLOTS for hs in words.values() for h in hs)
    most = max(slots.values(), default=1)
    keys, tops = {}, {}
    for x, hs in words.items():
        tops[x] = sorted(((slots[h % lines.SLOTS] * lines.COMMON // most).bit_length() << 32) + (h % (1 << 27)) * 32 + (h >> 27) for h in hs)[: lines.TOPS]
        keys[x] = {(a, b) for i, a in enumerate(tops[x]) for b in tops[x][i + 1 : i + 3]}
    distinct = sorted(words)
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            longest = max(len(x), len(y))
            if not keys[x] & keys[y] or min(len(x), len(y)) < 0.8 * longest or len(set(tops[x]) & set(tops[y])) < 3:
                continue
            fewer, more = sorted((len(words[x]), len(words[y])))
            if len(set(words[x]) & set(words[y])) < (-(-6 * more // 10) if more < lines.WORDS else -(-fewer // 2)):
                continue
            v, w = x.split(" "), y.split(" ")
            moved, most = levenshtein(v, w), max(len(v), len(w))
            if moved <= 0.25 * most if longest > lines.LONG else moved <= 0.2 * most or moved <= lines.MOVED * most and levenshtein(x, y) <= 0.2 * longest:
                root[find(x)] = find(y)
    for x in distinct:
        if not words[x] and len(x) <= lines.SHORT:  # all lines, whatever they share
            for y in distinct:
                if x != y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
                    root[find(x)] = find(y)
    first, gone = {}, set()
    for k, p, x in found:
        if first.setdefault(find(x), (k, p)) != (k, p):
            gone.add((k, p))
    return gone


@pytest.mark.parametrize("bucket", [lines.BUCKET, 1])
def test_lines(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    base = "this is a long enough line that is shared by documents number " + " ".join(f"word{i}" for i in range(400))
    near = base.replace("shared", "sharet")
    rows = [(1001, f"{base}\nkeep me as i am here"), (1002, f"{near}\nshort line\nshort line"), (1003, f"x\n{base.upper()}\nother line with six words here\nx"), (None, base), (1004, None), (1005, "")]
    rows += [(1100 + i, f"alpha beta gamma delta {'abcdefgh'[i] * 3} epsilon zeta eta\ncommon start of a line that ends in {i * 'y'}{i * 'z'} of its own") for i in range(8)]
    docs = stage(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3), "t")
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, r[0] or 0))
    gone = brute_dropped(rows)
    want = Counter((d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)) for k, (d, t) in enumerate(rows))
    # rows of one id can stand for each other if their texts are equal
    assert Counter(pairs(lines.dedup_lines(docs))) == want
    report = Counter((d, 0 if t is None else t.count("\n") + 1, tuple(p for p in range((t or "").count("\n") + 1) if (k, p) in gone)) for k, (d, t) in enumerate(rows))
    assert Counter((r["id"], r["n_lines"], tuple(r["dropped"])) for r in lines.line_report(docs).collect()) == report
    assert sum((t or "").lower().count("word399") for _, t in want.elements()) == 1


def test_packing(docs):
    library = Tokenizer.from_file(queries.TOKENIZER)
    got = packing.pack_documents(docs, queries.TOKENIZER, 1, group=64).collect()
    want = Counter()
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 2049, 700).tolist(), reverse=True)
    room, want = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(2048)
            k = len(room) - 1
        want.append((k, 2048 - room[k]))
        room[k] -= s
    assert list(zip(*packing.first_fit(sizes, 2048), strict=True)) == want
