"""What is compared, and what stays on the disk."""

import glob
import random

import pytest

from strataweave.llm import lines, substring
from strataweave.llm.common import shared_dir, stage


@pytest.mark.parametrize("counted", ["zq"])
def test_counted_characters_lose_no_link(spark, monkeypatch, counted):
    monkeypatch.setattr(lines, "COUNTED", counted)
    rng = random.Random(3)
    base = "der von " * 8 + "enden"
    rows = [(1, base.strip()), (2, base.replace("von", "vom")), (3, base.replace("d", "z")), (4, " ".join(rng.choice(("eine", "ganz", "andere")) + str(i) for i in range(10)))]
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "t")
    got = {r["id"]: list(r["dropped"]) for r in lines.line_report(docs).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: []}


def test_texts_of_lines_go_when_compared(spark):
    rows = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven nine"), (3, "one two three four fiwe six sewen eight")]
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "t")
    there = lambda: {n: len(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/{n}-*")) for n in ("line-texts", "wanted", "placed", "line-occurrences")}
    before = there()
    assert {r["id"]: list(r["dropped"]) for r in lines.line_report(docs).collect()}[2] == [0]
    assert there() == before


def test_keys_of_anchors_go_when_answered(spark):
    words = [f"w{i}" for i in range(60)]
    docs = stage(spark.createDataFrame([(1, " ".join(words)), (2, "before " + " ".join(words[:30]) + " behind"), (3, None)], "doc_id bigint, text string"), "t")
    chunks = lambda: {*glob.glob(f"{shared_dir(spark).removeprefix('file:')}/chunks-*")}
    before = chunks()
    found = substring.repeated_passages(docs)
    assert spark.read.parquet(*chunks() - before).where("keys is not null").isEmpty()
    assert {r["id"]: [tuple(s) for s in r["spans"]] for r in found.collect()} == {1: [], 2: [(1, 30)], 3: []}


def test_lines_of_few_words_are_counted_at_fitting_lengths_only_and_lose_no_link(spark):
    rng, rows = random.Random(5), []
    for k, word in enumerate(("erinsh.", "der", "inchtekeiten")):
        line = [word] * 20
        rows.append((10 * k, " ".join(line)))
        for n in (1, 4, 5):  # of 20 words four may be others; five long ones are too many
            put = list(line)
            for at in rng.sample(range(20), n):
                put[at] = "zzuuzzuu" + str(at)
            rows.append((10 * k + n, " ".join(put)))
    rows.append((99, "quite another line that fits in no way " * 30))
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "t")
    keyed = lines._keyed(docs, "doc_id", "text").drop("doc")
    seen = stage(lines.occurrences(keyed, lines.MIN_WORDS, 1), "seen")
    links = lines.few_word_links(seen.select("h", "size", "words"), seen, keyed, lines.SIMILARITY)
    assert "LeftSemi" in links._jdf.queryExecution().toString()
    ids = {r["h"]: r["id"] for r in seen.collect()}
    got = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in links.collect()}
    # line 14 is longer than 10 by more than a fifth
    assert got == {(0, 1), (0, 4), (10, 11), (20, 21), (20, 24)}
