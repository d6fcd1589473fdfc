"""Row keys, and the whole pipeline on rows with null and repeated ids, against plain versions one after another."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_against_brute_force import brute_dropped, brute_repeats, brute_statistics, pairs
from test_near_copies import first_rows
from tokenizers import Tokenizer

from strataweave.llm import lines, queries, shingles
from strataweave.llm.common import with_row_key


def test_keys_are_the_same_however_files_are_split(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("row"), F.lit("y").alias("_metadata")).repartition(40).write.parquet(f"{tmp_path}/t")
    found = []
    for n in ("4", "16"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200" if n == "4" else "128m")
        keyed = with_row_key(spark.read.parquet(f"{tmp_path}/t"))
        found.append({r["doc"]["doc_id"]: tuple(r["row"]) for r in keyed.collect()})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len(set(found[0].values())) == 1000
    doubled = spark.read.parquet(f"{tmp_path}/t")
    both = with_row_key(doubled.unionByName(doubled)).select("row").distinct()
    assert both.count() == 2000


def text(rng, n, lines_=1):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) for _ in range(lines_))


def awkward_rows():
    rng = random.Random(8)
    base = [text(rng, 30, 4) for _ in range(12)]
    passage = text(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[1] + "\n" + text(rng, 5)), (102, base[2].upper()), (None, text(rng, 70)), (None, text(rng, 80)), (None, base[3])]
    rows += [(50, text(rng, 60) + "\n" + passage + "\n" + text(rng, 20)), (51, text(rng, 70) + " " + passage + " " + text(rng, 20)), (52, text(rng, 55) + " " + passage)]
    rows += [(60, text(rng, 90)), (60, text(rng, 95)), (61, text(rng, 20)), (62, None), (63, ""), (64, "a b c " * 40), (65, text(rng, 2000))]
    rows += [(70, text(rng, 60) + "\nAll rights reserved."), (71, text(rng, 60) + "\nall rights  reserved.\n"), (72, text(rng, 60) + "\r\nAll rights reserved.\t")]
    return rows


def test_run(spark, tmp_path):
    rows = awkward_rows()
    table = spark.createDataFrame([(d, t, "xx", "clash", len(t or "")) for d, t in rows], "doc_id bigint, text string, row string, doc string, n_chars bigint")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def kept(t):
        s = brute_statistics(t)
        return s[0] >= 50 and 100 * s[5] <= 50 * s[0]

    rows = sorted((r for r in rows if kept(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    gone = brute_dropped(rows)
    rows = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)) for k, (d, t) in enumerate(rows)]
    rows = [rows[i] for i in first_rows(rows)]
    library = Tokenizer.from_file(queries.TOKENIZER)
    assert len(rows) > 15 and {d for d, _ in rows} >= {None, 50, 51, 60, 65}
    # white space in a cut text is the stage's own, so words are compared, and tokens where nothing is cut
    want = Counter((d, len(library.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows if not next(n for (e, _, n, _) in brute_repeats(rows) if e == d))
    sizes = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert not want - sizes and sum(sizes.values()) == len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage_ in corpus_pipeline.STAGES:
        out = stage_(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_other_columns_of_any_name_are_kept(spark):
    rows = [(1, "one two three four five six", "a", "b", 1), (2, "one two three four five six", "c", "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, doc string, dropped int")
    assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == [rows[0], (2, "", "c", "d", 2)]
    assert list(map(tuple, shingles.one_of_each(docs).collect())) == [rows[0]]
