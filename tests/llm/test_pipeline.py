"""Each stage of the pipeline against plain versions, on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from strataweave.llm import quality, queries
from strataweave.llm.common import stage
from test_against_brute_force import SF, brute_dropped, brute_repeats, brute_statistics, pairs
from test_near_copies import first_rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    judged = quality.judge(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()
    good = stage(steps["quality rules"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["id"] for r in judged)
    for _, t in pairs(good):
        s = brute_statistics(t)
        assert s[0] >= 50 and 100 * s[5] <= 50 * s[0]

    lined = stage(steps["line dedup"](spark, good, SF), "t")
    assert lined.columns == docs.columns and lined.count() == good.count()
    before = sorted(pairs(good))
    gone = brute_dropped(before)
    assert Counter(pairs(lined)) == Counter((d, "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)) for k, (d, t) in enumerate(before))

    single = stage(steps["simhash near-dedup"](spark, lined, SF), "t")
    rows = sorted(pairs(lined))
    assert Counter(pairs(single)) == Counter(rows[i] for i in first_rows(rows))

    cut = stage(steps["substring dedup"](spark, single, SF), "t")
    assert cut.columns == docs.columns
    assert Counter((d, " ".join(t.split())) for d, t in pairs(cut)) == Counter({(d, k): n for (d, _, _, k), n in brute_repeats(pairs(single)).items()})
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    library = Tokenizer.from_file(queries.TOKENIZER)
    packed = steps["packing"](spark, cut, SF).collect()
    sizes = Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in pairs(cut)})
