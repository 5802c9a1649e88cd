"""Counts of n-grams at places, asked by blocks from buckets."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import corpus, correction, places, spelling
from loomwork.plans import catalog, correcting, statistics  # noqa: F401
from loomwork.plans.common import script_documents

SF = os.environ.get("LOOMWORK_TESTDATA", "/root/testdata") + "/sf0.001"


def texts(spark):
    said = ["a b c a b c a b", "b a b  c", " ", "c", "a b c d e f g a b c", None, "x\ty", "a་b།c"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string").repartition(6, "doc_id")


def test_many_blocks_count_together(spark):
    table = places.blocks(texts(spark), size=3)
    assert table.count() > 2
    said, buckets, totals = places.answers(table)

    def tell(block, counts, first, keys):
        c = places.neighbours(block, counts)
        doc = np.repeat(np.array(keys.to_pylist()), block.sizes)
        yield from places.batches_of({"doc_id": places.pa.array(doc), **{k: places.pa.array(v) for k, v in c.items()}}, schema)

    names = ("word", "left", "lw", "wr", "ll", "llw")
    schema = places.pa.schema([(c, places.pa.int64()) for c in ("doc_id", *names)])
    out = Counter(tuple(r) for r in places.over_blocks(table, said, buckets, tell, ", ".join(f"{c} long" for c in ("doc_id", *names))).collect())

    words = {r["doc_id"]: (r["text"] or "").replace("་", " ").replace("།", " ").split() for r in texts(spark).collect()}
    n = Counter(tuple(w[i : i + k]) for w in words.values() for k in (1, 2, 3) for i in range(len(w) - k + 1))
    wanted = Counter()
    for d, w in words.items():
        for i in range(len(w)):
            of = lambda a, b, w=w: n[tuple(w[a:b])] if a >= 0 and b <= len(w) else -1
            wanted[(d, of(i, i + 1), of(i - 1, i), of(i - 1, i + 1), of(i, i + 2), of(i - 2, i), of(i - 2, i + 1))] += 1
    assert out == wanted
    assert totals == {"total": sum(map(len, words.values())), "kinds": len({x for w in words.values() for x in w}), "most": max(v for k, v in n.items() if len(k) == 1)}


@pytest.mark.parametrize("name", ["suspicious_words", "context_bonus", "trigram_scores", "context_findings"])
def test_no_ngram_is_shuffled_as_text(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("ngram" in line or "concat" in line or "left2" in line for line in moved), moved


def test_context_findings_by_definition(spark):
    rows = corpus.with_syllables(script_documents(spark, SF))
    one, two, three = (corpus.ngrams(rows, n) for n in (1, 2, 3))
    nodes = corpus.places(rows).withColumns({"char_start": F.col("pos"), "char_end": F.col("pos") + 1})
    judged = one.select(F.col("ngram").alias("word"), F.lit("known").alias("verdict"))
    often = one.where("n >= 200").select(F.col("ngram").alias("word"))
    best = correction.same_start(judged, often, 1).groupBy("query").agg(F.min("word").alias("candidate")).select(F.col("query").alias("word"), "candidate", F.lit(True).alias("safe"))
    wanted = Counter(tuple(r) for r in spelling.context_findings(nodes, judged, one, two, three, best, gap=4.5).collect())
    found = Counter(tuple(r) for r in catalog.queries()["context_findings"](spark, SF).collect())
    assert wanted and found == wanted


def test_pipes_hold_all_numbers():
    x = np.array([0, 1, 255, 1 << 40, (1 << 60) - 1], np.uint64)
    keys, times, words = places.read_asked(places.asked(x, np.array([1, 2, 3, 4, 1 << 31]), np.array([True, False, False, True, False])))
    assert keys.tolist() == x.tolist() and times.tolist() == [1, 2, 3, 4, 1 << 31] and words.tolist() == [True, False, False, True, False]
