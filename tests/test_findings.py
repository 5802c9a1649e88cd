"""Cases that the test data of small size do not hold, each against the query's own SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from oracle import DATA, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork import session
from loomwork.functions import script as sc
from loomwork.llm import simhash, tokenfile
from loomwork.operators import corpus, grammar, sentence_rules
from loomwork.operators import fingerprints as fp
from loomwork.operators import tagging
from loomwork.plans import files, statistics
from loomwork.plans import grammar as grammar_plans

DOCUMENT = "doc_id long, text string"


@pytest.fixture
def agrees(spark, tmp_path):
    """Compares a query with its SQL over given tables, each (rows, schema)."""

    def run(name: str, **tables) -> None:
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for table, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        out = con.sql(entry.oracle_sql()[name])
        wanted = rows(out.columns, out.fetchall())
        assert wanted and rows(df.columns, df.collect()) == wanted

    return run


def test_term_taken_back_by_one_document_stays_by_another(agrees):
    texts = [(15, "zebra"), (30, "zebra"), (5, "zebra one two"), (25, "zebra"), (10, "lone here"), (45, "gone"), (7, "over there two")]
    agrees("terminology_file", documents=(texts, DOCUMENT))


def test_entries_become_distinct_before_they_become_one_row(spark, tmp_path, monkeypatch):
    told = []
    monkeypatch.setattr(files, "_json", lambda spark, name, row: told.append(row))
    spark.createDataFrame([(k, f"a{'b' * k} c") for k in range(9)], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    files._entries_file(spark, str(tmp_path))
    assert "array_distinct" not in told[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["vowel_variants", "letter_variants", "omitted_particles", "contextual_rules", "malapropisms", "spelling_findings"])
def test_words_meet_small_tables_without_a_shuffle(spark, name):
    """In one pass over the documents, behind those that made the tables."""
    plan = entry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("documents.parquet") == 1


def test_a_long_text_is_indexed_in_chunks_and_counted(spark):
    """The SQL of ``index_build_stats`` leaves such texts out; the statistics hold them, chunk by chunk."""
    text = "\n".join(f"line {k} of {k * k}" for k in range(9000))
    docs = spark.createDataFrame([(1, text), (2, "a short text")], DOCUMENT)
    none = spark.createDataFrame([], "doc_id string, parent_id string")
    stats = fp.build(docs, none, "doc_id")[1].first()
    parts = [text[a:b] for a, b in fp.pack_lines(text, fp.CHUNK)] + ["a short text"]
    assert len(parts) > 2 and stats["total_fingerprints"] == sum(len(set(fp.prints(p)[0].tolist())) for p in parts)


def test_token_codes_round_trip_and_stay_small():
    """Lengths are bytes, not long integers: they are made for every token."""
    sizes = np.array([0, 1, 2, 3, 4, 5, 0, 9])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for top in (200, 60_000, 1 << 20, 1 << 31):
        ranks = (np.arange(ends[-1]) * 7919 % 97 * (top // 97)).astype(np.uint32)
        control, control_ends, data, data_ends = tokenfile.code(ranks, ends)
        assert np.array_equal(tokenfile.uncode(control, control_ends, data, sizes), ranks) and data_ends[-1] == len(data)
    assert tokenfile.LENGTHS.dtype == np.uint8


def test_no_side_of_a_fingerprint_join_goes_to_the_driver(spark):
    """Entries are many times the fingerprints that the optimizer's estimate counts."""
    prints = spark.range(300).select(F.col("id").alias("fp"))
    for crowd in (2, 1000):
        plan = simhash.near_links(prints, crowd=crowd)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan


def test_fingerprints_are_summed_up_in_their_row(spark):
    """Only ids are shuffled; rows that share an id count together."""
    rows_ = [(1, "a text of some length"), (2, "another text, the other"), (2, "a text of some length"), (None, "no id, yet a text"), (None, "no id, another text"), (3, "tiny"), (4, None)]
    docs = spark.createDataFrame(rows_, DOCUMENT)
    wanted = fp.fingerprints(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*"), F.count_distinct("hash"), F.min("hash"), F.sum("pos"))
    assert sorted(map(str, fp.summaries(docs, "doc_id", "text").collect())) == sorted(map(str, wanted.toDF("doc_id", "n_prints", "n_hashes", "least_hash", "positions").collect()))
    plan = entry.queries()["fingerprint_documents"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan


def test_whatever_reads_a_table_has_bounded_batches(spark, monkeypatch):
    """Also in a session that nothing else has prepared."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(session.ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(session.ARROW_BYTES)}
    for key in bounds:
        spark.conf.unset(key)
    try:
        entry.queries()["syllable_spans"](spark, f"{DATA}/sf0.001")
        assert {key: spark.conf.get(key) for key in bounds} == bounds
    finally:
        session.prepare(spark)


@pytest.mark.parametrize("name", ["bigram_scores", "trigram_scores"])
def test_texts_are_cut_into_syllables_once(spark, monkeypatch, agrees, name):
    """All counts follow from one table, also of texts shorter than an n-gram."""
    made = []
    monkeypatch.setattr(statistics.corpus, "with_syllables", lambda df, f=corpus.with_syllables: made.append(1) or f(df))
    agrees(name, documents=([(1, "a b a b c"), (2, "a"), (3, "a b"), (4, " . "), (5, None), (6, "c a b")], DOCUMENT))
    assert made == [1]


def test_syllables_and_sentences_equal_their_patterns(spark):
    """Every delimiter, alone, in runs and at the ends; supplementary characters; nothing at all."""
    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    between = sc.TSHEGS + sc.SHADS + white
    assert set(white) == set(sc.WHITE_CHARS)
    texts = [*(f"{c}ཀ{c}{c}ཁ \U00010000{c}" for c in between), f"a{between}b", between, "", "ཀ།།ཁ\n།\x1fག༔ ", None]
    rows_ = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", sc.syllables(F.col("t")), sc.sentences(F.col("t"))).collect()
    for k, syllables, sentences in rows_:
        t = texts[k]
        assert syllables == (None if t is None else re.findall(f"[^{between}]+", t))
        told = None if t is None else [m.strip(white) for m in re.findall(f"[^{sc.SHADS}\n\r\x0b\f\x85  ]+[{sc.SHADS}]*", t)]
        assert sentences == (told and [m for m in told if m.strip(sc.SHADS + white)] if told is not None else None)


def test_syllables_are_made_once_for_each_text(spark):
    """Not again in the filter that an explosion brings along, and no pattern is tried at every character."""
    plan = entry.queries()["suspicious_words"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "size(array_remove" not in plan


def test_tags_are_trained_without_an_order_and_one_path_is_not_searched(spark):
    """Neighbours stand in the rows; where each word has one tag there is nothing to compare."""
    told = spark.createDataFrame([(1, 0, "a", "n.", None), (1, 1, "b", "v.", "n."), (2, 0, "a", "v.", None), (2, 1, "a", "n.", "v.")], "s long, pos long, surface string, tag string, before string")
    one, two = tagging.train(told, ["s"]), tagging.train(told, before="before")
    assert all(sorted(map(tuple, one[k].collect())) == sorted(map(tuple, two[k].collect())) for k in one)
    assert "Window" not in two["transitions"]._jdf.queryExecution().optimizedPlan().toString()
    model = tagging.Viterbi([("<s>", "n.", 1), ("n.", "v.", 1)], [("n.", 1), ("v.", 1)])
    model.step = {}  # not asked
    assert model.decode([{"n.": 1}, {"v.": 2}]) == ["n.", "v."] and model.decode([]) == []


NODES = "array<struct<text:string,start:int,end:int,category:string,relation:string>>"


def random_sentences(n: int) -> list[tuple]:
    """Words of all rules with marks about them, and nulls wherever one can stand."""
    pick = random.Random(7)
    words = [*grammar_plans.RULE_WORDS, "ཆོས་སྒོར་", "ང", "བོད", "ཡིན", "", "་", "། ", "ངས", "མདའ", "བྱའི", "པཱ", "x", "ངའ", "ན\U00010000ག"]
    marked = lambda: pick.choice(["", "", "", "་", " "]) + pick.choice(words) + pick.choice(["", "", "", "་", "།", "་ །"])
    maybe = lambda x, share=0.03: None if pick.random() < share else x
    out = []
    for k in range(n):
        nodes = []
        for i in range(pick.choice([0, 1, 2, 5, 12, 12, 30])):
            w = nodes[-1][0] if nodes and nodes[-1] and pick.random() < 0.1 else marked()
            nodes.append(maybe((maybe(w), maybe(i * 9), maybe(i * 9 + 5), pick.choice(grammar_plans.CATEGORIES), pick.choice([*grammar_plans.RELATIONS, "obj", "object", None]))))
        text = "་".join(x[0] or "" for x in nodes if x) + pick.choice(["", "།", "ཁྱེད་", "བྱུང་", "ཞེས"])
        out.append((maybe(k), maybe(k * 1000), maybe(text), maybe(nodes)))
    return out


@pytest.mark.parametrize("config", [None, {"TIB-SOV-001": False, "TIB-PART-001": {"confidence_baseline": 0.25}}, {"TIB-PART-001": False, "TIB-HONOR-001": False}])
def test_rules_over_batches_equal_the_rules_of_one_node(spark, config):
    """Also with nulls anywhere; with and without the rule that must be asked for."""
    told = spark.createDataFrame(random_sentences(1500), f"doc_id long, sent_start int, text string, nodes {NODES}").withColumn("sent_idx", F.lit(0))
    for demonyms in (True, False):
        one = sentence_rules.findings(told, grammar.Registry(config), "s", demonyms)
        two = grammar.findings(grammar.neighbours(told), grammar.Registry(config), "s", demonyms)
        assert one.columns == two.columns and [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
        found, wanted = rows(one.columns, one.collect()), rows(two.columns, two.collect())
        assert found == wanted and len({r[5] for r in wanted}) > 2


def test_grammar_rules_lay_no_node_apart(spark, agrees):
    """Nothing is done node by node, and the SQL's rows come out: capitals, other letters, texts of many batches or of no word."""
    pick = random.Random(3)
    long = " ".join("".join(pick.choices("abcdefghij", k=pick.randint(1, 9))) for _ in range(12 * 4096 + 30))
    texts = [long, None, "", " .1", "A", "Kelvin \u212aelvin aé\u0301b z-z\x00q", "of the of the cat", "x" * 5000, "ab\ncd ab\tcd", "one two three four five six seven eight nine ten eleven twelve"]
    agrees("grammar_rules", documents=([(k, t) for k, t in enumerate(texts)], DOCUMENT))
    plan = entry.queries()["grammar_rules"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "transform(" not in plan


def test_objects_behind_roots_are_told_in_bounded_batches(spark):
    """A sentence has as many findings as it has pairs."""
    nodes = [(f"w{i}", i, i + 1, None, "root" if i < 700 else "obj") for i in range(1400)]
    batch = spark.createDataFrame([(1, 0, "", nodes)], f"doc_id long, sent_start int, text string, nodes {NODES}").toArrow().to_batches()[0]
    sizes = [b.num_rows for b in sentence_rules._found([batch], {"TIB-SOV-001": 0.5}, False)]
    assert sum(sizes) == 700 * 700 and max(sizes) <= sentence_rules.PAIRS
