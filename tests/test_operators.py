"""Operators on small inputs with known results."""

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwork.functions import script as sc
from loomwork.functions import spans
from loomwork.operators import contextual, correction, corpus, fingerprints, fusion, grammar, lexicon, metrics, models, morphology, plugins, rules, snapshot, spelling, syntax, synthetic, tagging, wordpieces
from loomwork.sources import tables


def value(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("", []), ("  ", []), ("\n\n", []), ("།", []), ("།།།", []), ("  ། ། ", []), ("ཀ་ཁ།ག།། ང", ["ཀ་ཁ།", "ག།།", "ང"]), ("a\r\nb", ["a", "b"]), ("།ཀ", ["ཀ"])],
)
def test_sentences(spark, text, wanted):
    assert value(spark, sc.sentences(F.col("t")), t=text) == wanted


def test_text_functions(spark):
    t = F.col("t")
    assert value(spark, sc.tidy(t), t="ཀ་་༌ཁ །། ག") == "ཀ་ཁ།ག"
    assert value(spark, sc.squeeze_space(t), t=" a　\xa0b\n") == "a b"
    assert value(spark, sc.normalize(t), t="é​\x07 x") == "é x"
    assert value(spark, sc.script_ratio(t), t="") == 0.0
    assert value(spark, sc.script_ratio(t), t="ཀa") == 0.5
    assert value(spark, sc.syllables(t), t="ཀ་ཁ༌ག། ང") == ["ཀ", "ཁ", "ག", "ང"]
    assert value(spark, sc.byte_offset(t, F.lit(2)), t="aཀb") == 4
    assert value(spark, sc.vowel_before_consonant(t), t="ཀངི") == "ཀིང"
    assert value(spark, sc.occurrences_before(t, "aa", F.lit(3)), t="aaaa") == 3
    assert [value(spark, sc.final_consonant(t), t=x) for x in ("བོད", "ཀ", "དགའ", "བོད་ཡིག", "བློ")] == ["ད", "open", "འ", "ག", "open"]


def brute_prints(text, k=6, w=4):
    text = unicodedata.normalize("NFC", (text or "").strip())
    hashes = [sum(ord(c) * 131 ** (k - 1 - j) for j, c in enumerate(text[i : i + k])) % 2**64 for i in range(len(text) - k + 1)]
    if not hashes:
        return set()
    w = min(w, len(hashes))
    kept = {min((hashes[i + j], i + j) for j in range(w)) for i in range(len(hashes) - w + 1)}
    return {(h - 2**64 * (h >> 63), p) for h, p in kept}


@pytest.mark.parametrize(("k", "w"), [(6, 4), (2, 1), (7, 5), (30, 3), (100, 50)])
def test_fingerprints_equal_the_definition(spark, k, w, monkeypatch):
    texts = [None, "", "abc", "abcdef", " abc\n\tdef  g ", "aaaaaaaaaaaaaaaa", "The quick brown fox jumps over the lazy dog", "ཀ་ཁ་ག་ང་ཅ་ཆ་ཇ་ཉ " * 14, "e\u0301\U0001f600" * 90]
    wanted = {i: v for i, v in ((i, brute_prints(t, k, w)) for i, t in enumerate(texts)) if v}
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    made = {i: {(int(h) - 2**64 * (int(h) >> 63), int(p)) for h, p in zip(*fingerprints.prints(t, k, w), strict=True)} for i, t in enumerate(texts)}
    assert {i: v for i, v in made.items() if v} == wanted
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for r in fingerprints.fingerprints(df, "id", "text", k, w).collect():
        found.setdefault(r["id"], set()).add((r["hash"], r["pos"]))
    assert found == wanted
    for r in fingerprints.index_entries(df, "id", "text", k, w).collect():
        places = [p for h, p in wanted[r["id"]] if h == r["hash"]]
        assert (r["pos"], r["last"], r["total"]) == (min(places), max(places), len({h for h, _ in wanted[r["id"]]}))


def test_index_upkeep(spark):
    old = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "doc_id long, hash long")
    new = spark.createDataFrame([(2, 21), (3, 30), (3, 30)], "doc_id long, hash long")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "hash").collect()))
    assert rows(fingerprints.upsert(old, new, "doc_id")) == [(1, 10), (1, 11), (2, 21), (3, 30)]
    assert rows(fingerprints.add_missing(old, new, "doc_id")) == [(1, 10), (1, 11), (2, 20), (3, 30), (3, 30)]
    assert rows(fingerprints.remove(old, new, "doc_id")) == [(1, 10), (1, 11)]


def test_ngrams_cross_sentences_not_documents(spark):
    df = corpus.with_syllables(spark.createDataFrame([("ཀ་ཁ།ག",), ("ཀ་ཁ",), (None,), ("",)], "text string"))
    assert {r["ngram"]: r["n"] for r in corpus.ngrams(df, 2).collect()} == {"ཀ ཁ": 2, "ཁ ག": 1}
    assert corpus.statistics(spark.createDataFrame([(None,)], "text string")).first()["type_token_ratio"] == 0.0


def brute_aligned(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_aligned_distance():
    for a, b in itertools.product(["", "a", "ab", "ba", "ca", "abc", "acb", "abcd"], repeat=2):
        assert correction.aligned_distance(list(a), list(b)) == brute_aligned(a, b)
    assert correction.aligned_distance(list("ca"), list("abc")) == 3
    assert correction.graphemes("བོད") == ["བོ", "ད"]


def test_structure():
    cases = {"བོད": None, "བདག": None, "ཀཀཀ": "GIBBERISH", "ཀིུ": "DOUBLE_VOWEL", "ཀཁགངཅཆ": "TOO_MANY_CONSONANTS", "ཞཀ": "INVALID_PREFIX", "བོངཀ": "INVALID_POST_SUFFIX", "བསྒྲུབས": None, "རྒྱུ": None}
    assert {w: morphology.violation(w) for w in cases} == cases
    assert morphology.repaired("ཀིུ") == "ཀི་"


def test_morphemes(spark):
    found = lambda w: [(m["kind"], m["text"]) for m in value(spark, morphology.morphemes(F.col("t")), t=w)]
    assert found("གི") == [("affix", "གི")]
    assert found("དེ") == [("ambiguous", "དེ")]
    assert found("པའི") == [("root", "པ"), ("affix", "འི")]
    assert found("བོད") == [("root", "བོད")]
    best = value(spark, morphology.stems(F.col("t"), [("པས", "agentive", 2, 0.9), ("ས", "agentive", 1, 0.8)]), t="བྱེདཔས")
    assert [(s["stem"], s["confidence"]) for s in best] == [("བྱེད", 0.9), ("བྱེདཔ", 0.8), ("བྱེདཔས", 0.3)]


def test_viterbi_equals_exhaustive_search():
    emissions = [("a", "X", 3), ("a", "Y", 1), ("b", "Y", 4), ("c", "X", 1)]
    transitions = [("<s>", "X", 3), ("X", "Y", 3), ("Y", "X", 1)]
    model = tagging.Viterbi(transitions, [("X", 4), ("Y", 5)])
    known = {}
    for word, tag, n in emissions:
        known.setdefault(word, {})[tag] = n
    for n in range(1, 5):
        for words in itertools.product("abz", repeat=n):

            def score(tags, words=words):
                total, before = 0.0, "<s>"
                for w, t in zip(words, tags, strict=True):
                    total += model.step[before, t] + model.emission(t, known.get(w, {}).get(t, 0))
                    before = t
                return total

            best = max(score(t) for t in itertools.product(*(model.candidates(known.get(w, {}), None) for w in words)))
            assert score(model.decode([known.get(w, {}) for w in words])) == pytest.approx(best)
    assert model.decode([]) == []
    cased = tagging.Viterbi([("<s>", "case.gen", 1)], [("case.gen", 1), ("n.count", 5)])
    assert cased.candidates({}, ["genitive"]) == ["case.gen"] and cased.candidates({}, ["final"]) == ["case.gen", "n.count"]


def test_tagging_and_names_by_broadcast_or_join(spark):
    words = [["a", "b", "z"], [], ["z", "a"], None, ["a", "b", "c", "a", "b"]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, words array<string>")
    rows = lambda items, schema: spark.createDataFrame(items, schema)
    model = {
        "emissions": rows([("a", "n.prop", 3), ("a", "v.past", 1), ("b", "n.prop", 4), ("c", "v.past", 1)], "surface string, tag string, n long"),
        "transitions": rows([("<s>", "n.prop", 3), ("n.prop", "v.past", 3), ("v.past", "n.prop", 1)], "prev string, tag string, n long"), "tag_counts": rows([("n.prop", 7), ("v.past", 2)], "tag string, n long"),
    }
    entries = rows([(["a", "b"], "plain"), (["c"], "ambiguous"), (["z"], "plain")], "syllables array<string>, tier string")
    out = []
    for told in (100, 0):
        tagged = tagging.tag_sentences(df, model, "words", told=told)
        named = syntax.recognize(syntax.recognize(tagged, entries, "words", "tags", told=told), entries, "words", out="terms", least=1, told=told)
        out.append({r["k"]: (r["tags"], r["runs"], r["terms"]) for r in named.collect()})
    assert out[0] == out[1] and len(out[0]) == 5


def test_dependencies_are_trees():
    tags = ["n.count", "case.gen", "n.count", "case.agn", "adj", "v.past", "n.prop", "neg", "punc", "cv.sem", "d.dem"]
    for n in range(len(tags) + 1):
        for some in itertools.islice(itertools.permutations(tags, n), 200):
            tree = syntax.dependencies(list(some))
            assert sum(h == -1 for h, _ in tree) == bool(some)
            for i in range(len(tree)):
                seen = set()
                while i != -1:
                    assert i not in seen
                    seen.add(i)
                    i = tree[i][0]
    assert syntax.dependencies(["n.count", "case.agn", "n.count", "v.past"]) == [(3, "arg1"), (0, "case"), (3, "arg2"), (-1, "root")]
    assert syntax.dependencies(["n.count", "case.gen", "n.count", "v.past"]) == [(2, "nmod_poss"), (0, "case"), (3, "arg1"), (-1, "root")]


def test_names_and_graph():
    words, entries = ["a", "b", "c", "d"], {("a", "b"), ("a",), ("c",)}
    assert syntax.longest_matches(words, entries, 2) == [(0, 2), (2, 3)]
    assert syntax.names(["x", "a", "y"], ["n.prop", "n.count", "n.prop"], {("a",)}, set(), 1) == [(0, 1, "tagger"), (1, 2, "gazetteer"), (2, 3, "tagger")]
    tags = ["n.count", "case.agn", "n.count", "v.past"]
    nodes, edges = syntax.semantic_graph(tags, syntax.dependencies(tags), [], {3: True})
    assert [n[3] for n in nodes] == ["concept", "concept", "predicate"]
    assert edges == [(2, 0, "agent", "case"), (2, 1, "patient", "lexicon")]


SCHEMA = "doc_id long, source string, char_start long, char_end long, replacement string, score double, priority string, message string, error_type string"


def test_fusion_is_greedy_and_independent_of_order(spark):
    rows = [
        (1, "a", 0, 4, "X", 0.9, "HIGH", "m", "e"), (1, "b", 2, 6, "Y", 0.5, "HIGH", "m", "e"), (1, "b", 6, 8, "Z", 0.4, "LOW", "m", "e"),
        (1, "c", 4, 6, "W", 0.3, "LOW", "m", "e"), (1, "c", 0, 9, None, 0.3, "LOW", "advice", "e"), (1, "c", 50, 60, "Q", 0.3, "LOW", "m", "e"), (1, "a", 0, 4, "X", 0.8, "HIGH", "m", "e"),
    ]
    texts = spark.createDataFrame([(1, "0123456789"), (2, "abc")], "doc_id long, text string")
    for order in (rows, rows[::-1]):
        valid = fusion.validated(spark.createDataFrame(order, SCHEMA), texts).withColumn("confidence", fusion.confidence())
        assert {r["rejection"]: r["count"] for r in valid.groupBy("rejection").count().collect()} == {None: 5, "INVALID_RANGE": 1, "DUPLICATE": 1}
        done = fusion.resolved(valid)
        assert {r["replacement"]: r["rejection"] for r in done.collect()} == {"X": None, "Y": "SUPERSEDED", "Z": None, "W": None, None: None}
        merged = fusion.merged(done.where("rejection is null and replacement is not null"))
        assert [tuple(r) for r in merged.collect()] == [(1, 0, 8, "XWZ", "a+c+b")]
        assert {r["doc_id"]: r["text"] for r in fusion.applied(texts, merged).collect()} == {1: "XWZ89", 2: "abc"}


def test_plugins_are_isolated(spark):
    docs = spark.createDataFrame([(1, "ཀ་་ཁ")], "doc_id long, text string")

    def broken(df):
        raise RuntimeError("no model")

    out = plugins.dispatch(docs, {"typo": rules.typography, "broken": broken, "shape": lambda df: df})
    assert [(r["char_start"], r["char_end"], r["replacement"]) for r in out.findings.collect()] == [(1, 3, "་")]
    assert sorted(out.failures) == ["broken", "shape"]
    assert out.failures["broken"].startswith("EXECUTION_FAILED") and out.failures["shape"].startswith("CONTRACT")


def test_faults_while_a_plugin_runs_and_time_limits(spark):
    docs = spark.createDataFrame([(1, "ཀ་་ཁ")], "doc_id long, text string")

    def failing(df):
        @F.udf("string")
        def fail(x):
            raise KeyError(x)

        return rules.typography(df).withColumn("message", fail("message"))

    def slow(df):
        @F.udf("string")
        def wait(x):
            import time

            time.sleep(60)
            return x

        return rules.typography(df).withColumn("message", wait("message"))

    out = plugins.dispatch(docs, {"typo": rules.typography, "failing": failing, "slow": slow}, timeout=20)
    assert out.findings.count() == 1 and set(out.failures) == {"failing", "slow"}
    assert out.failures["failing"].startswith("EXECUTION_FAILED") and out.failures["slow"].startswith("TIMEOUT")


def test_models(spark):
    up = models.Model("up", "grammar", "9", lambda: str.upper, lambda f, xs: [f(x) for x in xs], 10)
    registry = models.Registry()
    registry.register(up)
    registry.register(models.Model("z", "grammar", "10", dict, list, 10))
    assert registry.resolve("grammar").key == "up" and registry.resolve("grammar", "z").key == "z"
    with pytest.raises(LookupError):
        registry.resolve("ocr")
    assert plugins.newest(registry.table(spark)).collect()[0]["key"] == "up"
    held = models.Residency(25)
    for key in "abca":
        held.get(models.Model(key, "ocr", "1", object, list, 10))
    assert list(held.held) == ["c", "a"]
    df = spark.createDataFrame([(1, 0, 5, "abcde"), (2, 0, 5, "ABCDE"), (3, 0, 2, "ab"), (4, 0, 0, None)], "doc_id long, char_start long, char_end long, text string")
    assert {r["doc_id"]: r["corrected"] for r in models.rewritten(df, up.__class__(**{**up.__dict__, "infer": lambda f, xs: [x and f(x) for x in xs]})).collect()} == {1: "ABCDE", 2: "ABCDE", 3: "AB", 4: None}
    assert [r["replacement"] for r in models.rewriting_findings(df.where("doc_id < 4"), up).collect()] == ["ABCDE"]
    assert models.rewriting_findings(df, None).count() == 0
    broken = models.infer(df, models.Model("bad", "ocr", "1", dict, lambda m, xs: 1 / 0), "text", "out").collect()
    assert all(r["out"] is None and "ZeroDivisionError" in r["out_fault"] for r in broken)
    asked = spark.createDataFrame([("abc", 1, 2, "x"), ("abc", 1, 2, ""), ("abc", 1, 2, "yy")], "sentence string, char_start long, char_end long, candidate string")
    pieces = models.Model("m", "spelling", "1", dict, lambda m, xs: [[None if c == "y" else -2.0 for c in x["candidate"]] for x in xs])
    assert {r["candidate"]: r["score"] for r in models.masked_scores(asked, pieces).collect()} == {"x": pytest.approx(0.8), "": 0.0, "yy": 0.0}


def test_incremental_equals_cold(spark):
    stage = lambda rows: rows.select("hash", F.char_length("sentence").alias("n"))
    one = spark.createDataFrame([(1, "ཀ། ཁ། ཀ།")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "ཀ། ག། ཀ།")], "doc_id long, text string")
    known = snapshot.analyze(snapshot.sentence_rows(one), stage)
    whole, new = snapshot.reanalyze(snapshot.sentence_rows(two), known, stage)
    assert new.count() == 1
    cold = snapshot.sentence_rows(two).join(snapshot.analyze(snapshot.sentence_rows(two), stage), "hash")
    key = lambda df: sorted((r["sent_idx"], r["n"]) for r in df.collect())
    assert key(whole) == key(cold)


def plain_distance(a, b):
    return max(len(a), len(b)) if not a or not b else min(plain_distance(a[1:], b) + 1, plain_distance(a, b[1:]) + 1, plain_distance(a[1:], b[1:]) + (a[0] != b[0]))


def plain_subsequence(a, b):
    return 0 if not a or not b else max(plain_subsequence(a[1:], b), plain_subsequence(a, b[1:]), plain_subsequence(a[1:], b[1:]) + 1 if a[0] == b[0] else 0)


def test_wordpieces_synthetic_and_scores(spark):
    assert wordpieces.pieces("unwanted", {"un", "##want", "##ed"}) == ["un", "##want", "##ed"]
    assert wordpieces.pieces("xyz", {"x"}) == ["[UNK]"]
    assert wordpieces.joined(["un", "##want", "##ed", "x"]) == "unwanted x"
    docs = spark.createDataFrame([(1, "ཀ་ཁ་ག"), (2, "abcdefg"), (3, "abc"), (4, None)], "id long, text string")
    out = synthetic.inject(docs, "id", "text").collect()
    assert {r["id"] for r in out} == {1, 2} and all(r["original_text"] != r["corrupted_text"] for r in out)
    perfect = metrics.text_scores("a b", "a b c d", "a b c d")
    assert perfect["cer"] == perfect["wer"] == 0 and perfect["rouge_l"] == perfect["chrf"] == 1 and perfect["bleu"] == pytest.approx(1)
    assert metrics.text_scores("x", "abc", "ab")["cer"] == pytest.approx(1 / 3) and metrics.text_scores("x", "abc", "ab")["rouge_l"] == pytest.approx(0.8)
    for a, b in itertools.product(["", "a", "ab", "ba", "abcab", "bca"], repeat=2):
        assert metrics.edits(list(a), list(b)) == plain_distance(a, b) and metrics.subsequence(list(a), list(b)) == plain_subsequence(a, b)


def test_sources(spark, tmp_path):
    model = {"tags": ["X"], "tag_counts": {"X": 2}, "emissions": {"a": {"X": 2}}, "transitions": {"<s>": {"X": 2}}}
    import json

    path = tmp_path / "model.json"
    path.write_text(json.dumps(model))
    assert tables.read_tag_model(spark, str(path))["emissions"].first().asDict() == {"surface": "a", "tag": "X", "n": 2}
    (tmp_path / "bad.json").write_text(json.dumps({"tags": []}))
    with pytest.raises(ValueError, match="lacks"):
        tables.read_tag_model(spark, str(tmp_path / "bad.json"))
    (tmp_path / "gaz.json").write_text(json.dumps({"entries": [["a", "b"]], "ambiguous_entries": [["c"]]}))
    assert {(tuple(r["syllables"]), r["tier"]) for r in tables.read_entries(spark, str(tmp_path / "gaz.json")).collect()} == {(("a", "b"), "plain"), (("c",), "ambiguous")}
    (tmp_path / "gold.txt").write_text("a|X b|Y|z\n")
    assert [(r["surface"], r["tag"]) for r in tables.read_tagged(spark, str(tmp_path / "gold.txt")).collect()] == [("a", "X"), ("b", "Y|z")]
    spark.createDataFrame([("x", "", "t1"), ("y", "c", None)], "id string, collection string, text string").write.parquet(str(tmp_path / "corpus"))
    assert [(r["id"], r["collection"]) for r in tables.read_corpus(spark, str(tmp_path / "corpus")).collect()] == [("x", None)]


def test_streaming_index_is_resumable(spark, tmp_path):
    from loomwork.streaming import jobs

    source, index, mark = (str(tmp_path / x) for x in ("in", "index", "mark"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "the quick brown fox"), (2, "jumps over it all")], schema).write.parquet(source)
    for _ in range(2):
        jobs.index_documents(spark.readStream.schema(schema).parquet(source), index, mark).awaitTermination()
    n = spark.read.parquet(index).count()
    spark.createDataFrame([(1, "the quick brown fox"), (3, "another text here")], schema).write.mode("append").parquet(source)
    jobs.index_documents(spark.readStream.schema(schema).parquet(source), index, mark).awaitTermination()
    found = spark.read.parquet(index)
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == {1, 2, 3}
    assert found.where("doc_id < 3").count() == n


def test_line_chunks(spark):
    assert fingerprints.pack_lines("", 4) == [(0, 0)]
    assert fingerprints.pack_lines("ab\ncd\nefghijkl\nm", 5) == [(0, 2), (3, 5), (6, 11), (11, 14), (15, 16)]
    assert fingerprints.pack_lines("ab\nc\nefghijkl\nm", 5) == [(0, 4), (5, 10), (10, 13), (14, 15)]
    rows = fingerprints.line_chunks(spark.createDataFrame([(1, "ab\ncd"), (2, "abcdef"), (3, None)], "doc_id long, text string"), "doc_id", "text", 5).collect()
    assert [(r["chunk_id"], r["text"]) for r in rows] == [("1", "ab\ncd"), ("2#chunk_0", "abcde"), ("2#chunk_1", "f"), ("3", "")]


def brute_candidates(query, words, top=300, near=2):
    """What the provider's sources find within a distance, by definition."""
    grams = lambda w: [(w + correction.END)[k : k + 2] for k in range(len(w))]
    distance = lambda w: brute_aligned(correction.graphemes(query), correction.graphemes(w))
    shared = {w: sum(g in set(grams(w)) for g in grams(query)) for w in words if w != query}
    best = [w for w in sorted(shared, key=lambda w: (-shared[w], w)) if shared[w]][:top]
    found = {w: distance(w) for w in best} | {w: distance(w) for w in words if w != query and w[:1] == query[:1] and abs(len(w) - len(query)) <= 2}
    close = {w: d for w, d in found.items() if 0 < d <= near}
    return close or {w: d for w, d in ((w, distance(w)) for w in best) if 0 < d <= 3}


def test_provider_candidates_equal_the_definition(spark):
    words = ["abcd", "abdc", "acbd", "axcd", "bcd", "xyz", "xyw", "abc", "abcdefgh", "zzzz", "qq"]
    queries = ["abcd", "abxd", "zzyy", "xy", "bacd"]
    lexicon_table = spark.createDataFrame([(w,) for w in words], "word string")
    found = {}
    for r in correction.provider_candidates(spark.createDataFrame([(q,) for q in queries], "word string"), lexicon_table).collect():
        found.setdefault(r["query"], {})[r["word"]] = r["distance"]
    for q in queries:
        assert brute_candidates(q, words).items() <= found.get(q, {}).items()
        assert all(0 < d <= 3 for d in found.get(q, {}).values())
    split = correction.frequent_splits(spark.createDataFrame([("abcd",)], "word string"), spark.createDataFrame([("ab་",), ("cd",), ("cd་",)], "word string"))
    assert {r["word"] for r in split.collect()} == {"ab་cd", "ab་cd་"}
    pairs = correction.compound_candidates(spark.createDataFrame([("abc་xyw",)], "word string"), spark.createDataFrame([("abc",), ("abd",), ("xyz",)], "word string"))
    assert {(r["word"], r["distance"]) for r in pairs.collect()} == {("abc་xyz", 1), ("abd་xyz", 2)}


def test_dictionary_candidates_and_guards(spark):
    table = spark.createDataFrame([("བོད",), ("ཡིག",), ("བདེ",), ("ལེགས",)], "word string")
    asked = spark.createDataFrame([("བདོ་",), ("བདེལེགས",), ("",), ("ཡག",)], "word string")
    found = {}
    for r in correction.candidates(asked, table).collect():
        found.setdefault(r["query"], []).append(r["word"])
    assert "བོད་" in found["བདོ་"] and {"བདེ་ལེགས", "བདེ་ལེགས་"} <= set(found["བདེལེགས"]) and "ཡིག" in found["ཡག"]
    rows = spark.createDataFrame([("བདེལེགས", "བདེ་ལེགས", 0.85), ("ཡག", "ཡིག", 0.85), ("ཡག", "ཡིག", 0.5), ("ཡག", "abc", 0.9), ("ཀ", "ལེགས", 0.9), ("ཡག", "ཡུག", 0.9), ("ཡག", None, 0.9)], "w string, r string, c double")
    safe = {(r["w"], r["r"], r["c"]): r["safe"] for r in correction.guarded(rows, "w", "r", "c", table).collect()}
    assert [k for k, v in safe.items() if v] == [("བདེལེགས", "བདེ་ལེགས", 0.85)]  # one sign more in a word of two letters is a third of it


def test_lexicons(spark):
    rows = spark.createDataFrame([(1, ["བོད་", "ཆོས་སྒོར"]), (2, ["ཀ", "x"]), (3, ["ཆོས", "འཐུང"]), (4, ["ཆུ", "འཐུང"])], "k long, words array<string>")
    assert {(r["k"], r["word"]) for r in lexicon.malapropisms(rows, lexicon.collocations(spark)).collect()} == {(1, "བོད་"), (1, "ཆོས་སྒོར"), (3, "ཆོས"), (3, "འཐུང")}
    said = rows.select("k", lexicon.semantic_replacements(F.get("words", F.lit(0)), F.col("words")).alias("r")).collect()
    assert {r["k"]: r["r"] for r in said} == {1: ["བདག་"], 2: [], 3: ["ཆུ་"], 4: []}
    verbs = lexicon.verb_info(spark.createDataFrame([("ཞུས་",), ("x",)], "word string"), lexicon.verbs(spark)).collect()
    assert {r["word"]: (r["is_verb"], r["honorific"]) for r in verbs} == {"ཞུས་": (True, "HON"), "x": (False, None)}


def test_spans(spark):
    assert [s[:3] + s[5:] for s in spans.sentence_spans("  ། ཀ།། \n ཁ \nག")] == [("ཀ།།", 4, 7, "།།"), ("ཁ", 10, 11, ""), ("ག", 13, 14, "")]
    assert [s[:3] for s in spans.sentence_spans("ཀ\nཁ།", False)] == [("ཀ\nཁ།", 0, 4)]
    assert spans.syllable_spans("aཀ་ཁ།") == [("aཀ", 0, 2, 0, 4, True), ("ཁ", 3, 4, 7, 10, False)]
    for text in ("", " ", "།།", "\r\n", "\x00", "་་"):
        assert all(s[0].strip() for s in spans.sentence_spans(text)) and isinstance(spans.syllable_spans(text), list)


def test_rules_need_no_nodes(spark):
    empty = spark.createDataFrame([(1, 0, 0, "", [])], "doc_id long, sent_idx int, sent_start int, text string, nodes array<struct<text:string,start:int,end:int,category:string,relation:string>>")
    assert grammar.findings(grammar.neighbours(empty)).collect() == []
    none = spark.createDataFrame([(1, 0, 0, None), (2, 0, 0, ""), (3, 0, 0, "།")], "doc_id long, sent_idx int, sent_start int, text string")
    assert contextual.findings(none, spark.createDataFrame([], "wrong string, right string")).collect() == []


def test_spelling_findings_tell_every_stage(spark):
    kind = "array<struct<text:string,start:int,end:int,category:string,relation:string>>"
    words = ["བོད", "ཡིག་་", "ཀཀཀ", "ལེགསས", "བེད", "གི", "x", "ཁང"]
    nodes, at = [], 0
    for w in words:
        nodes.append((w, at, at + len(w), None, "case" if w == "གི" else "dep"))
        at += len(w) + 1
    rows = spark.createDataFrame([(1, 0, 0, "་".join(words), nodes)], f"doc_id long, sent_idx int, sent_start int, text string, nodes {kind}")
    table = spark.createDataFrame([("བོད",), ("ཡིག",), ("ལེགས",)], "word string")
    none = spark.createDataFrame([], "ngram string, n long")
    suffixes = spark.createDataFrame([], "suffix string, category string, priority int, confidence double")
    looked = spelling.spelled(grammar.neighbours(rows))
    judged = spelling.verdicts(looked.select(F.col("raw").alias("word")), table, none, none, suffixes)
    found = spelling.findings(looked, judged, spelling.best_candidates(judged, table, none)).collect()
    assert {r["char_start"]: (r["error_type"], r["replacement"]) for r in found} == {4: ("NORMALIZATION", "ཡིག་"), 10: ("STRUCTURAL", "ཀ་"), 20: ("SPELLING", "བོད"), 29: ("SPELLING", None)}


def test_streaming_analysis_and_counts(spark, tmp_path):
    from loomwork.streaming import jobs

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "ཀ། ཁ།"), (2, "ཀ། ག།")], "doc_id long, text string").write.parquet(source)
    stage = lambda rows: rows.select("hash", F.char_length("sentence").alias("n"))
    for _ in range(2):
        jobs.analyze_documents(spark.readStream.schema("doc_id long, text string").parquet(source), out, mark, stage).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    events = str(tmp_path / "events")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'").write.parquet(events)
    counts = jobs.event_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(events))
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
