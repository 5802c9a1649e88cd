"""Spelling: a cascade of stages over the nodes of sentences.

What a word is does not depend on where it stands, so every distinct word is judged
once, by joins with tables of any size, and the verdicts are joined back to the nodes.
Only known words are looked at in their context, by distinct triples of neighbours.

Stages: words that are not looked at; normalisation; structure of the syllables; words
that are known, as such, as a stem, as a compound that a corpus attests; and, for the
rest, candidates, of which the first is proposed if it is safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.script import tidy, unicode_form
from loomwork.operators import correction, corpus, grammar, places
from loomwork.operators.grammar import stripped
from loomwork.operators.morphology import repaired_column, violation_column
from loomwork.shared import cut

# Particles and endings that are never flagged, endings that a known stem may take.
SAFE = (
    "གི", "ཀྱི", "གྱི", "ཡི", "འི", "གིས", "ཀྱིས", "གྱིས", "ཡིས", "ས", "ལ", "ར", "རུ", "ཏུ", "དུ", "ན", "ནས", "ལས", "ནི", "ཀྱང", "ཡང", "འང", "དང", "མི", "མེད", "ཡིན", "རེད", "ཡོད", "འདུག",
)
SUFFIXES = ("་ལཏར", "་མཁན", "་པོ", "་པས", "་མས", "་གིས", "་གི", "་བྱས")
ENDINGS = "རས"
SMALL_RELATIONS = ("case", "aux", "mark", "neg")
#: Confidence from which a candidate is proposed, and that of a finding without one.
LEAST, UNSURE = 0.75, 0.85


def known(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """Add ``known``: the word, or what is left without a final ར or ས, is in the lexicon; the empty word is."""
    stem = F.when(F.col(column).rlike(f"[{ENDINGS}]$"), F.expr(f"substring({column}, 1, char_length({column}) - 1)"))
    one = lexicon.select(F.col("word").alias("__w"), F.lit(True).alias("__a")).distinct()
    two = lexicon.select(F.col("word").alias("__v"), F.lit(True).alias("__b")).distinct()
    out = words.withColumn("__stem", stem).join(one, F.col(column) == F.col("__w"), "left").join(two, F.col("__stem") == F.col("__v"), "left")
    return out.withColumn("known", F.coalesce("__a", F.lit(False)) | F.coalesce("__b", F.lit(False)) | (F.col(column) == "")).drop("__stem", "__w", "__a", "__v", "__b")


def skipped(word: Column) -> Column:
    """Words of two scripts, numerals, and what has no letter of the script."""
    bare = stripped(word)
    mixed = word.rlike("[ༀ-࿚]") & word.rlike("[A-Za-z]")
    return (bare == "") | mixed | bare.rlike("^[༠-༳]+$") | ~bare.rlike("[ཀ-ཬཱ-྅ྐ-ྼ]")


def suffix_base(word: Column) -> Column:
    """What is left of a word before the first listed ending it has; null if it has none."""
    out = None
    for s in SUFFIXES:
        base = F.substring(word, F.lit(1), F.char_length(word) - len(s))
        out = F.when(word.endswith(s), base) if out is None else out.when(word.endswith(s), base)
    return out


def _held(words: DataFrame, column: Column, table: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether the expression is a word of the table (word)."""
    t = table.select(F.col("word").alias("__listed"), F.lit(True).alias(name)).distinct()
    return words.join(t, column == F.col("__listed"), "left").drop("__listed").withColumn(name, F.coalesce(name, F.lit(False)))


def stem_table(words: DataFrame, suffix_rules: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """(word, stem, confidence, rule, source, rank): irregular form first, every suffix by priority, the word itself last.

    ``suffix_rules`` is (suffix, category, priority, confidence), ``irregular`` (form, stem, confidence, rule).
    A word is joined by its own endings, not with every rule.
    """
    bare = words.select("word", stripped(F.col("word")).alias("w")).where("w <> ''").distinct()
    ends = bare.select("word", "w", F.explode(F.sequence(F.lit(1), F.char_length("w") - 1)).alias("k")).where("k > 0 and k < char_length(w)")
    ends = ends.select("word", F.expr("substring(w, char_length(w) - k + 1)").alias("suffix"), F.regexp_replace(F.expr("substring(w, 1, char_length(w) - k)"), "[་ ]+$", "").alias("stem")).where("stem <> ''")
    rules = suffix_rules.select("suffix", "category", "priority", "confidence")
    found = ends.join(rules, "suffix").select("word", "stem", F.col("confidence").cast("double").alias("confidence"), F.concat(F.lit("SUFFIX_"), F.upper("category")).alias("rule"), F.lit("suffix").alias("source"), (-F.col("priority")).cast("long").alias("place"))
    if irregular is not None:
        forms = irregular.select(F.col("form").alias("w"), "stem", F.coalesce("confidence", F.lit(0.97)).alias("confidence"), F.coalesce("rule", F.lit("PAST_IRREGULAR")).alias("rule"))
        found = found.unionByName(bare.join(forms, "w").select("word", "stem", "confidence", "rule", F.lit("irregular").alias("source"), F.lit(-(1 << 40)).cast("long").alias("place")))
    some = found.select("word").distinct().withColumn("__some", F.lit(True))
    raw = bare.join(some, "word", "left").select("word", F.col("w").alias("stem"), F.when(F.col("__some"), 0.30).otherwise(0.50).alias("confidence"), F.lit("NO_MORPHOLOGY").alias("rule"), F.lit("fallback").alias("source"), F.lit(1 << 40).cast("long").alias("place"))
    order = Window.partitionBy("word").orderBy("place", "rule", "stem")
    return found.unionByName(raw).withColumn("rank", F.row_number().over(order)).drop("place")


def verdicts(words: DataFrame, lexicon: DataFrame, bigrams: DataFrame, trigrams: DataFrame, suffix_rules: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """(word, normal, verdict, syllable, repair) of every distinct word.

    The distinct words are a table of their own, which the stages read. The verdict is skipped, suffixed, SPELL-NORM-001, SPELL-STRUCT-001, known, compound, stem, or unknown.
    """
    safe = [*SAFE, *grammar.EXCEPTIONS]
    vocabulary = lexicon.select(stripped(F.col("word")).alias("word")).where("word <> ''").distinct()
    asked = cut(words.select("word").distinct(), "words").withColumn("normal", tidy(unicode_form(F.col("word")))).withColumn("bare", stripped(F.col("normal")))
    base = suffix_base(F.col("word"))
    rows = _held(asked.withColumn("__base", stripped(base)), F.col("__base"), vocabulary, "__suffixed")
    rows = rows.withColumn("__suffixed", (F.coalesce(F.col("__base"), F.lit("")) != "") & (F.col("__suffixed") | F.col("__base").isin(*safe)))
    syllables = F.filter(F.split("normal", "་"), lambda s: s != "")
    # the first syllable that breaks a rule: syllables are judged once, whatever words they stand in
    parts = asked.select("word", F.posexplode(syllables).alias("k", "syllable"))
    broken = parts.select("syllable").distinct().withColumn("error", violation_column("syllable")).where("error is not null").withColumn("repair", repaired_column("syllable"))
    first = parts.join(broken, "syllable").groupBy("word").agg(F.min(F.struct("k", "syllable", "error", "repair")).alias("__broken"))
    rows = rows.join(first, "word", "left")
    rows = known(rows, vocabulary, "bare").withColumnRenamed("known", "__known")
    pieces = F.filter(F.transform(F.split("normal", "་"), lambda s: stripped(s)), lambda s: s != "")
    rows = rows.withColumn("__parts", pieces).withColumn("__n", F.size("__parts"))
    several = rows.where("__n > 1").select("word", "__parts", "__n", F.explode("__parts").alias("__p"))
    several = _held(several, F.col("__p"), vocabulary, "__in").withColumn("__in", F.col("__in") | F.col("__p").isin(*safe))
    whole = several.groupBy("word", "__parts", "__n").agg(F.min("__in").alias("__all")).where("__all")
    pair = F.concat_ws(" ", F.get("__parts", F.lit(0)), F.get("__parts", F.lit(1)))
    triple = F.concat_ws(" ", *(F.get("__parts", F.lit(k)) for k in range(3)))
    two = bigrams.where("n > 0").select(F.col("ngram").alias("word"))
    three = trigrams.where("n > 0").select(F.col("ngram").alias("word"))
    attested = _held(_held(whole, F.when(F.col("__n") != 3, pair), two, "__b"), F.when(F.col("__n") == 3, triple), three, "__t").where("__b or __t").select("word", F.lit(True).alias("__compound"))
    rows = rows.join(attested, "word", "left")
    stems = stem_table(asked.select(F.col("normal").alias("word")), suffix_rules, irregular)
    stemmed = stems.join(vocabulary.withColumnRenamed("word", "stem"), "stem", "left_semi").select(F.col("word").alias("normal"), F.lit(True).alias("__stem")).distinct()
    rows = rows.join(stemmed, "normal", "left")
    verdict = (
        F.when(skipped(F.col("word")), "skipped")
        .when(F.col("__suffixed"), "suffixed")
        .when(F.col("normal") != F.col("word"), "SPELL-NORM-001")
        .when(F.col("__broken").isNotNull(), "SPELL-STRUCT-001")
        .when(F.col("__known") | F.col("bare").isin(*safe), "known")
        .when(F.col("__compound"), "compound")
        .when(F.col("__stem"), "stem")
        .otherwise("unknown")
    )
    return rows.select("word", "normal", verdict.alias("verdict"), F.col("__broken.syllable").alias("syllable"), F.col("__broken.error").alias("error"), F.col("__broken.repair").alias("repair"))


def spelled(flat: DataFrame) -> DataFrame:
    """Nodes (``grammar.neighbours``) that are looked at, with ``raw``: the text without shads, spaces and the sign ཿ at its ends."""
    raw = F.regexp_replace("node_text", "^[། ཿ]+|[། ཿ]+$", "")
    rows = flat.withColumn("raw", raw).where((F.col("raw") != "") & ~F.coalesce(F.col("relation") == "punct", F.lit(False)))
    small = F.coalesce(F.col("relation").isin(*SMALL_RELATIONS), F.lit(False)) & (F.col("raw").rlike("^[\\x00-\\x7F]*$") | F.regexp_replace("raw", "^[་ ]+|[་ ]+$", "").isin(*SAFE))
    return rows.where(~small)


def findings(nodes: DataFrame, judged: DataFrame, best: DataFrame, source: str = "spelling") -> DataFrame:
    """Findings of all nodes whose word is not in order.

    ``judged`` is ``verdicts``; ``best`` is (word, candidate, confidence, safe): the first
    candidate of each unknown word, if it has any.
    """
    rows = nodes.select("doc_id", (F.col("sent_start") + F.col("start")).alias("char_start"), (F.col("sent_start") + F.col("end")).alias("char_end"), F.col("raw").alias("word"))
    wrong = judged.where(F.col("verdict").isin("SPELL-NORM-001", "SPELL-STRUCT-001", "unknown")).join(best, "word", "left")
    norm, struct = F.col("verdict") == "SPELL-NORM-001", F.col("verdict") == "SPELL-STRUCT-001"
    none, safe = F.col("candidate").isNull(), F.coalesce("safe", F.lit(False))
    said = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    message = (
        F.when(norm, said("[SPELL-NORM-001] Normalization: '", F.col("word"), "' -> '", F.col("normal"), "'"))
        .when(struct, said("[SPELL-STRUCT-001] Structural Error [", F.col("error"), "]: Syllable '", F.col("syllable"), "' violates Tibetan orthography rules"))
        .when(none, said("[SPELL-DICT-002] Unknown word: '", F.col("normal"), "' — No suggestion available."))
        .when(safe, said("[SPELL-DICT-001] Correction available: Unknown word '", F.col("normal"), "' — Did you mean '", F.col("candidate"), "'? (confidence: ", F.format_string("%.2f", F.col("confidence").cast("double")), ")"))
        .otherwise(said("[SPELL-DICT-003] Unknown word: '", F.col("normal"), "' — candidate rejected by safety guardrails, no edit applied."))
    )
    told = wrong.select(
        "word", F.when(norm, F.col("normal")).when(struct, F.col("repair")).when(safe, F.col("candidate")).alias("replacement"),
        F.when(norm | struct, 0.95).when(safe, F.col("confidence")).otherwise(UNSURE).alias("score"),
        F.when(norm | struct | (safe & (F.col("confidence") >= 0.80)), "HIGH").otherwise("MEDIUM").alias("priority"), message.alias("message"),
        F.when(norm, "NORMALIZATION").when(struct, "STRUCTURAL").otherwise("SPELLING").alias("kind"),
    )
    return _typed(rows.join(cut(told, "told"), "word"), source)


def _typed(found: DataFrame, source: str) -> DataFrame:
    return found.select(
        "doc_id", F.lit(source).alias("source"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.col("replacement").cast("string").alias("replacement"),
        F.col("score").cast("double").alias("score"), "priority", "message", F.col("kind").alias("error_type"),
    )


def best_candidates(judged: DataFrame, lexicon: DataFrame, bigrams: DataFrame, frequencies: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(word, candidate, confidence, safe): the first candidate of each unknown word and whether it may be proposed."""
    asked = cut(judged.where("verdict = 'unknown'").select("word", "normal"), "unknown")
    found = correction.candidates(asked.select(F.col("normal").alias("word")), lexicon, frequencies, 1)
    first = asked.join(found.select(F.col("query").alias("normal"), F.col("word").alias("candidate"), "confidence"), "normal")
    return correction.guarded(first, "normal", "candidate", "confidence", lexicon, bigrams, least).select("word", "candidate", "confidence", "safe")


def context_findings(nodes: DataFrame, judged: DataFrame, unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame, best: DataFrame, gap: float = 4.5, least: float = LEAST, source: str = "spelling") -> DataFrame:
    """Known words that their context makes implausible.

    ``nodes`` are one-syllable words with ``left2``, ``left`` and ``right``; ``best`` is
    (word, candidate, safe). The candidate is proposed if it fits the context so much better
    that 0.5 + gain / 10 reaches ``least``, and may be made.
    """
    fine = judged.where(F.col("verdict").isin("known", "compound", "stem") & ~F.col("word").isin(*SAFE)).select("word")
    rows = nodes.join(fine, "word", "left_semi")
    asked = rows.select("left2", "left", "word", "right").distinct()
    scored = corpus.context_plausibility(asked, unigrams, bigrams, trigrams)
    wrong = scored.where((F.col("pll") != 0) & (F.col("alone") - F.col("pll") > gap))
    tried = wrong.join(best, "word", "left")
    others = tried.where("candidate is not null").select("left2", "left", F.col("candidate").alias("word"), "right").distinct()
    better = corpus.context_plausibility(others, unigrams, bigrams, trigrams).select(*(F.col(c).alias(f"o_{c}") for c in ("left2", "left", "word", "right")), F.col("pll").alias("other"))
    same = F.col("left2").eqNullSafe(F.col("o_left2")) & F.col("left").eqNullSafe(F.col("o_left")) & F.col("right").eqNullSafe(F.col("o_right")) & (F.col("candidate") == F.col("o_word"))
    joined = tried.join(better, same, "left").select("left2", "left", "word", "right", "pll", "candidate", "safe", "other")
    told = _judged(joined, least)
    t = told.select(*(F.col(c).alias(f"__{c}") for c in ("left2", "left", "word", "right")), "candidate", "sure", "edit")
    hit = rows.join(t, F.col("word").eqNullSafe(F.col("__word")) & F.col("left").eqNullSafe(F.col("__left")) & F.col("left2").eqNullSafe(F.col("__left2")) & F.col("right").eqNullSafe(F.col("__right")))
    return _implausible(hit, source)


def _judged(rows: DataFrame, least: float) -> DataFrame:
    """Rows (pll, other, safe, …) with how sure the candidate is and whether it may be made."""
    sure = F.when((F.col("other") != 0) & (F.col("pll") != 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("other") - F.col("pll")) / 10))).otherwise(0.0)
    return rows.withColumn("sure", F.coalesce(sure, F.lit(0.0))).withColumn("edit", F.coalesce((F.col("sure") >= least) & F.col("safe"), F.lit(False)))


def _implausible(hit: DataFrame, source: str) -> DataFrame:
    message = F.when(F.col("edit"), F.concat(F.lit("[SPELL-CTX-001] Known word '"), "word", F.lit("' appears in an implausible context — did you mean '"), "candidate", F.lit("'?"))).otherwise(
        F.concat(F.lit("[SPELL-CTX-002] Known word '"), "word", F.lit("' appears in an implausible context."))
    )
    return _typed(
        hit.select(
            "doc_id", "char_start", "char_end", F.when(F.col("edit"), F.col("candidate")).alias("replacement"), F.when(F.col("edit"), F.round(F.least(F.lit(1.0), F.col("sure") * 0.8), 3)).otherwise(0.5).alias("score"),
            F.lit("LOW").alias("priority"), message.alias("message"), F.lit("CONTEXT").alias("kind"),
        ),
        source,
    )


def findings_at_places(documents: DataFrame, candidates: Callable[[DataFrame], DataFrame], gap: float = 4.5, least: float = LEAST, source: str = "spelling") -> DataFrame:
    """``context_findings`` of all words of texts that are known by standing there, without n-grams as text.

    ``candidates`` makes (word, candidate, safe) of (ngram, n), one for a word at most and a word of the texts.
    """
    found, one, table, totals = places.implausible(documents, gap, corpus.ALPHA)
    wrong = found.where(~F.col("word").isin(*SAFE))
    best = cut(candidates(one.withColumnRenamed("word", "ngram")).join(one.select(F.col("word").alias("candidate"), F.col("n").alias("n_candidate")), "candidate"), "best", tidy=True)
    tried = wrong.join(best, "word", "left")
    told = places.instead(tried.where("candidate is not null"), table, totals, corpus.ALPHA)
    alone = tried.where("candidate is null").withColumn("other", F.lit(None).cast("double"))
    return _implausible(_judged(told.unionByName(alone), least).withColumns({"char_start": F.col("pos"), "char_end": F.col("pos") + 1}), source)
