"""Lexicons: verbs and their frames, collocations, Sanskrit words, irregular forms.

Built-in entries are small; tables given by the user go before them and may have any
size, as every look-up is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.script import FINALS
from loomwork.shared import cut

# Verbs (transitivity, honorific, valency, tense), pairs of words (mutual information, t, frequency).
VERBS = {
    "ཡིན": ("COPULA", "NEUT", 1, "present"), "ཡོད": ("EXISTENTIAL", "NEUT", 1, "present"), "འགྱུར": ("INTRANS", "NEUT", 1, "future"), "བལྟས": ("TRANS", "NEUT", 2, "past"),
    "ཕྱིན": ("INTRANS", "NEUT", 1, "past"), "བཀོལ": ("TRANS", "NEUT", 2, "past"), "འཁོར": ("INTRANS", "NEUT", 1, "present"), "ཞུས": ("TRANS", "HON", 2, "past"),
    "འཐུང": ("TRANS", "NEUT", 2, "present"), "བསྐོལ": ("TRANS", "NEUT", 2, "past"), "གཟིགས": ("TRANS", "HON", 2, "present"), "བཟོས": ("TRANS", "NEUT", 2, "past"), "བཟོ": ("TRANS", "NEUT", 2, "present"),
}
COLLOCATIONS = (
    ("ང་", "ཡིན", 4.85, 8.42, 14500), ("ང་", "བདག", 4.12, 6.25, 8200), ("ཆོས་སྒོར", "བདག", 5.21, 7.10, 3400), ("ཆོས་སྒོར", "བོད", 0.15, 0.20, 2), ("ང་ཚོས", "བལྟས", 4.65, 7.80, 5600), ("བལྟས", "ལག", 4.32, 6.90, 2900),
    ("བལྟས", "ངོས", 4.10, 6.45, 2100), ("བལྟས", "ཀ", 0.05, 0.10, 1), ("ཁོང", "ཡིན", 4.50, 7.90, 11200), ("ཁོང", "བོད་པ", 4.70, 7.15, 4800), ("ཆུ", "འཐུང", 5.40, 8.10, 6100), ("ཆོས", "འཐུང", 0.10, 0.15, 1),
)
SANSKRIT_VALID = ("ཀརྨ", "པདྨ", "བུདྡྷ", "དྷརྨ", "སངྒྷ", "ཨཱརྱ", "ཛྙཱན", "མཉྫུ", "བཛྲ", "རཏྣ", "མཎྜལ")
SANSKRIT_INVALID = ("ཀསྨ", "པསྨ", "བདྡྷ")
SANSKRIT_FINALS = {"ཀརྨ": "མ", "པདྨ": "མ", "བུདྡྷ": "ད"}
MALAPROPS = (("བོད", ("ཆོས་སྒོར", "ཆོས་སྒོ")), ("ཀ", ("བལྟས", "ལྟོས")))
NEUTRAL = 0.5


def without_marks(word: Column) -> Column:
    return F.regexp_replace(word, "[་ །]+$", "")


def verbs(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """(word, transitivity, honorific, valency, tense): given entries before the built-in ones."""
    own = spark.createDataFrame([(w, *v) for w, v in VERBS.items()], "word string, transitivity string, honorific string, valency int, tense string")
    if given is None:
        return own
    return given.select(*own.columns).unionByName(own.join(given.select("word"), "word", "left_anti"))


def verb_info(words: DataFrame, table: DataFrame, column: str = "word") -> DataFrame:
    """Add the verb's properties and ``is_verb``."""
    t = table.withColumnRenamed("word", "__verb")
    return words.join(t, without_marks(F.col(column)) == F.col("__verb"), "left").withColumn("is_verb", F.col("__verb").isNotNull()).drop("__verb")


def collocations(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """(w1, w2, mi, t, freq): given pairs before the built-in ones."""
    own = spark.createDataFrame(list(COLLOCATIONS), "w1 string, w2 string, mi double, t double, freq int")
    if given is None:
        return own
    return given.select(*own.columns).unionByName(own.join(given.select("w1", "w2"), ["w1", "w2"], "left_anti"))


def _keyed(pairs: DataFrame, keys: list[Column], table: DataFrame, value: str) -> DataFrame:
    """Add ``__hit``: the value of the first of the keys (w1 and w2 with a colon between) that the table has.

    Every distinct key is joined once.
    """
    t = table.select(F.concat_ws(":", "w1", "w2").alias("__key"), F.col(value).alias("__value")).groupBy("__key").agg(F.max("__value").alias("__value"))
    told = pairs.select("w1", "w2").distinct().select("w1", "w2", F.posexplode(F.array(*keys)).alias("__rank", "__key"))
    first = told.join(t, "__key").groupBy("w1", "w2").agg(F.min_by("__value", "__rank").alias("__hit"))
    return pairs.join(first, ["w1", "w2"], "left")


def collocation_scores(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(w1, w2, score): mutual information over five inside 0 to 1, in either order, with or without marks; neutral for unknown pairs."""
    a, b = without_marks(F.col("w1")), without_marks(F.col("w2"))
    mark = lambda c: F.concat(c, F.lit("་"))
    join = lambda x, y: F.concat_ws(":", x, y)
    keys = [join(a, b), join(b, a), join(F.col("w1"), F.col("w2")), join(F.col("w2"), F.col("w1")), join(mark(a), b), join(a, mark(b)), join(mark(a), mark(b))]
    out = _keyed(pairs, keys, table, "mi")
    score = F.when(F.col("__hit").isNull(), NEUTRAL).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__hit") / 5)))
    return out.withColumn("score", score).drop("__hit")


def collocation_strength(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(w1, w2, strength): t, or else mutual information, in this order only; 0 for unknown pairs."""
    strip = lambda c: F.regexp_replace(F.col(c), "^[་ །]+|[་ །]+$", "")
    a, b = strip("w1"), strip("w2")
    mark = lambda c: F.concat(c, F.lit("་"))
    keys = [F.concat_ws(":", x, y) for x, y in ((a, b), (mark(a), b), (a, mark(b)), (mark(a), mark(b)))]
    both = table.withColumn("__best", F.coalesce("t", "mi"))
    return _keyed(pairs, keys, both, "__best").withColumn("strength", F.coalesce("__hit", F.lit(0.0))).drop("__hit")


def malapropisms(sentences: DataFrame, table: DataFrame) -> DataFrame:
    """(…, i, word): words of a sentence (array ``words``) that hardly ever stand with another word of it.

    A known pair scores below 0.1, in either order. The table's weak pairs are joined to the words; no pairs of a sentence are made.
    """
    keys = [c for c in sentences.columns if c != "words"]
    ways = [table.select(F.col(x).alias("__a"), F.col(y).alias("__b"), "mi", F.lit(k).alias("__k")) for k, (x, y) in enumerate((("w2", "w1"), ("w1", "w2")))]
    both = ways[0].unionByName(ways[1]).groupBy("__a", "__b").agg(F.min_by("mi", "__k").alias("mi")).where(F.col("mi") / 5 < 0.1)  # the order as they stand goes first
    partners = cut(both.groupBy("__a").agg(F.collect_set("__b").alias("__partners")), "partners")  # of known size: words meet a small table where they stand
    bare = F.transform("words", lambda w: without_marks(w))
    rows = sentences.withColumn("__bare", bare).select(*keys, "__bare", F.posexplode("words").alias("i", "word")).withColumn("__w", without_marks(F.col("word")))
    listed = F.lit(False)
    for target, contexts in MALAPROPS:
        listed = listed | ((F.col("__w") == target) & F.arrays_overlap("__bare", F.array(*map(F.lit, contexts))))
    joined = rows.join(partners, F.col("__w") == F.col("__a"), "left")
    others = F.array_remove(F.coalesce("__partners", F.array().cast("array<string>")), F.col("__w"))
    return joined.where(listed | F.arrays_overlap(others, "__bare")).select(*keys, "i", "word")


def semantic_replacements(word: Column, context: Column) -> Column:
    """Words that fit a sentence (array of words) better than a confused one."""
    bare = without_marks(word)
    has = lambda *parts: F.exists(context, lambda w: F.greatest(*(w.contains(p) for p in parts), F.lit(False)))
    none = F.array().cast("array<string>")
    person = F.arrays_overlap(F.transform(context, lambda w: without_marks(w)), F.array(F.lit("ང"), F.lit("ཁོང")))
    return (
        F.when((bare == "བོད") & has("ཆོས་སྒོར", "ཆོས་སྒོ་"), F.array(F.lit("བདག་")))
        .when((bare == "བོད") & person, F.array(F.lit("བོད་པ་")))
        .when((bare == "ཀ") & has("བལྟས"), F.array(F.lit("ལག་"), F.lit("ངོས་")))
        .when((bare == "ཆོས") & has("འཐུང"), F.array(F.lit("ཆུ་")))
        .otherwise(none)
    )


def sanskrit(words: DataFrame, invalid: DataFrame | None = None, column: str = "word") -> DataFrame:
    """Add ``final``, the closing consonant that particles follow, and ``valid``: the word is not among the wrong stacks."""
    bare = without_marks(F.col(column))
    final = None
    for w, c in SANSKRIT_FINALS.items():
        final = F.when(bare == w, c) if final is None else final.when(bare == w, c)
    consonants = F.regexp_replace(bare, f"[^{FINALS.replace('འ', '')}]", "")
    out = words.withColumn("final", final.when(consonants != "", F.substring(consonants, -1, 1)).otherwise("open")).withColumn("valid", ~bare.isin(*SANSKRIT_INVALID))
    if invalid is None:
        return out
    wrong = invalid.select(F.col("word").alias("__x"), F.lit(True).alias("__wrong")).distinct()
    return out.join(wrong, bare == F.col("__x"), "left").withColumn("valid", F.col("valid") & F.col("__wrong").isNull()).drop("__x", "__wrong")


def is_transitive(slots: Column, transitivity: Column) -> Column:
    """Whether a frame takes an agent: its slots decide, else its label; null if neither says."""
    return F.when(F.size(slots) > 0, F.array_contains(slots, "ergative")).when(transitivity == "transitive", True).when(transitivity == "intransitive", False)


def agreed(frames: DataFrame, key: str) -> DataFrame:
    """(key, lemma, is_transitive, is_ambiguous): what all frames of a word agree on; null where they do not."""
    rows = frames.withColumn("__t", is_transitive(F.col("slots"), F.col("transitivity")))
    one = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.first(c))
    return rows.groupBy(key).agg(one("lemma").alias("lemma"), one("__t").alias("is_transitive"), (F.count("*") > 1).alias("is_ambiguous"))


def irregular_forms(existing: DataFrame, lexicon: DataFrame, tagged: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(form, stem, confidence, rule): irregular verb forms of four sources; the first that has a form is kept.

    ``existing`` has the result's columns; ``lexicon`` is (word, tense); ``tagged`` is (pos, word, tag) in the order of a
    text in which a present form goes before its other forms; ``lemmas`` is (lemma).
    """
    clean = lambda c: F.regexp_replace(c, "^[་ །]+|[་ །]+$", "")
    one = existing.select("form", "stem", "confidence", "rule", F.lit(0).alias("source"), F.lit(0).cast("long").alias("place"))
    two = lexicon.select(clean(F.col("word")).alias("form"), F.concat(F.lit("VERB_LEXICON_"), F.upper(F.coalesce("tense", F.lit("FORM")))).alias("rule"))
    two = two.select("form", F.col("form").alias("stem"), F.lit(0.90).alias("confidence"), "rule", F.lit(1).alias("source"), F.lit(0).cast("long").alias("place"))
    three = carried(tagged).where("tag rlike 'v[.](past|fut|imp)' and not tag rlike 'v[.]pres' and stem is not null and form <> stem").select(
        "form", "stem", F.lit(0.90).alias("confidence"), F.concat(F.lit("VERB_"), F.upper(F.replace("tag", F.lit("."), F.lit("_")))).alias("rule"), F.lit(2).alias("source"), F.col("pos").cast("long").alias("place")
    )
    four = lemmas.select(clean(F.regexp_replace(F.trim(F.col("lemma")), "[√0-9]", "")).alias("form"))
    four = four.select("form", F.col("form").alias("stem"), F.lit(0.75).alias("confidence"), F.lit("VERB_LEMMA_INFERRED").alias("rule"), F.lit(3).alias("source"), F.lit(0).cast("long").alias("place"))
    every = one.unionByName(two).unionByName(three).unionByName(four).where("form <> ''")
    return every.groupBy("form").agg(F.min(F.struct("source", "place", "rule", "stem", "confidence")).alias("b")).select("form", "b.stem", "b.confidence", "b.rule")


def carried(tagged: DataFrame, block: int = 65536) -> DataFrame:
    """(pos, form, tag, stem): each word with the last present form up to it, carried over blocks of ``block`` places."""
    clean = F.regexp_replace("word", "^[་ །]+|[་ །]+$", "")
    rows = tagged.select("pos", clean.alias("form"), "tag", F.floor(F.col("pos") / block).alias("__block")).where("form <> ''")
    present = F.when(F.col("tag").contains("v.pres"), F.col("form"))
    inside = Window.partitionBy("__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("__near", F.last(present, True).over(inside))
    ends = rows.groupBy("__block").agg(F.max(F.when(present.isNotNull(), F.struct("pos", "form"))).alias("last"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    earlier = ends.select(F.col("__block").alias("__b"), F.last("last", True).over(before).alias("__far"))
    joined = held.join(earlier, F.col("__block") == F.col("__b"))
    return joined.select("pos", "form", "tag", F.coalesce("__near", F.col("__far.form")).alias("stem"))
