"""Corpus statistics, n-gram models and collocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.script import TIBETAN, Script, shad_sentences, squeeze_space, syllables
from loomwork.session import held

ALPHA = 0.1
#: Published n-gram tables keep this many entries.
KEPT_NGRAMS = 50_000


def with_syllables(df: DataFrame, text_col: str = "text", script: Script = TIBETAN) -> DataFrame:
    """Add ``syllables``, made once for each row; white space parts them, whatever its length."""
    return held(df, {"syllables": syllables(F.col(text_col), script)})


def ngrams(df: DataFrame, n: int, ends: bool = False) -> DataFrame:
    """Counts of n neighbouring syllables of a document, joined by one space.

    Counts are aggregated before the shuffle. With ``ends``, the shorter ones that close
    a document are counted, too: then the counts of all beginnings follow (``beginnings``).
    """
    least = 1 if ends else n
    parts = [F.get("syllables", F.col("__i") + k) for k in range(n)]
    at = F.sequence(F.lit(0), F.size("syllables") - least)
    rows = df.select("syllables", F.explode_outer(F.when(F.size("syllables") >= least, at)).alias("__i")).where("__i is not null")
    return rows.groupBy(F.concat_ws(" ", *parts).alias("ngram")).agg(F.count("*").alias("n"))


def beginnings(counts: DataFrame, n: int) -> DataFrame:
    """Counts of n neighbouring syllables from those of more with ``ends``: every place begins one of these."""
    whole = F.size(F.split("ngram", " ")) >= n
    return counts.where(whole).groupBy(F.substring_index("ngram", " ", n).alias("ngram")).agg(F.sum("n").alias("n"))


def most_common(counts: DataFrame, k: int = KEPT_NGRAMS, key: str = "ngram") -> DataFrame:
    """The k most frequent; ties go by the key."""
    return counts.orderBy(F.desc("n"), key).limit(k)


def statistics(df: DataFrame, text_col: str = "text", script: Script = TIBETAN) -> DataFrame:
    """One row: documents (null texts too), characters, sentences, syllables, distinct ones, and their ratio."""
    rows = with_syllables(df, text_col, script)
    text = squeeze_space(F.col(text_col))
    sums = rows.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("characters"),
        F.coalesce(F.sum(F.size(shad_sentences(text))), F.lit(0)).alias("sentences"), F.coalesce(F.sum(F.size("syllables")), F.lit(0)).alias("n_syllables"),
    )
    kinds = ngrams(rows, 1).agg(F.count("*").alias("distinct_syllables"))
    ratio = F.when(F.col("n_syllables") > 0, F.round(F.col("distinct_syllables") / F.col("n_syllables"), 6)).otherwise(F.lit(0.0))
    return sums.join(kinds).withColumn("type_token_ratio", ratio)  # one row each


def characters(df: DataFrame, text_col: str = "text") -> DataFrame:
    rows = df.select(F.explode(F.split(F.col(text_col), "")).alias("character")).where("character <> ''")
    return rows.groupBy("character").agg(F.count("*").alias("n"))


def log_probability(count: Column, total: Column, kinds: Column, alpha: float = ALPHA) -> Column:
    return F.ln((F.coalesce(count, F.lit(0)) + alpha) / (total + alpha * kinds))


def frequency_score(count: Column, most: Column) -> Column:
    """log(f + 1) / log(max + 1)."""
    return F.ln(count + 1.0) / F.ln(most + 1.0)


def collocations(df: DataFrame, text_col: str = "text", least: int = 10, top: int = 1500) -> DataFrame:
    """PMI and t-score of neighbouring words: the best by both."""
    words = df.select(F.filter(F.split(squeeze_space(F.col(text_col)), " "), lambda w: w != "").alias("syllables"))
    single = ngrams(words, 1).select(F.col("ngram").alias("w"), F.col("n").alias("f"))
    pairs = ngrams(words, 2).select(F.substring_index("ngram", " ", 1).alias("w1"), F.substring_index("ngram", " ", -1).alias("w2"), "n")
    pairs = pairs.where("char_length(w1) > 1 and char_length(w2) > 1 and w1 <> w2")
    total = pairs.agg(F.sum("n").alias("total"))
    joined = (
        pairs.where(F.col("n") >= least)
        .join(single.select(F.col("w").alias("w1"), F.col("f").alias("f1")), "w1")
        .join(single.select(F.col("w").alias("w2"), F.col("f").alias("f2")), "w2")
        .join(total)
    )
    expected = F.col("f1") * F.col("f2") / F.col("total")
    scored = joined.withColumn("pmi", F.round(F.log2(F.col("n") / expected), 2)).withColumn("t", F.round((F.col("n") - expected) / F.sqrt("n"), 2))
    return scored.orderBy(F.desc("pmi"), F.desc("t"), "w1", "w2").limit(top).select("w1", "w2", "n", "pmi", "t")


def cleaned(counts: DataFrame) -> DataFrame:
    """(ngram, n) with the marks taken off the words; spellings of one n-gram count together as their most frequent one."""
    bare = F.array_join(F.transform(F.split("ngram", " "), lambda w: F.regexp_replace(w, "[་ །]+$", "")), " ")
    return counts.groupBy(bare.alias("ngram")).agg(F.max("n").alias("n"))


def _joined(df: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    t = table.select(F.col("ngram").alias(f"__{name}"), F.col("n").alias(name))
    return df.join(t, key == F.col(f"__{name}"), "left").drop(f"__{name}")


def context_plausibility(places: DataFrame, unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """Distinct (left2, left, word, right) with ``alone``, the word's log-probability, and ``pll``, the mean of those after the left, before the right, and after both left neighbours.

    ``pll`` is 0 where there is no neighbour. Every combination is scored once, whatever
    the number of places that have it.
    """
    rows = places
    totals = unigrams.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    out = _joined(rows, F.col("word"), unigrams, "n_word")
    out = _joined(out, F.col("left"), unigrams, "n_left")
    out = _joined(out, F.concat("left", F.lit(" "), "word"), bigrams, "n_lw")
    out = _joined(out, F.concat("word", F.lit(" "), "right"), bigrams, "n_wr").join(totals)
    none = F.lit(0)
    alone = log_probability(F.col("n_word"), F.col("total"), F.col("kinds"), alpha)
    terms = [
        F.when(F.col("left").isNotNull(), log_probability(F.col("n_lw"), F.coalesce("n_left", none), F.col("kinds"), alpha)),
        F.when(F.col("right").isNotNull(), log_probability(F.col("n_wr"), F.coalesce("n_word", none), F.col("kinds"), alpha)),
    ]
    if trigrams is not None:
        out = _joined(out, F.concat("left2", F.lit(" "), "left"), bigrams, "n_ll")
        out = _joined(out, F.concat("left2", F.lit(" "), "left", F.lit(" "), "word"), trigrams, "n_llw")
        terms.append(F.when(F.col("left2").isNotNull() & F.col("left").isNotNull(), log_probability(F.col("n_llw"), F.coalesce("n_ll", none), F.col("kinds"), alpha)))
    there = sum((t.isNotNull().cast("int") for t in terms[1:]), terms[0].isNotNull().cast("int"))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    pll = F.when(there > 0, total / there).otherwise(F.lit(0.0))
    return out.withColumns({"alone": alone, "pll": pll}).select(*places.columns, "alone", "pll")


def places(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, word, left2, left, right) of arrays ``syllables``: neighbours inside the row, without a shuffle."""
    none = F.array(F.lit(None).cast("string"))
    n = F.size("syllables")
    before = lambda k: F.concat(*([none] * k), F.col("syllables"))
    after = F.concat(F.slice("syllables", 2, F.greatest(n, F.lit(0))), none)
    zipped = F.arrays_zip(F.col("syllables").alias("word"), before(2).alias("left2"), before(1).alias("left"), after.alias("right"))
    out = rows.select(key, n.alias("__n"), F.posexplode_outer(zipped).alias("pos", "z")).where("pos < __n")
    return out.select(key, "pos", "z.word", "z.left2", "z.left", "z.right")


def conditional_score(count: Column, before: Column) -> Column:
    """min(1, c / c(before)); 0 where either is missing."""
    return F.when((count > 0) & (before > 0), F.least(F.lit(1.0), count / before)).otherwise(F.lit(0.0))


def context_bonus(candidates: DataFrame, unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Rows (left2, left, word, right) of one-syllable candidates with ``bonus``: 0.4 of their frequency's, 0.3 of each neighbour's and 0.4 of the left pair's score, at most 1."""
    most = unigrams.agg(F.max("n").alias("most"))
    out = _joined(candidates, F.col("word"), unigrams, "n_word")
    out = _joined(out, F.col("left"), unigrams, "n_left")
    out = _joined(out, F.concat("left", F.lit(" "), "word"), bigrams, "n_lw")
    out = _joined(out, F.concat("word", F.lit(" "), "right"), bigrams, "n_wr")
    out = _joined(out, F.concat("left2", F.lit(" "), "left"), bigrams, "n_ll")
    out = _joined(out, F.concat("left2", F.lit(" "), "left", F.lit(" "), "word"), trigrams, "n_llw").join(most)
    alone = F.when(F.col("n_word") > 0, frequency_score(F.col("n_word"), F.col("most"))).otherwise(F.lit(0.0))
    score = 0.4 * alone + 0.3 * conditional_score(F.col("n_lw"), F.col("n_left")) + 0.3 * conditional_score(F.col("n_wr"), F.col("n_word")) + 0.4 * conditional_score(F.col("n_llw"), F.col("n_ll"))
    return out.withColumn("bonus", F.least(F.lit(1.0), score)).select(*candidates.columns, "bonus")
