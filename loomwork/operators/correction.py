"""Correction candidates: character-bigram retrieval, edit distance, ranking.

Retrieval takes the queries in blocks of at most ``QUERIES`` words to the tasks that
hold the lexicon: each part of the lexicon is indexed by its bigrams, scored for all
queries of the block, and tells only its best ones, so that no pair is ever shuffled but
``top`` for each query and part. Lexicons are tables of any size; queries are distinct
words, and more of them make more blocks.

Distances are aligned edit distances by letters with their marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.script import vowel_before_consonant
from loomwork.operators.grammar import stripped
from loomwork.session import prepare
from loomwork.shared import cut

TSHEG = "་"
#: Words of a block of queries, and of a part of the lexicon that a task indexes at a time.
QUERIES = 200_000
PART = 50_000
#: Retrieved words, largest distance, that of rare words, and up to which count a word is rare.
TOP, NEAR, RARE_NEAR, RARE = 200, 2, 3, 10
PROVIDER_TOP, PROVIDER_KEPT, PART_TOP, PART_KEPT = 300, 20, 100, 20
#: Ends every word in the bigram index.
END = "\x02"
MARKS = "ཱ-ཾྀ-྄྆-྇ྐ-ྼ༹༵༷"


def graphemes(word: str) -> list[str]:
    """Letters with the marks that follow them, in composed form."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", word):
        code = ord(c)
        mark = unicodedata.combining(c) or 0x0F71 <= code <= 0x0F7E or 0x0F80 <= code <= 0x0F84 or code in (0x0F86, 0x0F87, 0x0F35, 0x0F37, 0x0F39) or 0x0F90 <= code <= 0x0FBC
        if mark and out:
            out[-1] += c
        else:
            out.append(c)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def graphemes_column(words: pa.Array) -> pa.Array:
    """Letters of words with their marks; null for null."""
    return pa.array([w if w is None else graphemes(w) for w in words.to_pylist()], pa.list_(pa.string()))


def aligned_distance(a: list[str], b: list[str]) -> int:
    """Edits with transposition of neighbours, none edited twice (optimal string alignment)."""
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        older, last = last, row
    return last[-1]


@F.arrow_udf(T.IntegerType())
def distance_column(a: pa.Array, b: pa.Array) -> pa.Array:
    """Aligned distance of two words by graphemes; null for null."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else aligned_distance(graphemes(x), graphemes(y)) for x, y in pairs], pa.int32())


def bigrams(word: Column) -> Column:
    """Overlapping pairs of characters of the word and its end mark."""
    ended = F.concat(word, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(ended, i, F.lit(2)))


def _word_bigrams(word: str) -> list[str]:
    ended = word + END
    return [ended[k : k + 2] for k in range(len(word))]


def best_shared(asked: list[str], words: list[str], top: int):
    """(query number, word number, shared) of the words that share most bigrams with each query, itself excluded."""
    postings: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        for g in set(_word_bigrams(w)):
            postings.setdefault(g, []).append(k)
    arrays = {g: np.array(p, dtype=np.int64) for g, p in postings.items()}
    for q, word in enumerate(asked):
        found = [arrays[g] for g in _word_bigrams(word) if g in arrays]
        if not found:
            continue
        counts = np.bincount(np.concatenate(found), minlength=len(words))
        at = np.flatnonzero(counts)
        if len(at) > top + 1:
            least = np.partition(counts[at], len(at) - top - 1)[len(at) - top - 1]
            at = at[counts[at] >= least]  # ties at the edge stay: the word decides among them
        for k in sorted(at.tolist(), key=lambda k: (-counts[k], words[k]))[: top + 1]:
            if words[k] != word:
                yield q, k, int(counts[k])


def _parts(batches):
    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= PART:
            yield held[:PART]
            held = held[PART:]
    if held:
        yield held


def _retrieved(batches, asked, top: int):
    for words in _parts(batches):
        rows = list(best_shared(asked.value, words, top))
        if rows:
            q, k, n = (np.array(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([asked.value[x] for x in q]), pa.array([words[x] for x in k]), pa.array(n, pa.int64())], ["query", "word", "shared"])


def _scanned(batches, asked, near: int):
    """All words of a part whose length is within ``near`` of a query's, with their distance if it is at most that."""
    for words in _parts(batches):
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        rows = []
        for query in asked.value:
            for n in range(len(query) - near, len(query) + near + 1):
                for w in by_length.get(n, ()):
                    d = aligned_distance(graphemes(query), graphemes(w))
                    if 0 < d <= near:
                        rows.append((query, w, d))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["query", "word", "distance"])


def _in_blocks(queries: DataFrame, lexicon: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the lexicon for each block of at most about ``QUERIES`` distinct query words."""
    spark = prepare(queries.sparkSession)
    asked = queries.where("word <> ''").select("word").distinct()
    blocks = max(1, -(-asked.count() // QUERIES))
    out = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k)
        words = spark.sparkContext.broadcast(sorted(r["word"] for r in block.collect()))  # a block's size
        one = lexicon.where("word <> ''").select("word").mapInArrow(partial(run, asked=words), schema)
        out = one if out is None else out.unionByName(one)
    return out


def retrieve(queries: DataFrame, lexicon: DataFrame, top: int = TOP) -> DataFrame:
    """(query, word, shared, rank): the words that share most bigrams, themselves excluded; ties go by the word.

    A query's bigrams count as often as they come; a word's count once.
    """
    found = _in_blocks(queries, lexicon.distinct(), partial(_retrieved, top=top), "query string, word string, shared long")
    order = Window.partitionBy("query").orderBy(F.desc("shared"), "word")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def same_start(queries: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """(query, word, distance): words with the same first character and a length within ``most``, near enough.

    Joined on character and length, each query being told out to the lengths it may meet.
    """
    asked = queries.where("word <> ''").select(
        F.col("word").alias("query"), F.substring("word", 1, 1).alias("first"), F.explode(F.sequence(F.char_length("word") - most, F.char_length("word") + most)).alias("n")
    )
    held = lexicon.select("word", F.substring("word", 1, 1).alias("first"), F.char_length("word").alias("n"))
    distance = F.levenshtein("query", "word")
    return asked.join(held, ["first", "n"]).where("query <> word").withColumn("distance", distance).where(F.col("distance") <= most).select("query", "word", "distance")


def scan(queries: DataFrame, lexicon: DataFrame, near: int = NEAR) -> DataFrame:
    """(query, word, distance) by looking at every word of a fitting length: for the few queries that retrieval finds nothing for."""
    return _in_blocks(queries, lexicon.distinct(), partial(_scanned, near=near), "query string, word string, distance int")


def canonical(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query, word): queries whose vowel sign stands one letter too late, put right, if that is a word."""
    swapped = queries.select(F.col("word").alias("query"), vowel_before_consonant(F.col("word")).alias("word")).where("query <> word")
    return swapped.join(lexicon.select("word").distinct(), "word", "left_semi").select("query", "word")


def splits(queries: DataFrame, lexicon: DataFrame, mark: str = TSHEG, shortest: int = 4, least: int = 2) -> DataFrame:
    """(query, word): two words of the lexicon that the query, without a mark, is written together from.

    Told with and without a mark behind. Each part is looked up by an equi-join.
    """
    asked = queries.where((F.char_length("word") >= shortest) & ~F.col("word").contains(mark)).select(F.col("word").alias("query")).distinct()
    cut = asked.select("query", F.explode(F.sequence(F.lit(least), F.char_length("query") - least)).alias("k"))
    parts = cut.select("query", F.expr("substring(query, 1, k)").alias("a"), F.expr("substring(query, k + 1)").alias("b"))
    known = lexicon.select("word").distinct()
    both = parts.join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    whole = F.concat("a", F.lit(mark), "b")
    return both.select("query", F.explode(F.array(whole, F.concat(whole, F.lit(mark)))).alias("word"))


def word_frequency(words: DataFrame, frequencies: DataFrame, column: str = "word") -> DataFrame:
    """Add ``freq``: the count of the stripped word, or else of the word with a mark behind; 0 for others."""
    bare = stripped(F.col(column))
    one = frequencies.select(F.col("ngram").alias("__a"), F.col("n").alias("__na"))
    two = frequencies.select(F.col("ngram").alias("__b"), F.col("n").alias("__nb"))
    out = words.join(one, bare == F.col("__a"), "left").join(two, F.concat(bare, F.lit(TSHEG)) == F.col("__b"), "left")
    return out.withColumn("freq", F.coalesce("__na", "__nb", F.lit(0))).drop("__a", "__b", "__na", "__nb")


def ranked(candidates: DataFrame, frequencies: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(query, word, distance) -> confidence by distance, scaled by log-frequency where counts are given; best ``top`` per query."""
    base = F.when(F.col("distance") == 0, 0.95).when(F.col("distance") == 1, 0.85).when(F.col("distance") == 2, 0.70).otherwise(0.55)
    least = candidates.groupBy("query", "word").agg(F.min("distance").alias("distance"))
    if frequencies is None:
        scored = least.withColumn("confidence", base)
    else:
        most = frequencies.agg(F.max("n").alias("most"))
        log = F.ln(F.col("freq") + 1.0) / F.ln(F.col("most") + 1.0)
        scored = word_frequency(least, frequencies).join(most).withColumn("confidence", F.round(base * (0.85 + 0.15 * log), 2))
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "distance", "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "word", "distance", "confidence", "rank")


def candidates(queries: DataFrame, lexicon: DataFrame, frequencies: DataFrame | None = None, top: int = 5, retrieved: int = TOP) -> DataFrame:
    """Candidates of a dictionary: retrieval within a distance, a scan where it finds nothing, canonical spelling and splits, ranked.

    With frequencies, words seen ``RARE`` times or less may differ by ``RARE_NEAR`` edits. Queries that
    end in a mark get candidates that do.
    """
    # tables: each of them is read several times below
    words = cut(queries.select(F.col("word").alias("raw"), stripped(F.col("word")).alias("word")).where("word <> ''").distinct(), "asked")
    held = cut(lexicon.select(stripped(F.col("word")).alias("word")).where("word <> ''").distinct(), "lexicon")
    asked = words.select("word").distinct()
    caps = asked.withColumn("cap", F.lit(NEAR))
    if frequencies is not None:
        caps = word_frequency(asked, frequencies).select("word", F.when(F.col("freq") <= RARE, RARE_NEAR).otherwise(NEAR).alias("cap"))
    near = cut(retrieve(asked, held, retrieved).select("query", "word"), "retrieved")
    measured = near.withColumn("distance", distance_column("query", "word"))
    missed = asked.join(near.select(F.col("query").alias("word")).distinct(), "word", "left_anti")
    every = measured.unionByName(scan(missed, held, RARE_NEAR if frequencies is not None else NEAR))
    every = every.join(caps.select(F.col("word").alias("query"), "cap"), "query").where((F.col("distance") > 0) & (F.col("distance") <= F.col("cap"))).select("query", "word", "distance")
    for more in (canonical(asked, held), splits(asked, held)):
        every = every.unionByName(more.withColumn("distance", F.lit(1)))
    best = ranked(every, frequencies, top)
    told = words.select("raw", F.col("word").alias("query")).join(best, "query")
    return told.select(F.col("raw").alias("query"), F.when(F.col("raw").endswith(TSHEG), F.concat("word", F.lit(TSHEG))).otherwise(F.col("word")).alias("word"), "distance", "confidence", "rank")


#: Letters, marks and white space that a correction in the script may hold (a pattern).
CLEAN = "^[ཀ-ཬཱ-྇ྐ-ྼ་༌།༎༏ \\t]*$"
LETTER = "[ཀ-ཬཱ-྇ྐ-ྼ]"


def _combined(batches, near: int):
    """Words of several parts: one candidate of each part, all edits together at most ``near``."""
    for batch in batches:
        rows = []
        for query, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            options = [[(o["word"], o["distance"]) for o in p["options"]] or [(p["part"], 0)] for p in sorted(parts, key=lambda p: p["k"])]
            prefixes = [((), 0)]
            for option in options:  # what is too far already goes no further
                prefixes = [((*w, o), d + e) for w, d in prefixes for o, e in option if d + e <= near]
            rows += [(query, TSHEG.join(w), d) for w, d in prefixes if d]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))], ["query", "word", "distance"])


def compound_candidates(queries: DataFrame, lexicon: DataFrame, near: int = NEAR) -> DataFrame:
    """(query, word, distance) for queries of several parts: every part is corrected by itself, the nearest ``PART_KEPT`` of each."""
    asked = queries.where(F.col("word").contains(TSHEG)).select(F.col("word").alias("query")).distinct()
    parts = asked.select("query", F.posexplode(F.split("query", TSHEG)).alias("k", "part"))
    words = parts.where("part <> ''").select(F.col("part").alias("word")).distinct()
    found = _near(words, lexicon, PART_TOP, near).groupBy("query", "word").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "word")
    kept = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PART_KEPT).select("query", "word", "distance")
    known = words.join(lexicon.select("word").distinct(), "word", "left_semi").select(F.col("word").alias("query"), "word", F.lit(0).alias("distance"))
    options = kept.unionByName(known).groupBy(F.col("query").alias("part")).agg(F.sort_array(F.collect_list(F.struct("distance", "word"))).alias("options"))
    none = F.array().cast("array<struct<distance:int,word:string>>")
    grouped = parts.join(options, "part", "left").groupBy("query").agg(F.collect_list(F.struct("k", "part", F.coalesce("options", none).alias("options"))).alias("parts"))
    return grouped.mapInArrow(partial(_combined, near=near), "query string, word string, distance int")


def _acceptable(df: DataFrame) -> DataFrame:
    """For queries in the script, candidates of its letters and marks only."""
    return df.where(~F.col("query").rlike(LETTER) | F.col("word").rlike(CLEAN))


def _near(queries: DataFrame, lexicon: DataFrame, retrieved: int, near: int) -> DataFrame:
    """Retrieval and the words of the same first letter and like length, within a distance."""
    first = _acceptable(retrieve(queries, lexicon, retrieved).select("query", "word"))
    start = F.substring("word", 1, 1)
    asked = queries.where("word <> ''").select(F.col("word").alias("query"), start.alias("first"), F.explode(F.sequence(F.char_length("word") - 2, F.char_length("word") + 2)).alias("n")).distinct()
    held = lexicon.select("word", start.alias("first"), F.char_length("word").alias("n")).distinct()
    second = _acceptable(asked.join(held, ["first", "n"]).where("query <> word").select("query", "word"))
    return first.unionByName(second).distinct().withColumn("distance", distance_column("query", "word")).where((F.col("distance") > 0) & (F.col("distance") <= near))


def provider_candidates(queries: DataFrame, lexicon: DataFrame, frequencies: DataFrame | None = None, kept: int = PROVIDER_KEPT, near: int = NEAR) -> DataFrame:
    """(query, word, distance, rank): candidates that a scoring model chooses from.

    Retrieval and words of the same first letter; where both find nothing, retrieval
    within ``RARE_NEAR`` edits; canonical spelling; splits whose parts are frequent;
    where still nothing is found, a scan; for words of several parts, combinations.
    """
    asked = cut(queries.where("word <> ''").select("word").distinct(), "asked")
    held = cut(lexicon.where("word <> ''").select("word").distinct(), "lexicon")
    found = cut(_near(asked, held, PROVIDER_TOP, near), "near")
    left = asked.join(found.select(F.col("query").alias("word")).distinct(), "word", "left_anti")
    wide = _acceptable(retrieve(left, held, PROVIDER_TOP).select("query", "word")).withColumn("distance", distance_column("query", "word"))
    found = found.unionByName(wide.where((F.col("distance") > 0) & (F.col("distance") <= RARE_NEAR)))
    found = found.unionByName(canonical(asked, held).withColumn("distance", F.lit(1)))
    found = cut(found.unionByName(frequent_splits(asked, held, frequencies).withColumn("distance", F.lit(1))), "near")
    missed = asked.join(found.select(F.col("query").alias("word")).distinct(), "word", "left_anti")
    found = found.unionByName(_acceptable(scan(missed, held, RARE_NEAR)))
    found = found.unionByName(compound_candidates(asked, held, near))
    least = found.groupBy("query", "word").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "word")
    return least.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def frequent_splits(queries: DataFrame, lexicon: DataFrame, frequencies: DataFrame | None = None, least: int = 10) -> DataFrame:
    """(query, word): two parts, the first known with a mark behind, the second with or without, both seen ``least`` times.

    Without counts a known part counts as seen often enough.
    """
    asked = queries.where((F.char_length("word") >= 4) & ~F.col("word").contains(TSHEG)).select(F.col("word").alias("query")).distinct()
    parts = asked.select("query", F.explode(F.sequence(F.lit(2), F.char_length("query") - 2)).alias("k")).select(
        "query", F.concat(F.expr("substring(query, 1, k)"), F.lit(TSHEG)).alias("a"), F.expr("substring(query, k + 1)").alias("b")
    )
    seen = lexicon.select(F.col("word").alias("w"), F.lit(least).alias("n")) if frequencies is None else frequencies.select(F.col("ngram").alias("w"), "n").where(F.col("n") >= least)
    often = seen.where(F.col("n") >= least).select("w").distinct()
    one = parts.join(often, F.col("a") == F.col("w"), "left_semi")
    bare = one.join(often, F.col("b") == F.col("w"), "left_semi").select("query", F.concat("a", "b").alias("word"))
    marked = one.join(often, F.concat("b", F.lit(TSHEG)) == F.col("w"), "left_semi")
    told = marked.select("query", F.explode(F.array(F.concat("a", "b"), F.concat("a", "b", F.lit(TSHEG)))).alias("word"))
    return bare.unionByName(told).distinct()


def fits_marks(word: Column, candidate: Column, following: Column) -> Column:
    """Whether a candidate's closing mark agrees with the word's and with what follows it."""
    has, had, there = candidate.endswith(TSHEG), word.endswith(TSHEG), F.coalesce(following == TSHEG, F.lit(False))
    doubled = has & there
    brought = has & ~had & (F.concat(word, F.lit(TSHEG)) != candidate)
    dropped = had & ~has & ~there
    return ~(doubled | brought | dropped)


def best_hybrid(scored: DataFrame, threshold: float = 0.5, key: tuple[str, ...] = ("query",)) -> DataFrame:
    """(key, word, confidence) of rows (key, query, word, distance, model, context): the best of model, context and distance.

    The confidence told is the model's own; below the threshold nothing is. Ties go to the greater word.
    """
    far = F.when(F.col("word") == vowel_before_consonant(F.col("query")), 0.5).otherwise(F.col("distance").cast("double"))
    rows = scored.withColumn("__hybrid", F.round(0.4 * F.col("model") + 0.6 * F.col("context") - 0.15 * far, 9))
    best = rows.groupBy(*key).agg(F.max(F.struct("__hybrid", "word", "model")).alias("b"))
    return best.where(F.col("b.model") >= threshold).select(*key, "b.word", F.col("b.model").alias("confidence"))


def reranked(found: DataFrame, scores: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Candidates (query, word, confidence, rank) by a model's scores (query, word, score), which replace the confidence where there are any."""
    rows = found if scores is None else found.join(scores, ["query", "word"], "left").withColumn("confidence", F.coalesce(F.round("score", 3), "confidence")).drop("score")
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def guarded(df: DataFrame, word: str, replacement: str, confidence: str, lexicon: DataFrame, bigrams: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """Add ``safe``: whether a replacement may be made.

    It must be sure enough; known as a whole, by all of its syllables, or as a counted
    pair; of the script only, for words of it; at most two letters longer and a fifth
    longer or shorter; and right in the structure of every syllable.
    """
    from loomwork.operators.morphology import violation_column

    known = lexicon.select(stripped(F.col("word")).alias("__k")).where("__k <> ''").distinct()
    rows = df.withColumn("__r", stripped(F.col(replacement)))
    distinct = rows.select("__r").where("__r is not null").distinct()
    parts = F.filter(F.split("__r", TSHEG), lambda s: stripped(s) != "")
    marked = distinct.select("__r", F.size(parts).alias("__n"), F.explode_outer(F.array_distinct(F.transform(parts, lambda s: stripped(s)))).alias("__p"))
    whole = distinct.join(known, F.col("__r") == F.col("__k"), "left_semi").select("__r")
    by_parts = marked.where("__n > 0").join(known.withColumn("__hit", F.lit(1)), F.col("__p") == F.col("__k"), "left").groupBy("__r").agg(F.count_if(F.col("__hit").isNull()).alias("__miss")).where("__miss = 0").select("__r")
    attested = whole.unionByName(by_parts)
    if bigrams is not None:
        pair = F.array_join(F.transform(parts, lambda s: s), " ")
        attested = attested.unionByName(distinct.join(bigrams.where("n > 0").select(F.col("ngram").alias("__g")), pair == F.col("__g"), "left_semi").select("__r"))
    attested = attested.distinct().withColumn("__attested", F.lit(True))
    letters = lambda c: F.regexp_count(c, F.lit("[ཀ-ཬཱ-྅ྐ-ྼ]"))
    before, after = letters(F.col(word)), letters(F.col(replacement))
    grows = (before > 0) & ((after - before > 2) | (F.abs(after - before) / before > 0.20))
    script = ~F.col(word).rlike("[ཀ-ཬཱ-྅ྐ-ྼ]") | F.col(replacement).rlike("^[ཀ-ཬཱ-྅ྐ-ྼ་༌།༎༏]+$")
    safe = F.col("__attested").isNotNull() & (F.col(confidence) >= least) & script & ~grows & violation_column(replacement).isNull()
    joined = rows.join(attested, "__r", "left")
    return joined.withColumn("safe", F.coalesce(safe, F.lit(False))).drop("__r", "__attested")
