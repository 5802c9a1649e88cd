"""Contextual rules: words that are right by themselves and wrong where they stand.

Rules are data. A ``Place`` is tried in order at every word; the first whose word
fits decides, and it tells a finding if its context fits too. A table of confused
spellings (wrong, right) goes before all of them; it may hold compounds of two or three
words, written with marks, spaces or together, and is joined, so it may have any size.

Words lie beside their neighbours without a shuffle. The table is asked once for each
distinct word with the two behind it; only findings are grouped by sentence, to leave out
what a longer finding before them has covered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.spans import matches_column
from loomwork.operators.grammar import neighbours, stripped
from loomwork.shared import cut

#: Words between marks, shads and white space.
WORD = "[^་།\\s]+"
# Words that are left alone, and what may follow an adjective.
SAFE = ("གནད", "བཤད", "འཇིག", "གསོན", "དཔེ", "ཤེས", "བཟང", "ནུས", "ཏན")
AFTER_ADJECTIVE = ("པོ", "བོ", "གྱི", "གི", "ཀྱི", "འི", "ཡི", "ནི", "དང")
#: Spellings that hold where the table has none for a word.
FALLBACKS = {"བཅང": "ཅང"}


@dataclass(frozen=True)
class Place:
    """``words``: exact words, or ``starts``: their beginnings; the rule decides if they fit (and ``if_*`` do).

    The finding is told if the other conditions hold: beginnings or whole forms of the
    words beside it, and texts in the sentence. ``width`` words are covered and the
    ``skips`` words behind left out.
    """

    code: str
    kind: str
    fix: str
    words: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    not_starts: tuple[str, ...] = ()
    if_next: tuple[str, ...] = ()
    if_next_starts: tuple[str, ...] = ()
    if_left: tuple[str, ...] = ()
    if_left_starts: tuple[str, ...] = ()
    if_left_or_next: tuple[tuple[str, ...], tuple[str, ...]] = ()
    unless_left: tuple[str, ...] = ()
    unless_left_starts: tuple[str, ...] = ()
    unless_next_starts: tuple[str, ...] = ()
    unless_after: tuple[str, ...] = ()
    needs_left_starts: tuple[str, ...] = ()
    needs_next_starts: tuple[str, ...] = ()
    needs_any: tuple[str, ...] = ()
    needs_left_or_next_starts: tuple[tuple[str, ...], tuple[str, ...]] = ()
    width: int = 1
    skips: int = 0


# The rules, in the order in which they are tried.
PAIRS = (
    Place("SPELLING_FALLBACK_BCANG_PO", "SPELLING", "ཆང་པོ", words=("བཅང",), if_next=("པོ",), width=2),
    Place("SPELLING_FALLBACK_CHEN_PHO", "SPELLING", "ཆེན་པོ", words=("ཆེན",), if_next=("ཕོ",), width=2),
    Place("SPELLING_FALLBACK_HA_BCANG", "SPELLING", "ཧ་ཅང", words=("ཧ",), if_next=("བཅང",), width=2),
)
PLACES = (
    Place("CONTEXT_JIG_JIGTEN", "CONTEXTUAL_SEMANTIC", "འཇིག་རྟེན", words=("ཇིག",), if_next_starts=("བརྟེན",)),
    Place("", "", "", words=SAFE),
    Place("VERB_FORM_BYAS_NI", "CONTEXTUAL_SEMANTIC", "བྱེད་པ", words=("བྱས",), if_next=("ནི",), width=2),
    Place("VERB_FORM_BYAS_CHED", "TENSE_MISMATCH", "བྱེད་ཆེད", words=("བྱས",), if_next=("ཆེད",), width=2),
    Place("ADJ_NOMINALIZATION", "CONTEXTUAL_SEMANTIC", "གལ་ཆེན་པོ", words=("གལ",), if_next=("ཆེན",), unless_after=AFTER_ADJECTIVE, width=2),
    Place("VERB_NOMINALIZATION", "CONTEXTUAL_SEMANTIC", "མེད་པ", words=("མེད",), unless_left=("མི", "མ"), unless_next_starts=("པ", "བ", "ན")),
    Place("SPELLING_BSBYONG_SBYONG", "SPELLING", "སྦྱོང", words=("བསྦྱོང",)),
    Place("CONTEXT_NAD_GNAD", "CONTEXTUAL_SEMANTIC", "གནད", words=("ནད",), if_left_starts=("གལ",)),
    Place("CONTEXT_SHAD_BSHAD", "CONTEXTUAL_SEMANTIC", "བཤད", words=("ཤད",), if_left_or_next=(("སྐོར",), ("པ",))),
    Place("CONTEXT_SON_GSON", "CONTEXTUAL_SEMANTIC", "གསོན", words=("སོན",), if_next_starts=("པོ",)),
    Place("CONTEXT_BSHES_SHES", "CONTEXTUAL_SEMANTIC", "ཤེས", words=("བཤེས",), if_next=("བྱ",)),
    Place("CONTEXT_ZANG_BZANG", "CONTEXTUAL_SEMANTIC", "བཟང", words=("ཟང",), if_next_starts=("བསྤྱོད",)),
    Place("CONTEXT_MNUS_NUS", "CONTEXTUAL_SEMANTIC", "ནུས", words=("མནུས",)),
    Place("CONTEXT_BTAN_TAN", "CONTEXTUAL_SEMANTIC", "ཏན", words=("བཏན",), if_left=("ཡོན",)),
    Place("STRUCTURAL_SLABS_BSLABS", "STRUCTURAL", "བསླབས", words=("སླབས",)),
    Place("SPELLING_KLO_KLOG", "SPELLING", "ཀློག", words=("ཀློ",)),
    Place(
        "CONTEXT_DAG_DGE", "CONTEXTUAL_SEMANTIC", "དགེ", starts=("དག",), not_starts=("དགེ", "དགོ"), unless_left_starts=("དེ", "འདི", "ཁོ", "ང་", "རྣམ"),
        needs_next_starts=("གིས",), needs_any=("སློབ་", "སླབས", "བརྡ་སྤྲོད"),
    ),
    Place("CONTEXT_PAR_BRDA", "CONTEXTUAL_SEMANTIC", "བརྡ", words=("པར",), needs_next_starts=("སྤྲོ",), needs_any=("དགེ", "གིས")),
    Place("CONTEXT_SPRO_SPROD", "CONTEXTUAL_SEMANTIC", "སྤྲོད", words=("སྤྲོ",), unless_left_starts=("དགའ",), needs_left_or_next_starts=(("པར", "བརྡ"), ("གསར་",))),
    Place("CONTEXT_BONG_SBYONG", "CONTEXTUAL_SEMANTIC", "སྦྱོང", words=("བོང",), unless_next_starts=("བུ", "ཚད"), needs_any=("ཡིག་ཆ", "ཡི་གེ་", "ང་ཚོས", "སློབ་", "ཀློ")),
    Place("TENSE_BYA_BYAS", "TENSE_MISMATCH", "བྱས", words=("བྱ",), unless_next_starts=("བ", "རྒྱུ", "དངོས", "དེ", "པ"), needs_left_starts=("བོང", "སྦྱོང")),
    Place(
        "TENSE_PHYI_PHYIN", "TENSE_MISMATCH", "ཕྱིན", words=("ཕྱི",), unless_next_starts=("ར", "འི", "རོལ", "རྒྱལ", "མོ", "ལ"), needs_left_starts=("ལ", "ཏུ", "རུ", "སུ"),
        needs_any=("དེ་རིང", "སློབ་ཚན"),
    ),
)
#: (negation, verb, right form): negations that ask for another tense.
TENSES = (("མི", "བྱས", "མ་བྱས"), ("མ", "བྱ", "བྱས"))

#: A word and the two behind it: what the table of confused spellings is asked.
TRIPLE = ("word", "right", "after")
#: Words covered by a finding that no other one hides.
ALWAYS = -1


def sentence_words(sentences: DataFrame) -> DataFrame:
    """Sentences (doc_id, sent_idx, sent_start, text) with their words as nodes."""
    found = F.transform(matches_column(F.col("text"), WORD), lambda m: F.struct(
        m["matched"].alias("text"), m["char_start"].alias("start"), m["char_end"].alias("end"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("relation")))
    return sentences.select("doc_id", "sent_idx", "sent_start", "text", found.alias("nodes"))


def _starts(c: Column, forms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in forms:
        out = out | F.coalesce(c.startswith(f), F.lit(False))
    return out


def _is(c: Column, forms: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*forms), F.lit(False)) if forms else F.lit(False)


def _decides(p: Place) -> Column:
    word, left, right = F.col("word"), F.col("left"), F.col("right")
    out = _is(word, p.words) if p.words else _starts(word, p.starts) & ~_starts(word, p.not_starts)
    for names, column, test in ((p.if_next, right, _is), (p.if_next_starts, right, _starts), (p.if_left, left, _is), (p.if_left_starts, left, _starts)):
        if names:
            out = out & test(column, names)
    if p.if_left_or_next:
        out = out & (_is(left, p.if_left_or_next[0]) | _is(right, p.if_left_or_next[1]))
    if p.unless_after:
        out = out & ~_is(F.col("after"), p.unless_after)
    if p.code == "VERB_NOMINALIZATION":  # goes on to the next rule where it does not hold
        out = out & ~_is(left, p.unless_left) & ~_starts(right, p.unless_next_starts)
    return out


def _holds(p: Place) -> Column:
    word_left, word_right = F.col("left"), F.col("right")
    out = F.lit(bool(p.code)) & ~_is(word_left, p.unless_left) & ~_starts(word_left, p.unless_left_starts) & ~_starts(word_right, p.unless_next_starts)
    if p.needs_left_starts:
        out = out & _starts(word_left, p.needs_left_starts)
    if p.needs_next_starts:
        out = out & _starts(word_right, p.needs_next_starts)
    if p.needs_left_or_next_starts:
        out = out & (_starts(word_left, p.needs_left_or_next_starts[0]) | _starts(word_right, p.needs_left_or_next_starts[1]))
    if p.needs_any:
        there = F.lit(False)
        for text in p.needs_any:
            there = there | F.col("text").contains(text)
        out = out & there
    return out


FOUND = T.StructType().add("code", "string").add("kind", "string").add("fix", "string").add("width", "integer").add("skips", "integer")


def _told(p: Place) -> Column:
    return F.struct(F.lit(p.code).alias("code"), F.lit(p.kind).alias("kind"), F.lit(p.fix).alias("fix"), F.lit(p.width).alias("width"), F.lit(p.skips).alias("skips"))


def _chain(places: tuple[Place, ...]) -> Column:
    out = None
    for p in places:
        told = F.when(_holds(p), _told(p))
        out = F.when(_decides(p), told) if out is None else out.when(_decides(p), told)
    return out


def keys(rows: DataFrame) -> DataFrame:
    """(word, right, after, rank, width, key): what may stand in the table of confused spellings at each word, longest first."""
    w = [F.col("word"), F.col("right"), F.col("after")]
    options = []
    for width in (3, 2):
        for rank, mark in enumerate(("་", " ", "")):
            options.append(F.when(w[width - 1].isNotNull(), F.struct(F.lit(3 * (3 - width) + rank).alias("rank"), F.lit(width).alias("width"), F.concat_ws(mark, *w[:width]).alias("key"))))
    options.append(F.struct(F.lit(99).alias("rank"), F.lit(1).alias("width"), w[0].alias("key")))
    return rows.select("word", "right", "after", F.explode(F.array(*options)).alias("o")).where("o is not null").select("word", "right", "after", "o.*")


def findings(sentences: DataFrame, confused: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, char_start, char_end, code, kind, fix) of sentences (doc_id, sent_idx, sent_start, text).

    ``confused`` is (wrong, right). Places are those of the document.
    """
    flat = neighbours(sentence_words(sentences))
    table = confused.select(stripped(F.col("wrong")).alias("key"), F.col("right").alias("fix")).where("key <> '' and fix <> ''").groupBy("key").agg(F.min("fix").alias("fix"))
    hits = keys(flat.select("word", "right", "after").distinct()).join(table, "key").groupBy("word", "right", "after").agg(F.min(F.struct("rank", "width", "fix")).alias("h"))
    hits = cut(hits.select(*(F.col(c).alias(f"__{c}") for c in TRIPLE), "h"), "hits")
    place = ["doc_id", "sent_idx", "i"]
    ends = {1: F.col("end"), 2: F.col("right_end"), 3: F.col("after_end")}
    fallback = lambda fix: F.struct(F.lit("SPELLING_FALLBACK").alias("code"), F.lit("SPELLING").alias("kind"), fix.alias("fix"), F.lit(1).alias("width"), F.lit(0).alias("skips"))
    single = None
    for word, fix in FALLBACKS.items():
        told = F.when(F.col("word") == word, fallback(F.lit(fix)))
        single = told if single is None else F.coalesce(single, told)
    tense = None
    for negation, verb, fix in TENSES:
        hit = (F.col("word") == verb) & (F.col("left") == negation)
        tense = F.when(hit, F.lit(fix)) if tense is None else tense.when(hit, F.lit(fix))
    # what the sentence says is found before the rows meet the table: they take no texts along
    known = flat.select(
        *place, "sent_start", "start", "end", "right_end", "after_end", *TRIPLE, _chain(PAIRS).alias("pair"), F.coalesce(single, _chain(PLACES)).alias("other"), tense.alias("tense"),
    )
    same = (F.col("word") == F.col("__word")) & F.col("right").eqNullSafe(F.col("__right")) & F.col("after").eqNullSafe(F.col("__after"))
    compound = F.struct(F.lit("SPELLING_FALLBACK_COMPOUND").alias("code"), F.lit("SPELLING").alias("kind"), F.col("h.fix").alias("fix"), F.col("h.width").alias("width"), F.lit(0).alias("skips"))
    first = F.when(F.col("h.width") > 1, compound).otherwise(F.coalesce(F.col("pair"), F.when(F.col("h").isNotNull(), fallback(F.col("h.fix"))), F.col("other")))
    found = known.join(hits, same, "left").withColumn("f", first)
    end = F.when(F.col("f.width") == 3, ends[3]).when(F.col("f.width") == 2, ends[2]).otherwise(ends[1])
    begin = F.col("sent_start") + F.col("start")
    fields = lambda end, code, kind, fix, covers: F.struct((F.col("sent_start") + end).alias("char_end"), code.alias("code"), kind.alias("kind"), fix.alias("fix"), covers.alias("covers"))
    said = F.when(F.col("f").isNotNull(), fields(end, F.col("f.code"), F.col("f.kind"), F.col("f.fix"), F.col("f.width") - 1 + F.col("f.skips")))
    wrong = F.when(F.col("tense").isNotNull(), fields(F.col("end"), F.lit("TENSE_MI_MA"), F.lit("TENSE_MISMATCH"), F.col("tense"), F.lit(ALWAYS)))
    told = found.where("f is not null or tense is not null").select(*place, begin.alias("char_start"), F.explode_outer(F.array(said, wrong)).alias("x"))
    return without_covered(told.where("x is not null").select(*place, "char_start", "x.*"))


def without_covered(found: DataFrame) -> DataFrame:
    """Findings of a sentence from left to right, without those that one before them covers; those that cover ``ALWAYS`` stay and cover nothing."""
    fields = ["i", "char_start", "char_end", "code", "kind", "fix", "covers"]
    grouped = found.groupBy("doc_id", "sent_idx").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("fs"))
    none = F.slice(F.col("fs"), 1, 0)
    begin = F.struct(F.lit(-1).alias("until"), none.alias("kept"))
    def step(s, f):
        always, fresh = f["covers"] == ALWAYS, f["i"] > s["until"]
        return F.struct(F.when(fresh & ~always, f["i"] + f["covers"]).otherwise(s["until"]).alias("until"), F.when(fresh | always, F.concat(s["kept"], F.array(f))).otherwise(s["kept"]).alias("kept"))

    kept = grouped.withColumn("kept", F.aggregate("fs", begin, step, lambda s: s["kept"]))
    return kept.select("doc_id", "sent_idx", F.explode_outer("kept").alias("f")).where("f is not null").select("doc_id", "sent_idx", "f.char_start", "f.char_end", "f.code", "f.kind", "f.fix")
