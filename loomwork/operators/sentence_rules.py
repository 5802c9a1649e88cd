"""The grammar rules that need no lexicon, told for whole batches of sentences.

``findings`` gives the rows of ``grammar.findings(grammar.neighbours(sentences))``.
The nodes of a batch are laid end to end. What the rules ask of a text (``asked``)
follows once for each distinct text; everything else is arithmetic on numbers of
texts, categories and relations, and strings are made for the findings alone.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwork.functions.script import FINALS
from loomwork.operators import grammar as g
from loomwork.session import prepare

FAMILIES = (
    ("Genitive", g.ALL_GENITIVE, g.GENITIVE, "གི"), ("Ergative", g.ALL_ERGATIVE, g.ERGATIVE, "གིས"),
    ("Interrogative", g.ALL_INTERROGATIVE, g.INTERROGATIVE, "འམ"), ("Sentence-final", g.ALL_FINAL, g.FINAL, "འོ"),
)
CLOSINGS = (*FINALS, "open")
#: The wanted form, and its family's name, by family and closing consonant.
FORMS = pa.array([table.get(c, default) for _, _, table, default in FAMILIES for c in CLOSINGS])
NAMES = pa.array([name for name, *_ in FAMILIES for _ in CLOSINGS])
#: Forms that are right after any consonant; genitives and ergatives stand anywhere, the others close something.
ANYWHERE, FREE = ("འི", "ཡི", "ས", "ཡིས"), 2
WE, IS, WHEEL = ("ང་ཚོ", "ང"), "ཡིན", "ཆོས་སྒོར"
#: Distinct texts that are remembered, and characters up to which one is.
REMEMBERED, SHORT = 1 << 16, 64
#: Pairs of an object and a root that are told at once, and bytes of their texts.
PAIRS, PAIR_BYTES = 1 << 16, 16 << 20
STRING = pa.string()


class Asked(NamedTuple):
    """What the rules ask of a node's text; all of it is false of none."""

    word: str | None = None
    family: int = -1
    closing: int = 0
    existential: str | None = None
    polite: str | None = None
    copula: str | None = None
    plain: str | None = None
    there: bool = False
    aspect: bool = False
    verb: bool = False
    anywhere: bool = False
    nowadays: bool = False
    once: bool = False
    land: bool = False
    long: bool = False
    first: bool = False
    we: bool = False
    is_: bool = False
    wheel: bool = False


def closing(word: str) -> int:
    """``script.final_consonant``, as its number in ``CLOSINGS``."""
    last = word.strip("་། ").rpartition("་")[2]
    letters = [c for c in last if "ཀ" <= c <= "ཪ"]
    if last.endswith("འ"):
        return CLOSINGS.index("འ")
    open_ = len(letters) <= 1 or "ཱ" <= last[-1] <= "྇" or "ྐ" <= last[-1] <= "ྼ"
    return len(FINALS) if open_ or letters[-1] not in FINALS else CLOSINGS.index(letters[-1])


def asked(text: str | None) -> Asked:
    if text is None:
        return Asked()
    word = text.strip("་ །")
    return Asked(
        word, next((k for k, (_, forms, *_) in enumerate(FAMILIES) if word in forms), -1), closing(word), g.EXISTENTIAL.get(word), next((v for k, v in g.HONORIFIC.items() if word.startswith(k)), None), g.COPULA.get(word),
        g.NOMINALIZED.get(word), word != "", word == "གི", word in g.ASPECT_VERBS, word in ANYWHERE, word == g.NOWADAYS, word not in g.MAY_REPEAT, word == g.LAND, len(text.strip("་ ")) > 1, word in g.FIRST_PERSON, word in WE,
        word == IS, WHEEL in word,
    )


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """The number of each value among the distinct ones; null is the last of these."""
    told = values.dictionary_encode()
    return told.indices.fill_null(len(told.dictionary)).to_numpy(zero_copy_only=False), [*told.dictionary.to_pylist(), None]


def joined(*parts, between: str = "", nulls: str = "emit_null") -> pa.Array:
    return pc.binary_join_element_wise(*parts, between, null_handling=nulls)


class Batch:
    """The sentences of a batch, with their nodes end to end."""

    def __init__(self, batch: pa.RecordBatch, memo: dict[str, Asked]):
        self.ids, starts, self.text, nodes = (batch.column(name) for name in ("doc_id", "sent_start", "text", "nodes"))
        offsets = nodes.offsets.to_numpy().astype(np.int64)
        values = nodes.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        counts = np.diff(offsets)
        self.size, self.sentences = int(offsets[-1]), len(counts)
        self.sentence = np.repeat(np.arange(self.sentences), counts)
        self.first, at = offsets[self.sentence], np.arange(self.size)
        self.opens, self.ends = at == self.first, at == offsets[self.sentence + 1] - 1
        texts, self.starts, self.stops, categories, relations = (pc.struct_field(values, name) for name in ("text", "start", "end", "category", "relation"))
        self.sent_start = starts.cast(pa.int64())
        self.texts, (self.code, distinct) = texts, coded(texts)
        self.category, self.categories = coded(categories)
        self.relation, self.relations = coded(relations)
        told = [memo.get(t) or asked(t) for t in distinct]
        if len(memo) > REMEMBERED:
            memo.clear()
        memo.update((t, x) for t, x in zip(distinct, told, strict=True) if t is not None and len(t) <= SHORT)
        self.told = Asked(*map(list, zip(*told, strict=True)))
        self.null = len(distinct) - 1
        self.words = pa.array(self.told.word, STRING)
        numbers: dict[str | None, int] = {}
        self.number = np.array([numbers.setdefault(w, len(numbers)) for w in self.told.word])
        self.left = self.before(self.code, self.null)

    def is_a(self, *categories: str) -> np.ndarray:
        return np.array([c in categories for c in self.categories])[self.category]

    def stands_as(self, *relations: str) -> np.ndarray:
        return np.array([r in relations for r in self.relations])[self.relation]

    def before(self, codes: np.ndarray, none: int) -> np.ndarray:
        out = np.concatenate(([none], codes[:-1]))
        out[self.opens] = none
        return out

    def after(self, codes: np.ndarray, none: int) -> np.ndarray:
        out = np.concatenate((codes[1:], [none]))
        out[self.ends] = none
        return out

    def of(self, name: str, codes: np.ndarray | None = None) -> np.ndarray:
        """A number or truth of each node's text."""
        return np.array(getattr(self.told, name))[self.code if codes is None else codes]

    def fixed(self, name: str) -> tuple[pa.Array, np.ndarray]:
        """The replacements by text, and which nodes have one."""
        fixes = getattr(self.told, name)
        return pa.array(fixes, STRING), np.array([x is not None for x in fixes])[self.code]

    def says(self, parts, null: bool = False) -> np.ndarray:
        """Whether the node's sentence contains one of ``parts``; ``null`` is the answer for a sentence without text."""
        out = np.zeros(self.sentences, bool)
        for p in parts:
            out |= pc.match_substring(self.text, p).fill_null(null).to_numpy(zero_copy_only=False)
        return out[self.sentence]

    def has(self, which: np.ndarray) -> np.ndarray:
        """Whether any node of the node's sentence is one of ``which``."""
        out = np.zeros(self.sentences, bool)
        out[self.sentence[which]] = True
        return out[self.sentence]

    def word(self, at: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.code[at]))

    def rows(self, parts: list[tuple]) -> pa.RecordBatch:
        """Findings from (places, replacement, score, priority, message)."""
        at = np.concatenate([p[0] for p in parts])
        nodes, sentences = pa.array(at), pa.array(self.sentence[at])
        place = lambda c: pc.add(self.sent_start.take(sentences), c.take(nodes).cast(pa.int64()))
        every = lambda k: pa.concat_arrays([pa.repeat(pa.scalar(p[k]), len(p[0])) for p in parts])
        texts = lambda k: pa.concat_arrays([p[k] for p in parts])
        return pa.RecordBatch.from_arrays(
            [self.ids.take(sentences), place(self.starts), place(self.stops), texts(1), every(2), every(3), texts(4)],
            ["doc_id", "char_start", "char_end", "replacement", "score", "priority", "message"],
        )


def particles(b: Batch, score: float):
    """``grammar.particle_rule``"""
    family, left = b.of("family"), b.left
    closes = (b.ends | b.after(b.is_a("PUNCTUATION"), False) | b.is_a("PARTICLE")) & ~b.is_a("NOUN", "ADVERB")
    verbal = b.before(b.is_a("VERB") | b.stands_as("root", "aux"), False) | b.of("verb", left)
    applies = np.where(family < FREE, ~(b.of("aspect") & verbal) & ~b.of("anywhere"), closes)
    at = np.flatnonzero((family >= 0) & applies & b.of("there", left))
    form = family[at] * len(CLOSINGS) + b.of("closing", left[at])
    wrong = pc.not_equal(FORMS.take(pa.array(form)), b.word(at)).to_numpy(zero_copy_only=False)
    at, form = at[wrong], pa.array(form[wrong])
    wanted = FORMS.take(form)
    said = joined(NAMES.take(form), ' particle agreement error: "', b.words.take(pa.array(left[at])), '" should take "', wanted, '" instead of "', b.word(at), '"')
    yield at, wanted, score, "HIGH", said


def replaced(b: Batch, name: str, where, score: float, priority: str, said: tuple[str, str, str], word_first: bool = False):
    """Words with a fixed replacement, where ``where`` holds."""
    fixes, there = b.fixed(name)
    at = np.flatnonzero(there & where) if there.any() else np.zeros(0, np.int64)
    fix, word = fixes.take(pa.array(b.code[at])), b.word(at)
    two = (word, fix) if word_first else (fix, word)
    yield at, fix, score, priority, joined(said[0], two[0], said[1], two[1], said[2])


def existential(b: Batch, score: float):
    yield from replaced(b, "existential", True, score, "HIGH", ('[TIB-EXIST-001] Invalid existential verb spelling "', '" -> suggest "', '"'), True)


def honorific(b: Batch, score: float):
    said = ('[TIB-HONOR-001] Honorific agreement suggestion: honorific subject present, consider "', '" instead of plain verb "', '" (depending on register)')
    yield from replaced(b, "polite", b.says(g.HONORED), score, "LOW", said)


def copula(b: Batch, score: float):
    said = ('[TIB-COP-001] Copula agreement check: 1st person subject typically pairs with "', '" rather than "', '". Depending on dialect and register, this may be acceptable.')
    yield from replaced(b, "copula", b.has(b.of("first")), score, "LOW", said)


def nominalizer(b: Batch, score: float):
    said = ('[TIB-NOM-001] Redundant nominalizer: sentence-final declarative clause should end with copula "', '" instead of nominalized "', '".')
    yield from replaced(b, "plain", b.ends, score, "HIGH", said)


def told(at: np.ndarray, replacement: str | None, score: float, priority: str, message: str):
    yield at, pa.repeat(pa.scalar(replacement, STRING), len(at)), score, priority, pa.repeat(pa.scalar(message), len(at))


def temporal(b: Batch, score: float):
    said = f'[TIB-TEMP-001] Temporal adverb context check: "{g.NOWADAYS}" means "nowadays"; suggest "{g.TODAY}" for today'
    yield from told(np.flatnonzero(b.of("nowadays") & b.says((g.TODAY, g.HAPPENED))), g.TODAY, score, "MEDIUM", said)


def repeated(b: Batch, score: float = 0.90):
    at = np.flatnonzero((b.number[b.code] == b.number[b.left]) & b.of("there") & b.of("once"))
    yield at, pa.nulls(len(at), STRING), score, "HIGH", joined('Duplicate repeated word detected: "', b.word(at), '" is repeated sequentially.')


def demonym(b: Batch, score: float = 0.90):
    there = b.of("land")
    if there.any():  # a node without text may be anything, so nothing is said of its sentence
        there = there & b.has(b.of("we")) & b.has(b.of("is_")) & ~b.has(b.of("wheel") | (b.code == b.null))
    yield from told(np.flatnonzero(there), g.DEMONYM, score, "HIGH", f'Logical Mismatch: First-person subject "ང་" with "{g.LAND}་" requires demonym suffix "བོད་པ"')


def order(b: Batch, score: float):
    """Every object behind every root before it; a bounded number of these pairs at once."""
    late = np.flatnonzero(b.stands_as(*g.OBJECTS) & b.of("long") & ~b.says(g.REPORTED, null=True))
    roots = np.flatnonzero(b.stands_as("root"))
    least = np.searchsorted(roots, b.first[late])
    counts = np.searchsorted(roots, late) - least
    ends = np.cumsum(counts)
    longest = pc.max(pc.binary_length(b.texts)).as_py() or 1
    step = max(1, min(PAIRS, PAIR_BYTES // longest))
    for a in range(0, int(ends[-1]) if len(ends) else 0, step):
        pair = np.arange(a, min(a + step, int(ends[-1])))
        q = np.searchsorted(ends, pair, "right")
        at = late[q]
        node, root = b.texts.take(pa.array(at)), b.texts.take(pa.array(roots[least[q] + pair - (ends[q] - counts[q])]))
        said = joined('[TIB-SOV-001] SOV Word Order: Object "', node, '" appears after verb "', root, '". Consider placing object before verb.')
        yield at, joined(node, root, between=" ", nulls="skip"), score, "LOW", said


RULES = {
    "TIB-PART-001": particles, "TIB-EXIST-001": existential, "TIB-TEMP-001": temporal, "TIB-HONOR-001": honorific,
    "TIB-COP-001": copula, "TIB-NOM-001": nominalizer,
}


def _found(batches, scores: dict[str, float], demonyms: bool):
    memo: dict[str, Asked] = {}
    for batch in batches:
        b = Batch(batch, memo)
        if not b.size:
            continue
        parts = [part for k, rule in RULES.items() if k in scores for part in rule(b, scores[k])]
        yield b.rows([*parts, *repeated(b), *(demonym(b) if demonyms else ())])
        if "TIB-SOV-001" in scores:
            for part in order(b, scores["TIB-SOV-001"]):
                yield b.rows([part])


def findings(sentences: DataFrame, registry: g.Registry | None = None, source: str = "grammar", demonyms: bool = False) -> DataFrame:
    """Findings of all rules that need no lexicon, from sentences (doc_id, sent_start, text, nodes)."""
    registry = registry or g.Registry()
    prepare(sentences.sparkSession)
    scores = {k: float(registry.score(k)) for k in registry.rules if registry.enabled(k)}
    schema = T.StructType().add("doc_id", sentences.schema["doc_id"].dataType)
    for name, kind in (("char_start", "long"), ("char_end", "long"), ("replacement", "string"), ("score", "double"), ("priority", "string"), ("message", "string")):
        schema = schema.add(name, kind)
    rows = sentences.select("doc_id", "sent_start", "text", "nodes")
    return g.as_findings(rows.mapInArrow(partial(_found, scores=scores, demonyms=demonyms), schema), source)
