"""BPE encoding and decoding by forced-boundary splitting.

A merge of byte-pair encoding always yields a vocabulary token, so two bytes
that stand side by side in no token can never be joined: between them is a
certain cut. The encoder marks these cuts inside every new pre-token, encodes
the fragments between them independently, many at a time as rows of an array,
and concatenates their ids. Only the last fragment of a pre-token carries the
end-of-word suffix. Pre-tokens met before are looked up in a bounded memo; when its
younger half is full, that becomes the older one, and the older one is forgotten.

Defined results: a null or empty text (or one of white space alone) has no ids;
no ids decode to the empty string; null ids decode to the empty string. An id
outside the vocabulary decodes to nothing, as in the library. Existing columns
with the name of an output column are replaced, all others are kept. Texts of any
length are taken whole; long pre-tokens, those of white-space-free texts too, are
cut at their boundaries like others, and a fragment of more than ``ARRAY_SYMBOLS``
bytes is merged by the library's queue, in the same way, so that none costs its
square. Equal texts get equal ids; nothing depends on row order or on partitions.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import caches
from loomwork.session import prepare

#: The normalizer and pattern of pre-tokens that the short way below stands for; files with
#: others go through the library's own normalizer and splitter (fixed values of the format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: White space below U+0250 other than the space (fixed values).
WHITE = "\n\t\x0b\x0c\r\x85\xa0"
#: Characters whose classes depend on the version of Unicode: texts with any go
#: through the library's own normalizer and splitter, so that results agree.
ODD = re.compile("[^\x00-\u024f]").search
#: Pre-tokens a worker remembers, about 200 bytes each, and the longest of them: bounds its memory.
MEMO_WORDS = 1_500_000
MEMO_CHARS = 64
#: Texts encoded together, and the longest fragment for the array encoder.
TEXTS_AT_ONCE = 256
ARRAY_SYMBOLS = 64
#: Pre-tokens of texts whose characters are all below U+0250: runs of letters,
#: contractions, single digits, runs of other signs.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
SIMPLE_WORDS = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^ {LETTERS}{DIGITS}]+").findall
FAR = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBpe:
    """A BPE vocabulary file with end-of-word suffix, split at forced boundaries."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec, vocab, merges = self._read(path)
        model = spec["model"]
        self.path = path
        self.suffix = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.joined = np.zeros((256, 256), dtype=bool)  # pairs found inside some token
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.tokens: list[bytes] = [b""] * size
        self.texts: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = token.encode("utf-8")
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            body = bytes(byte_of[c] for c in (token[: -len(self.suffix)] if ends else token) if c in byte_of)
            self.texts[i] = body + b" " * ends
            for x, y in zip(body, body[1:], strict=False):
                self.joined[x, y] = True
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.special.items():
            self.tokens[i] = self.texts[i] = content.encode("utf-8")
        self.known = np.array([bool(t) for t in self.tokens])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.short_way = split == PATTERN and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
        self.splitter = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        empty = {"type": "BPE", "vocab": {}, "merges": []}
        self.normalizer = Tokenizer.from_str(json.dumps({"version": "1.0", "normalizer": spec["normalizer"], "model": empty})).normalizer
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # a pair of ids -> rank of its merge and the id it yields
        pairs = np.array([vocab[x] << 20 | vocab[y] for x, y in merges], dtype=np.int64)
        self.pair_rank = np.argsort(pairs, kind="stable").astype(np.int32)
        self.pairs = pairs[self.pair_rank]
        self.merged = np.array([vocab[x + y] for x, y in merges], dtype=np.int32)
        self.first_ids = np.array([vocab[c] for c in self.alphabet], dtype=np.int32)
        self.final_ids = np.array([vocab[c + self.suffix] for c in self.alphabet], dtype=np.int32)
        # ranks of pairs of single bytes, as a table: most of what is ever looked up
        size = 1 << 9
        single = np.full(max(size, int(max(self.first_ids.max(), self.final_ids.max())) + 1), -1, dtype=np.int64)
        single[self.first_ids], single[self.final_ids] = np.arange(256), np.arange(256, 512)
        symbols = np.concatenate([self.first_ids, self.final_ids])
        self.single = single
        self.first_ranks = self._ranks(np.repeat(symbols, size), np.tile(symbols, size))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _read(path: str) -> tuple[dict, dict[str, int], list[tuple[str, str]]]:
        """The file, its vocabulary and its merges."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        return spec, model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

    def _queue(self, suffix: str | None):
        """The library's own encoder, made from the file when a long fragment is met."""
        from tokenizers import models

        _, vocab, merges = self._read(self.path)
        return models.BPE(vocab, merges, end_of_word_suffix=suffix, cache_capacity=0)

    @cached_property
    def last(self):
        return self._queue(self.suffix or None)

    @cached_property
    def inner(self):
        return self._queue(None)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; FAR where there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.pair_rank[at], FAR).astype(np.int32)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row (one fragment's ids, then -1) until nothing merges.

        Each round joins the leftmost pair of least rank of each row, as BPE does
        for one text; rows that are done leave the working set.
        """
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], axis=1)
        done = ids.copy()
        rows, columns = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
        codes = np.where(ids >= 0, self.single[np.maximum(ids, 0)], 0)
        ranks = np.where(ids[:, 1:] >= 0, self.first_ranks[codes[:, :-1] * 512 + codes[:, 1:]], FAR)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            active = best < FAR
            if not active.all():
                done[rows[~active]] = ids[~active]
                rows, ids, ranks, at, best = rows[active], ids[active], ranks[active], at[active], best[active]
            if not len(rows):
                break
            own = np.arange(len(rows))
            shift = columns[None, :] + (columns[None, :] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, shift, axis=1)
            ids[:, -1] = -1
            ids[own, at] = self.merged[best]
            ranks[:, :-1] = np.take_along_axis(ranks, shift[:, :-1], axis=1)
            ranks[:, -1] = FAR
            ranks[own, at] = self._ranks(ids[own, at], ids[own, at + 1])
            back = at > 0
            ranks[own[back], at[back] - 1] = self._ranks(ids[own[back], at[back] - 1], ids[own[back], at[back]])
        return done[:, :-1]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens: split all at their forced boundaries, encode the
        fragments by length classes, and put the ids together again."""
        coded = [w.encode("utf-8") for w in words]
        lengths = np.array([len(c) for c in coded])
        codes = np.frombuffer(b"".join(coded), dtype=np.uint8)
        word_ends = np.cumsum(lengths)
        cut = np.zeros(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[codes[:-1], codes[1:]]
        cut[0] = True
        cut[word_ends] = True
        edges = np.flatnonzero(cut)
        begins, sizes = edges[:-1], np.diff(edges)
        symbols = self.first_ids[codes]
        symbols[word_ends - 1] = self.final_ids[codes[word_ends - 1]]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(sizes), dtype=np.int64)
        low = 0
        for width in (1, 4, 8, 12, 16, 24, 32, ARRAY_SYMBOLS):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(group):
                place = begins[group][:, None] + np.arange(width)
                ids = np.where(np.arange(width) < sizes[group][:, None], symbols[np.minimum(place, len(symbols) - 1)], -1).astype(np.int32)
                ids = self._merge(ids) if width > 1 else ids
                counts[group] = (ids >= 0).sum(axis=1)
                parts.append((group, ids))
        is_last = cut[edges[1:]] & np.isin(edges[1:], word_ends)
        longer = {}
        for k in np.flatnonzero(sizes > ARRAY_SYMBOLS).tolist():  # by the library's queue: no square of a long run
            text = "".join(map(self.alphabet.__getitem__, codes[begins[k] : begins[k] + sizes[k]].tolist()))
            longer[k] = [t.id for t in (self.last if is_last[k] else self.inner).tokenize(text)]
            counts[k] = len(longer[k])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(int(offsets[-1]), dtype="<i4")
        for group, ids in parts:
            place = offsets[group][:, None] + np.arange(ids.shape[1])
            flat[place[ids >= 0]] = ids[ids >= 0]
        for k, ids in longer.items():
            flat[offsets[k] : offsets[k + 1]] = ids
        ends = (4 * offsets[np.searchsorted(edges, word_ends)]).tolist()
        data = flat.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _plain_words(self, text: str) -> list[str]:
        if self.short_way and (text.isascii() or not ODD(text)):
            text = unicodedata.normalize("NFC", text).lower()
            for c in WHITE:
                if c in text:
                    text = text.replace(c, " ")
            return SIMPLE_WORDS(text)
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def pre_tokens(self, text: str | None) -> list[str]:
        """Pre-tokens of a whole text; those of the special tokens stand for themselves."""
        if not text:
            return []
        if self.specials and "<|" in text and self.specials.search(text):
            parts = self.specials.split(text)
            return [w for k, p in enumerate(parts) for w in (self._plain_words(p) if k % 2 == 0 else ["\n" + p])]
        return self._plain_words(text)

    def encode_batch(self, texts: list[str | None], memo_words: int = MEMO_WORDS) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers; at most ``memo_words`` pre-tokens
        and those of ``TEXTS_AT_ONCE`` texts are remembered."""
        out = []
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            lists = [self.pre_tokens(t) for t in texts[k : k + TEXTS_AT_ONCE]]
            coded = [list(map(self.words.get, words)) for words in lists]
            holes = [[i for i, c in enumerate(codes) if c is None] if None in codes else [] for codes in coded]
            new = {w: self.older.get(w) for w in {words[i] for words, at in zip(lists, holes, strict=True) for i in at}}
            missing = [w for w, c in new.items() if c is None]
            special = [w for w in missing if w[0] == "\n"]  # no pre-token has a line feed
            new |= {w: np.array([self.special[w[1:]]], dtype="<i4").tobytes() for w in special}
            missing = [w for w in missing if w[0] != "\n"]
            if missing:
                new.update(zip(missing, self.encode_words(missing), strict=True))
            for words, codes, at in zip(lists, coded, holes, strict=True):
                for i in at:
                    codes[i] = new[words[i]]
                out.append(b"".join(codes))
            if len(self.words) + len(new) > memo_words // 2:
                self.older, self.words = (self.words if len(self.words) <= memo_words // 2 else {}), {}
            self.words.update((w, c) for w, c in new.items() if len(w) <= MEMO_CHARS)
        return out

    def forget(self) -> None:
        """Give up what is remembered."""
        self.words, self.older = {}, {}

    def decode_tokens(self, ids: np.ndarray) -> str:
        """The tokens, joined by one space, as the library decodes this file."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        ids = ids[self.known[ids]] if len(ids) else ids
        return b" ".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8")

    def decode_text(self, ids: np.ndarray) -> str:
        """The text: bytes of the tokens, one space at each end of a word."""
        ids = ids[(ids >= 0) & (ids < len(self.texts))]
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder for each file and worker process, while it encodes or decodes."""
    caches.use("bpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def coded(batches: Iterator[pa.Array], path: str, memo_words: int, forget: bool) -> Iterator[pa.Array]:
    """Ids of the texts of one task."""
    bpe = loaded(path)
    try:
        for texts in batches:
            found = bpe.encode_batch(texts.to_pylist(), memo_words)
            ends = np.cumsum([0, *(len(c) // 4 for c in found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4"), pa.int32()))
    finally:
        if forget:
            bpe.forget()


def encode_column(text: Column, path: str, memo_words: int = MEMO_WORDS, forget: bool = False) -> Column:
    """Ids of a text column as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return coded(batches, path, memo_words, forget)

    return encode(text)


def decode_column(ids: Column, path: str, as_text: bool = False) -> Column:
    """The inverse: tokens joined by spaces as the library does, or the text itself."""

    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        bpe = loaded(path)
        one = bpe.decode_text if as_text else bpe.decode_tokens
        ends, flat = arrays.offsets.to_numpy(), arrays.values.fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array([one(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", memo_words: int = MEMO_WORDS, forget: bool = False) -> DataFrame:
    """Add the ids of ``text_col`` as column ``out``; a worker remembers ``memo_words`` pre-tokens,
    with ``forget`` only until its task ends: idle workers then hold none."""
    prepare(df.sparkSession)
    return df.withColumn(out, encode_column(F.col(text_col).cast("string"), path, memo_words, forget))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", as_text: bool = False) -> DataFrame:
    """Add the decoded form of ``ids_col`` as column ``out``."""
    prepare(df.sparkSession)
    return df.withColumn(out, decode_column(F.col(ids_col), path, as_text))
