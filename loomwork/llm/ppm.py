"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted on a
bounded sample of labelled texts. A byte's probability in a context is its share
with one escape per distinct follower (method C). The escape's share goes to the
bytes not seen in the context, in proportion to their probability in the context
shorter by one: seen bytes are excluded there, so that all 256 probabilities of a
context sum to 1. Below no context are 256 equal bytes. The statistics are frozen,
so a text's exact code length is a sum of table entries; the language with the
shortest code wins.

All contexts of the sample are kept, of all languages, in one sparse table: an entry
for each byte seen in a context by any language, with the code length in every
language, and an escape for each context. A bit set per context finds an entry by
rank; what is missing escapes to the suffix.

Only the sample is bounded: about ``TRAIN_DOCS`` whole rows of each language, chosen
by a hash of the id, and no more than about ``CELLS`` / languages ** 2 bytes of each,
but always one row. That bounds the table by ``CELLS`` numbers for each order of
contexts. More than ``MOST_LANGUAGES`` languages are refused with an error. Scoring
reads whole texts in pieces of ``PIECE`` bytes. Texts are lower-cased first.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything when nothing was learnt. Equal code lengths go to the language
first in code-point order. The score is the winner's posterior probability under
equal priors. Equal texts get equal results. Existing columns with the name of an
output column are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import caches
from loomwork.session import prepare

TRAIN_DOCS = 1500
CELLS = 64 << 20
MOST_LANGUAGES = 4096
PIECE = 1 << 16
UNKNOWN = "und"
START = b"\n\n\n"


def prepared(text: str | None) -> bytes:
    return START + (text or "").lower().encode("utf-8")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with its three predecessors, packed into 32 bits."""
    d = data.astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


class Ppm:
    """Code lengths in bits of every byte in every context of the sample, for each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: language -> (packed four-byte strings, their numbers)."""
        self.languages = sorted(counts)
        grams_of = [np.asarray(counts[k][0], dtype=np.uint32) for k in self.languages]
        numbers = [np.asarray(counts[k][1], dtype=np.float64) for k in self.languages]
        used = np.unique(np.concatenate([np.concatenate([g >> s & 255 for s in (0, 8, 16, 24)]) for g in grams_of])) if grams_of else np.array([], np.uint32)
        self.symbols = np.zeros(256, dtype=np.int64)  # 0: bytes that the sample lacks
        self.symbols[used.astype(int)] = np.arange(1, len(used) + 1)
        size = self.size = len(used) + 1
        coded = [[self.symbols[g >> s & 255] for s in (24, 16, 8, 0)] for g in grams_of]
        n_languages = max(1, len(self.languages))
        # the tables of all orders, one after the other; row 0 is the empty context
        self.words = (size + 63) // 64
        masks, before, bits, escapes, suffix = [], [], [], [], []
        shorter_keys, shorter_rows, shorter = None, None, None
        self.nodes = np.zeros(size**3, dtype=np.int32)
        first_row, first_entry = 0, 0
        for order in range(4):
            keyed = []  # context and follower of each gram, as one number
            for a, b, c, s in coded:
                context = (0, c, b * size + c, (a * size + b) * size + c)[order]
                keyed.append(context * size + s)
            keys = np.unique(np.concatenate(keyed)) if keyed else np.zeros(0, np.int64)
            contexts, row_of = np.unique(keys // size, return_inverse=True)
            place = None if order == 0 else np.searchsorted(shorter_keys, keys % size**order)
            p = np.empty((len(keys), n_languages))
            escape = np.ones((len(contexts), n_languages))
            for k, (key, n) in enumerate(zip(keyed, numbers, strict=True)):
                count = np.bincount(np.searchsorted(keys, key), n, len(keys))
                below = np.full(len(keys), 1 / 256) if order == 0 else shorter[place, k]
                total = np.bincount(row_of, count, len(contexts))
                kinds = np.bincount(row_of, count > 0, len(contexts))
                left = np.maximum(1 - np.bincount(row_of, below * (count > 0), len(contexts)), 1e-12)
                escape[:, k] = np.where(total > 0, kinds / np.maximum(total + kinds, 1) / left, 1.0)
                p[:, k] = np.where(count > 0, count / np.maximum(total + kinds, 1)[row_of], escape[row_of, k] * below)
            mask = np.zeros((len(contexts), self.words), dtype=np.uint64)
            follower = keys % size
            np.bitwise_or.at(mask, (row_of, follower >> 6), np.uint64(1) << (follower & 63).astype(np.uint64))
            counted = np.bitwise_count(mask).astype(np.int64).ravel()
            before.append(first_entry + np.cumsum(counted) - counted)
            masks.append(mask.ravel())
            bits.append(-np.log2(p))
            escapes.append(-np.log2(escape))
            rows = first_row + np.arange(len(contexts))
            if order == 0:
                suffix.append(np.full(len(contexts), -1))
            else:
                at = np.searchsorted(shorter_rows, contexts % size ** (order - 1)) if order > 1 else np.zeros(len(contexts), np.int64)
                suffix.append(first_row - len(shorter_rows) + at)
            if order == 1:  # every context starts from its longest suffix in the sample
                self.nodes.reshape(-1, size)[:, contexts] = rows
            elif order == 2:
                self.nodes.reshape(size, -1)[:, contexts] = rows
            elif order == 3:
                self.nodes[contexts] = rows
            shorter_keys, shorter_rows, shorter = keys, contexts, p
            first_row += len(contexts)
            first_entry += len(keys)
        self.masks, self.before = np.concatenate(masks), np.concatenate(before)
        self.bits, self.escapes = np.concatenate(bits).astype(np.float32), np.concatenate(escapes).astype(np.float32)
        self.suffix = np.concatenate(suffix).astype(np.int32)

    def lengths(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """(bytes, languages): bits of each symbol behind its context of three."""
        row = self.nodes[context].astype(np.int64)
        word, bit = symbol >> 6, (symbol & 63).astype(np.uint64)
        slot = row * self.words + word
        mask = self.masks[slot]
        hit = (mask >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(mask & ((np.uint64(1) << bit) - np.uint64(1)))
        out = self.bits[np.where(hit, self.before[slot] + below, 0)]
        open_ones = np.flatnonzero(~hit)
        if len(open_ones):
            r, s = row[open_ones], symbol[open_ones]
            sums = np.zeros((len(open_ones), out.shape[1]), dtype=np.float32)
            live = np.arange(len(open_ones))
            while len(live):
                sums[live] += self.escapes[r[live]]
                r[live] = self.suffix[r[live]]
                ended = r[live] < 0
                sums[live[ended]] += 8.0  # one of 256 equal bytes
                live = live[~ended]
                at = r[live] * self.words + (s[live] >> 6)
                bit = (s[live] & 63).astype(np.uint64)
                found = (self.masks[at] >> bit & np.uint64(1)).astype(bool)
                below = np.bitwise_count(self.masks[at] & ((np.uint64(1) << bit) - np.uint64(1)))
                sums[live[found]] += self.bits[self.before[at][found] + below[found]]
                live = live[~found]
            out[open_ones] = sums
        return out

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): bits of each whole text."""
        data = [prepared(t) for t in texts]
        ends = np.cumsum([len(d) for d in data])
        x = self.symbols[np.frombuffer(b"".join(data), dtype=np.uint8)]
        total = np.zeros((len(texts), len(self.languages)))
        starts = ends - [len(d) for d in data]
        for low in range(3, len(x), PIECE):
            high = min(low + PIECE, len(x))
            context = (x[low - 3 : high - 3] * self.size + x[low - 2 : high - 2]) * self.size + x[low - 1 : high - 1]
            bits = self.lengths(context, x[low:high])
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right")
            for k in range(first, last + 1):
                a, b = max(starts[k] + 3, low), min(ends[k], high)
                if a < b:
                    total[k] += bits[a - low : b - low].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior probability, and bits a byte of the shortest code of each text."""
        caches.use("ppm")
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = np.round(self.code_lengths(texts), 3)
        best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
        least = bits.min(axis=1, keepdims=True) if len(texts) else bits
        worse = np.minimum(bits - least, 1000.0)
        sizes = np.array([max(1, len(prepared(t)) - len(START)) for t in texts])
        return [self.languages[k] for k in best], np.round(1 / np.exp2(-worse).sum(axis=1), 6), np.round(least[:, 0] / sizes, 6) if len(texts) else np.zeros(0)


def _count_grams(batches):
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(prepared(text))
        for lang, data in by.items():
            found = [grams(np.frombuffer(d, dtype=np.uint8)) for d in data if len(d) > 3]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int = TRAIN_DOCS, cells: int = CELLS) -> Ppm:
    """Count contexts on a sample of the rows of each language (see above), chosen by a hash of the id."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000))
    found = (
        rows.groupBy(F.col(lang_col).alias("lang"))
        .agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes"), F.min(draw).alias("first"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not found:
        return Ppm({})
    most = cells / len(found) ** 2
    share = {r["lang"]: max(r["first"], int(min(1.0, train_docs / r["n"], most / max(1, r["bytes"])) * 1_000_000) - 1) for r in found}
    names = sorted(share)
    shares = pa.table({"__lang": pa.array(names, pa.string()), "__share": pa.array([share[n] for n in names], pa.int64())})
    limits = labelled.sparkSession.createDataFrame(shares)  # a row per language; as Arrow it needs no Python worker
    schema = T.StructType().add("lang", "string").add("gram", "long").add("n", "long")
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    chosen = drawn.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).where("draw <= __share").select("lang", "text")
    counted = chosen.mapInArrow(_count_grams, schema)
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # bounded by the sample
    return Ppm({lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in table.groupby("lang")})


def identify(df: DataFrame, model: Ppm, text_col: str = "text", lang: str = "lang_pred", score: str = "score", bits: str | None = None) -> DataFrame:
    """Add the predicted language of each whole text and the prediction's probability; with
    ``bits`` also the bits a byte of its code (null where the language is unknown)."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf(T.StructType().add("lang", "string").add("score", "double").add("bits", "double"))
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, lengths = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())], ["lang", "score", "bits"])

    text: Column = F.col(text_col)
    known = text.isNotNull() & text.rlike("\\p{L}")
    once = predict.asNondeterministic()  # a filter on the result must not be pushed below and run it again
    found = df.withColumn("__found", once(text)).withColumn("__known", F.coalesce(known, F.lit(False)))
    sure = F.col("__known") & (F.col("__found.lang") != UNKNOWN)
    out = found.withColumn(lang, F.when(sure, F.col("__found.lang")).otherwise(UNKNOWN)).withColumn(score, F.when(sure, F.col("__found.score")).otherwise(0.0))
    if bits:
        out = out.withColumn(bits, F.when(sure, F.col("__found.bits")))
    return out.drop("__found", "__known")
