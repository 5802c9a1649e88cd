"""Counts of the n-grams at every place of a text, without moving text or n-grams as text.

Documents are cut into blocks: their words once, and numbers of words for the places. A block
asks each n-gram it holds once, by a hash, from the bucket of the hash; buckets add up and answer
every block in the order it asked. Keys have 56 bits and are told apart within a bucket of at
least 64 (more for more text), so that n-grams count together only if 62 bits or more of two hashes agree.
No n-gram is asked more than once by a block: common ones are no heavier than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.script import TIBETAN, Script, spaced
from loomwork.shared import cut, drop_table

#: Places of a block (more if one text has more), and those that a bucket should have.
BLOCK, BUCKET = 1_000_000, 150_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
#: Bytes of a key that are stored as they are; the upper ones are nearly always 0 and compressed.
PLAIN = 6
ASKED = "block long, bucket int, data binary"
ANSWERS = "block long, bucket int, data binary, kinds long, most long"
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Bytes of numbers by place: all lowest ones first."""
    return np.ascontiguousarray(numbers.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T)


def numbers(data: bytes | memoryview, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), "<u8")


def keys_of(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the bucket in 16 bits) of n-grams, from the hashes of their words."""
    a = b = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        a, b = mixed(a * ODD[0] + w), mixed(b * ODD[1] + (w ^ ODD[2]))
    return a >> np.uint64(8), (b >> np.uint64(48)).astype(np.uint16)


def blocks(rows: DataFrame, key: str = "doc_id", text_col: str = "text", script: Script = TIBETAN, size: int = BLOCK) -> DataFrame:
    """A table of blocks (block, keys, sizes, words, ids) of the texts; those without a word are left out.

    Rows that have ``syllables`` already (without spaces in them) are taken as they are.
    """
    told = rows.select(F.col(key), F.col("syllables") if "syllables" in rows.columns else spaced(F.col(text_col), script).alias("__t"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        index: dict[str, int] = {}
        ids, keys, sizes, places = [], [], [], 0

        def block() -> pa.RecordBatch:
            words, all_ids = list(index), np.concatenate(ids)
            order = np.argsort(-np.bincount(all_ids, minlength=len(words)), kind="stable")  # the common ones get small numbers
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            n = np.concatenate(sizes)
            ends = pa.array([0, len(n)], pa.int32())
            data = [pa.array([base + made]), pa.ListArray.from_arrays(ends, pa.concat_arrays(keys)), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
            data += [pa.array([packed(" ".join(words[i] for i in order.tolist()).encode("utf-8", "surrogatepass"))]), pa.array([packed(planes(rank[all_ids], 4).tobytes())])]
            return pa.RecordBatch.from_arrays(data, ["block", "keys", "sizes", "words", "ids"])

        for batch in batches:
            parts = batch.column(1) if pa.types.is_list(batch.column(1).type) else pc.split_pattern(batch.column(1), " ")
            flat = parts.flatten()
            there = pc.fill_null(pc.not_equal(flat, ""), False)
            before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
            lengths = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
            ends = np.cumsum(lengths)
            n = before[ends] - before[ends - lengths]
            kept = np.flatnonzero(n)
            if not len(kept):
                continue
            coded = flat.filter(there).dictionary_encode()
            known = np.array([index.setdefault(w, len(index)) for w in coded.dictionary.to_pylist()], np.uint32)
            ids.append(known[coded.indices.to_numpy()])
            keys.append(batch.column(0).take(pa.array(kept)))
            sizes.append(n[kept])
            places += int(n.sum())
            if places >= size:
                yield block()
                made, index, ids, keys, sizes, places = made + 1, {}, [], [], [], 0
        if places:
            yield block()

    return cut(told.mapInArrow(run, schema), "blocks")


def in_order(asked: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys, their buckets, and their order by bucket and key."""
    keys, places = (np.concatenate(x) for x in zip(*asked, strict=True))
    bucket = places if buckets == MOST_BUCKETS else places % np.uint16(buckets)
    order = np.argsort(keys)
    return keys, bucket, order[np.argsort(bucket[order], kind="stable")]


class Block:
    """A block's places, its distinct n-grams (exact, by numbers of words), and the order in which they are asked."""

    def __init__(self, sizes: np.ndarray, words: bytes, ids: bytes, buckets: int, most: int = 3):
        self.words = unpacked(words).decode("utf-8", "surrogatepass").split(" ")
        self.sizes, self.ids = sizes.astype(np.int32), numbers(unpacked(ids), 4).astype(np.int32)
        n, kinds = len(self.ids), len(self.words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pos = (np.arange(n) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        left = np.repeat(self.sizes, self.sizes) - self.pos  # places to the text's end
        hashes = word_hashes(self.words)
        # of every place the number of the n-gram that begins there, -1 for none; how often each is there; its words
        self.number, self.times, self.grams = [self.ids], [np.bincount(self.ids, minlength=kinds).astype(np.uint32)], [(np.arange(kinds, dtype=np.int32),)]
        asked = [keys_of(hashes)]
        for k in range(2, most + 1):
            at = np.flatnonzero(left >= k)
            number = np.full(n, -1, np.int32)
            found, inverse, times = np.unique(self.number[-1][at].astype(np.int64) * kinds + self.ids[at + k - 1], return_inverse=True, return_counts=True)
            number[at] = inverse
            del inverse
            head, tail = (found // kinds).astype(np.int32), (found % kinds).astype(np.int32)
            self.grams.append((*(g[head] for g in self.grams[-1]), tail))
            self.number.append(number), self.times.append(times.astype(np.uint32))
            asked.append(keys_of(*(hashes[g] for g in self.grams[-1])))
        self.keys, self.bucket, self.order = in_order(asked, buckets)

    def asks(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        yield from asks(self.keys, self.bucket, self.order, np.concatenate(self.times), len(self.words), buckets)

    def told(self, answers: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each n: counts of the block's distinct n-grams, and whether this block is the first that has them."""
        back = in_place(answers, self.order)
        ends = np.cumsum([len(t) for t in self.times])[:-1]
        return np.split((back >> np.uint64(1)).astype(np.int64), ends), np.split((back & np.uint64(1)).astype(bool), ends)


def asks(keys: np.ndarray, bucket: np.ndarray, order: np.ndarray, times: np.ndarray, words: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its keys with their times); the first ``words`` keys are those of words."""
    keys, times, word = keys[order], times[order], order < words
    ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
    for b, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if z > a:
            yield b, asked(keys[a:z], times[a:z], word[a:z])


def in_place(answers: list[tuple[int, bytes]], order: np.ndarray) -> np.ndarray:
    """Answers of all buckets, back in the places of what was asked."""
    said = np.concatenate([numbers(unpacked(d), 8) for _, d in sorted(answers)] or [np.empty(0, np.uint64)])
    if len(said) != len(order):
        raise ValueError("a block has other answers than it asked for")
    out = np.empty(len(said), np.uint64)
    out[order] = said
    return out


def asked(keys: np.ndarray, times: np.ndarray, words: np.ndarray) -> bytes:
    """Sorted keys as differences, times, and whether an n-gram is a word."""
    p = planes(np.diff(keys, prepend=np.uint64(0)), 8)
    rest = packed(p[PLAIN:].tobytes() + planes(times, 4).tobytes() + words.astype(np.uint8).tobytes())
    return len(keys).to_bytes(8, "little") + p[:PLAIN].tobytes() + rest


def read_asked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    rest = unpacked(data[8 + PLAIN * n :])
    upper = (8 - PLAIN) * n
    keys = np.cumsum(numbers(data[8 : 8 + PLAIN * n] + rest[:upper], 8), dtype=np.uint64)
    return keys, numbers(rest[upper : upper + 4 * n], 4), np.frombuffer(rest[upper + 4 * n :], np.uint8).astype(bool)


def answered(table: pa.Table, only: bool = False) -> pa.Table:
    """Of all keys of a bucket: counts over all blocks, for each block in its order, with a bit for the first block. ``only``: to blocks of questions."""
    table = table.sort_by("block")
    parts = [read_asked(d) for d in table["data"].to_pylist()]
    keys, times, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # equal keys stay in the order of their blocks
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    sums = np.add.reduceat(times[order].astype(np.uint64), np.flatnonzero(first))
    said = np.empty(len(keys), np.uint64)
    said[order] = (sums[np.cumsum(first) - 1] << np.uint64(1)) | first.astype(np.uint64)
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    data = [packed(planes(s, 8).tobytes()) for s in np.split(said, ends)]
    own = said[words]
    kinds, most = [0] * len(parts), [0] * len(parts)
    kinds[0], most[0] = int((own & np.uint64(1)).sum()), int((own >> np.uint64(1)).max(initial=0))
    out = pa.table({"block": table["block"], "bucket": table["bucket"], "data": pa.array(data, pa.binary()), "kinds": pa.array(kinds, pa.int64()), "most": pa.array(most, pa.int64())})
    return out.filter(pc.less(out["block"], 0)) if only else out


def block_of(batch: pa.RecordBatch, k: int, buckets: int) -> Block:
    return Block(batch.column("sizes")[k].values.to_numpy(zero_copy_only=False), batch.column("words")[k].as_py(), batch.column("ids")[k].as_py(), buckets)


def buckets_for(places: int) -> int:
    n = LEAST_BUCKETS
    while n < MOST_BUCKETS and n * BUCKET < places:
        n *= 2
    return n


def answers(table: DataFrame, questions: DataFrame | None = None) -> tuple[DataFrame, int, dict[str, int]]:
    """A table of the buckets' answers to all blocks, the number of buckets, and the corpus' totals: ``total`` places, ``kinds`` of words, ``most`` of one word.

    With ``questions`` (block, rows), only these are answered (``question_keys``).
    """
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    buckets = buckets_for(total)

    def sent(name: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b, data in parts:
            held.append((name, b, data))
            size += len(data)
            if size > 1 << 20:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from sent(batch.column("block")[k].as_py(), block_of(batch, k, buckets).asks(buckets))

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, bucket, order = in_order(question_keys(batch.column("rows")[k].values), buckets)
                yield from sent(batch.column("block")[k].as_py(), asks(keys, bucket, order, np.zeros(len(keys), np.uint32), 0, buckets))

    told = table.mapInArrow(ask, ASKED)
    if questions is not None:
        told = told.unionByName(questions.mapInArrow(question, ASKED))
    only = questions is not None
    out = cut(told.groupBy("bucket").applyInArrow(lambda t: answered(t, only), ANSWERS), "answers", tidy=True)
    sums = out.agg(F.sum("kinds"), F.max("most")).first()
    return out, buckets, {"total": total, "kinds": sums[0] or 0, "most": sums[1] or 0}


def _rows(held: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["block", "bucket", "data"])


def over_blocks(table: DataFrame, said: DataFrame, buckets: int, tell: Callable[[Block, list[np.ndarray], list[np.ndarray], pa.Array], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What ``tell`` makes of each block: its n-grams' counts, which of them it is the first to have, and the texts' keys."""
    told = said.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = block_of(batch, k, buckets)
                counts, first = block.told([(x["bucket"], x["data"]) for x in batch.column("answers")[k].as_py()])
                yield from tell(block, counts, first, batch.column("keys")[k].values)
                del block, counts, first  # before the next one is made

    return table.join(told, "block").mapInArrow(run, schema)


def neighbours(block: Block, counts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Counts at every place: of the word, the left one, (left, word), (word, right), (left2, left) and all three; -1 where there is no neighbour."""
    n = len(block.ids)

    def at(kind: int, back: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        here = np.flatnonzero(block.pos >= back)
        number = block.number[kind][here - back]
        out[here[number >= 0]] = counts[kind][number[number >= 0]]
        return out

    return {"word": counts[0][block.ids], "left": at(0, 1), "lw": at(1, 1), "wr": at(1, 0), "ll": at(1, 2), "llw": at(2, 2)}


def plausibility(c: dict[str, np.ndarray], total: int, kinds: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(alone, pll) of every place, as ``corpus.context_plausibility`` has them."""
    of = lambda n, before: np.where(n >= 0, np.log((np.maximum(n, 0) + alpha) / (np.maximum(before, 0) + alpha * kinds)), 0.0)
    alone = np.log((c["word"] + alpha) / (total + alpha * kinds))
    sums = of(c["lw"], c["left"]) + of(c["wr"], c["word"]) + of(c["llw"], c["ll"])
    there = (c["lw"] >= 0).astype(np.int64) + (c["wr"] >= 0) + (c["llw"] >= 0)
    return alone, np.where(there > 0, sums / np.maximum(there, 1), 0.0)


def bonus(c: dict[str, np.ndarray], most: int) -> np.ndarray:
    """The bonus of every place, as ``corpus.context_bonus`` has it."""
    of = lambda n, before: np.where((n > 0) & (before > 0), np.minimum(1.0, n / np.maximum(before, 1)), 0.0)
    score = 0.4 * (np.log(c["word"] + 1.0) / np.log(most + 1.0)) + 0.3 * of(c["lw"], c["left"]) + 0.3 * of(c["wr"], c["word"]) + 0.4 * of(c["llw"], c["ll"])
    return np.minimum(1.0, score)


def by_text(rows: DataFrame, measure: Callable[[dict[str, np.ndarray], dict[str, int]], dict[str, np.ndarray]], schema: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, …): for each text its places and what ``measure`` makes of all places' counts, added up (``most_…``: the largest)."""
    table = blocks(rows, key, text_col)
    said, buckets, totals = answers(table)
    fields = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("n", T.LongType()), *T._parse_datatype_string(schema).fields])

    def tell(block: Block, counts: list[np.ndarray], _, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        made = measure(neighbours(block, counts), totals)
        sums = [(np.maximum if c.startswith("most_") else np.add).reduceat(v, block.starts) for c, v in made.items()]
        out = pa.RecordBatch.from_arrays([keys, pa.array(block.sizes, pa.int64()), *map(pa.array, sums)], [key, "n", *made])
        for i in range(0, out.num_rows, 10_000):
            yield out.slice(i, 10_000)

    out = cut(over_blocks(table, said, buckets, tell, fields), "texts", tidy=True)
    drop_table(table), drop_table(said)
    return out


def batches_of(columns: dict[str, pa.Array], schema: pa.Schema, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    for i in range(0, n, rows):
        yield out.slice(i, rows)


def trigrams(rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(ngram, n, f) of all trigrams, with the count of their first two words, and the number of kinds of words. The first block that has a trigram tells it."""
    table = blocks(rows, key, text_col)
    said, buckets, totals = answers(table)
    schema = pa.schema([("ngram", pa.string()), ("n", pa.int64()), ("f", pa.int64())])

    def tell(block: Block, counts: list[np.ndarray], first: list[np.ndarray], _) -> Iterator[pa.RecordBatch]:
        words, own = pa.array(block.words), np.flatnonzero(first[2])
        pair = np.empty(len(counts[2]), np.int32)  # of each trigram the number of its first two words
        here = np.flatnonzero(block.number[2] >= 0)
        pair[block.number[2][here]] = block.number[1][here]
        for i in range(0, len(own), 10_000):
            k = own[i : i + 10_000]
            ngram = pc.binary_join_element_wise(*(words.take(pa.array(g[k])) for g in block.grams[2]), " ")
            yield from batches_of({"ngram": ngram, "n": pa.array(counts[2][k]), "f": pa.array(counts[1][pair[k]])}, schema)

    return over_blocks(table, said, buckets, tell, "ngram string, n long, f long"), totals["kinds"]


def implausible(rows: DataFrame, gap: float, alpha: float, key: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Places whose word is that much likelier alone than in its context, all words with their counts, the blocks, and the corpus' totals.

    Places are (key, pos, word, left2, left, right, pll) with ``n_left`` and ``n_ll``, the counts of the left word and the left pair.
    """
    table = blocks(rows, key, text_col)
    said, buckets, totals = answers(table)
    fields = T.StructType([T.StructField(key, rows.schema[key].dataType), *T._parse_datatype_string("pos int, word string, left2 string, left string, right string, pll double, n_left long, n_ll long, n long").fields])

    def tell(block: Block, counts: list[np.ndarray], first: list[np.ndarray], keys: pa.Array) -> Iterator[pa.RecordBatch]:
        words = pa.array(block.words)
        schema = pa.schema([(key, keys.type), ("pos", pa.int32()), *((c, pa.string()) for c in ("word", "left2", "left", "right")), ("pll", pa.float64()), *((c, pa.int64()) for c in ("n_left", "n_ll", "n"))])
        own = np.flatnonzero(first[0])
        yield from batches_of({"word": words.take(pa.array(own)), "n": pa.array(counts[0][own])}, schema)
        c = neighbours(block, counts)
        alone, pll = plausibility(c, totals["total"], totals["kinds"], alpha)
        at = np.flatnonzero((pll != 0) & (alone - pll > gap))
        text = np.searchsorted(block.starts, at, side="right") - 1

        def word(back: int, there: np.ndarray) -> pa.Array:
            return words.take(pa.array(block.ids[np.clip(at - back, 0, len(block.ids) - 1)], mask=~there))

        told = {"word": word(0, at >= 0), "left2": word(2, block.pos[at] > 1), "left": word(1, block.pos[at] > 0), "right": word(-1, block.pos[at] + 1 < block.sizes[text])}
        told |= {key: keys.take(pa.array(text)), "pos": pa.array(block.pos[at]), "pll": pa.array(pll[at]), "n_left": pa.array(c["left"][at]), "n_ll": pa.array(c["ll"][at])}
        yield from batches_of(told, schema)

    out = cut(over_blocks(table, said, buckets, tell, fields), "places", tidy=True)
    drop_table(said)
    return out.where("pos is not null").drop("n"), out.where("pos is null").select("word", "n"), table, totals


def question_keys(rows: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of (left, candidate), (candidate, right), (left2, left, candidate) of each row; without a neighbour, of what no text has."""
    hashed = {}
    for c in ("left2", "left", "candidate", "right"):
        coded = pc.fill_null(rows.field(c), "").dictionary_encode()
        hashed[c] = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    return [keys_of(hashed["left"], hashed["candidate"]), keys_of(hashed["candidate"], hashed["right"]), keys_of(hashed["left2"], hashed["left"], hashed["candidate"])]


def instead(asked_rows: DataFrame, table: DataFrame, totals: dict[str, int], alpha: float, size: int = 100_000) -> DataFrame:
    """Rows (…, left2, left, candidate, right, n_left, n_ll, n_candidate) with ``other``, the plausibility of the candidate in the word's stead."""
    schema = asked_rows.schema
    grouped = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(schema))])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, n = -1 - (TaskContext.get().partitionId() << 24), 0, [], 0

        def one() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_struct_array().combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([base - made]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["block", "rows"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield one()
                made, held, n = made + 1, [], 0
        if n:
            yield one()

    questions = cut(asked_rows.mapInArrow(group, grouped), "questions", tidy=True)
    said, buckets, _ = answers(table, questions)
    told = said.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    out = T.StructType([*schema.fields, T.StructField("other", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows")[k].values
                order = in_order(question_keys(rows), buckets)[2]
                lw, wr, llw = np.split((in_place([(x["bucket"], x["data"]) for x in batch.column("answers")[k].as_py()], order) >> np.uint64(1)).astype(np.int64), 3)
                none = {c: rows.field(c).is_null().to_numpy(zero_copy_only=False) for c in ("left2", "left", "right")}
                own, left, ll = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("n_candidate", "n_left", "n_ll"))
                counts = {"word": own, "left": left, "ll": ll, "lw": np.where(none["left"], -1, lw), "wr": np.where(none["right"], -1, wr), "llw": np.where(none["left2"] | none["left"], -1, llw)}
                other = pa.array(plausibility(counts, totals["total"], totals["kinds"], alpha)[1])
                made = pa.RecordBatch.from_arrays([*rows.flatten(), other], [*schema.names, "other"])
                for i in range(0, made.num_rows, 10_000):
                    yield made.slice(i, 10_000)

    return questions.join(told, "block").mapInArrow(run, out)
