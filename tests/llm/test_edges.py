"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import io
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import bpe, chat, components, media, mixing, neardup, pii, ppm, queries, rules, simhash, tokenfile, warc

PATH = queries.tokenizer_path()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "x" * 50_000
TEXTS = [None, "", " \n\t", "a", "Hello, it's 123 <|endoftext|> wörld", "same text here now", "same text here now", LONG, "\x00\x1c é 漢字 😀", "12 34", "!!!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 4 else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id", "en", "s0", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("media", F.lit(2))


def test_bpe_on_odd_rows(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(out) == len(TEXTS) + 3
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    plain = bpe.decode(bpe.encode(spark.createDataFrame([("Two  words",)], "text string"), PATH), PATH, as_text=True)
    assert plain.first()["decoded"] == "two words "


def test_workers_let_go_of_what_others_kept():
    bpe.loaded(PATH)
    assert bpe._LOADED
    neardup.shingle_batch(["a b"])
    assert not bpe._LOADED
    assert bpe.loaded(PATH) is bpe.loaded(PATH)


def test_memo_is_bounded_and_given_up_after_a_task(spark):
    encoder = bpe.WordBpe(PATH)
    texts = [f"word{k} {'x' * 80}{k} again common" for k in range(3000)]
    want = [bpe.WordBpe(PATH).encode_batch([t])[0] for t in texts[:3]]
    got = encoder.encode_batch(texts, 2000)
    assert got[:3] == want and got == encoder.encode_batch(texts)
    encoder.encode_batch(texts, 2000)
    assert len(encoder.words) <= 1000 + 5 * bpe.TEXTS_AT_ONCE and len(encoder.older) <= 1000
    assert max(map(len, [*encoder.words, *encoder.older])) <= bpe.MEMO_CHARS
    arrays = list(bpe.coded(iter([pa.array(texts[:50]), pa.array([None, "common"])]), PATH, 100, True))
    assert [np.array(a, "<i4").tobytes() for x in arrays for a in x.to_pylist()] == [*got[:50], b"", encoder.encode_batch(["common"])[0]]
    assert not bpe.loaded(PATH).words and not bpe.loaded(PATH).older
    told = bpe.encode(spark.createDataFrame([(t,) for t in texts[:50]], "text string"), PATH, memo_words=100, forget=True).collect()
    assert {r["text"]: np.array(r["ids"], "<i4").tobytes() for r in told} == dict(zip(texts, got[:50], strict=False))


def test_fragments_at_forced_boundaries():
    encoder = bpe.loaded(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinéüçß") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    whole = [np.array([t.id for t in encoder.last.tokenize("".join(encoder.alphabet[b] for b in w.encode()))], "<i4").tobytes() for w in words]
    assert encoder.encode_words(words) == whole


def test_another_pattern_of_pre_tokens(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    spec["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library = Tokenizer.from_file(path)
    texts = ["Hello, it's 123!! abc123", "ÉCOLE 漢字... x"]
    assert [np.frombuffer(c, "<i4").tolist() for c in bpe.WordBpe(path).encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rules(spark, docs):
    out = rules.with_stats(docs).select("doc_id", "text", "n_words", "n_repeat_words", rules.base_failed().alias("b")).collect()
    assert len(out) == len(TEXTS) + 3
    assert all(r["n_words"] == len((r["text"] or "").encode().split()) for r in out)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn(docs, labels) == []
    assert rules.with_stats(docs.limit(0)).collect() == []
    rng = random.Random(2)
    rows = [({"x": rng.random(), "y": rng.random()}, False, bool(k % 3 == 0)) for k in range(600)]
    rows = [(f, f["x"] > 0.7 and f["y"] < 0.5, s) for f, _, s in rows]
    learnt = rules.learn_list(rows)
    said = [any(bool(rules.covers(r, {k: np.array([v]) for k, v in f.items()})[0]) for r in learnt) for f, _, _ in rows]
    assert sum(a == b for a, (_, b, _) in zip(said, rows, strict=True)) >= 0.97 * len(rows)


def naive_list(rows):
    """Sequential covering by its definition, one candidate condition after the other."""

    def holds(rule, f):
        return all(f[name] >= cut if above else f[name] <= cut for name, above, cut in rule)

    def count(rule, some):
        hit = [bad for f, bad, _ in some if holds(rule, f)]
        return sum(hit), len(hit) - sum(hit)

    left, out = list(rows), []
    while True:
        grow, prune = [r for r in left if not r[2]], [r for r in left if r[2]]
        if sum(r[1] for r in grow) < rules.MIN_COVER:
            return out
        rule = []
        while all(count(rule, grow)):
            p0, n0 = count(rule, grow)
            best, found = 1e-9, None
            live = [r for r in grow if holds(rule, r[0])]
            for name in sorted(live[0][0]):
                kinds = sorted({r[0][name] for r in live})
                for above in (True, False):
                    for cut in [(a + b) / 2 for a, b in itertools.pairwise(kinds)]:
                        p, n = count([(name, above, cut)], live)
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best + 1e-12:
                            best, found = gain, (name, above, cut)
            if not found:
                break
            rule.append(found)
        if not rule:
            return out
        worth = lambda k: (lambda p, n: ((p - n) / (p + n) if p + n else -1.0, k))(*count(rule[:k], prune))
        rule = rule[: max(range(1, len(rule) + 1), key=worth)] if prune else rule
        p, n = count(rule, prune)
        if count(rule, grow)[0] < rules.MIN_COVER or not p + n or p < rules.MIN_PRECISION * (p + n):
            return out
        out.append(rule)
        left = [r for r in left if not holds(rule, r[0])]


@pytest.mark.parametrize("seed", range(4))
def test_learnt_list_equals_the_naive_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        f = {"a": float(rng.randrange(12)), "b": round(rng.random(), 2), "c": float(rng.randrange(3))}
        rows.append((f, (f["a"] >= 8 and f["b"] < 0.5) or (f["c"] == 2 and f["b"] > 0.8) or rng.random() < 0.02 * seed, k % 3 == 0))
    learnt = rules.learn_list(rows)
    assert [[(c.feature, c.above, c.threshold) for c in r] for r in learnt] == [[(n, a, pytest.approx(t)) for n, a, t in r] for r in naive_list(rows)]
    if seed == 0:
        assert len(learnt) > 1 and max(map(len, learnt)) > 1
    df = spark.createDataFrame([(r[0],) for r in rows], "features struct<a:double,b:double,c:double>")
    kept = [r["kept"] for r in df.select(rules.verdict(learnt).alias("kept")).collect()]
    assert kept == [not any(all(c.holds({n: np.array([v]) for n, v in f.items()})[0] for c in r) for r in learnt) for f, _, _ in rows]


def distribution(counts, context):
    """Probabilities of all bytes behind a context, by the definition."""
    shorter = distribution(counts, context[1:]) if context else [1 / 256] * 256
    seen = [0] * 256
    for g, n in counts.items():
        if g[3 - len(context) : 3] == context:
            seen[g[3]] += n
    total, kinds = sum(seen), sum(n > 0 for n in seen)
    if not total:
        return shorter
    left = sum(p for p, n in zip(shorter, seen, strict=True) if not n)
    return [n / (total + kinds) if n else kinds / (total + kinds) * p / left for p, n in zip(shorter, seen, strict=True)]


def test_ppm_equals_the_definition(spark, docs):
    samples = {"xx": "the cat sat on the mat", "yy": "le chat est sur le tapis"}
    counts = {k: Counter(ppm.prepared(t)[i : i + 4] for i in range(len(t))) for k, t in samples.items()}
    model = ppm.Ppm({k: (np.array([int.from_bytes(g, "big") for g in c]), np.array(list(c.values()))) for k, c in counts.items()})
    assert model.languages == ["xx", "yy"]
    for text in ("the mat", "le tapis", "zebra", "", "THE chat", "é"):
        data = ppm.prepared(text)
        for language, bits in zip(model.languages, model.code_lengths([text])[0], strict=True):
            spread = [distribution(counts[language], data[i - 3 : i]) for i in range(3, len(data))]
            assert all(sum(p) == pytest.approx(1) for p in spread)
            assert bits == pytest.approx(-sum(math.log2(p[data[i + 3]]) for i, p in enumerate(spread)), rel=1e-4, abs=1e-3)
    out = ppm.identify(docs, ppm.fit(docs, "doc_id", "text", "lang"), bits="bits").collect()
    assert len(out) == len(TEXTS) + 3
    assert all((r["lang_pred"] == "und") == (r["text"] in (None, "", " \n\t", "12 34", "!!!")) == (r["bits"] is None) for r in out)
    nothing = ppm.identify(docs, ppm.fit(docs.limit(0), "doc_id", "text", "lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_ppm_learns_rare_languages_among_many(spark):
    rng = random.Random(8)
    letters = [chr(0x400 + 12 * k + j) for k in range(40) for j in range(12)]
    rows = [(i, "".join(rng.choice(letters[12 * k : 12 * k + 12]) for _ in range(60)), f"l{k:02d}") for k in range(40) for i in range(1 if k else 400)]
    df = spark.createDataFrame([(100 * k + i, t, lang) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = ppm.fit(df, "doc_id", "text", "lang", cells=200_000)
    assert len(model.languages) == 40
    out = ppm.identify(df, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_media_formats(spark, docs):
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (media.decode(b"P5 # note\n3 2\n255\n" + pixels.tobytes()) == pixels).all()
    assert (media.decode(b"P2\n3 2\n255\n0 1 2\n3 4 5\n") == pixels).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    colour = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode(b"P6\n2 2\n255\n" + colour.tobytes()) == colour).all()
    body = b"".join(colour[y, :, ::-1].tobytes() + b"\0\0" for y in (1, 0))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    head += (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24
    assert (media.decode(head + body) == colour).all()
    image = np.random.default_rng(0).integers(0, 256, (9001, 7)).astype(np.uint8)
    fine = np.repeat(np.repeat(image, 5, axis=0), 3, axis=1).reshape(5, 9001, 3, 7).mean(axis=(1, 3))
    assert media.resize_area(image, 5, 3) == pytest.approx(fine)
    assert np.load(io.BytesIO(media.npy_tile(image))).shape == (16, 16)
    rows = spark.createDataFrame([(None,), (b"",), (b"BM",), (b"P5\n9 9\n255\nxx",), (b"P5\n1 1\n255\nx",)], "media binary")
    out = media.read_media(rows.withColumn("image", F.lit(0))).collect()
    assert [r["image"]["pixels"] for r in out] == [None, None, None, None, b"x"]
    assert [r["image"]["error"] is None for r in out] == [True, False, False, False, True]
    stored = media.read_media(media.store_netpbm(docs.select("doc_id", "text", "media"), "text")).collect()
    assert all(bytes(r["image"]["pixels"]).rstrip(b"\0") == (r["text"] or "").encode().rstrip(b"\0") for r in stored)


def test_media_of_wrong_sizes_and_samples(spark, docs):
    assert (media.decode(b"P2\n3 1\n15\n0 5 15\n") == [[0, 85, 255]]).all()
    assert (media.decode(b"P5\n2 1\n1000\n" + (500).to_bytes(2, "big") + (1000).to_bytes(2, "big")) == [[32768, 65535]]).all()
    huge = b"9" * 30
    bmp = bytearray(b"BM" + bytes(52))
    bmp[18:26], bmp[28] = b"\xff\xff\xff\x7f\xff\xff\xff\x7f", 24
    wrong = [b"P2\n1 1\n15\n300", b"P2\n1 1\n255\n" + huge, b"P5\n" + huge + b" " + huge + b"\n255\nx", b"P4\n" + huge + b" 9\nx", b"P1\n" + huge + b" 1\n1",
             b"P1\n2 1\n1 7", b"P2\n1 1\n255\nx", b"P5\n1 1\n15\n\xff", b"P3\n1 1\n255\n1 2", b"P5\n1 1\n70000\nx", bytes(bmp), b"P6", b"BM" + bytes(10)]
    out = media.read_media(spark.createDataFrame([(x,) for x in wrong], "media binary")).collect()
    assert all(r["image"]["error"] and r["image"]["pixels"] is None for r in out)
    stored = media.read_media(media.store_bmp(docs.select("doc_id", "text", "media"), "text")).collect()
    assert {r["image"]["channels"] for r in stored} == {1} and {r["image"]["width"] for r in stored} == {64}
    assert all(bytes(r["image"]["pixels"]).rstrip(b"\0") == (r["text"] or "").encode().rstrip(b"\0") for r in stored)


def test_token_file(spark, docs):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 4, 5, 0, 9])
    ranks = rng.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], sizes.sum()).astype(np.uint32)
    control, control_ends, data, _ = tokenfile.code(ranks, np.concatenate([[0], np.cumsum(sizes)]))
    assert (tokenfile.uncode(control, control_ends, data, sizes) == ranks).all()
    rows = tokenfile.with_starts(tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, PATH))).orderBy("start", "place").collect()
    assert len(rows) == len(TEXTS) + 3
    assert [r["id"] for r in rows] == sorted((r["id"] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    for r in rows:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"] and bytes(r["ids"][-4:]) == b"\1\0\0\0"
        start += r["n_tokens"]
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(docs.limit(0), PATH)).collect() == []


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    b = a.copy()
    for k, n in enumerate(rng.integers(0, 3, len(b))):
        for bit in rng.choice(64, n, replace=False):
            b.view(np.uint64)[k] ^= np.uint64(1 << int(bit))
    ask, entered = simhash.keys(a)[0], simhash.keys(b)[1]
    assert all(set(x.tolist()) & (set(y.ravel().tolist()) - {-1}) for x, y in zip(ask, entered, strict=True))


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_links(spark, crowd):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for v in base for _ in range(25)}
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    found = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd=crowd)
    pairs = {tuple(sorted((x, y))) for x, y in itertools.combinations(signed, 2) if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2}
    got = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    assert got <= pairs and (crowd == 1 or got == pairs)

    def roots(links):
        root = {v: v for v in signed}
        changed = True
        while changed:
            changed = False
            for x, y in links:
                low = min(root[x], root[y])
                changed |= root[x] != low or root[y] != low
                root[x] = root[y] = low
        return root

    wanted = {k: v for k, v in roots(pairs).items() if any(k in p for p in pairs)}
    assert {r["node"]: r["root"] for r in components.components(found, "a", "b").collect()} == wanted


def test_simhash_on_odd_rows(spark, docs):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS) + 3
    by = {}
    for r in out:
        by.setdefault(r["id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == {(0, 0)} and (0, 0) in by[None] and by[5] == by[6]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_revisits(spark):
    header = "map<string,string>"
    rows = [
        ("a", "response", "http://www.X.com:80/p/?b=2&a=1#f", 100, 200, {"etag": '"1"', "content-type": "text/html", "date": "1"}, "A"),
        ("b", "response", "https://x.com/p?a=1&b=2&utm_source=z", 86_500, 200, {"last-modified": "m", "date": "2"}, "B"),
        ("c", "response", "https://x.com/p?a=1&b=2", 86_600, 404, {}, "C"),
        ("r1", "revisit", "x.com/p?a=1&b=2", 50, 304, {}, None),
        ("r2", "revisit", "x.com/p?a=1&b=2", 100, 304, {}, None),
        ("r3", "revisit", "x.com/p?a=1&b=2", 101, 304, {"etag": 'W/"1"', "date": "9", "content-type": "bad"}, None),
        ("r4", "revisit", "x.com/p?a=1&b=2", 400_000, 304, {"last-modified": "m"}, None),
        ("r5", "revisit", "x.com/p?a=1&b=2", 400_001, 304, {"last-modified": "n"}, None),
        ("r6", "revisit", None, 5, 304, None, None),
        ("r7", "revisit", "x.com/p?a=1&b=2", None, 304, {}, None),
        ("x", "request", "x.com", 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"record_id string, kind string, url string, at long, status int, headers {header}, payload_sha256 string")
    out = {r["record_id"]: r for r in warc.resolve_revisits(df.withColumn("block", F.lit("clash"))).collect()}
    assert {k: (r["response_id"], r["outcome"]) for k, r in out.items()} == {
        "r1": (None, "unseen"), "r2": (None, "unseen"), "r3": ("a", "resolved"), "r4": ("b", "resolved"), "r5": ("b", "changed"), "r6": (None, "unseen"), "r7": (None, "unseen"),
    }
    assert out["r3"]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "date": "9"} and out["r3"]["payload_sha256"] == "A"
    assert warc.resolve_revisits(df.limit(0)).collect() == []
    twice = [("r", "revisit", "x.com/p", 9, 304, {}, None)] * 2 + [("r", "revisit", "y.com/q", 9, 304, {}, None), (None, "revisit", "y.com/q", 9, 304, {}, None)]
    twice += [("a", "response", "x.com/p", 5, 200, {"date": "1"}, "A")] * 3 + [("a", "response", "x.com/p", 5, 200, {"date": "0"}, "Z"), (None, "response", "y.com/q", 4, 200, {}, "N")]
    twice += [(None, "revisit", None, 9, 304, {}, None), ("n", "response", None, 1, 200, None, "U")]
    out = warc.resolve_revisits(spark.createDataFrame(twice, df.schema)).collect()
    assert Counter((r["record_id"], r["url"], r["response_id"], r["outcome"], r["payload_sha256"]) for r in out) == {
        ("r", "x.com/p", "a", "unchecked", "A"): 2, ("r", "y.com/q", None, "unchecked", "N"): 1, (None, "y.com/q", None, "unchecked", "N"): 1, (None, None, "n", "unchecked", "U"): 1,
    }
    block = spark.range(1).select(warc.headers_map(F.lit("ETag: x\r\nDate: 1\r\ndate: 2")).alias("h")).first()["h"]
    assert block == {"etag": "x", "date": "2"}


def test_mixing(spark, docs, monkeypatch):
    assert mixing.targets([10, 1000, 0]) == pytest.approx([30, 980, 0])
    out = mixing.per_row(mixing.decide(docs)).collect()
    assert len(out) == len(TEXTS) + 3
    assert mixing.decide(docs.limit(0)).collect() == []
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{i % 3 if i % 2 else 0}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided = mixing.decide(df)
    sums = decided.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("s"), F.sum("copies").alias("c"), F.count("*").alias("n")).collect()
    for r in sums:
        assert abs(r["taken"] - r["target"]) <= 60
        assert abs(r["c"] - r["n"] * r["target"] / r["s"]) <= 12
    assert sorted(map(tuple, decided.collect())) == sorted(map(tuple, mixing.decide(df.repartition(7)).collect()))
    mix = mixing.mixed(df.withColumn("size", F.lit("clash")))
    assert mix.columns == ["doc_id", "text", "source", "size"]
    assert mix.count() == sum(r["c"] for r in sums)


def test_mixing_of_repeated_rows_and_other_ids(spark):
    rows = [("same", "a b c d e f g h i j", "s0", {"k": "v"})] * 1000 + [(None, "w " * 7, "s1", None)] * 600 + [(f"x{k}", "u v", "s1", {}) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, tags map<string,string>")
    decided = mixing.decide(df)
    sums = {r["source"]: r for r in decided.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert sorted(sums) == ["s0", "s1"] and all(abs(r["taken"] - r["target"]) <= 20 for r in sums.values())
    each = mixing.per_row(decided).collect()
    assert len(each) == len(rows) and Counter(r["id"] for r in each)["same"] == 1000
    assert sum(r["size"] * r["copies"] for r in each) == sum(r["taken"] for r in sums.values())
    assert max(r["copies"] for r in each) <= 3
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    taken = {r["source"]: r["w"] for r in mix.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    assert taken == {k: r["taken"] for k, r in sums.items()}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5, 5), (7, None), (None, None), (900, 901), (901, 900)]
    root = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()} == root
    assert components.components(df.limit(0), "a", "b").collect() == []


def test_pii(spark, docs):
    out = pii.detect(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" my iban GB82 WEST 1234 5698 7654 32, a@b.co, 1.2.3.4, +1 (974) 555-3436 SSN 123-45-6789")))).collect()
    assert {tuple(s["kind"] for s in r["spans"]) for r in out} == {("iban", "email", "ip", "phone", "ssn")}
    hidden = pii.redact(docs).collect()
    assert [r["text"] for r in hidden if r["doc_id"] in (0, 1)] == [None, ""]
    assert "@" not in pii.masked("+12345678901@b.co x")
    assert pii.detect(docs.limit(0)).collect() == []


TREE = "tree long, node long, parent long, role string, text string, score double"


def test_reply_trees(spark):
    said = "\\ <|im_end|> <\\| \n<|"
    rows = [(1, 1, None, "user", said, 1.0), (1, 2, 1, "assistant", said, 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 2, "user", "x", 1.0), (1, 5, 3, None, "y", None),
            (2, 1, 9, "a b<|\n", "orphan", 1.0), (3, 1, 2, "user", "c", 1.0), (3, 2, 1, "user", "c", 1.0), (None, 1, None, "assistant", "", 0.0), (2, 1, 9, "a b<|\n", "orphan", 1.0)]
    rows += [(7, k, k - 1 if k > 1 else None, "user" if k % 2 else "assistant", f"t{k}", 0.0) for k in range(1, 70)]
    df = spark.createDataFrame(rows, TREE)
    out = chat.format_trees(df, "tree", "node", "parent", "role", "text", "score", top=2).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {(r["tree"], r["rank"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"], r["score"]) for r in out.collect()}
    assert got[1, 1] == ([("user", said), ("assistant", ""), ("", "y")], [""], 6.0)
    assert got[1, 2] == ([("user", said), ("assistant", said), ("user", "x")], [said], 3.0)
    assert got[2, 1][0] == [("a b<|\n", "orphan")] and got[None, 1][0] == [("assistant", "")]
    assert [t[1] for t in got[7, 1][0]] == [f"t{k}" for k in range(1, 70)] and set(got) == {(1, 1), (1, 2), (2, 1), (None, 1), (7, 1)}
    for r in out.collect():
        for s in r["loss_spans"]:
            assert r["formatted"][: s["start"]].endswith("assistant\n") and r["formatted"][s["end"] :].startswith("<|im_end|>")
    assert chat.format_trees(df.limit(0), "tree", "node", "parent", "role", "text").collect() == []


def shingles(text, words=5):
    parts = text.encode().lower().split()
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies(spark, docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, near = [], 0
    for k in range(40):
        w = [rng.choice(words) for _ in range(200)]
        rows.append((2 * k, " ".join(w)))
        for _ in range(k % 5):
            w[rng.randrange(200)] = "edited"
        rows.append((2 * k + 1, " ".join(w)))
    kept = {r["doc_id"] for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(40):
        if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8:
            near += 2 * k + 1 not in kept
        assert 2 * k in kept
    assert near >= 36
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    found = [r["text"] or "" for r in out.collect()]
    assert len(found) == len(set(found)) == len({t or "" for t in TEXTS})  # one more text, and the two without words are alike
    assert neardup.one_of_each(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for df in (plain, plain.limit(0)):
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            if name != "token_ids":
                assert out.columns == plain.columns
            assert rows or df is not plain
    whole = plain
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_stages_equal_their_definitions(spark):
    rng = random.Random(21)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "some", "other", "dogs", "ran", "away", "from", "it"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)), None if k == 3 else "en", f"s{k % 3}", 7) for k in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 7), (101, rows[1][1] + " end", "en", "s1", 7), (102, None, "en", "s0", 0), (103, "123 456", "en", "s0", 7), (104, "mail a.b@c.org now and then", "en", None, 27)]
    rows += [(105, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400)), None, "s0", 400), rows[5]]
    noise = "".join(chr(c) for c in rng.sample(range(0x21, 0x17F), 300))
    rows.append((106, noise, None, "s0", 300))  # neither is learnt from
    df = spark.createDataFrame(rows, DOCS).withColumn("__row", F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)

    known = stages["language_id"](spark, df, "")
    assert known.columns == df.columns
    kept = {r["doc_id"]: r for r in known.collect()}
    assert set(kept) == {r[0] for r in rows} - {102, 103, 105, 106} and known.count() == len(kept) + 1
    assert kept[3]["lang"] == "en" and kept[4]["lang"] == "en"

    one = stages["near_dedup"](spark, df, "")
    unique = [(r[0], r[1] or "") for r in rows]
    assert one.columns == df.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(least_of_groups(list(dict.fromkeys(unique))))

    hidden = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["personal_data"](spark, df, "").collect()}
    assert hidden == {r[0]: (pii.masked(r[1]), len("mail <EMAIL> now and then") if r[0] == 104 else r[4]) for r in rows}

    size = lambda t: len((t or "").split())
    mix = stages["source_mix"](spark, df, "")
    names = ["s0", "s1", "s2", None]
    wanted = mixing.targets([sum(size(r[1]) for r in rows if r[3] == n) for n in names])
    taken = Counter()
    for r in mix.collect():
        taken[r["source"]] += size(r["text"])
    assert mix.columns == df.columns and all(abs(taken[n] - w) <= 61 for n, w in zip(names, wanted, strict=True))

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    coded = stages["token_ids"](spark, df, "").collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in coded) == Counter(
        (r[0], tuple(ids), len(ids)) for r in rows for ids in [library.encode(r[1] or "", add_special_tokens=False).ids]
    )


def prose(rng, length):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(length)]


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = "".join(rng.choice("klmnopqrst") for _ in range(6))
    return out


def least_of_groups(rows):
    """doc_ids that stay, by comparing all texts with all."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if len(s & t) >= 0.8 * len(s | t):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i for i in up if root(i) == i}


def test_odd_sketches_rule_out_only_what_differs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        whole = np.unique(rng.integers(-(1 << 63), 1 << 63, int(rng.integers(1, 900))))
        a, b = (whole[rng.random(len(whole)) < share] for share in rng.choice([0.5, 0.9, 0.97, 1.0], 2))
        if not len(a) or not len(b):
            continue
        common = len(np.intersect1d(a, b))
        possible = neardup.may_be_similar(len(a), neardup.odd_sketch(a), len(b), neardup.odd_sketch(b), 0.8)
        assert possible or common / (len(a) + len(b) - common) < 0.8
    a, b = (np.unique(rng.integers(-(1 << 63), 1 << 63, 500)) for _ in range(2))
    assert not neardup.may_be_similar(500, neardup.odd_sketch(a), 500, neardup.odd_sketch(b), 0.8)


def kept_ids(spark, rows):
    return {r["doc_id"] for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_copies_of_crowded_keys(spark):
    rng = random.Random(11)
    texts = []
    for length, copies, changes in ((200, 50, 4), (180, 50, 4), (150, 60, 3)):  # copies of one text, often alike by their original only
        base = prose(rng, length)
        texts += [base, *(edited(rng, base, changes) for _ in range(copies))]
    passage = prose(rng, 60)
    texts += [passage + prose(rng, 8 + k % 12) for k in range(60)]  # a common passage, other words behind it
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert kept_ids(spark, rows) == least_of_groups(rows)


def test_near_copies_and_long_tokens(spark):
    rng = random.Random(12)
    url = "https://example.org/a/rather/long/path/of/some/article/that/all/share"
    rows = []
    for k in range(60):
        base = prose(rng, rng.randrange(100, 200))
        at = rng.randrange(len(base))
        for _ in range(2):  # the same but for one long token
            token = f"https://example.org/{rng.getrandbits(80):020x}"
            rows.append((len(rows), " ".join([*base[:at], token, *base[at:]])))
        base = prose(rng, rng.randrange(100, 200))
        for changes in (0, 1):  # all of these share one long token
            rows.append((len(rows), " ".join([url, *edited(rng, base, changes)])))
    want = least_of_groups(rows)
    assert len(want) == 120
    assert kept_ids(spark, rows) == want


def test_all_pairs_at_the_bound_are_found(spark):
    rng = random.Random(13)
    rows, alike = [], 0
    for k in range(240):
        base = prose(rng, rng.choice((3, 9, 40, 100, 200, 400)))
        copy = edited(rng, base, round(len(base) * (k % 6) / 200))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    for k in range(30):  # of five shingles four, and of 405 just 0.8 are common
        base = prose(rng, (9, 365)[k % 2])
        rows += [(480 + 2 * k, " ".join(base[:-1])), (481 + 2 * k, " ".join(base + prose(rng, 40) if k % 2 else base))]
    for k in range(0, len(rows), 2):
        alike += jaccard(rows[k][1], rows[k + 1][1]) >= 0.8
    kept = kept_ids(spark, rows)
    assert alike > 150
    for k in range(0, len(rows), 2):
        assert (rows[k + 1][0] not in kept) == (jaccard(rows[k][1], rows[k + 1][1]) >= 0.8)


def test_ibans_side_by_side_and_context_behind():
    def of(text):
        return [(kind, text[start:end]) for start, kind, end, _ in pii.find(text) if pii.KINDS[kind] in ("iban", "ssn")]

    iban, ssn = pii.KINDS.index("iban"), pii.KINDS.index("ssn")
    assert of("GB82WEST12345698765432 DE89370400440532013000") == [(iban, "GB82WEST12345698765432"), (iban, "DE89370400440532013000")]
    assert of("REF AB12 DE89 3704 0044 0532 0130 00") == [(iban, "DE89 3704 0044 0532 0130 00")]
    assert of("123-45-6789 is the ssn") == [(ssn, "123-45-6789")]
    assert of("123-45-6789 is a number") == []
