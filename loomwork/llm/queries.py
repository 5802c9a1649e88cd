"""The opN queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import bpe, chat, media, mixing, pii, ppm, rules, simhash, tokenfile, warc
from loomwork.session import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def sha(text: str) -> F.Column:
    return F.sha2(F.encode(F.col(text), "UTF-8"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path).drop("text")
    return (
        bpe.decode(coded, path)
        .withColumn("ids_text", F.array_join(F.col("ids").cast("array<string>"), " "))
        .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha("ids_text").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = rules.learn(docs, table(spark, sf_dir, "labels"))
    out = rules.with_stats(docs).withColumn("base_failed", rules.base_failed())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & rules.verdict(learnt)).alias("kept"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2
    model = ppm.fit(docs.where(~held), "doc_id", "text", "lang")
    return ppm.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = F.when(F.crc32(payload) % 2 == 1, media.bmp(payload)).otherwise(media.netpbm(payload))  # both formats, by the text alone
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), kept.alias("media"))
    pixels = F.col("image.pixels")
    return media.read_media(stored).select(
        "doc_id", "n_bytes", F.octet_length(pixels).cast("long").alias("payload_bytes"), F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", F.col("image.dhash"), F.substring(F.sha2(F.col("image.tile"), 256), 1, 16)).alias("feature"),
    )


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokenfile.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    read = tokenfile.read_tokens(spark, written).select("id", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return tokenfile.with_starts(read).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records of the pages: a full response of each, a revisit a second before any
    other crawl of the page's minute, and one a month later under another spelling of the URL.

    By a digest of the page's number a later revisit's entity tag agrees,
    differs, or is missing with or without a modification date.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = F.lit(1_700_000_000).cast("long") + 60 * F.col("page_id")
    pick = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 1), 16, 10).cast("int") % 4
    base = pages.select("page_id", "url", tag.alias("tag"), at.alias("at"), pick.alias("pick"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))
    empty = F.map_filter(F.create_map(F.lit(""), F.lit("")), lambda k, v: F.lit(False))
    stamp = F.concat(F.lit("day "), F.floor(F.col("at") / 86400).cast("string"))
    response = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("tag"), F.lit("last-modified"), stamp, F.lit("date"), F.col("at").cast("string"), F.lit("cache-control"), F.lit("no-cache")
    )
    late = F.create_map(F.lit("date"), (F.col("at") + 2_592_000).cast("string"), F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=60"))
    tagged = (
        F.when(F.col("pick") == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("tag"))))
        .when(F.col("pick") == 1, F.create_map(F.lit("etag"), F.lit('"other"')))
        .when(F.col("pick") == 2, F.create_map(F.lit("last-modified"), stamp))
        .otherwise(empty)
    )
    name = lambda x: F.concat(F.lit(x), F.col("page_id").cast("string"))
    none = F.lit(None).cast("string")
    return (
        base.select(name("full-").alias("record_id"), F.lit("response").alias("kind"), "url", "at", F.lit(200).alias("status"), response.alias("headers"), F.col("sha").alias("payload_sha256"))
        .unionByName(base.select(name("early-").alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("at") - 1).alias("at"), F.lit(304).alias("status"), empty.alias("headers"), none.alias("payload_sha256")))
        .unionByName(
            base.select(
                name("late-").alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), (F.col("at") + 2_592_000).alias("at"),
                F.lit(304).alias("status"), F.map_concat(late, tagged).alias("headers"), none.alias("payload_sha256"),
            )
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(spark, sf_dir))
    return found.select("record_id", "url", F.col("at").alias("captured_at"), "response_id", "outcome", warc.headers_text(F.col("headers")).alias("headers"), "payload_sha256")


WARC_SQL = r"""
WITH base AS (
  SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 1700000000 + 60 * page_id AS ts,
         sha256(coalesce(html, '')) AS sha, (strpos('0123456789abcdef', substr(md5(page_id::VARCHAR), 1, 1)) - 1) % 4 AS pick,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))) AS kept
  FROM base),
named AS (
  SELECT page_id, tag, ts, sha, pick, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM parts),
asked AS (
  SELECT 'early-' || page_id AS record_id, page_id, url, ts - 1 AS ts, 'early' AS kind FROM named
  UNION ALL SELECT 'late-' || page_id, page_id, url, ts + 2592000, 'late' FROM named),
found AS (
  SELECT a.record_id, a.page_id, a.url, a.ts, a.kind, max(struct_pack(t := n.ts, r := 'full-' || n.page_id)) AS best
  FROM asked a LEFT JOIN named n ON n.url IS NOT DISTINCT FROM a.url AND n.ts < a.ts GROUP BY ALL),
joined AS (
  SELECT f.record_id, f.url, f.ts, f.kind, f.best.r AS response_id, o.tag AS own_tag, o.pick, o.ts AS own_at, r.tag AS tag, r.ts AS res_at, r.sha
  FROM found f JOIN named o ON o.page_id = f.page_id LEFT JOIN named r ON 'full-' || r.page_id = f.best.r),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'unseen' WHEN kind = 'early' OR pick = 3 THEN 'unchecked'
    WHEN pick = 0 THEN CASE WHEN own_tag = tag THEN 'resolved' ELSE 'changed' END
    WHEN pick = 1 THEN 'changed'
    WHEN own_at // 86400 = res_at // 86400 THEN 'resolved' ELSE 'changed' END AS outcome FROM joined)
SELECT record_id, url, ts AS captured_at, response_id, outcome,
  CASE WHEN outcome NOT IN ('resolved', 'unchecked') THEN NULL
    WHEN kind = 'early' THEN 'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || res_at || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: day ' || res_at // 86400
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) ||
      'etag: ' || CASE WHEN pick = 0 THEN 'W/' || own_tag ELSE tag END || chr(10) ||
      'last-modified: day ' || CASE WHEN pick = 2 THEN own_at // 86400 ELSE res_at // 86400 END END AS headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN sha END AS payload_sha256
FROM judged
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.per_row(mixing.decide(table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [pii.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.sql(f"select -1L conv_id, t.turn turn, t.role role, '{said}' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.withColumn("node", F.row_number().over(by)).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    out = chat.format_trees(nodes, "conv_id", "node", "parent", "role", "text")
    read = out.select(F.col("tree").alias("conv_id"), "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.withColumn("turns_text", turns_text).withColumn("loss_text", F.array_join("loss", "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha("turns_text").alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_rules": op2_quality_rules,
        "op3_language_id": op3_language_id,
        "op4_media": op4_media,
        "op5_token_file": op5_token_file,
        "op6_simhash": op6_simhash,
        "op7_warc": op7_warc,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": WARC_SQL}
