"""Queries over fingerprints: containment, index upkeep, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import fingerprints as fp
from loomwork.plans.catalog import register
from loomwork.plans.common import WHITE_SQL, documents, table


STRIPPED_SQL = f"nfc_normalize(regexp_replace(text, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g'))"


def prints_sql(source: str, key: str, k: int = fp.K, w: int = fp.W, where: str = "text IS NOT NULL AND text <> ''") -> str:
    """Fingerprints by window functions: another way than the operator's. Hashes are unsigned until the end."""
    hashed = " + ".join(f"cs[i+{j}]::HUGEINT*{fp.BASE ** (k - 1 - j)}::HUGEINT" for j in range(k))
    signed = "(CASE WHEN m.h >= 9223372036854775808 THEN m.h - 18446744073709551616 ELSE m.h END)::BIGINT"
    return f"""
    stripped AS (SELECT {key}, {STRIPPED_SQL} AS s FROM {source} WHERE {where}),
    codes AS (SELECT {key}, list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT) AS cs FROM stripped WHERE length(s) >= {k}),
    grams AS (SELECT {key}, cs, unnest(range(1, len(cs) - {k} + 2)) AS i FROM codes),
    hashed AS (SELECT {key}, i - 1 AS pos, ({hashed}) % 18446744073709551616::HUGEINT AS hash, len(cs) - {k} + 1 AS n FROM grams),
    windows AS (SELECT {key}, pos, n, min(struct_pack(h := hash, p := pos)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m FROM hashed),
    prints AS (SELECT DISTINCT {key}, {signed} AS hash, m.p AS pos FROM windows WHERE pos <= greatest(n - {w}, 0))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


CONTAINMENT_SQL = f"""
WITH {prints_sql("documents", "doc_id")},
held AS (SELECT DISTINCT doc_id, hash FROM prints),
sizes AS (SELECT doc_id, count(*) AS doc_total FROM held GROUP BY 1),
q AS (WITH {prints_sql("benchmark", "item_id")} SELECT * FROM prints),
asked AS (SELECT item_id, hash, min(pos) AS a, max(pos) AS b FROM q GROUP BY 1, 2),
totals AS (SELECT item_id, count(*) AS query_total FROM asked GROUP BY 1),
shared AS (SELECT item_id, doc_id, count(*) AS overlap, min(a) AS span_start, max(b) + {fp.K} AS span_end FROM asked JOIN held USING (hash) GROUP BY 1, 2)
SELECT item_id, doc_id, overlap, span_start, span_end, round(overlap / query_total, 6) AS similarity, round(overlap / doc_total, 6) AS coverage
FROM shared JOIN totals USING (item_id) JOIN sizes USING (doc_id) WHERE overlap / query_total >= 0.5
"""


def _matches(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    asked = fp.index_entries(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return fp.containment(asked, fp.index_entries(_documents(spark, sf_dir), "doc_id", "text"), "item_id", "doc_id", least=least)


@register("plagiarism_containment", CONTAINMENT_SQL)
def plagiarism_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _matches(spark, sf_dir, 0.5)
    return out.select("item_id", "doc_id", "overlap", "span_start", "span_end", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"))


@register(
    "containment_spans",
    f"""WITH m AS ({CONTAINMENT_SQL}) SELECT m.item_id, m.doc_id, d.lang, d.source AS collection, strlen(substr(b.text, 1, span_start::INT)) AS byte_start, strlen(substr(b.text, 1, span_end::INT)) AS byte_end
    FROM m JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)""",
)
def containment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the documents' metadata and the spans in bytes of the raw query."""
    found = fp.with_byte_spans(_matches(spark, sf_dir, 0.5), table(spark, sf_dir, "benchmark"), "item_id")
    named = fp.with_metadata(found, table(spark, sf_dir, "documents"), "doc_id", "lang", "source")
    return named.select("item_id", "doc_id", "lang", F.col("source").alias("collection"), "byte_start", "byte_end")


@register(
    "plagiarism_advisories",
    f"""WITH m AS ({CONTAINMENT_SQL.replace(">= 0.5", ">= 0.1")}),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, coverage DESC, doc_id) AS rank FROM m)
    SELECT item_id, doc_id, rank, similarity, CASE WHEN similarity >= 0.5 THEN 'HIGH' WHEN similarity >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM r WHERE rank <= 10""",
)
def plagiarism_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _matches(spark, sf_dir, 0.1).withColumns({"similarity": F.round("similarity", 6), "coverage": F.round("coverage", 6)})
    return fp.advisories(rounded, "item_id").select("item_id", "doc_id", "rank", "similarity", "priority")


@register(
    "originality",
    f"""WITH m AS ({CONTAINMENT_SQL.replace(">= 0.5", ">= 0.1")})
    SELECT b.item_id, coalesce(max(similarity), 0) AS max_similarity, arg_min(doc_id, (-similarity, -coverage, doc_id)) AS best_match, round((1 - coalesce(max(similarity), 0)) * 100, 1) AS originality
    FROM benchmark b LEFT JOIN m USING (item_id) GROUP BY 1""",
)
def originality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _matches(spark, sf_dir, 0.1).withColumns({"similarity": F.round("similarity", 6), "coverage": F.round("coverage", 6)})
    best = rounded.groupBy("item_id").agg(F.max("similarity").alias("s"), F.min(F.struct(-F.col("similarity"), -F.col("coverage"), "doc_id")).alias("b"))
    most = F.coalesce("s", F.lit(0.0))
    rows = table(spark, sf_dir, "benchmark").select("item_id").join(best, "item_id", "left")
    return rows.select("item_id", most.alias("max_similarity"), F.col("b.doc_id").alias("best_match"), F.round((1 - most) * 100, 1).alias("originality"))


@register(
    "fingerprint_documents",
    f"WITH {prints_sql('documents', 'doc_id')} SELECT doc_id, count(*) AS n_prints, count(DISTINCT hash) AS n_hashes, min(hash) AS least_hash, sum(pos) AS positions FROM prints GROUP BY 1",
)
def fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.summaries(_documents(spark, sf_dir), "doc_id", "text")


@register(
    "fingerprint_passages",
    f"WITH {prints_sql('benchmark', 'item_id', 12, 5)} SELECT item_id, hash, pos FROM prints",
)
def fingerprint_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer k-grams, whose hashes go round 2^64."""
    return fp.fingerprints(table(spark, sf_dir, "benchmark"), "item_id", "text", 12, 5)


@register(
    "fingerprint_index_totals",
    f"WITH {prints_sql('documents', 'doc_id')}, d AS (SELECT DISTINCT doc_id, hash FROM prints) SELECT count(DISTINCT doc_id) AS documents, count(*) AS total_fingerprints, count(DISTINCT hash) AS distinct_hashes FROM d",
)
def fingerprint_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.totals(fp.index_entries(_documents(spark, sf_dir), "doc_id", "text"), "doc_id")


GOOD = "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@register(
    "index_build_stats",
    f"""WITH {prints_sql('documents', 'doc_id', where=f"text <> '' AND length(text) <= 100000 AND NOT {GOOD}")}, d AS (SELECT DISTINCT doc_id, hash FROM prints)
    SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM documents WHERE NOT {GOOD}) AS indexed_documents, (SELECT count(*) FROM documents WHERE {GOOD}) AS skipped_documents, (SELECT count(*) FROM d) AS total_fingerprints""",
)
def index_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexing what an index of the good documents lacks."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    index = good.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("parent_id"))
    _, stats = fp.build(_documents(spark, sf_dir), index, "doc_id")
    return stats


CHUNK_SQL = """
WITH c AS (SELECT doc_id::VARCHAR AS parent, text, greatest(1, ceil(length(text) / 1000))::INT AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
p AS (SELECT *, unnest(range(0, n))::INT AS chunk_index FROM c)
SELECT CASE WHEN n = 1 THEN parent ELSE parent || '#chunk_' || chunk_index END AS chunk_id, parent, chunk_index, chunk_index * 1000 AS char_start,
  least(length(text), chunk_index * 1000 + 1000)::INT AS char_end, md5(substr(text, chunk_index * 1000 + 1, 1000)) AS text_md5 FROM p"""


@register("document_chunks", CHUNK_SQL)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fp.chunks(documents(spark, sf_dir), "doc_id", "text", 1000)
    return out.select("chunk_id", "parent", "chunk_index", "char_start", "char_end", F.md5("text").alias("text_md5"))


@register(
    "index_skip_existing",
    """WITH known AS (SELECT doc_id::VARCHAR AS k FROM labels WHERE quality = 1) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM known WHERE k = d.doc_id::VARCHAR)""",
)
def index_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(None).cast("string").alias("parent_id"))
    return fp.unseen(table(spark, sf_dir, "documents").select("doc_id"), index, "doc_id")


def _split_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the good documents with k 6, and of all labelled ones with k 8."""
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    old = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    new = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    entries = lambda df, k: fp.index_entries(df, "doc_id", "text", k, 4).select("doc_id", "hash", "pos")
    return entries(old, 6), entries(new, 8)


OLD_SQL = f"old AS (WITH {prints_sql('documents', 'doc_id', 6, 4, GOOD)} SELECT doc_id, hash FROM prints GROUP BY ALL)"
NEW_SQL = f"new AS (WITH {prints_sql('documents', 'doc_id', 8, 4, 'doc_id IN (SELECT doc_id FROM labels)')} SELECT doc_id, hash FROM prints GROUP BY ALL)"


@register("index_upsert", f"WITH {OLD_SQL}, {NEW_SQL}, i AS (SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new) SELECT doc_id, count(*) AS n, sum(hash % 1000003) AS hashes FROM i GROUP BY 1")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the new entries are replaced."""
    old, new = _split_index(spark, sf_dir)
    return fp.upsert(old, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("hash") % 1000003).alias("hashes"))


@register("index_add_missing", f"WITH {OLD_SQL}, {NEW_SQL}, i AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)) SELECT doc_id, count(*) AS n, sum(hash % 1000003) AS hashes FROM i GROUP BY 1")
def index_add_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the index has stay as they are."""
    old, new = _split_index(spark, sf_dir)
    return fp.add_missing(old, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("hash") % 1000003).alias("hashes"))


@register("index_remove", f"WITH {NEW_SQL} SELECT doc_id, count(*) AS n FROM new WHERE NOT {GOOD} GROUP BY 1")
def index_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new = _split_index(spark, sf_dir)
    gone = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return fp.remove(new, gone, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("line_chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fp.line_chunks(documents(spark, sf_dir), "doc_id", "text", 1000)
    return out.select("chunk_id", "parent", "chunk_index", "char_start", "char_end", F.md5("text").alias("text_md5"))
