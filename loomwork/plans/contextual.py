"""Queries over contextual rules, on sentences made of their own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import contextual
from loomwork.plans.catalog import register
from loomwork.plans.common import documents
from loomwork.plans.grammar import WIDTH, listed, rule_words, words_sql

WORDS = [
    "བཅང", "པོ", "ཆེན", "ཕོ", "ཧ", "ཇིག", "བརྟེན", *contextual.SAFE, "བྱས", "ནི", "ཆེད", "གལ", "མེད", "མི", "མ", "པ", "ན", "བསྦྱོང", "ནད", "ཤད", "སྐོར", "སོན", "བཤེས", "བྱ", "ཟང", "བསྤྱོད", "མནུས", "བཏན", "ཡོན", "སླབས",
    "ཀློ", "དག", "དགེ", "གིས", "པར", "སྤྲོ", "དགའ", "བོང", "བུ", "སྦྱོང", "ཕྱི", "ལ", "ཡིག", "ཆ", "སློབ", "ཚན", "དེ", "རིང", "རྒྱུ", "བྱེད", "དང", "གི", "མི", "བྱས", "བྱས", "ཆེད", "མ", "བྱ", "གལ", "ཆེན", "བོང", "བྱ",
]
CONFUSED = (("དག་གིས", "དགེ་གིས"), ("པར སྤྲོ", "བརྡ་སྤྲོད"), ("སྐོརཤད", "སྐོར་བཤད"), ("ཟང་", "བཟང"), ("མི་བྱས་ནི", "མ་བྱས་ནི"), ("གནད་པ", "གནད"), ("", "x"), ("ལ", ""))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_words(documents(spark, sf_dir), WORDS).where(F.size("words") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / WIDTH).cast("int")), lambda g: F.concat(F.array_join(F.slice("words", g * WIDTH + 1, F.lit(WIDTH)), "་"), F.lit("།")))
    return rows.select("doc_id", F.posexplode_outer(groups).alias("sent_idx", "text")).withColumn("sent_start", F.col("sent_idx") * 1000)


def _any(column: str, forms) -> str:
    return "(" + " OR ".join(f"starts_with(coalesce({column}, ''), '{f}')" for f in forms) + ")"


SAFE_SQL = listed(contextual.SAFE)
#: The chain of rules as one conditional, in their order: what decides, and what it tells ('' for nothing).
CHAIN_SQL = f"""CASE
  WHEN g3 IS NOT NULL THEN 'SPELLING_FALLBACK_COMPOUND|' || g3 || '|3' WHEN g2 IS NOT NULL THEN 'SPELLING_FALLBACK_COMPOUND|' || g2 || '|2'
  WHEN w = 'བཅང' AND r = 'པོ' THEN 'SPELLING_FALLBACK_BCANG_PO|ཆང་པོ|2' WHEN w = 'ཆེན' AND r = 'ཕོ' THEN 'SPELLING_FALLBACK_CHEN_PHO|ཆེན་པོ|2' WHEN w = 'ཧ' AND r = 'བཅང' THEN 'SPELLING_FALLBACK_HA_BCANG|ཧ་ཅང|2'
  WHEN g1 IS NOT NULL THEN 'SPELLING_FALLBACK|' || g1 || '|1' WHEN w = 'བཅང' THEN 'SPELLING_FALLBACK|ཅང|1'
  WHEN w = 'ཇིག' AND {_any("r", ["བརྟེན"])} THEN 'CONTEXT_JIG_JIGTEN|འཇིག་རྟེན|1' WHEN w IN ({SAFE_SQL}) THEN ''
  WHEN w = 'བྱས' AND r = 'ནི' THEN 'VERB_FORM_BYAS_NI|བྱེད་པ|2' WHEN w = 'བྱས' AND r = 'ཆེད' THEN 'VERB_FORM_BYAS_CHED|བྱེད་ཆེད|2'
  WHEN w = 'གལ' AND r = 'ཆེན' AND coalesce(x, '') NOT IN ({listed(contextual.AFTER_ADJECTIVE)}) THEN 'ADJ_NOMINALIZATION|གལ་ཆེན་པོ|2'
  WHEN w = 'མེད' AND coalesce(l, '') NOT IN ('མི', 'མ') AND NOT {_any("r", ["པ", "བ", "ན"])} THEN 'VERB_NOMINALIZATION|མེད་པ|1'
  WHEN w = 'བསྦྱོང' THEN 'SPELLING_BSBYONG_SBYONG|སྦྱོང|1' WHEN w = 'ནད' AND {_any("l", ["གལ"])} THEN 'CONTEXT_NAD_GNAD|གནད|1'
  WHEN w = 'ཤད' AND (l = 'སྐོར' OR r = 'པ') THEN 'CONTEXT_SHAD_BSHAD|བཤད|1' WHEN w = 'སོན' AND {_any("r", ["པོ"])} THEN 'CONTEXT_SON_GSON|གསོན|1'
  WHEN w = 'བཤེས' AND r = 'བྱ' THEN 'CONTEXT_BSHES_SHES|ཤེས|1' WHEN w = 'ཟང' AND {_any("r", ["བསྤྱོད"])} THEN 'CONTEXT_ZANG_BZANG|བཟང|1'
  WHEN w = 'མནུས' THEN 'CONTEXT_MNUS_NUS|ནུས|1' WHEN w = 'བཏན' AND l = 'ཡོན' THEN 'CONTEXT_BTAN_TAN|ཏན|1' WHEN w = 'སླབས' THEN 'STRUCTURAL_SLABS_BSLABS|བསླབས|1' WHEN w = 'ཀློ' THEN 'SPELLING_KLO_KLOG|ཀློག|1'
  WHEN starts_with(w, 'དག') AND NOT {_any("w", ["དགེ", "དགོ"])} THEN CASE WHEN NOT {_any("l", ["དེ", "འདི", "ཁོ", "རྣམ"])} AND {_any("r", ["གིས"])}
    AND (contains(txt, 'སློབ་') OR contains(txt, 'སླབས') OR contains(txt, 'བརྡ་སྤྲོད')) THEN 'CONTEXT_DAG_DGE|དགེ|1' ELSE '' END
  WHEN w = 'པར' THEN CASE WHEN {_any("r", ["སྤྲོ"])} AND (contains(txt, 'དགེ') OR contains(txt, 'གིས')) THEN 'CONTEXT_PAR_BRDA|བརྡ|1' ELSE '' END
  WHEN w = 'སྤྲོ' THEN CASE WHEN NOT {_any("l", ["དགའ"])} AND {_any("l", ["པར", "བརྡ"])} THEN 'CONTEXT_SPRO_SPROD|སྤྲོད|1' ELSE '' END
  WHEN w = 'བོང' THEN CASE WHEN NOT {_any("r", ["བུ", "ཚད"])} AND (contains(txt, 'ཡིག་ཆ') OR contains(txt, 'ཡི་གེ་') OR contains(txt, 'ང་ཚོས') OR contains(txt, 'སློབ་') OR contains(txt, 'ཀློ')) THEN 'CONTEXT_BONG_SBYONG|སྦྱོང|1' ELSE '' END
  WHEN w = 'བྱ' THEN CASE WHEN NOT {_any("r", ["བ", "རྒྱུ", "དངོས", "དེ", "པ"])} AND {_any("l", ["བོང", "སྦྱོང"])} THEN 'TENSE_BYA_BYAS|བྱས|1' ELSE '' END
  WHEN w = 'ཕྱི' THEN CASE WHEN NOT {_any("r", ["ར", "འི", "རོལ", "རྒྱལ", "མོ", "ལ"])} AND {_any("l", ["ལ", "ཏུ", "རུ", "སུ"])} AND (contains(txt, 'དེ་རིང') OR contains(txt, 'སློབ་ཚན')) THEN 'TENSE_PHYI_PHYIN|ཕྱིན|1' ELSE '' END
  END"""
VALUES = ", ".join(f"('{a}', '{b}')" for a, b in CONFUSED)
CONTEXT_SQL = f"""WITH RECURSIVE {words_sql(WORDS)},
every AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM told),
nodes AS (SELECT doc_id, p // {WIDTH} AS s, p % {WIDTH} AS i, w FROM every),
texts AS (SELECT doc_id, s, string_agg(w, '་' ORDER BY i) || '།' AS txt FROM nodes GROUP BY 1, 2),
placed AS (SELECT n.*, txt, lag(w) OVER v AS l, lead(w) OVER v AS r, lead(w, 2) OVER v AS x, s * 1000 + (coalesce(sum(length(w) + 1) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a
  FROM nodes n JOIN texts USING (doc_id, s) WINDOW v AS (PARTITION BY doc_id, s ORDER BY i)),
confused AS (SELECT trim(a, '་ །') AS k, min(b) AS b FROM (VALUES {VALUES}) t(a, b) WHERE trim(a, '་ །') <> '' AND b <> '' GROUP BY 1),
looked AS (SELECT p.*, coalesce(c1.b, c2.b, c3.b) AS g3, coalesce(d1.b, d2.b, d3.b) AS g2, e.b AS g1 FROM placed p
  LEFT JOIN confused c1 ON c1.k = w || '་' || r || '་' || x LEFT JOIN confused c2 ON c2.k = w || ' ' || r || ' ' || x LEFT JOIN confused c3 ON c3.k = w || r || x
  LEFT JOIN confused d1 ON d1.k = w || '་' || r LEFT JOIN confused d2 ON d2.k = w || ' ' || r LEFT JOIN confused d3 ON d3.k = w || r LEFT JOIN confused e ON e.k = w),
judged AS (SELECT *, {CHAIN_SQL} AS said FROM looked),
cand AS (SELECT doc_id, s, i, a, w, r, x, string_split(said, '|')[1] AS code, string_split(said, '|')[2] AS fix, string_split(said, '|')[3]::INT AS width FROM judged WHERE said <> ''),
walk AS (SELECT DISTINCT doc_id, s, 0 AS i, -1 AS until FROM nodes UNION ALL
  SELECT k.doc_id, k.s, k.i + 1, CASE WHEN c.code IS NOT NULL AND k.i > k.until THEN k.i + c.width - 1 ELSE k.until END FROM walk k LEFT JOIN cand c ON c.doc_id = k.doc_id AND c.s = k.s AND c.i = k.i WHERE k.i < {WIDTH}),
kept AS (SELECT c.* FROM cand c JOIN walk k ON k.doc_id = c.doc_id AND k.s = c.s AND k.i = c.i WHERE c.i > k.until)
SELECT doc_id, s AS sent_idx, a AS char_start, a + length(w) + CASE WHEN width > 1 THEN 1 + length(r) ELSE 0 END + CASE WHEN width > 2 THEN 1 + length(x) ELSE 0 END AS char_end, code, fix FROM kept
UNION ALL SELECT doc_id, s, a, a + length(w), 'TENSE_MI_MA', CASE w WHEN 'བྱས' THEN 'མ་བྱས' ELSE 'བྱས' END FROM placed WHERE (w = 'བྱས' AND l = 'མི') OR (w = 'བྱ' AND l = 'མ')"""


@register("contextual_rules", CONTEXT_SQL)
def contextual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    confused = spark.createDataFrame(list(CONFUSED), "wrong string, right string")
    found = contextual.findings(sentences(spark, sf_dir), confused)
    return found.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "code", "fix")
