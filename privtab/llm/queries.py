"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privtab.llm import (bpe, decontaminate, divergence, fingerprint, html_text, langid, licenses, linedup, lm, neardup, substrings,
                         turns, urls)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(of).cast("string")) % parts


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_main_text(spark, sf_dir):
    out = html_text.extract_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "carry.url", "text", "n_chars")


def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_repeated_substrings(spark, sf_dir):
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_license_texts(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_bpe(spark, sf_dir):
    out = bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_language(spark, sf_dir):
    out = langid.identify(_table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_language_model(spark, sf_dir):
    return lm.score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return turns.repair(turns.damaged(_table(spark, sf_dir, "conversations"), F.crc32(key) % 20))


def op13_line_dedup(spark, sf_dir):
    out = linedup.drop_common_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_main_text, op2_near_duplicates, op3_repeated_substrings, op4_license_texts, op5_decontamination, op6_bpe,
        op7_fingerprints, op8_url_filter, op9_language, op10_language_model,
        op11_source_divergence, op12_conversation_repair, op13_line_dedup)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP2 = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(ws[p:p+4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.low, w.doc_id), w.doc_id) AS component_id,
       coalesce(least(c.low, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""

_OP3 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN low USING (g) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS k FROM each ANTI JOIN hit USING (doc_id, i)
         GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP5 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p+least(10, len(ws))-1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p+n-1], ' ') AS g
       FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT i) AS k FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS t
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(words.k, 0) AS n_hit, coalesce(items.k, 0) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(words.k, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, {_TERMS}) AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
size AS (SELECT lang, source, sum(c) AS n FROM n GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.c, 0) AS c,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.c, 0) + 1)) // (coalesce(size.n, 0) + v.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (kept.c + 1)) // (v.n + v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN size USING (lang, source)
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
part AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
         LEFT JOIN sums ON sums.lang = x.lang AND sums.source = x.source AND sums.item = y.source
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM part)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR k <= 200
"""

_OP13 = """
WITH l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, x, translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, x, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": _OP2, "op3_repeated_substrings": _OP3, "op4_license_texts": licenses.oracle(),
            "op5_decontamination": _OP5, "op11_source_divergence": _OP11,
            "op13_line_dedup": _OP13}
