"""op4: licenses of documents, which lie in directories by source and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.licenses import TEMPLATES, THRESHOLD, TemplateIndex, scan_licenses

NAME = "op4_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs, "doc_id", path)


_VALUES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
#: Without one of these words no unit reaches the threshold.
_NEEDED = "|".join(sorted(TemplateIndex(TEMPLATES, THRESHOLD).needed))
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH templates(license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, w, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all({_LOW.format('text')}, '[a-z0-9]+')) AS w FROM templates) GROUP BY ALL),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tw GROUP BY w),
other AS (SELECT ln(1 + (SELECT count(*) FROM templates)) + 1 AS idf),
tn AS (SELECT license, sqrt(sum(pow(tf * idf, 2))) AS norm FROM tw JOIN idf USING (w) GROUP BY license),
docs AS (
  SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir,
         coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || doc_id || '.txt' AS path,
         {_LOW.format("coalesce(text, '')")} AS t
  FROM documents
),
units AS (
  SELECT doc_id, row_number() OVER () AS u, unit
  FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+')) AS unit FROM docs)
),
uw AS (SELECT doc_id, u, w, count(*) AS tf FROM (SELECT doc_id, u, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS w FROM units
       WHERE regexp_matches(unit, '{_NEEDED}')) GROUP BY ALL),
un AS (SELECT doc_id, u, sqrt(sum(pow(tf * coalesce(idf.idf, other.idf), 2))) AS norm, sum(tf) AS words FROM uw LEFT JOIN idf USING (w), other GROUP BY ALL),
cosines AS (
  SELECT uw.doc_id, uw.u, tw.license, any_value(un.words) AS words, round(sum(uw.tf * tw.tf * idf.idf * idf.idf) / (any_value(un.norm) * any_value(tn.norm)), 9) AS score
  FROM uw JOIN tw USING (w) JOIN idf USING (w) JOIN un ON un.doc_id = uw.doc_id AND un.u = uw.u JOIN tn ON tn.license = tw.license
  GROUP BY uw.doc_id, uw.u, tw.license
),
hits AS (SELECT doc_id, u, any_value(words) AS words, max((score, license)) AS top FROM cosines GROUP BY doc_id, u HAVING max(score) >= {THRESHOLD}),
own AS (SELECT doc_id, max(top) AS top, sum(words) AS words FROM hits GROUP BY doc_id),
totals AS (SELECT doc_id, len(regexp_extract_all(t, '[a-z0-9]+')) AS n FROM docs),
table_ AS (
  SELECT d.doc_id, d.path, d.dir, o.top[2] AS own_license, o.top[1] AS own_score, coalesce(o.words / n.n >= 0.5, false) AS is_license_file
  FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN totals n USING (doc_id)
),
dirs AS (SELECT dir, arg_min(own_license, (-own_score, path)) AS given FROM table_ WHERE is_license_file GROUP BY dir)
SELECT t.doc_id, t.path, t.own_license, round(t.own_score, 6) AS own_score, t.is_license_file, coalesce(t.own_license, d.given) AS license,
       CASE WHEN t.own_license IS NOT NULL THEN 'own' WHEN d.given IS NOT NULL THEN 'inherited' END AS via
FROM table_ t LEFT JOIN dirs d USING (dir)
"""
