"""op2: secrets in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm import secrets

NAME = "op2_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "n_entropy",
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("all", ",").alias("spans"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, kind, ord, s, e, m): matches by the lengths of what lies between and before them."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, s, s + length(ms[i]) AS e, ms[i] AS m FROM (
  SELECT doc_id, i, ms, gs, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS gs FROM d WHERE regexp_matches(t, {p}))))
  WHERE length(gs[i]) >= {least}"""


_BASE = " UNION ALL ".join(_matches(kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(secrets.BASE))
_ALLOWED = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in secrets.ALLOW[:-1])
_LEAST = "CASE " + " ".join(f"WHEN regexp_matches(m, {_quoted(p)}) THEN {least}e0" for _, p, least in secrets.CLASSES) + " ELSE 1e300 END"
_W = secrets.WINDOW

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_BASE}),
runs AS (SELECT * FROM ({_matches('entropy', len(secrets.BASE), f'({secrets.CANDIDATE})', 1, secrets.MIN_CANDIDATE)}) WHERE regexp_matches(m, '[0-9]')),
open AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e)
  AND NOT ({_ALLOWED}) AND NOT list_bool_or(list_transform(list_distinct(string_split(m, '')), lambda c: contains(m, repeat(c, 8))))),
windows AS (SELECT doc_id, s, i, m[i : i + {_W - 1}] AS w FROM (SELECT doc_id, s, m, unnest(range(1, greatest(length(m) - {_W - 1}, 1) + 1)) AS i FROM open)),
counts AS (SELECT doc_id, s, i, length(any_value(w)) AS n, count(*) AS c FROM (SELECT doc_id, s, i, w, unnest(string_split(w, '')) AS ch FROM windows) GROUP BY doc_id, s, i, ch),
entropies AS (SELECT doc_id, s, i, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS h FROM counts GROUP BY doc_id, s, i),
best AS (SELECT doc_id, s, max(h) AS h FROM entropies GROUP BY doc_id, s),
more AS (SELECT o.doc_id, o.kind, o.ord, o.s, o.e FROM open o JOIN best b ON b.doc_id = o.doc_id AND b.s = o.s WHERE b.h >= {_LEAST}),
listed AS (SELECT doc_id, kind, ord, s, e FROM base UNION ALL SELECT * FROM more),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'entropy') AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS a FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""
