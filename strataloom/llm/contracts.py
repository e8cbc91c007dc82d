"""What SQL can say of operators that it cannot express whole: their queries' columns of fixed meaning, each with its SQL.

Every query here runs the operator's registered query over its whole table and only picks columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, mixing, pii

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: op6 whole: sets of shingles, links counted over shared shingles, components by reachability.
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.v FROM r JOIN l ON r.m = l.u)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = s.doc_id
"""


def op4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op4_chat_formatting(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


_OP4 = """
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
FROM t GROUP BY conv_id
"""


def op5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: Sources by ceiling over weight: the first k are full, the others share the rest; the right k is the first whose level the next ceiling does not pass.
_OP5 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size / w AS full_at, row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k FROM g),
q AS (
  SELECT *, (SELECT sum(source_size) FROM g)::DOUBLE AS total, coalesce(sum(3.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
level AS (SELECT (total - taken) / open AS l FROM q WHERE full_at >= (total - taken) / open ORDER BY k LIMIT 1)
SELECT d.doc_id, d.size, g.source_size, round(least(3.0 * g.source_size, g.w * (SELECT l FROM level)), 4) AS target
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""


def op8_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _found(kind: str, number: int, pattern: str, keep: str) -> str:
    """Matches of a pattern as rows: each starts after the stretches and matches before it."""
    return f"""
  SELECT doc_id, {number} AS k, '{kind}' AS kind, m, a FROM (
    SELECT doc_id, ms[i] AS m, (list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT doc_id, ms, bs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS bs FROM d))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INTEGER ELSE {_DIGITS}[-i]::INTEGER * 2 - CASE WHEN {_DIGITS}[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PARTS = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"
_OP8 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nf AS ("
    + "\n  UNION ALL".join(
        (
            _found("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _found("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _PARTS),
            _found("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
            _found("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        )
    )
    + """)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
)


def op10_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op10_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following, length(text) // 3 AS third FROM d)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - third) || left(following, third)) AS edited_sha256 FROM n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "contract_op4": op4_columns,
    "contract_op5": op5_columns,
    "contract_op8": op8_columns,
    "contract_op10": op10_columns,
}
ORACLES: dict[str, str] = {"contract_op4": _OP4, "contract_op5": _OP5, "contract_op8": _OP8, "contract_op10": _OP10}
