"""op13: all conversations, damaged by rule, repaired and reported on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.registry import register
from polarity.llm.repair import REPORT, repair, reports

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` chooses: 0 drops the row, 1 empties its
    text, 2 takes out its sentence ends, 3 repeats it, 4 makes it a user's; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return (rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
            .filter("kind != 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
            .select("conv_id", "turn", "role", "text"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    ids = rows.select("conv_id").distinct()
    found = reports(repair(damaged(rows)))
    nothing = {**{c: F.lit(0).cast("bigint") for c in REPORT[1:7]}, "audit": F.lit(""), "repaired_sha256": F.lit(EMPTY_SHA256)}
    return (ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
            .select("conv_id", *[F.coalesce(found[c], nothing[c]).alias(c) for c in REPORT[1:]]))


# ----------------------------------------------------------------- the same in SQL: a path a state is one string
# of cost (9 digits), audit, character 1, repaired lines; the least string is the cheapest, then least audit

def _crc32_sql(k: str) -> str:
    characters = f"list_transform(string_split({k}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {characters}), lambda a, b: {bits}))"


def _edit_sql(path: str, cost: str, letter: str, line: str = "''") -> str:
    return (f"CASE WHEN {path} IS NULL THEN NULL ELSE lpad(CAST(CAST({path}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') "
            f"|| substr({path}, 10, strpos({path}, chr(1)) - 10) || '{letter}' || substr({path}, strpos({path}, chr(1))) || {line} END")


def _put_sql(path: str, role: str) -> str:
    return _edit_sql(path, "2", "I", f"chr(10) || '{role}:'")


def _kept_sql(path: str, initial: str) -> str:
    return f"CASE WHEN initial = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {_edit_sql(path, 'more', 'K', 'chr(10) || line')} END"


def _reroled_sql(path: str, role: str) -> str:
    return f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edit_sql(path, '2 + more', 'R', f"chr(10) || '{role}:' || text")} END"


def _with_inserts_sql(source: str) -> str:
    u = f"least(s2, {_put_sql('s0', 'user')}, {_put_sql('s1', 'user')}, {_put_sql('s3', 'user')})"
    return f"SELECT *, least(s3, {_put_sql('u', 'assistant')}) AS a FROM (SELECT *, {u} AS u FROM ({source}))"


SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(2) t(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM damaged),
marked AS (
  SELECT c, i, turn, text, role[1:1] AS initial, role || ':' || text AS line,
         CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) || role[1:1] AS pair FROM placed),
told AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY c),
paths AS (
  SELECT c, CAST(1 AS BIGINT) AS i, '000000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM told
  UNION ALL
  SELECT c, i + 1, {_edit_sql('s0', '3', 'D')}, least({_edit_sql('s1', '3', 'D')}, {_kept_sql('s0', 's')}),
         least({_edit_sql('u', '3', 'D')}, {', '.join(_kept_sql(x, 'u') for x in ('s0', 's1', 'a'))}, {', '.join(_reroled_sql(x, 'user') for x in ('s0', 's1', 'a'))}),
         least({_edit_sql('a', '3', 'D')}, {_kept_sql('u', 'a')}, {_reroled_sql('u', 'assistant')})
  FROM ({_with_inserts_sql("SELECT p.*, m.text, m.initial, m.line, m.fault, CAST(m.fault = 'truncated' AS INTEGER) AS more FROM paths p JOIN marked m ON p.c = m.c AND p.i = m.i")})),
ends AS (SELECT c, least(s0, a) AS best FROM ({_with_inserts_sql('SELECT p.* FROM paths p JOIN told USING (c) WHERE p.i = told.n + 1')}))
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(best[1:9] AS INTEGER), 0) AS BIGINT) AS cost,
       coalesce(substr(best, 10, strpos(best, chr(1)) - 10), '') AS audit,
       sha256(coalesce(substr(best, strpos(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM drawn) d LEFT JOIN told USING (c) LEFT JOIN ends USING (c)
"""


@register("op13_conversation_repair", SQL)
def op13_conversation_repair(spark, sf_dir):
    return repaired_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
