"""op2: all conversations, and one made of control strings, formatted and read back."""

from pyspark.sql import functions as F

from polarity.llm.chat import INST, format_conversations, loss_text, read_turns
from polarity.llm.common import table
from polarity.llm.registry import register

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in INST.control:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


def _quoted(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


#: One step: a state and the next turn (its number and role) give the next state, or ! and the number of the wrong turn.
_STEP = " ".join(f"WHEN s = '{state}' AND t[strpos(t, ':') + 1:] IN ({_quoted(roles)}) THEN t[strpos(t, ':') + 1:]" for state, roles in INST.after.items())
_MACHINE = (f"SELECT conv_id, list_reduce(list_prepend('{INST.start}', list(CAST(k AS VARCHAR) || ':' || role ORDER BY k)), "
            f"lambda s, t: CASE WHEN s LIKE '!%' THEN s {_STEP} ELSE '!' || t[:strpos(t, ':') - 1] END) AS state "
            "FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM r) GROUP BY conv_id")
_FRAME = " ".join(f"WHEN '{r}' THEN {len(x.open) + len(x.close)}" for r, x in INST.turns.items())
SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
machine AS ({_MACHINE})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length({_escaped_sql('text')}) + CASE role {_FRAME}
                ELSE {sum(map(len, INST.other))} + length({_escaped_sql('role')}) END) AS BIGINT) AS formatted_chars,
       any_value(state NOT LIKE '!%' AND state IN ({_quoted(INST.last)})) AS valid,
       any_value(CASE WHEN state LIKE '!%' THEN CAST(state[2:] AS BIGINT) END) AS first_wrong
FROM r JOIN machine USING (conv_id) GROUP BY conv_id
"""


@register("op2_chat_format", SQL)
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL_TEXT).alias("text"))
    made = format_conversations(rows.unionByName(control))
    read = made.select("conv_id", "formatted", "valid", "first_wrong", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", F.col("first_wrong").cast("bigint").alias("first_wrong"))
