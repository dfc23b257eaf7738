"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt; what follows on either side is
rendered as a completion with a mask, which marks what a model is to learn: the text and end mark of assistant turns. A
mask is a list of runs "length:flag" in code points, and its lengths add up to the completion's. Everything is
expressions on arrays of turns, which are no longer than a conversation.

Defined cases: null roles and texts count as empty; null arrays on either side give status "unpaired" and null prompt,
completions and masks; equal conversations give status "identical", the whole as prompt and empty completions; an empty
conversation has an empty completion. Further columns stay, those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galaxis.llm._store import read

#: The template of a turn: "<|role|>\ntext<|end|>\n".
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"
RESULTS = ("n_prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask", "status")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        head = F.length(t["role"]) + (len(OPEN) + len(CLOSE))
        body = F.length(t["text"]) + len(END)
        return F.when(t["role"] == LEARNED, F.concat(head.cast("string"), F.lit(":0,"), body.cast("string"), F.lit(":1"))).otherwise(F.concat((head + body).cast("string"), F.lit(":0")))

    return F.array_join(F.transform(turns, runs), ",")


def _clean(turns: Column) -> Column:
    empty = F.lit("")
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], empty).alias("role"), F.coalesce(t["text"], empty).alias("text")))


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with `chosen` and `rejected` (arrays of structs with role and text) replaced by the results."""
    rows = pairs.drop(*RESULTS).withColumns({chosen: _clean(F.col(chosen)), rejected: _clean(F.col(rejected))})
    differs = F.array_position(F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.withColumn("n_prompt_turns", F.when(differs == 0, F.size(chosen).cast("long")).otherwise(differs - 1))
    rest = lambda side: F.slice(F.col(side), (F.col("n_prompt_turns") + 1).cast("int"), F.size(side))
    paired = F.col(chosen).isNotNull() & F.col(rejected).isNotNull()
    status = F.when(~paired, "unpaired").when((F.col("n_prompt_turns") == F.size(chosen)) & (F.col("n_prompt_turns") == F.size(rejected)), "identical").otherwise("paired")
    made = {
        "prompt": _render(F.slice(F.col(chosen), F.lit(1), F.col("n_prompt_turns").cast("int"))),
        "chosen_text": _render(rest(chosen)), "chosen_mask": _mask(rest(chosen)), "rejected_text": _render(rest(rejected)), "rejected_mask": _mask(rest(rejected)),
    }
    return rows.withColumns({k: F.when(paired, v) for k, v in made.items()} | {"status": status}).drop(chosen, rejected)


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """For each conversation (conv_id, chosen, rejected): itself, and itself with the last turn of its neighbour, the
    conversation whose id differs in the lowest bit; null where there is none. Turns are ordered by number, then role and
    text, nulls first; rows without a conv_id belong to no conversation. Neighbours meet in one shuffle by their common
    id, which holds two conversations."""
    turn = F.struct("turn", "role", "text")
    own = lambda bit: F.array_agg(F.when(F.col("conv_id").bitwiseAND(1) == bit, turn))
    both = conversations.where("conv_id IS NOT NULL").groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(F.sort_array(own(0)).alias("even"), F.sort_array(own(1)).alias("odd"))
    side = lambda bit, mine, other: F.struct((F.col("pair_id") * 2 + bit).alias("conv_id"), F.col(mine).alias("chosen"), F.col(other).alias("other"))
    rows = both.select("pair_id", F.explode(F.array(side(0, "even", "odd"), side(1, "odd", "even"))).alias("s")).select("pair_id", "s.*").where(F.size("chosen") > 0)
    swapped = F.concat(F.slice("chosen", 1, F.size("chosen") - 1), F.slice("other", -1, 1))
    return rows.select("conv_id", "pair_id", "chosen", F.when(F.size("other") > 0, swapped).alias("rejected"))


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen against itself with another reply."""
    return formatted(reply_pairs(read(spark, sf_dir, "conversations"))).select("conv_id", "pair_id", *RESULTS)


_R = "coalesce(t.role, '')"
_T = "coalesce(t.text, '')"
_RENDER = "list_aggregate(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', '')"
_RUNS = "list_aggregate(list_transform({0}, lambda t: CASE WHEN t.role = 'assistant' THEN (length(t.role) + 5) || ':0,' || (length(t.text) + 8) || ':1' ELSE (length(t.role) + length(t.text) + 13) || ':0' END), 'string_agg', ',')"


def _sql(template: str, turns: str) -> str:
    return f"coalesce({template.format(turns)}, '')"


ORACLE = f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT a.conv_id, a.conv_id >> 1 AS pair_id, a.turns AS c, CASE WHEN b.turns IS NOT NULL THEN a.turns[:-2] || [b.turns[-1]] END AS r FROM c a LEFT JOIN c b ON b.conv_id = xor(a.conv_id, 1)),
n AS (SELECT *, CASE WHEN r IS NOT NULL THEN coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, greatest(len(c), len(r)) + 1)) AS i) WHERE c[i] IS DISTINCT FROM r[i]), len(c)) END AS k FROM p)
SELECT conv_id, pair_id, k::BIGINT AS n_prompt_turns, CASE WHEN r IS NULL THEN 'unpaired' WHEN k = len(c) AND k = len(r) THEN 'identical' ELSE 'paired' END AS status,
  CASE WHEN r IS NOT NULL THEN {_sql(_RENDER, "c[:k]")} END AS prompt,
  CASE WHEN r IS NOT NULL THEN {_sql(_RENDER, "c[k + 1:]")} END AS chosen_text, CASE WHEN r IS NOT NULL THEN {_sql(_RUNS, "c[k + 1:]")} END AS chosen_mask,
  CASE WHEN r IS NOT NULL THEN {_sql(_RENDER, "r[k + 1:]")} END AS rejected_text, CASE WHEN r IS NOT NULL THEN {_sql(_RUNS, "r[k + 1:]")} END AS rejected_mask
FROM n
"""
