"""Queries over archives, sequences and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm import packing, preference, warc
from foldwise.llm.registry import query, table


@query("op1_warc_transactions")
def op1(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op4_curve_packing")
def op4(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP5_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
chosen AS (
  SELECT c.conv_id AS pair_id, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS text, l.last
  FROM conversations c JOIN last l USING (conv_id)
  WHERE c.conv_id + 1 IN (SELECT conv_id FROM last)),
rejected AS (
  SELECT pair_id, turn, role, text FROM chosen WHERE turn < last
  UNION ALL
  SELECT l.conv_id, l.last, coalesce(c.role, ''), coalesce(c.text, '')
  FROM last l JOIN conversations c ON c.conv_id = l.conv_id + 1
  JOIN last m ON m.conv_id = c.conv_id AND c.turn = m.last),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS place FROM chosen),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS place FROM rejected),
n AS (
  SELECT pair_id, min(coalesce(a.place, b.place)) FILTER (
    WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1 AS cut, count(*) AS most
  FROM a FULL JOIN b USING (pair_id, place) GROUP BY pair_id),
m AS (SELECT pair_id, coalesce(cut, most) AS n_prompt_turns FROM n),
ra AS (SELECT a.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, n_prompt_turns FROM a JOIN m USING (pair_id)),
rb AS (SELECT b.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, n_prompt_turns FROM b JOIN m USING (pair_id)),
pa AS (
  SELECT pair_id, n_prompt_turns,
    coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE place <= n_prompt_turns), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE place > n_prompt_turns), '') AS chosen
  FROM ra GROUP BY pair_id, n_prompt_turns),
pb AS (
  SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE place > n_prompt_turns), '') AS rejected
  FROM rb GROUP BY pair_id),
oa AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs
  FROM ra WHERE place > n_prompt_turns),
ob AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs
  FROM rb WHERE place > n_prompt_turns),
ma AS (
  SELECT pair_id, string_agg((ofs + length(role) + 5)::BIGINT || ':' || (ofs + length(shown) - 1)::BIGINT, ',' ORDER BY place) AS chosen_mask
  FROM oa WHERE role = 'assistant' GROUP BY pair_id),
mb AS (
  SELECT pair_id, string_agg((ofs + length(role) + 5)::BIGINT || ':' || (ofs + length(shown) - 1)::BIGINT, ',' ORDER BY place) AS rejected_mask
  FROM ob WHERE role = 'assistant' GROUP BY pair_id)
SELECT pair_id, n_prompt_turns, prompt, chosen, coalesce(chosen_mask, '') AS chosen_mask, rejected,
  coalesce(rejected_mask, '') AS rejected_mask
FROM pa JOIN pb USING (pair_id) LEFT JOIN ma USING (pair_id) LEFT JOIN mb USING (pair_id)
"""


@query("op5_preference_pairs", OP5_SQL)
def op5(spark, sf_dir):
    pairs = preference.format_preferences(*preference.answers_of_the_next(table(spark, sf_dir, "conversations")))
    shown = lambda name: F.array_join(
        F.transform(name, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    ).alias(name)
    return pairs.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", shown("chosen_mask"), "rejected", shown("rejected_mask")
    )
