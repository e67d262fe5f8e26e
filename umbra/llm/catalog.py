"""The opN_ queries: each applies its operator to its whole table and returns the agreed digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from umbra.llm.chat import CONTROL, OTHER, ROLES, format_turns, read_back
from umbra.llm.html_text import main_text
from umbra.llm.language_model import score_texts
from umbra.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, scan_licenses, step_of, template_words
from umbra.llm.near_dups import near_duplicates
from umbra.llm.packing import pack
from umbra.llm.quality_model import quality
from umbra.llm.quality_rules import quality_rules
from umbra.llm.tables import read
from umbra.llm.toxicity import toxicity
from umbra.llm.winnowing import contamination

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


#: Of op2: what SQL can say of the source; formatted_chars follows from the grammar and its escapes.
ORACLE["op2_chat"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + {"+".join(f"(length(text)-length(replace(text,'{c}','')))//{len(c)}" for c in [*CONTROL, chr(92)])} AS inner_chars FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(inner_chars + CASE role WHEN 'system' THEN {sum(map(len, ROLES["system"]))} WHEN 'user' THEN {sum(map(len, ROLES["user"]))}
    WHEN 'assistant' THEN {sum(map(len, ROLES["assistant"]))} ELSE {sum(map(len, OTHER))} + length(role) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    """DuckDB: the list of lower-cased alphanumeric words."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b))),
hits AS (SELECT doc_id, n, p, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_templates = ", ".join(f"('{label}', {step_of(text)}, [{', '.join(repr(w) for w in template_words(text))}])" for label, text in TEMPLATES)
_places = " UNION ALL ".join(
    f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE "
    + " AND ".join(f"w[i + {j}] = '{part}'" for j, part in enumerate(phrase.split()))
    for phrase, label in PHRASES.items()
)
ORACLE["op10_licenses"] = f"""
WITH d AS (SELECT doc_id, text, {_words_sql("text")} AS w FROM documents),
places AS ({_places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM places GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {_templates}) AS v(label, step, words)),
blocks AS (SELECT doc_id, step, list_distinct(w[i + 1:i + 2 * step]) AS lw FROM
  (SELECT doc_id, w, step, unnest(range(0, len(w), step)) AS i FROM d, (SELECT DISTINCT step FROM t))),
held AS (SELECT doc_id, label, len(list_intersect(lw, words))::DOUBLE / len(words) AS score FROM blocks JOIN t USING (step)
  WHERE len(list_intersect(lw, words)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM held) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS held FROM held GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(held, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""
