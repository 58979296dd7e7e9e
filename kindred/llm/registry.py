"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, mixing, pii, quality, simhash, substring, tokens, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_pii": pii.op2_pii,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_token_counts": tokens.op5_token_counts,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_url_filters": urls.op7_url_filters,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality_rules": quality.op10_quality_rules,
    }


# The words of a text: between any of the six ASCII separators.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_SUBSTRING = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
  low AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
  hit AS (SELECT DISTINCT doc_id, i + o AS pos FROM win JOIN low USING (s), range(0, 13) r(o) WHERE lo < doc_id),
  gone AS (SELECT doc_id, list(pos) AS p FROM hit GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
  FROM d LEFT JOIN gone USING (doc_id)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
  items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS s, n FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
  win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
  found AS (SELECT doc_id, i, n, item_id FROM win JOIN items USING (s, n)),
  hits AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM found, range(0, 10) r(o) WHERE o < n GROUP BY doc_id),
  names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, spans
  FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN
    (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM (SELECT doc_id, min(p) - 1 AS a, max(p) AS z FROM
      (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, i + o AS p FROM found, range(0, 10) r(o) WHERE o < n))
      GROUP BY doc_id, g) GROUP BY doc_id) USING (doc_id)""".replace("contaminated, spans\n", "contaminated, coalesce(spans, '') AS spans\n")

_CHAT = """WITH turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
  convs AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY place) AS ts,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered FROM turns GROUP BY conv_id),
  one AS (SELECT min(conv_id) AS conv_id, ts, any_value(rendered) AS rendered, count(*) AS n_copies FROM convs GROUP BY ts),
  begun AS (SELECT DISTINCT ts[1:n] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM one))
  SELECT conv_id, len(one.ts)::INTEGER AS n_turns, n_copies, rendered FROM one ANTI JOIN begun USING (ts)"""

_QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
  rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
  cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, 5) r(o) GROUP BY doc_id),
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
  marked AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM lines),
  kept AS (SELECT doc_id, sum(chars) FILTER (n = 0 OR NOT (
      (len(regexp_extract_all(line, '[|»›•]')) * 100 >= n * 30 AND n >= 4)
      OR len(regexp_extract_all(line, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D.,;:!?''"()\-]')) * 100 > chars * 40
      OR (n < 3 AND NOT regexp_matches(line, '[.,;:!?…''")]'))
      OR regexp_matches(line, '{{boilerplate}}'))) AS kept_chars,
    count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM marked GROUP BY doc_id),
  s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(kept_chars, 0) AS kept_chars FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN kept USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars * 100 >= word_chars * 50 AS kept FROM s""".replace("{boilerplate}", quality.QualityRules().boilerplate)


def oracle_sql() -> dict[str, str]:
    """The other operators use hash functions or trained models that SQL lacks; tests hold them against brute force."""
    return {
        "op4_substring_dedup": _SUBSTRING,
        "op6_decontamination": _DECONTAMINATION,
        "op8_chat_formatting": _CHAT,
        "op10_quality_rules": _QUALITY,
    }
