"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from stratum.llm import quality

ORACLES: dict[str, str] = {}

ORACLES["op5_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, (2 * source_size)::HUGEINT AS cap,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
         sum(source_size) OVER () AS all_words
  FROM s),
f AS (
  SELECT *, (3 * all_words - 2 * used)::HUGEINT AS num, (2 * w_left)::HUGEINT AS den,
         (3 * all_words - 2 * used) * w <= cap * 2 * w_left AS free
  FROM c),
l AS (SELECT num, den FROM f WHERE free ORDER BY source_size / w, source IS NULL, source LIMIT 1),
b AS (
  SELECT source, source_size,
         CASE WHEN free THEN l.num::DOUBLE * w / l.den::DOUBLE ELSE cap::DOUBLE END AS target,
         (CASE WHEN free THEN (l.num * w) // l.den ELSE cap END)::BIGINT AS budget
  FROM f LEFT JOIN l ON TRUE),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM p"""

ORACLES["op10_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t.turn, t.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
r AS (
  SELECT conv_id, turn, role, text, '<|im_start|>'
    || replace(regexp_replace(role, '<(\\*)\|(im_start|im_end|br)\|>', '<\\\1|\2|>', 'g'), chr(10), '<|br|>')
    || chr(10) || regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') || '<|im_end|>' || chr(10) AS rendered
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, rendered)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, rendered) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(rendered))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


def _quality() -> str:
    rules, least = quality.Rules(), dict(quality.Rules().least)
    width = lambda r: f"{rules.spread} * greatest({r}_q75 - {r}_q25, {least[r]})"
    value = lambda b: f"CASE WHEN {b} > {quality.ZERO} THEN exp({b} * {rules.log_base!r}) * {1 - rules.accuracy!r} ELSE 0 END"
    rates = ", ".join(f"'{r}'" for r in quality.RATES)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        columns = ", ".join(f"max(CASE WHEN rate = '{r}' THEN {value(f'b{p}')} END) AS {r}_q{p}" for r in quality.RATES for p in (25, 75))
        sides = ", ".join([*(f"{r}_q75 + {width(r)} AS {r}_high" for r in quality.RATES), f"word_length_q25 - {width('word_length')} AS word_length_low"])
        return f"""
{name}m AS (SELECT {by}rate, bucket, sum(n) AS n FROM sketch GROUP BY {by}rate, bucket),
{name}u AS (SELECT *, sum(n) OVER (PARTITION BY {by}rate ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}rate) AS total FROM {name}m),
{name}q AS (SELECT {by}rate, max(total) AS n, min(bucket) FILTER (upto > 0.25 * (total - 1)) AS b25, min(bucket) FILTER (upto > 0.75 * (total - 1)) AS b75 FROM {name}u GROUP BY {by}rate),
{name}w AS (SELECT {by}max(n) AS n, {columns} FROM {name}q {group}),
{name} AS (SELECT {by}n, {sides} FROM {name}w)"""

    pick = lambda c: f"CASE WHEN own.n >= {rules.min_group} THEN own.{c} WHEN mid.n >= {rules.min_group} THEN mid.{c} ELSE top.{c} END"
    odd = " OR ".join([f"word_length < {pick('word_length_low')}", *(f"{r} > {pick(f'{r}_high')}" for r in quality.RATES)])
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
v AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
x AS (SELECT rid, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 AS rep FROM v),
y AS (SELECT rid, rep OR lag(rep, 1, false) OVER o OR lag(rep, 2, false) OVER o AS hit FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
z AS (SELECT rid, count(*) FILTER (hit) AS n FROM y GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(z.n, 0)::BIGINT AS n_repeat_words, greatest(len(ls), 1) AS n_lines
  FROM d LEFT JOIN z USING (rid)),
m AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words AS base_failed,
         word_chars / greatest(n_words, 1)::DOUBLE AS word_length, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_rate,
         n_dup_lines / n_lines::DOUBLE AS dup_line_rate, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_rate
  FROM c),
r AS (SELECT lang, source, unnest([{rates}]) AS rate, unnest([{', '.join(quality.RATES)}]) AS v FROM m WHERE NOT base_failed),
sketch AS (SELECT lang, source, rate, CASE WHEN v > 0 THEN ceil(ln(v) / {rules.log_base!r})::INT ELSE {quality.ZERO} END AS bucket, count(*) AS n FROM r GROUP BY ALL),
{level("own", "lang, source").strip()},
{level("mid", "lang").strip()},
{level("top", "").strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({odd}, false) AS kept
FROM m LEFT JOIN own ON m.lang IS NOT DISTINCT FROM own.lang AND m.source IS NOT DISTINCT FROM own.source
LEFT JOIN mid ON m.lang IS NOT DISTINCT FROM mid.lang CROSS JOIN top"""


ORACLES["op9_quality"] = _quality()
