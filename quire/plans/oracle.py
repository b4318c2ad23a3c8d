"""DuckDB SQL equivalents of the catalogue queries (the correctness oracle).

Expressions are generated from the same constants as the Spark Column
functions, expanded to RE2 syntax. Every integer output is cast to BIGINT.
"""

from __future__ import annotations

from quire import constants as K
from quire.functions import parse as ps
from quire.operators.quota import PROMPT_HEAD
from quire.plans import catalog as C
from quire.sources.io import KEY_STRIDE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(K.SPACE_RUN)}, ' ', 'g'))"


def clean(x: str) -> str:
    t = f"regexp_replace({x}, {lit(K.re2(K.URL_CLEAN))}, '', 'g')"
    t = f"regexp_replace({t}, {lit(K.re2(K.MENTION_CLEAN))}, '', 'g')"
    return collapse(t)


def dedup_key(x: str) -> str:
    return collapse(f"lower({x})")


_TYPO_FROM = lit("’“”—–")
_TYPO_TO = lit("'\"\"--")
_WORDS_RE = lit("[a-z0-9']+")
_OPENING_RE = lit("[A-Za-z0-9']+")
_TOKEN_RE = lit("[\\p{L}\\p{N}_']+")


def normalize(x: str) -> str:
    return collapse(f"translate(lower({x}), {_TYPO_FROM}, {_TYPO_TO})")


def word_list(x: str) -> str:
    return f"list_distinct(regexp_extract_all({normalize(x)}, {_WORDS_RE}))"


def opening(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), {_OPENING_RE})[1:{K.OPENING_WORDS}], ' ')"


def length_group(x: str) -> str:
    parts = " ".join(f"WHEN length({x}) <= {hi} THEN {lit(n)}" for n, _lo, hi, _p in K.LENGTH_BANDS[:-1])
    return f"(CASE {parts} ELSE {lit(K.LENGTH_BANDS[-1][0])} END)"


def matches(x: str, template: str) -> str:
    return f"regexp_matches({x}, {lit(K.re2(template))})"


def any_match(x: str, templates: list[str]) -> str:
    return "(" + " OR ".join(matches(x, t) for t in templates) + ")"


def count_char(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(ch)}, '')))"


def quality_flags(x: str) -> str:
    t = collapse(x)
    low = f"lower({t})"
    leak = " OR ".join(f"contains({low}, {lit(p)})" for p in K.V2_LEAK_PHRASES)
    boiler = " + ".join(f"CAST({matches(low, p)} AS INTEGER)" for p in K.V2_BOILERPLATE)
    cum = (f"concat_ws(',', CASE WHEN length({t}) < {K.V2_MIN_CHARS} THEN 'too_short' END, "
           f"CASE WHEN {leak} THEN 'instruction_leak' END, "
           f"CASE WHEN {count_char(t, '#')} > {K.V2_MAX_HASHTAGS} THEN 'too_many_hashtags' END, "
           f"CASE WHEN {count_char(t, '@')} > {K.V2_MAX_MENTIONS} THEN 'too_many_mentions' END, "
           f"CASE WHEN regexp_matches({t}, {lit(K.PUNCT_SPAM)}) THEN 'punctuation_spam' END, "
           f"CASE WHEN ({boiler}) >= 2 THEN 'boilerplate' END)")
    return (f"(CASE WHEN length({t}) = 0 THEN 'empty' WHEN length({t}) > {K.V2_MAX_CHARS} THEN 'over_280' "
            f"WHEN contains({low}, {lit(K.PLACEHOLDER_HANDLE)}) THEN 'placeholder_handle' ELSE {cum} END)")


def row_verdict(x: str, lo: str, hi: str) -> str:
    t = collapse(x)
    norm = normalize(t)
    return (f"(CASE WHEN {x} IS NULL THEN 'not_a_string' WHEN length({t}) = 0 THEN 'empty' "
            f"WHEN NOT (length({t}) BETWEEN {lo} AND {hi}) THEN 'profile_length_mismatch' "
            f"WHEN regexp_matches({t}, {lit(K.URL_PRESENT)}) THEN 'contains_url' "
            f"WHEN {matches(t, K.HANDLE_PRESENT)} THEN 'contains_handle' "
            f"WHEN {any_match(norm, K.V3_METADATA)} THEN 'metadata_leakage' "
            f"WHEN {any_match(norm, K.V3_BOILERPLATE)} THEN 'boilerplate' ELSE 'ok' END)")


_STRIP = lit("^" + K.SPACE_RUN + "|" + K.SPACE_RUN + "$")


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


def english(t: str, lang: str) -> str:
    return f"({t} IS NOT NULL AND length({t}) >= 3 AND {lang} = 'en')"


def md5_order(seed, key: str) -> str:
    return f"md5(concat_ws(':', CAST({seed} AS VARCHAR), CAST({key} AS VARCHAR)))"


def md5_int(seed, key: str) -> str:
    return f"CAST(('0x' || substr({md5_order(seed, key)}, 1, 8)) AS BIGINT)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {_TOKEN_RE})"


POSTS = f"""posts AS (
  SELECT doc_id * {KEY_STRIDE} + (i - 1) AS key, line AS text, lang, source FROM (
    SELECT doc_id, lang, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)))"""

CLASS_ITEMS = f"""class_items AS (
  SELECT key, text, label FROM (
    SELECT conv_id * {KEY_STRIDE} + turn AS key, {clean('text')} AS text,
           CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS label
    FROM conversations)
  WHERE label IS NOT NULL AND length(text) > 0)"""


def _hash_rank(src: str, group: str, key: str, seed) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return (f"SELECT *, row_number() OVER ({part}ORDER BY {md5_order(seed, key)}, {key}) AS rnk FROM {src}")


def _split_sql(src: str) -> str:
    """O6 in SQL: per-label train/val sizes by largest remainder."""
    return f"""
counts AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM {src} GROUP BY label),
t1 AS (SELECT *, CAST(floor(n * {K.TRAIN_FRAC}::DOUBLE) AS BIGINT) AS ntrain FROM counts),
t2 AS (SELECT *, (c * ntrain) // n AS b, c * ntrain - ((c * ntrain) // n) * n AS r FROM t1),
t3 AS (SELECT *, b + CASE WHEN row_number() OVER (ORDER BY r DESC, label) <= ntrain - sum(b) OVER () THEN 1 ELSE 0 END AS t FROM t2),
v1 AS (SELECT label, c, t, c - t AS c2, n - ntrain AS n2,
              CAST(floor((n - ntrain) * {K.VAL_FRAC / (K.VAL_FRAC + K.TEST_FRAC)}::DOUBLE) AS BIGINT) AS nval FROM t3),
v2 AS (SELECT *, (c2 * nval) // n2 AS b2, c2 * nval - ((c2 * nval) // n2) * n2 AS r2 FROM v1),
quotas AS (SELECT label, t, b2 + CASE WHEN row_number() OVER (ORDER BY r2 DESC, label) <= nval - sum(b2) OVER () THEN 1 ELSE 0 END AS v FROM v2),
ranked AS ({_hash_rank(src, 'label', 'key', K.SEED)}),
split AS (SELECT ranked.*, CASE WHEN rnk <= t THEN 'train' WHEN rnk <= t + v THEN 'val' ELSE 'test' END AS split
          FROM ranked JOIN quotas USING (label))"""


def _balance_sql(src: str) -> str:
    return f"""
bal_sizes AS (SELECT min(c) AS m FROM (SELECT label, count(*) AS c FROM {src} GROUP BY label)),
bal_ranked AS ({_hash_rank(src, 'label', 'key', K.SEED)}),
balanced AS (SELECT key, text, label FROM bal_ranked, bal_sizes WHERE rnk <= m)"""


def _logits(n: int) -> str:
    return f"list_transform(embedding[1:{n}], lambda x: CAST(x AS DOUBLE))"


def _softmax(arr: str) -> str:
    return (f"list_transform({arr}, lambda x: exp(x - list_max({arr})) / "
            f"list_sum(list_transform({arr}, lambda y: exp(y - list_max({arr})))))")


def _sent_label(s: str) -> str:
    parts = " ".join(f"WHEN {s} {op} {thr} AND NOT isnan({s}) THEN {lit(n)}" for n, op, thr in K.SENTIMENT_BUCKETS)
    return f"(CASE WHEN {s} IS NULL THEN NULL {parts} ELSE {lit(K.SENTIMENT_TOP)} END)"


def _ai_label(s: str) -> str:
    parts = " ".join(f"WHEN {s} >= {thr} AND NOT isnan({s}) THEN {lit(n)}" for n, thr in K.AI_BUCKETS)
    return f"(CASE WHEN {s} IS NULL THEN NULL {parts} ELSE {lit(K.AI_BOTTOM)} END)"


SQL: dict[str, str] = {}

SQL["clean_text"] = f"""
SELECT kind, id, clean_text, CAST(length(clean_text) AS BIGINT) AS n_chars FROM (
  SELECT 'documents' AS kind, doc_id AS id, {clean('text')} AS clean_text FROM documents
  UNION ALL
  SELECT 'pages', page_id, {clean("concat_ws(' ', html, url)")} FROM pages)
WHERE length(clean_text) > 0"""

SQL["dedup_key_first"] = f"""
WITH d AS (SELECT doc_id, lang, {dedup_key(clean('text'))} AS dedup_key FROM documents WHERE length({clean('text')}) > 0)
SELECT doc_id, lang, dedup_key FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, dedup_key ORDER BY doc_id) AS rn FROM d) WHERE rn = 1"""

SQL["exact_dedup_raw"] = f"""
WITH {POSTS},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS rn FROM posts) WHERE rn = 1)
SELECT key, {clean('text')} AS clean_text FROM first WHERE length({clean('text')}) > 0"""

SQL["normalize_typography"] = f"SELECT doc_id, {normalize('text')} AS norm_text FROM documents"

SQL["word_sets"] = f"""
WITH {POSTS}
SELECT key, CAST(len(ws) AS BIGINT) AS n_words, array_to_string(list_sort(ws), ' ') AS words
FROM (SELECT key, {word_list('text')} AS ws FROM posts)"""

SQL["opening_counts"] = f"""
WITH {POSTS}
SELECT opening, count(*) AS n FROM (SELECT {opening('text')} AS opening FROM posts)
WHERE opening <> '' GROUP BY opening HAVING count(*) >= 2"""

SQL["opening_cap"] = f"""
WITH {POSTS}, o AS (SELECT key, {opening('text')} AS opening FROM posts)
SELECT key, opening FROM (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY key) AS rn FROM o WHERE opening <> '')
WHERE rn <= {K.OPENING_CAP}
UNION ALL SELECT key, opening FROM o WHERE opening = ''"""

SQL["surface_flags"] = f"""
WITH {POSTS}
SELECT {length_group('text')} AS length_group, count(*) AS n,
  count(*) FILTER (WHERE contains(text, {lit(C.QUESTION_MARKER)})) AS n_marker,
  count(*) FILTER (WHERE contains(text, '#')) AS n_hashtag,
  count(*) FILTER (WHERE contains(text, '@')) AS n_mention,
  count(*) FILTER (WHERE regexp_matches(text, {lit(K.re2(K.EMOJI))})) AS n_emoji,
  CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len
FROM posts GROUP BY 1"""

SQL["quality_flags"] = f"""
WITH {POSTS}
SELECT key, flags, flags = '' AS ok FROM (SELECT key, {quality_flags('text')} AS flags FROM posts)"""

SQL["accept_posts"] = f"""
WITH {POSTS}, t AS (SELECT key, {collapse('text')} AS text FROM posts),
ok AS (SELECT * FROM t WHERE {quality_flags('text')} = ''),
first AS (SELECT key, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS rn FROM ok) WHERE rn = 1)
SELECT key, text FROM first ORDER BY key LIMIT {C.ACCEPT_LIMIT}"""

_BANDS_VALUES = ", ".join(f"({i}, {lit(n)}, {lo}, {hi})" for i, (n, lo, hi, _p) in enumerate(K.LENGTH_BANDS))

SQL["row_verdict"] = f"""
WITH {POSTS}, bands(band_idx, length_name, min_chars, max_chars) AS (VALUES {_BANDS_VALUES}),
p AS (SELECT *, {md5_int(K.SEED, 'key')} % 4 AS band_idx FROM posts)
SELECT key, length_name, {row_verdict('text', 'min_chars', 'max_chars')} AS reason
FROM p JOIN bands USING (band_idx)"""

SQL["english_only"] = f"""
SELECT doc_id, clean_text FROM (SELECT doc_id, lang, {clean('text')} AS clean_text FROM documents)
WHERE {english('clean_text', 'lang')}"""

SQL["prefix_until_target"] = f"""
WITH d AS (SELECT doc_id, lang, {clean('text')} AS clean_text, CAST(floor(doc_id / {C.PREFIX_CHUNK_ROWS}) AS BIGINT) AS chunk FROM documents),
u AS (SELECT * FROM d WHERE length(clean_text) > 0 AND {english('clean_text', 'lang')}),
c AS (SELECT chunk, count(*) AS n FROM u GROUP BY chunk),
k AS (SELECT chunk FROM (SELECT chunk, coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
      WHERE before < CAST(floor({C.PREFIX_N} / {C.PREFIX_K} * {K.OVERSAMPLE_FACTOR}::DOUBLE) + {K.OVERSAMPLE_EXTRA} AS BIGINT))
SELECT doc_id, chunk, clean_text FROM u WHERE chunk IN (SELECT chunk FROM k)"""

SQL["prefix_read"] = f"""
WITH d AS (SELECT doc_id, lang, {clean('text')} AS clean_text FROM documents),
u AS (SELECT doc_id FROM d WHERE length(clean_text) > 0 AND {english('clean_text', 'lang')}),
b AS (SELECT (SELECT min(doc_id) // {C.PREFIX_CHUNK_ROWS} * {C.PREFIX_CHUNK_ROWS} FROM documents) + {C.smp.FIRST_CHUNKS * C.PREFIX_CHUNK_ROWS} * (2 ** k - 1)::BIGINT AS bound
      FROM generate_series(1, 40) g(k)),
e AS (SELECT min(bound) AS bound FROM b
      WHERE (SELECT count(*) FROM u WHERE doc_id < bound) >= {C.PREFIX_TARGET} OR bound > (SELECT max(doc_id) FROM documents))
SELECT count(*) FILTER (WHERE doc_id < bound) AS rows_read, count(*) AS rows_total, max(doc_id) FILTER (WHERE doc_id < bound) AS last_read FROM documents, e"""

SQL["union_tagged_sources"] = f"""
SELECT source_file, count(*) AS n_items, CAST(sum(len) AS BIGINT) AS n_chars,
  CASE WHEN source_file IN ({', '.join(lit(s) for s in C.HOLDOUT_SOURCES)}) THEN 'holdout' ELSE 'train' END AS role
FROM (SELECT source AS source_file, length(text) AS len FROM documents
      UNION ALL SELECT 'benchmark', length(text) FROM benchmark)
GROUP BY source_file"""

SQL["label_mapping"] = """
SELECT conv_id, turn, label, CAST(CASE label WHEN 'human' THEN 0 WHEN 'ai' THEN 1 END AS BIGINT) AS label_id FROM (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS label
  FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
WHERE label IS NOT NULL"""

SQL["seeded_sample"] = f"""
WITH {POSTS},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS rn FROM posts) WHERE rn = 1),
c AS (SELECT key, {clean('text')} AS clean_text FROM first)
SELECT key, clean_text FROM c WHERE length(clean_text) > 0
ORDER BY {md5_order(K.SEED, 'key')}, key LIMIT {C.SAMPLE_N}"""

_EN_CAND = f"""
d0 AS (SELECT doc_id, lang, source, {clean('text')} AS t FROM documents),
d1 AS (SELECT *, {dedup_key('t')} AS dk FROM d0 WHERE length(t) > 0 AND {english('t', 'lang')}),
cand AS (SELECT doc_id, lang, source, t FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY doc_id) AS rn FROM d1) WHERE rn = 1)"""

SQL["even_source_sample"] = f"""
WITH {_EN_CAND},
srcs AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS idx FROM cand GROUP BY source),
params AS (SELECT least(CAST(floor((SELECT count(*) FROM cand) * {C.SOURCE_SAMPLE_FRAC}::DOUBLE) AS BIGINT), (SELECT count(*) FROM cand)) AS n,
                  (SELECT count(*) FROM srcs) AS k),
quotas AS (SELECT source, idx, n // k + CASE WHEN idx < n % k THEN 1 ELSE 0 END AS req FROM srcs, params),
ranked AS (SELECT cand.*, quotas.idx, quotas.req,
           row_number() OVER (PARTITION BY cand.source ORDER BY {md5_order(f'{K.SEED} + quotas.idx', 'cand.doc_id')}, cand.doc_id) AS rnk
           FROM cand JOIN quotas USING (source)),
picked AS (SELECT doc_id, source FROM ranked WHERE rnk <= req),
rest AS (SELECT doc_id, source, row_number() OVER (ORDER BY {md5_order(K.SEED, 'doc_id')}, doc_id) AS fr
         FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM picked)),
fill AS (SELECT doc_id, source FROM rest WHERE fr <= (SELECT n FROM params) - (SELECT count(*) FROM picked))
SELECT doc_id, source FROM picked UNION ALL SELECT doc_id, source FROM fill"""

SQL["balance_classes"] = f"""
WITH {CLASS_ITEMS}, {_balance_sql('class_items')}
SELECT key, label FROM balanced"""

SQL["stratified_split"] = f"""
WITH {CLASS_ITEMS}, {_split_sql('class_items')}
SELECT key, label, split FROM split"""

SQL["examples_per_label"] = f"""
WITH {CLASS_ITEMS}
SELECT label, key, text FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_order(K.SEED, 'key')}, key) AS rn FROM class_items)
WHERE rn <= {C.EXAMPLES_PER_LABEL}"""

SQL["build_dataset"] = f"""
WITH {CLASS_ITEMS},
dd AS (SELECT key, text, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label, {dedup_key('text')} ORDER BY key) AS rn FROM class_items) WHERE rn = 1),
{_balance_sql('dd')}, {_split_sql('balanced')}
SELECT key, label, split, text FROM split"""

SQL["source_distribution"] = """
SELECT 'source' AS dimension, source AS value, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang"""

SQL["length_summary"] = f"""
WITH {CLASS_ITEMS}
SELECT label, count(*) AS n, avg(length(text)) AS mean_len, CAST(min(length(text)) AS BIGINT) AS min_len,
  CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_len, CAST(max(length(text)) AS BIGINT) AS max_len
FROM class_items GROUP BY label"""

SQL["length_median_upper"] = f"""
WITH {POSTS}
SELECT source, count(*) AS n, CAST(min(length(text)) AS BIGINT) AS min_len,
  CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS BIGINT) AS median_len,
  CAST(max(length(text)) AS BIGINT) AS max_len
FROM posts GROUP BY source"""

SQL["shortfall_report"] = f"""
WITH d AS (SELECT source, lang, {clean('text')} AS t FROM documents),
per AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE length(t) > 0 AND {english('t', 'lang')}) AS available
        FROM d GROUP BY source),
tot AS (SELECT sum(docs) AS alln, count(*) AS k FROM per)
SELECT source, CAST(floor(alln / k * {C.SHORTFALL_FRAC}::DOUBLE) AS BIGINT) AS requested, available,
  CAST(greatest(CAST(floor(alln / k * {C.SHORTFALL_FRAC}::DOUBLE) AS BIGINT) - available, 0) AS BIGINT) AS short
FROM per, tot"""

SQL["softmax_probs"] = f"""
SELECT vec_id, round(p[1], 6) AS p_negative, round(p[2], 6) AS p_neutral, round(p[3], 6) AS p_positive,
  ['negative', 'neutral', 'positive'][list_position(p, list_max(p))] AS top_class
FROM (SELECT vec_id, {_softmax(_logits(3))} AS p FROM embeddings)"""

_SENT = f"""sent AS (SELECT vec_id, p[3] - p[1] AS raw FROM (SELECT vec_id, {_softmax(_logits(3))} AS p FROM embeddings))"""

SQL["sentiment_scale"] = f"""
WITH {_SENT}
SELECT vec_id, round(raw, 4) AS scale_score, {_sent_label('raw')} AS scale_label,
  round((round(raw, 4) + 1) / 2 * 100, 6) AS scale_pct, printf('%+.4f', round(raw, 4)) AS score_text
FROM sent"""

SQL["ai_likelihood"] = f"""
WITH det AS (SELECT vec_id, round(p[2], 4) AS a, round(p[1], 4) AS h FROM (SELECT vec_id, {_softmax(_logits(2))} AS p FROM embeddings))
SELECT vec_id, a AS ai_likelihood, h AS p_human, {_ai_label('a')} AS ai_label, round(a * 100, 6) AS ai_pct,
  printf('%.4f', a) AS ai_text FROM det"""

SQL["analyze_json"] = f"""
WITH r AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), {lit('^' + K.SPACE_RUN + '|' + K.SPACE_RUN + '$')}, '', 'g') AS text FROM conversations),
j AS (SELECT r.*, e.embedding FROM r LEFT JOIN embeddings e ON e.vec_id = r.conv_id),
s AS (SELECT conv_id, turn, text, {_softmax(_logits(3))} AS p3, {_softmax(_logits(2))} AS p2 FROM j)
SELECT conv_id, turn, CASE WHEN text = '' THEN 'No text provided' END AS error,
  CASE WHEN text = '' THEN NULL ELSE round(p3[3] - p3[1], 4) END AS scale_score,
  CASE WHEN text = '' THEN NULL ELSE {_sent_label('(p3[3] - p3[1])')} END AS scale_label,
  CASE WHEN text = '' THEN NULL ELSE round(p2[2], 4) END AS ai_likelihood
FROM s"""

SQL["binary_metrics"] = """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
                  count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn,
                  count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
FROM c"""

_THR = ", ".join(f"({t}::DOUBLE)" for t in C.METRIC_THRESHOLDS)
SQL["best_model"] = f"""
WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS s, label >= 5 AS t FROM embeddings),
thr(threshold) AS (VALUES {_THR}),
c AS (SELECT threshold, count(*) FILTER (WHERE t AND s > threshold) AS tp,
             count(*) FILTER (WHERE NOT t AND s > threshold) AS fp,
             count(*) FILTER (WHERE t AND NOT s > threshold) AS fn FROM thr, e GROUP BY threshold),
f AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c)
SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1"""

SQL["token_window"] = f"""
SELECT doc_id, CAST(least(len(toks), {K.TOKEN_WINDOW}) AS BIGINT) AS n_tokens,
  array_to_string(list_resize(toks[1:{K.TOKEN_WINDOW}], {K.TOKEN_WINDOW}, {lit(K.PAD_TOKEN)}), ' ') AS window
FROM (SELECT doc_id, {tokens(clean('text'))} AS toks FROM documents)"""

SQL["shuffled_items"] = f"""
WITH {CLASS_ITEMS}
SELECT row_number() OVER (ORDER BY {md5_order(K.SEED, 'key')}, key) - 1 AS position, key, text, label FROM class_items"""

SQL["csv_round_trip"] = f"""
WITH {CLASS_ITEMS}
SELECT label AS split, {strip_ws('text')} AS text FROM class_items WHERE text NOT IN ({', '.join(lit(t) for t in K.NULL_TOKENS)})"""

SQL["json_round_trip"] = f"""
SELECT 'lines' AS label, {strip_ws("coalesce(text, '')")} AS text FROM documents
UNION ALL SELECT 'array', {strip_ws("coalesce(text, '')")} FROM benchmark"""

SQL["dead_letters"] = """
SELECT doc_id, 'invalid_json' AS reason, substring(text, 1, 500) AS raw, 'main' AS phase FROM documents
WHERE text IS NOT NULL AND NOT json_valid(text)"""

SQL["stress_sample"] = f"""
WITH {POSTS},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS rn FROM posts) WHERE rn = 1),
c AS (SELECT key, lang, {clean('text')} AS clean_text FROM first),
s AS (SELECT key, clean_text, row_number() OVER (ORDER BY {md5_order(K.SEED, 'key')}, key) - 1 AS vec_id
      FROM c WHERE length(clean_text) > 0 AND {english('clean_text', 'lang')}
      ORDER BY {md5_order(K.SEED, 'key')}, key LIMIT {K.SAMPLE_SIZE}),
j AS (SELECT s.key, s.clean_text, {_softmax(_logits(3))} AS p FROM s JOIN embeddings USING (vec_id))
SELECT key, clean_text, round(p[3] - p[1], 4) AS scale_score, {_sent_label('(p[3] - p[1])')} AS scale_label,
  printf('%+.4f', round(p[3] - p[1], 4)) AS score_text FROM j"""

# ---------------------------------------------------------------------------
# Quotas, planning, prompts
# ---------------------------------------------------------------------------
_BANDP_VALUES = ", ".join(f"({i}, {lit(n)}, {lo}, {hi}, {p}::DOUBLE)" for i, (n, lo, hi, p) in enumerate(K.LENGTH_BANDS))

_QUOTA_BASE = f"""{POSTS},
bands(band_idx, length_name, min_chars, max_chars, proportion) AS (VALUES {_BANDP_VALUES}),
total AS (SELECT count(*) AS total FROM posts),
lt AS (SELECT *, CAST(floor(total * proportion) AS BIGINT) AS base FROM bands, total),
length_t AS (SELECT 'length' AS dimension, length_name AS value,
  CAST(base + CASE WHEN row_number() OVER (ORDER BY proportion DESC, band_idx) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM lt),
topics AS (SELECT DISTINCT source AS value FROM posts),
tk AS (SELECT value, row_number() OVER (ORDER BY {md5_order(K.SEED, 'value')}, value) AS rnk, count(*) OVER () AS k FROM topics),
topic_t AS (SELECT 'topic' AS dimension, value, CAST(total // k + CASE WHEN rnk <= total % k THEN 1 ELSE 0 END AS BIGINT) AS target FROM tk, total),
question_t AS (SELECT 'question' AS dimension, 'all' AS value, CAST(greatest(1, round_even(total * {K.MAX_QUESTION_RATE}::DOUBLE, 0)) AS BIGINT) AS target FROM total),
targets AS (SELECT * FROM length_t UNION ALL SELECT * FROM topic_t UNION ALL SELECT * FROM question_t),
vp AS (SELECT p.*, b.length_name, b.min_chars, b.max_chars FROM posts p JOIN bands b ON b.band_idx = {md5_int(K.SEED, 'p.key')} % 4),
ok AS (SELECT * FROM vp WHERE {row_verdict('text', 'min_chars', 'max_chars')} = 'ok'),
acc AS (SELECT 'length' AS dimension, length_name AS value, count(*) AS accepted FROM ok GROUP BY 2
        UNION ALL SELECT 'topic', source, count(*) FROM ok GROUP BY 2),
gaps AS (SELECT t.dimension, t.value, t.target, CAST(coalesce(a.accepted, 0) AS BIGINT) AS accepted,
                CAST(t.target - coalesce(a.accepted, 0) AS BIGINT) AS remaining
         FROM targets t LEFT JOIN acc a USING (dimension, value) WHERE t.dimension <> 'question')"""

SQL["quota_targets"] = f"""
WITH {_QUOTA_BASE}
SELECT dimension, value, target FROM targets"""

SQL["quota_gap"] = f"""
WITH {_QUOTA_BASE}
SELECT *, remaining > 0 AND remaining = max(CASE WHEN remaining > 0 THEN remaining END) OVER (PARTITION BY dimension) AS is_max_gap
FROM gaps"""


def _sql_pick(options: list[str], h: str) -> str:
    arr = "[" + ", ".join(lit(o) for o in options) + "]"
    return f"{arr}[({h}) % {len(options)} + 1]"


def _sql_weighted(weights, h: str) -> str:
    bp = [(n, int(round(w * 10000))) for n, w in weights]
    total = sum(v for _, v in bp)
    acc, parts = 0, []
    for n, v in bp[:-1]:
        acc += v
        parts.append(f"WHEN ({h}) % {total} < {acc} THEN {lit(n)}")
    return f"(CASE {' '.join(parts)} ELSE {lit(bp[-1][0])} END)"


def _h(tag: str) -> str:
    return md5_int(lit(f"{K.SEED}:{tag}"), "profile_id")


_SLOTS = """{d}_slots AS (SELECT value AS {d}, row_number() OVER (ORDER BY i DESC, {h}, slot) AS rnk FROM (
  SELECT value, i, value || ':' || CAST(i AS VARCHAR) AS slot FROM gaps, range(1, remaining + 1) r(i)
  WHERE dimension = '{d}' AND remaining > 0))"""

_PLAN = f"""{_QUOTA_BASE},
{_SLOTS.format(d='length', h=md5_order(lit(f"{K.SEED}:length"), 'slot'))},
{_SLOTS.format(d='topic', h=md5_order(lit(f"{K.SEED}:topic"), 'slot'))},
params AS (SELECT (SELECT count(*) FILTER (WHERE contains(text, {lit(C.QUESTION_MARKER)})) FROM ok) AS acc_q,
                  (SELECT target FROM targets WHERE dimension = 'question') AS max_q),
p0 AS (SELECT l.rnk AS profile_id, t.topic, l.length, b.min_chars, b.max_chars, params.*
       FROM length_slots l JOIN topic_slots t USING (rnk) JOIN bands b ON b.length_name = l.length, params),
p1 AS (SELECT *, {_sql_weighted(K.FORM_WEIGHTS, _h('form'))} AS form0, {_sql_weighted(K.STYLE_WEIGHTS, _h('style'))} AS style0 FROM p0),
p2 AS (SELECT *, form0 = 'question' AND acc_q < max_q AS allow_question FROM p1),
plan AS (SELECT CAST(profile_id AS BIGINT) AS profile_id, topic,
  {_sql_pick(K.STANCES, _h('stance'))} AS stance, {_sql_pick(K.TONES, _h('tone'))} AS tone,
  CASE WHEN form0 = 'question' AND NOT allow_question THEN {_sql_pick(K.QUESTION_REPLACEMENTS, _h('form2'))} ELSE form0 END AS form,
  CASE WHEN style0 = 'short_reaction' AND length IN ({', '.join(lit(x) for x in K.SHORT_REACTION_BANDS)})
       THEN {_sql_pick(K.SHORT_REACTION_REPLACEMENTS, _h('style2'))} ELSE style0 END AS casual_style,
  length AS length_name, CAST(min_chars AS BIGINT) AS min_chars, CAST(max_chars AS BIGINT) AS max_chars, allow_question
  FROM p2)"""

SQL["profile_plan"] = f"""
WITH {_PLAN}
SELECT * FROM plan"""

_HEAD_REST = [lit(part) for part in PROMPT_HEAD.split("{n}", 1)]

SQL["render_prompts"] = f"""
WITH {_PLAN},
b AS (SELECT (profile_id - 1) // {K.BATCH_SIZE} AS batch_id, (profile_id - 1) % {K.BATCH_SIZE} + 1 AS pos, * FROM plan),
l AS (SELECT batch_id, pos, '[' || CAST(pos AS VARCHAR) || '] about=' || topic || '; view=' || stance || '; mood=' || tone
   || '; shape=' || form || '; voice=' || casual_style || '; size=' || CAST(min_chars AS VARCHAR) || '..' || CAST(max_chars AS VARCHAR)
   || '; may_ask=' || CAST(allow_question AS VARCHAR) AS line FROM b)
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n_profiles,
  {_HEAD_REST[0]} || CAST(count(*) AS VARCHAR) || {_HEAD_REST[1]} || string_agg(line, chr(10) ORDER BY pos) AS prompt
FROM l GROUP BY batch_id"""

# ---------------------------------------------------------------------------
# Batch responses
# ---------------------------------------------------------------------------
_RESP = f"""g AS (SELECT item_id // {C.RESPONSE_BATCH} AS batch_id, CAST(to_json(list(text ORDER BY item_id)) AS VARCHAR) AS js
       FROM benchmark GROUP BY 1),
r AS (SELECT CAST(batch_id AS BIGINT) AS batch_id, CASE batch_id % 4 WHEN 0 THEN js
        WHEN 1 THEN {lit(C.FENCE_OPEN)} || js || {lit(C.FENCE_CLOSE)}
        WHEN 2 THEN {lit(C.PAD_BEFORE)} || js || {lit(C.PAD_AFTER)}
        ELSE substring(js, 1, length(js) - 1) END AS raw FROM g),
r0 AS (SELECT batch_id, {strip_ws('raw')} AS r0 FROM r),
r1 AS (SELECT batch_id, r0,
         CASE WHEN starts_with(r0, '```') THEN regexp_replace(regexp_replace(r0, {lit(ps.FENCE_OPEN_RE)}, ''), {lit(ps.FENCE_CLOSE_RE)}, '') ELSE r0 END AS fenced
       FROM r0),
r2 AS (SELECT *, regexp_extract(fenced, {lit(ps.BRACKET_RE)}) AS span FROM r1),
parsed AS (SELECT batch_id, coalesce(
    from_json(CASE WHEN starts_with(r0, '[') AND json_valid(r0) THEN r0 END, '["VARCHAR"]'),
    from_json(CASE WHEN starts_with({strip_ws('fenced')}, '[') AND json_valid({strip_ws('fenced')}) THEN {strip_ws('fenced')} END, '["VARCHAR"]'),
    from_json(CASE WHEN length(span) > 0 AND json_valid(span) THEN span END, '["VARCHAR"]')) AS posts FROM r2)"""

SQL["parse_batches"] = f"""
WITH {_RESP}
SELECT batch_id, CAST(generate_subscripts(posts, 1) - 1 AS BIGINT) AS pos, unnest(posts) AS text
FROM parsed WHERE posts IS NOT NULL"""

SQL["failure_rate"] = f"""
WITH {_RESP}
SELECT count(*) AS n_batches, count(*) FILTER (WHERE posts IS NULL) AS n_failed,
  CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count(*) FILTER (WHERE posts IS NULL) / count(*) ELSE 0.0 END AS failure_rate
FROM parsed"""

SQL["language_id"] = f"""
WITH d AS (SELECT doc_id, lang, lower({clean('text')}) AS t FROM documents),
ch AS (SELECT doc_id, lang, regexp_extract_all(t, '(?s).') AS c FROM d WHERE length(t) >= 3),
tri AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM ch),
counts AS (SELECT lang, g, count(*) AS c FROM tri WHERE doc_id % 2 = 0 GROUP BY lang, g),
v AS (SELECT count(DISTINCT g) AS v FROM counts),
tot AS (SELECT lang, sum(c) AS t FROM counts GROUP BY lang),
langs AS (SELECT lang, t, v, CAST(round(ln(1.0::DOUBLE / (t + v)) * 1000000) AS BIGINT) AS fl FROM tot, v),
model AS (SELECT c.lang, g, CAST(round(ln(CAST(c.c + 1 AS DOUBLE) / (t + v)) * 1000000) AS BIGINT) AS logp
          FROM counts c JOIN langs USING (lang)),
dg AS (SELECT doc_id, g, count(*) AS cnt FROM tri GROUP BY doc_id, g),
n AS (SELECT doc_id, sum(cnt) AS n FROM dg GROUP BY doc_id),
seen AS (SELECT doc_id, m.lang, sum(cnt * (logp - fl)) AS gain FROM dg JOIN model m USING (g) JOIN langs USING (lang)
         GROUP BY doc_id, m.lang),
scored AS (SELECT n.doc_id, l.lang, n.n * l.fl + coalesce(s.gain, 0) AS score, n.n
           FROM n CROSS JOIN langs l LEFT JOIN seen s ON s.doc_id = n.doc_id AND s.lang = l.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM scored) WHERE r = 1)
SELECT best.doc_id, documents.lang, best.lang AS predicted, CAST(best.n AS BIGINT) AS n_trigrams
FROM best JOIN documents USING (doc_id)"""

SQL["english_detected"] = f"""
{SQL["language_id"].rsplit("SELECT best.doc_id", 1)[0]}
SELECT doc_id, clean_text FROM (SELECT doc_id, {clean('text')} AS clean_text FROM documents)
WHERE length(clean_text) > 0 AND doc_id IN (SELECT doc_id FROM best WHERE lang = 'en')"""

SQL["count_detector"] = f"""
WITH {CLASS_ITEMS},
it AS (SELECT *, starts_with({md5_order(lit(str(K.SEED)), f"(key // {KEY_STRIDE})")}, {lit(C.HOLDOUT_HEX)}) AS holdout FROM class_items),
dd AS (SELECT key, text, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label, {dedup_key('text')} ORDER BY key) AS rn FROM it WHERE NOT holdout) WHERE rn = 1),
{_balance_sql('dd')}, {_split_sql('balanced')},
items AS (SELECT key, text, label, split FROM split UNION ALL SELECT key, text, label, 'holdout' FROM it WHERE holdout),
tok AS (SELECT key, split, label, unnest({tokens('text')}) AS token FROM items),
c AS (SELECT token, count(*) FILTER (WHERE label = 'ai') AS c1, count(*) FILTER (WHERE label = 'human') AS c0
      FROM tok WHERE split = 'train' GROUP BY token),
t AS (SELECT sum(c1) AS t1, sum(c0) AS t0, count(*) AS v FROM c),
m AS (SELECT token, CAST(round((ln((c1 + 1.0::DOUBLE) / (t1 + v)) - ln((c0 + 1.0::DOUBLE) / (t0 + v))) * 1000000) AS BIGINT) AS odds FROM c, t),
sc AS (SELECT key, sum(odds) AS score FROM tok JOIN m USING (token) GROUP BY key),
p AS (SELECT split, label = 'ai' AS truth, cut, coalesce(score, 0) > cut AS pred
      FROM items LEFT JOIN sc USING (key), (SELECT unnest({C.ODDS_CUTS}) AS cut) WHERE split <> 'train'),
n AS (SELECT split, cut, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE NOT truth AND pred) AS fp,
      count(*) FILTER (WHERE truth AND NOT pred) AS fn, count(*) FILTER (WHERE NOT truth AND NOT pred) AS tn FROM p GROUP BY split, cut),
r AS (SELECT split, CAST(cut AS BIGINT) AS cut, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM n),
best AS (SELECT cut FROM r WHERE split = 'val' ORDER BY f1 DESC, cut LIMIT 1)
SELECT * FROM r WHERE split = 'val' OR cut = (SELECT cut FROM best)"""

_SCORED_DOCS = SQL["count_detector"].split("sc AS (")[0] + f"""docs AS (SELECT doc_id, {strip_ws("coalesce(text, '')")} AS text FROM documents),
doc_tok AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM docs),
doc_score AS (SELECT doc_id, CAST(sum(odds) AS BIGINT) AS total FROM doc_tok JOIN m USING (token) GROUP BY doc_id),
doc_logit AS (SELECT doc_id, text, coalesce(total, 0) AS score, [0.0::DOUBLE, greatest(least(coalesce(total, 0) / 1000000, 30.0::DOUBLE), -30.0::DOUBLE)] AS l
              FROM docs LEFT JOIN doc_score USING (doc_id)),
doc_scored AS (SELECT doc_id, CASE WHEN text = '' THEN 'No text provided' END AS error, score,
                      CASE WHEN text <> '' THEN round(({_softmax('l')})[2], 4) END AS ai_likelihood FROM doc_logit)"""

SQL["score_documents"] = _SCORED_DOCS + f"""
SELECT doc_id, error, score, ai_likelihood, {_ai_label('ai_likelihood')} AS ai_label FROM doc_scored"""

SQL["stream_score_text"] = _SCORED_DOCS + f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'dead_letter' WHEN doc_id % 10 = 7 OR error IS NOT NULL THEN 'error' ELSE 'scored' END AS route,
  CASE WHEN doc_id % 10 = 3 THEN 'invalid_json' WHEN doc_id % 10 = 7 THEN 'No text provided' ELSE error END AS reason,
  CASE WHEN doc_id % 10 NOT IN (3, 7) THEN ai_likelihood END AS ai_likelihood,
  CASE WHEN doc_id % 10 NOT IN (3, 7) THEN {_ai_label('ai_likelihood')} END AS ai_label
FROM doc_scored"""

SQL["near_dup_jaccard"] = f"""
WITH {POSTS},
p AS (SELECT key, {word_list('text')} AS ws FROM posts),
w AS (SELECT key, unnest(ws) AS word, len(ws) AS s FROM p WHERE len(ws) > 0),
pairs AS (SELECT a.key AS ka, b.key AS kb, count(*) AS inter, any_value(a.s) AS sa, any_value(b.s) AS sb
          FROM w a JOIN w b ON a.word = b.word AND a.key < b.key
          WHERE 100 * least(a.s, b.s) >= 87 * greatest(a.s, b.s)
          GROUP BY a.key, b.key)
SELECT kb AS key, CAST(min(ka) AS BIGINT) AS dup_of FROM pairs
WHERE inter / (sa + sb - inter) >= 0.87::DOUBLE GROUP BY kb"""

SQL["stream_score"] = SQL["analyze_json"]

SQL["stream_dedup"] = f"""
WITH {POSTS}
SELECT DISTINCT text FROM posts"""

SQL["stream_reject_counts"] = f"""
WITH {POSTS},
f AS (SELECT CASE WHEN fl = '' THEN 'accepted' ELSE fl END AS fl FROM (SELECT {quality_flags('text')} AS fl FROM posts))
SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(fl, ',')) AS reason FROM f) GROUP BY reason"""

SQL["accept_posts_v1"] = f"""
WITH {POSTS}, t AS (SELECT key, {strip_ws('text')} AS text FROM posts),
ok AS (SELECT * FROM t WHERE length(text) > 0 AND NOT contains(lower(text), {lit(K.PLACEHOLDER_HANDLE)})),
first AS (SELECT key, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS rn FROM ok) WHERE rn = 1)
SELECT key, text FROM first ORDER BY key LIMIT {C.ACCEPT_LIMIT}"""

_RESP_V1 = _RESP.split("r1 AS (")[0] + f"""s0 AS (SELECT batch_id, {strip_ws('raw')} AS t FROM r),
s1 AS (SELECT batch_id, CASE WHEN starts_with(t, '```') THEN
         {strip_ws("CASE WHEN starts_with(regexp_replace(t, '^`+|`+$', '', 'g'), 'json') THEN substring(regexp_replace(t, '^`+|`+$', '', 'g'), 5) ELSE regexp_replace(t, '^`+|`+$', '', 'g') END")}
       ELSE t END AS t FROM s0),
s2 AS (SELECT *, regexp_extract(t, {lit(ps.BRACKET_RE)}) AS span FROM s1),
parsed AS (SELECT batch_id, coalesce(
    from_json(CASE WHEN starts_with({strip_ws('t')}, '[') AND json_valid({strip_ws('t')}) THEN {strip_ws('t')} END, '["VARCHAR"]'),
    from_json(CASE WHEN length(span) > 0 AND json_valid(span) THEN span END, '["VARCHAR"]')) AS posts FROM s2)"""

SQL["parse_batches_v1"] = f"""
WITH {_RESP_V1}
SELECT batch_id, CAST(generate_subscripts(posts, 1) - 1 AS BIGINT) AS pos, unnest(posts) AS text
FROM parsed WHERE posts IS NOT NULL"""

_ENV_JS = "CAST(to_json({'posts': items}) AS VARCHAR)"
_ENV_JS_SHORT = "CAST(to_json({'posts': items[1:len(items) - 1]}) AS VARCHAR)"

SQL["parse_envelope"] = f"""
WITH b AS (SELECT item_id // {K.BATCH_SIZE} AS batch_id, list(text ORDER BY item_id) AS items, count(*) AS expected
           FROM benchmark GROUP BY 1),
e AS (SELECT CAST(batch_id AS BIGINT) AS batch_id, expected, CASE batch_id % 4
        WHEN 1 THEN {_ENV_JS_SHORT}
        WHEN 2 THEN regexp_replace({_ENV_JS_SHORT}, '^\\{{"posts":\\[', '{{"posts":[1,')
        WHEN 3 THEN substring({_ENV_JS}, 1, length({_ENV_JS}) - 1)
        ELSE {_ENV_JS} END AS raw FROM b),
p AS (SELECT *, CASE WHEN json_valid(raw) THEN json_extract(raw, '$.posts') END AS posts,
             json_valid(raw) AS ok FROM e),
st AS (SELECT *, CASE WHEN NOT ok THEN 'invalid_json'
                      WHEN posts IS NULL OR json_type(posts) <> 'ARRAY' THEN 'missing_posts'
                      WHEN json_array_length(posts) <> expected THEN 'wrong_arity' END AS error FROM p),
items AS (SELECT batch_id, unnest(json_extract(posts, '$[*]')) AS item,
                 unnest(range(CAST(json_array_length(posts) AS BIGINT))) AS pos FROM st WHERE error IS NULL),
t AS (SELECT batch_id, pos, CASE WHEN json_type(item) = 'VARCHAR' THEN json_extract_string(item, '$') END AS text
      FROM items),
bands(band_idx, length_name, min_chars, max_chars) AS (VALUES {_BANDS_VALUES}),
z AS (SELECT t.*, b.length_name, b.min_chars, b.max_chars FROM t
      JOIN bands b ON b.band_idx = {md5_int(K.SEED, "concat_ws(':', t.batch_id, t.pos)")} % 4)
SELECT batch_id, CAST(pos AS BIGINT) AS pos, text, length_name, {row_verdict('text', 'min_chars', 'max_chars')} AS status
FROM z
UNION ALL
SELECT batch_id, CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), error FROM st WHERE error IS NOT NULL"""
