"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, chat, codes, decontaminate, langid, lattice, leaks, lines, mixing, quality, sharding, simhash, urls
from .common import table


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_lm_scoring": lattice.op2_lm_scoring,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_filter_interaction_audit": audit.op11_filter_interaction_audit,
    "op12_vector_code_compression": codes.op12_vector_code_compression,
    "op13_secret_scans": leaks.op13_secret_scans,
}

STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
o AS (SELECT k, s FROM g GROUP BY k, s HAVING count(*) > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT g.k, i, unnest(range(5)) AS j FROM g JOIN o ON o.k = g.k AND o.s = g.s) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT w.k, doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha, len(list_filter(w, lambda x: lower(x) IN ({STOP}))) AS stop FROM w JOIN l ON l.k = w.k LEFT JOIN r ON r.k = w.k),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 1000000 AND n_symbols <= 0.1::DOUBLE * word_chars AND word_chars / n_words BETWEEN 2 AND 12 AND (n_words < 20 OR stop / n_words >= 0.02::DOUBLE)
AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3::DOUBLE) AND alpha / n_words >= 0.7::DOUBLE AND (n_words < 20 OR letters = 0 OR upper / letters <= 0.6::DOUBLE) AS kept FROM b
"""


# What SQL can say of the operators whose whole result it can't: the same functions, fewer columns.
def url_rules(spark, sf_dir):
    url = F.col("url").cast("string")
    host, path = urls.host_of(url), urls.path_of(url)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), urls.fixed_rule(host, path).alias("rule"))


def fits(rule: str) -> str:
    host, _, rest = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"


URL_SQL = r"WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, host, path, CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in sorted((r for _, r in urls.FIXED), key=len, reverse=True)) + " END AS rule FROM u"


def mix_sizes(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", (F.col("taken") <= 2 * F.col("size")).alias("within"))


MIX_SQL = r"WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source) SELECT doc_id, size, s.n AS source_size, true AS within FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source"


def chat_texts(spark, sf_dir):
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return chat.render(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "segment", "offset", "n_turns", "text", trained.alias("trained"))


SAFE = r"regexp_replace({}, '<\|(im_start|im_end)\|>', '<' || chr(8203) || '|\1|>', 'g')"
CHAT_SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, {SAFE.format(r"regexp_replace(coalesce(nullif(trim(role), ''), 'unknown'), '\s+', ' ', 'g')")} AS role, {SAFE.format("coalesce(text, '')")} AS text, floor(turn / 256)::BIGINT AS segment FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system' UNION SELECT conv_id, NULL FROM t GROUP BY conv_id HAVING count(*) FILTER (role <> 'system') = 0),
x AS (SELECT t.*, speaker, coalesce(role = speaker, false) AS own, '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' AS body FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
s AS (SELECT conv_id, speaker, segment, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text, sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS trained FROM x GROUP BY ALL)
SELECT conv_id, speaker, segment, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY segment NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", n_turns, text, trained FROM s
"""

def secret_counts(spark, sf_dir):
    return leaks.op13_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access,
len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex FROM documents
"""

QUERIES |= {"secret_counts": secret_counts, "url_rules": url_rules, "mix_sizes": mix_sizes, "chat_texts": chat_texts}
ORACLES = {"op11_filter_interaction_audit": audit.OP11_SQL, "op12_vector_code_compression": codes.OP12_SQL, "secret_counts": SECRET_SQL, "op7_quality_rules": OP7_SQL, "op8_benchmark_decontamination": decontaminate.OP8_SQL, "url_rules": URL_SQL, "mix_sizes": MIX_SQL, "chat_texts": CHAT_SQL}
