"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isochron.llm import decontaminate, html_extract, line_quality, packing, pii, quality_lm, secret_scan, simhash, toxicity, url_filter

RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.op3_line_quality(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4_decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5_simhash(_read(spark, sf_dir, "documents"))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.op6_quality_lm(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op7_secrets(_read(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op8_html(_read(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10_pii(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_line_quality, op4_decontaminate, op5_simhash, op6_quality_lm, op7_secrets, op8_html, op9_url_filter, op10_pii)}


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT q.*, r.rhost || r.rpath AS rule, r.action, length(r.rhost || r.rpath) AS n
  FROM q LEFT JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(action, n), 'allow') AS verdict
FROM fit GROUP BY page_id, host, path
"""


_CLEAN = r"'[^\x20\x09-\x0D]+'"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {_CLEAN}) AS ws FROM d),
g AS (SELECT doc_id, i, ws[i:i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, {_CLEAN}) GROUP BY doc_id),
nl AS (SELECT doc_id, host, t, trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS x FROM l),
bad AS (SELECT host, x FROM nl WHERE x <> '' GROUP BY host, x HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN t END) > {line_quality.MOST_DOCUMENTS}),
rem AS (
  SELECT doc_id, sum(len(string_split(nl.x, ' '))) AS total, coalesce(sum(CASE WHEN bad.x IS NOT NULL THEN len(string_split(nl.x, ' ')) END), 0) AS removed
  FROM nl LEFT JOIN bad ON nl.host = bad.host AND nl.x = bad.x WHERE nl.x <> '' GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed, coalesce(total, 0) AS total
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines,
  cast(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed <= {line_quality.DEPLETED} * total AS kept
FROM c
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS k FROM (SELECT *, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
pos AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, pos.n, i FROM pos JOIN win ON pos.n = win.n AND pos.k = win.k),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _plain(pattern: str) -> str:
    """The pattern without possessive repeats, which DuckDB's engine neither has nor needs."""
    return pattern.replace("++", "+").replace("'", "''")


def _pii_sql() -> str:
    kinds = pii.BASE + pii.ADDED
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, '{k.name}' AS kind, {i} AS k, {k.prior} AS prior, '(?:^|[^a-z])(?:{k.context})' AS ctx, '(?:^|[^a-z])(?:{k.against})' AS con, regexp_extract_all(t, '{_plain(k.pattern)}') AS ms, string_split_regex(t, '{_plain(k.pattern)}') AS ps FROM d"
        for i, k in enumerate(kinds)
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN j % 2 = 0 THEN (2 * cast({digits}[-j] AS INTEGER)) - (CASE WHEN {digits}[-j] >= '5' THEN 9 ELSE 0 END) ELSE cast({digits}[-j] AS INTEGER) END for j in range(1, length({digits}) + 1)]) % 10 = 0"
    plain = "replace(m, ' ', '')"
    octets = "list_bool_and([try_cast(x AS HUGEINT) <= 255 for x in string_split(m, '.')])"
    number = f"array_to_string([CASE WHEN x >= '0' AND x <= '9' THEN x ELSE cast(ascii(x) - 55 AS VARCHAR) END for x in string_split(substr({plain}, 5) || substr({plain}, 1, 4), '')], '')"
    check = {
        "email": "true",
        "ip": octets,
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({plain}) BETWEEN 15 AND 34 AND try_cast(({_mod97(number)}) AS INTEGER) = 1",
        "tel": "true",
        "ssn": "true",
    }
    cases = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in check.items())
    base = len(pii.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
p AS (
  SELECT doc_id, t, kind, k, prior, ctx, ms[i] AS m, con, cast(list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0)),
s AS (
  SELECT doc_id, kind, k, a, a + length(m) AS b, greatest(0, least(1, prior + CASE WHEN regexp_matches(bef, ctx) THEN {pii.CONTEXT_BONUS} ELSE 0 END - CASE WHEN regexp_matches(bef, con) THEN {pii.CONTEXT_MALUS} ELSE 0 END)) AS score
  FROM (SELECT *, lower(substr(t, greatest(a - {pii.CONTEXT_CHARS}, 0) + 1, least(a, {pii.CONTEXT_CHARS}))) AS bef FROM p) WHERE CASE {cases} END),
base AS (SELECT * FROM s WHERE k < {base}),
added AS (SELECT * FROM s WHERE k >= {base} AND score >= {pii.THRESHOLD} AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = s.doc_id AND s.a < base.b AND base.a < s.b)),
x AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS line FROM base GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS line FROM (FROM base UNION ALL FROM added) GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)}, sha256(coalesce(x.line, '')) AS base_sha256, coalesce(y.line, '') AS spans
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""


def _mod97(number: str) -> str:
    """A decimal text modulo 97, nine digits at a time (at most 68 digits)."""
    rest = "''"
    for i in range(10):
        rest = f"cast(try_cast({rest} || substr({number}, {7 * i + 1}, 7) AS BIGINT) % 97 AS VARCHAR)"
    return rest


def oracle_sql() -> dict[str, str]:
    return {"op3_line_quality": OP3_SQL, "op4_decontaminate": OP4_SQL, "op9_url_filter": OP9_SQL, "op10_pii": _pii_sql()}
