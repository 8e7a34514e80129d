"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from . import exactsearch, middle, phrases, quality, secrets


def _located(name: str, kind: int, pattern: str) -> str:
    """A relation of spans (rid, k, s, e, v) of one pattern: a match's place is
    the length of all pieces and matches before it."""
    p = pattern.replace("'", "''")
    return (
        f"{name} AS (SELECT rid, {kind} AS k, s::BIGINT AS s, (s + length(h))::BIGINT AS e, h AS v FROM ("
        f"SELECT rid, h, sum(length(p) + length(h)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) - length(h) AS s FROM ("
        f"SELECT rid, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h, unnest(ps[1:len(hs)]) AS p FROM ("
        f"SELECT rid, regexp_extract_all(t, '{p}', 0) AS hs, string_split_regex(t, '{p}') AS ps FROM docs))))"
    )


def _secrets() -> str:
    listed = "string_agg(['assign','access','hex','generic'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    value = secrets.ASSIGN.replace("'", "''")
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
{_located('a0', 0, secrets.ASSIGN)}, {_located('a1', 1, secrets.ACCESS)}, {_located('a2', 2, secrets.HEX)}, {_located('a3', 3, secrets.GENERIC)},
base AS (SELECT rid, k, s, e, regexp_extract(v, '{value}', 2) AS v FROM a0 WHERE length(regexp_extract(v, '{value}', 2)) >= 6 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2),
extra AS (SELECT * FROM a3 x WHERE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 12
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND x.s < b.e AND b.s < x.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
owners AS (SELECT v, count(DISTINCT source) <= 2 AS specific FROM every JOIN docs USING (rid) GROUP BY v),
judged AS (SELECT every.*, specific FROM every JOIN owners USING (v)),
b AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {listed} AS l FROM base GROUP BY rid),
r AS (SELECT rid, {listed} FILTER (k < 3 OR specific) AS spans, count(*) FILTER (specific) AS n_live, count(*) FILTER (NOT specific) AS n_copied FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN b USING (rid) LEFT JOIN r USING (rid)"""


def _overlaps() -> str:
    """Every window of every alignment that shares a run of words: an item's
    window with t different words has t + 1 runs of equal ones, one of them of
    4 words or more (13 words, t = 2), of 3 (7 to 12 words, t = 1), or all."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    at = lambda table, key: f"SELECT {key}, i, w[i + 1] AS w0, w[i + 2] AS w1, w[i + 3] AS w2, w[i + 4] AS w3 FROM (SELECT {key}, w, unnest(range(0, len(w))) AS i FROM {table})"
    run = lambda n, where: "SELECT DISTINCT did, item, dp.i - ip.i AS d FROM dp JOIN ip ON " + " AND ".join(f"dp.w{k} = ip.w{k}" for k in range(n)) + f" JOIN iw USING (item) WHERE {where}"
    return f"""WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS did, doc_id, {words} AS w FROM documents),
iw AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, w, least(13, len(w)) AS k FROM (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w)),
dp AS MATERIALIZED ({at('dw', 'did')}), ip AS MATERIALIZED ({at('iw', 'item')}),
g AS ({run(4, 'k = 13')} UNION {run(3, 'k BETWEEN 7 AND 12')} UNION {run(1, 'k < 7')}),
p AS (SELECT doc_id, item_id, k, d, dw.w AS a, iw.w AS b, unnest(range(greatest(0, -d), least(len(b), len(a) - d) - k + 1)) AS p FROM g JOIN dw USING (did) JOIN iw USING (item)),
v AS (SELECT doc_id, item_id, k, p + d AS start, list_sum(list_transform(list_zip(a[p + d + 1 : p + d + k], b[p + 1 : p + k]), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) AS n FROM p)
SELECT doc_id, item_id, max(n)::INTEGER AS matched, min(start)::INTEGER AS first_word, max(start + k - 1)::INTEGER AS last_word FROM v WHERE n >= k - k * 2 // 13 GROUP BY doc_id, item_id"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first_id, strlen(any_value(h)) >= 100 AND count(*) > 1 AS many FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN many AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN many AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p JOIN f USING (h)"""


def _quality() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate((
        "n_words < 50", "100 * n_repeat_words > 50 * n_words", "100 * n_symbols > 25 * n_words", "100 * n_dup_lines > 50 * n_lines",
        "100 * n_upper > 50 * n_letters", "word_chars < 2 * n_words OR word_chars > 25 * n_words", "100 * n_letters < 30 * word_chars",
        "100 * n_distinct < 5 * n_words")))
    space = "[\\x20\\x09-\\x0D]"
    base = quality.mask_of(quality.POLICIES["base"])
    alone = " ".join(f"WHEN {1 << i} THEN '{rule}'" for i, rule in enumerate(quality.RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{space}+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(range(0, len(w))) AS i, unnest(w) AS w0 FROM m), p AS (SELECT rid, i, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w0, w1, w2) AS c FROM p WHERE w2 IS NOT NULL),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY rid),
x AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, len(list_distinct(w)) AS n_distinct FROM m LEFT JOIN r USING (rid)),
f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM x),
z AS (SELECT *, CASE fail_bits {alone} END AS sole_rule FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {base} <> 0 AS base_failed, fail_bits & {base} = 0 AND fail_bits & {quality.mask_of(quality.POLICIES['v2'])} = 0 AS kept, fail_bits, sole_rule, CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS n_sole FROM z"""


ORACLES = {
    "op1_secret_scan": _secrets(),
    "op4_decontamination": _overlaps(),
    "op5_warc": WARC,
    "op9_quality_rules": _quality(),
    "op11_exact_topk": exactsearch.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_fill_in_middle": middle.ORACLE,
}
