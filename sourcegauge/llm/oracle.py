"""SQL for the queries on text that SQL can express, as DuckDB reads it. The other queries are tested against plain loops."""

from __future__ import annotations

from . import mixing, oracle_vectors, quality

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality() -> str:
    def pattern(p: str) -> str:
        return p.replace("'", "''")

    words, chars = _WORDS.format("line"), r"length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))"
    parts, most = f"string_split_regex(line, '{quality.BARS}')", quality.LABEL
    navigation = (f"(len({parts}) >= 3 AND length({parts}[1]) > 0 AND length(regexp_replace({parts}[1], '^[\\x20\\x09-\\x0D]+', '')) <= {most} AND length({parts}[-1]) <= {most}"
                  f" AND len(list_filter({parts}[2:-2], lambda x: length(x) NOT BETWEEN 1 AND {most})) = 0)")
    symbols = f"len(regexp_extract_all({{0}}, '{quality.SYMBOLS}'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_no FROM documents),
w AS (SELECT row_no, doc_id, t, {_WORDS.format('t')} AS w FROM d),
place AS (SELECT row_no, w, len(w) AS n, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
gram AS (SELECT row_no, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM place),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS c FROM gram) WHERE c > 1),
hit AS (SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_no),
line AS (SELECT row_no, line, {chars} AS chars, {words} AS words
         FROM (SELECT row_no, unnest(string_split(t, chr(10))) AS line FROM d) WHERE len({words}) > 0),
judged AS (SELECT row_no, line, chars,
             {symbols.format('line')} * 100 > chars * {quality.MAX_SYMBOLS}
             OR (len(words) >= 3 AND len(list_filter(words, lambda x: regexp_matches(x, '{quality.SHOUTED}'))) * 2 > len(words))
             OR {navigation} OR regexp_matches(line, '{pattern(quality.MENU)}')
             OR (len(words) <= 30 AND regexp_matches(line, '{pattern(quality.BOILERPLATE)}')) AS bad FROM line),
lines AS (SELECT row_no, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
            CAST(coalesce(sum(chars), 0) AS BIGINT) AS word_chars, CAST(coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS BIGINT) AS kept_chars
          FROM judged GROUP BY row_no),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST({symbols.format('t')} AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(kept_chars, 0) AS kept_chars
      FROM w LEFT JOIN lines USING (row_no) LEFT JOIN hit USING (row_no)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEATED} AS base_failed FROM m)
SELECT *, NOT base_failed AND kept_chars >= word_chars * {1 - quality.MAX_LOST} AS kept FROM f"""


def _mixing() -> str:
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    most = mixing.MAX_EPOCHS
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {cycle} END AS weight FROM d GROUP BY source),
-- A source is clamped if the level that those before it in the order of size by weight leave is above its clamp.
o AS (SELECT *, {most} * source_size AS cap, {mixing.SHARE}e0 * sum(source_size) OVER () AS whole,
        coalesce(sum({most} * source_size) OVER (ORDER BY {most} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY {most} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
c AS (SELECT *, cap <= (whole - CAST(held AS DOUBLE)) / free * weight AS clamped FROM o),
level AS (SELECT (max(whole) - coalesce(CAST(sum(cap) FILTER (WHERE clamped) AS DOUBLE), 0e0)) / sum(weight) FILTER (WHERE NOT clamped) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM c, level),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
p AS (SELECT d.*, source_size, target, times, target - times * source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (times + CASE WHEN rest > 0 AND 2 * begins + size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM p"""


ORACLES = {"op9_quality": _quality(), "op10_mixing": _mixing(), **oracle_vectors.ORACLES}
