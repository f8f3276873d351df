"""DuckDB twins of the queries that SQL can express, by their definitions rather than the operators' methods."""
from __future__ import annotations

from strideframe.llm import line_chunks, quality

_SPACE = r"[\x20\x09-\x0D]+"


def _fails(rule: quality.Threshold) -> str:
    bounds = [f"{rule.metric} < {rule.low}::DOUBLE"] * (rule.low is not None) + [f"{rule.metric} > {rule.high}::DOUBLE"] * (rule.high is not None)
    return f"coalesce(({' OR '.join(bounds)}) AND n_words >= {rule.min_words}, FALSE)"


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
five AS (SELECT doc_id, i, ws[i:i + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM five) WHERE n > 1),
covered AS (SELECT doc_id, CAST(sum(least(5, after - i)) AS BIGINT) AS n_repeat_words
            FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS after FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in quality.STOP_WORDS)}))) AS n_stop_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words
      FROM w LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, CAST(word_chars AS DOUBLE) / nullif(n_words, 0) AS mean_word_length, CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) AS symbol_ratio,
             CAST(n_stop_words AS DOUBLE) / nullif(n_words, 0) AS stop_word_ratio, CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0) AS dup_line_ratio,
             CAST(n_alpha_words AS DOUBLE) / nullif(n_words, 0) AS alpha_word_ratio,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {' OR '.join(map(_fails, quality.TABLE))}) AS kept FROM r
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS owner FROM win) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINNOWING = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, ws[i:i + n - 1] AS win FROM
         (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS win FROM
         (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
w AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest((ws[3:] || [NULL, NULL])[:len(ws)]) AS w3 FROM q WHERE len(ws) > 0),
f1 AS (SELECT lang, w1 AS run, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS run, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS run, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f AS (SELECT lang, run, f FROM f1 UNION ALL SELECT lang, run, f FROM f2),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cut AS (SELECT lang, run, f AS a, 1 AS place, w1 AS x, w2 AS y FROM f2
        UNION ALL SELECT lang, run, f, 1, w1, w2 || ' ' || w3 FROM f3 UNION ALL SELECT lang, run, f, 2, w1 || ' ' || w2, w3 FROM f3),
scored AS (SELECT cut.lang, cut.run, a, place, x.f AS l, y.f AS r,
                  CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.run = cut.x JOIN f y ON y.lang = cut.lang AND y.run = cut.y),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, run ORDER BY score, place) = 1),
inner_runs AS (SELECT lang, run, max(f) AS longer FROM (
                 SELECT lang, w1 || ' ' || w2 AS run, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT weakest.*, weakest.run AS phrase FROM weakest LEFT JOIN inner_runs i ON i.lang = weakest.lang AND i.run = weakest.run
         WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

TRIES = r"""
WITH c AS (SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
                  length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM c),
-- the CRC of the digits, bit by bit
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384::BIGINT * (x % 2)))),
               4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM c)),
heads AS (SELECT ids.conv_id, pos, key, size FROM ids JOIN t ON t.conv_id = ids.base AND t.pos <= ids.h),
taken AS (SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id),
built AS (SELECT * FROM heads UNION ALL
          SELECT ids.conv_id, coalesce(k, 0) + pos - h, key, size FROM ids JOIN t USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE pos > h),
m AS (SELECT conv_id, pos AS depth, size, string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM built
      UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY depth, prefix),
edge AS (SELECT DISTINCT m.depth, m.prefix, up.prefix AS above FROM m JOIN m up ON up.conv_id = m.conv_id AND up.depth = m.depth - 1),
linked AS (SELECT node.*, parent.conv_id AS parent_conv_id, above FROM node LEFT JOIN edge USING (depth, prefix)
           LEFT JOIN node parent ON parent.depth = node.depth - 1 AND parent.prefix = above),
kids AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM edge GROUP BY ALL),
whole AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (depth, prefix)),
-- a node is one of its smallest member's prefixes, and so are its ancestors
sums AS (SELECT up.depth, up.prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * whole.size) AS saved
         FROM whole JOIN m up ON up.conv_id = whole.conv_id AND up.depth <= whole.depth GROUP BY ALL),
ends AS (SELECT depth, prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY depth, prefix)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM whole JOIN sums USING (depth, prefix) LEFT JOIN ends USING (depth, prefix)
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'),
                                                lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- documents of equal sets are compared once
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS rep, n
      FROM (SELECT doc_id, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS grams, count(*) AS n FROM s GROUP BY doc_id)),
own AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = rep),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM own x JOIN own y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM c WHERE doc_id = rep UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
root AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN root USING (rep)
"""

ORACLES = {"op11_phrases": PHRASES, "op12_jaccard": JACCARD, "op13_prefix_trie": TRIES, "op5_difference_cover": SUBSTRINGS, "op7_quality_rules": QUALITY, "op9_line_chunks": line_chunks.ORACLE, "op10_winnowing": WINNOWING}
