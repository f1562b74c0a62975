"""DuckDB SQL for the queries that SQL can express (1, 6, 8, 12 and 13); the others are tested against brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_TAIL = r"(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*)$"


def _strength(groups: str) -> str:
    """Prior pseudo-count of a level from its (n, good, prior) rows."""
    return f"""(SELECT 1 / CASE WHEN coalesce(w, 0) = 0 THEN 0.1::DOUBLE
        ELSE least(greatest((s - v) / w, 0.001::DOUBLE), 0.5::DOUBLE) END - 1 FROM (
        SELECT sum(n * (good / n - prior) * (good / n - prior)) AS s, sum(prior * (1 - prior)) AS v,
               sum(prior * (1 - prior) * (n - 1)) AS w FROM {groups} WHERE n > 0))"""


OP1 = rf"""
WITH p0 AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p1 AS (SELECT *, regexp_extract(host, '(?:^|\.)({_TAIL})', 1) AS suffix,
    regexp_extract(host, '(?:^|\.)([^.]+\.{_TAIL})', 1) AS d0,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html|/)?$', 1), '') AS BIGINT) AS label_id FROM p0),
p AS (SELECT page_id, host, path, suffix, CASE WHEN d0 = '' THEN host ELSE d0 END AS domain, label_id FROM p1),
l AS (SELECT doc_id AS label_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
      FROM p LEFT JOIN l USING (label_id) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
s1 AS (SELECT *, (SELECT CASE WHEN sum(n) = 0 THEN 0.5 ELSE sum(good) / sum(n) END FROM s) AS prior FROM s),
s2 AS (SELECT suffix, (good + m * prior) / (n + m) AS rate FROM s1, {_strength('s1')} AS t(m)),
d1 AS (SELECT d.*, s2.rate AS prior FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, suffix, (good + m * prior) / (n + m) AS rate FROM d1, {_strength('d1')} AS t(m)),
h1 AS (SELECT h.*, d2.rate AS prior FROM h JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, n, m, (good + m * prior) / (n + m) AS rate FROM h1, {_strength('h1')} AS t(m)),
rep AS (SELECT host, n, rate, greatest(rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)), 0) AS lower_ FROM h2),
rules(rule, host_, path_, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
    ('com/de/', 'com', '/de/', 'block')),
hp AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM hp JOIN rules
      ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_) GROUP BY ALL)
SELECT page_id, p.host, p.path, m.rule,
    coalesce(m.v, CASE WHEN rep.lower_ >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict,
    rep.n::BIGINT AS n_labelled, round(rep.rate, 6) AS host_rate, round(rep.lower_, 6) AS host_lower
FROM p JOIN rep USING (host) LEFT JOIN m ON m.host = p.host AND m.path = p.path
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
         FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM wins),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT * FROM d, ns) x, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS t(i)),
hits AS (SELECT doc_id, item_id, dg.n, i FROM dg JOIN wins ON dg.n = wins.n AND dg.g = wins.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS prev, len(w) AS n_words
      FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY ALL),
o1 AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
c2 AS (SELECT prev, w, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL),
o2 AS (SELECT doc_id, prev, w, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM t),
r AS (SELECT t.doc_id, t.i, c1.n - o1.n AS r1, coalesce(c2.n - o2.n, 0) AS r2, coalesce(cp.n - op.n, 0) AS rp,
             greatest(total.n - t.n_words, 1) AS others
      FROM t JOIN c1 ON c1.w = t.w JOIN o1 ON o1.doc_id = t.doc_id AND o1.w = t.w
      LEFT JOIN c2 ON c2.prev = t.prev AND c2.w = t.w
      LEFT JOIN o2 ON o2.doc_id = t.doc_id AND o2.prev = t.prev AND o2.w = t.w
      LEFT JOIN c1 cp ON cp.w = t.prev LEFT JOIN o1 op ON op.doc_id = t.doc_id AND op.w = t.prev, total),
v AS (SELECT doc_id, CASE WHEN i > 1 AND r2 > 0 THEN ln(r2) - ln(greatest(rp, 1))
        ELSE CASE WHEN r1 > 0 THEN ln(r1) - ln(others) ELSE ln(0.4) - ln(others) END
             + CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END END AS value,
      CASE WHEN i > 1 THEN r2 ELSE r1 END = 0 AS backed FROM r),
g AS (SELECT doc_id, avg(value) AS score, count(*) FILTER (WHERE backed) AS n_backoff FROM v GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
    round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN g USING (doc_id)
"""

OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM w, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 6)) AS u(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS longer
           FROM c, unnest(range(1, 5)) AS t(i), unnest(range(2, 5)) AS u(s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < f),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, k, x.f AS l, y.f AS r, n,
    (1000::HUGEINT * kept.f * n) // (x.f::HUGEINT * y.f) AS score
    FROM kept JOIN t USING (lang) JOIN unnest(range(1, 5)) AS u(k) ON k < m
    JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(ws[1:k], ' ')
    JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
    n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13 = """
WITH crc(t) AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(0, 256) AS r(i)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(
        string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
        4294967295) % 6 AS h FROM own, crc),
again AS (SELECT h.conv_id, list_concat(coalesce(base.own[1:h], []), h.own[h + 1:]) AS turns
          FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 100),
members AS (SELECT conv_id, d, turns[1:d] AS k, d = len(turns) AS ends FROM again, unnest(range(0, len(turns) + 1)) AS t(d)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].t) ELSE 0 END AS saved FROM nodes LEFT JOIN kids USING (k, d)),
sub AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
        FROM full_, unnest(range(0, d + 1)) AS t(e) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_ n JOIN sub ON sub.k = n.k AND sub.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""

ORACLE = {"op1_url_filter": OP1, "op6_decontaminate": OP6, "op8_lm_score": OP8, "op12_collocations": OP12,
          "op13_prefix_trie": OP13}
