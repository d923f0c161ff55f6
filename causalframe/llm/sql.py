"""The operators' questions as SQL over the same tables, by brute force, where SQL can express them."""

from __future__ import annotations

from causalframe.llm.license_scan import PHRASES, TEMPLATES, WRAPPED
from causalframe.llm.quality_rules import STOP_WORDS, SYMBOLS, THRESHOLDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_quote(x) for x in items) + "]"


def components(nodes: str, links: str) -> str:
    """CTEs that give reached(id, root) for all pairs of a node and a node it reaches, from links(a, b)."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reached(id, root) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, w.b FROM reached r JOIN both_ways w ON r.root = w.a)"""


def _rules() -> str:
    def ratio(over, under):
        return f"(CASE WHEN {under} > 0 THEN {over} * 1.0::DOUBLE / {under} ELSE 0.0 END)"

    out = []
    for _, over, under, least, most in THRESHOLDS:
        if least is not None:
            out.append(f"{ratio(over, under)} >= {least}::DOUBLE")
        if most is not None:
            out.append(f"{ratio(over, under)} <= {most}::DOUBLE")
    return " AND ".join(out)


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT rid, unnest(range(0, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT rid, i, list_aggregate(ws[i + 1 : i + 8], 'string_agg', ' ') AS g FROM grams),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM keyed) WHERE n > 1),
cover AS (SELECT rid, sum(least(8, coalesce(after, i + 8) - i)) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM twice) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
 len(ls) AS n_lines, len(list_filter(ws, lambda x: list_contains({_list(sorted(set(STOP_WORDS)))}, lower(x)))) AS n_stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
 len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_words FROM w LEFT JOIN cover ON w.rid = cover.rid),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM f"""

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM sound x JOIN sound y ON x.id < y.id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9),
{components("v", "links")},
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
c AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
SELECT v.id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.id = c.component_id AS kept FROM v LEFT JOIN n ON v.id = n.id JOIN c ON v.id = c.id"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [] END AS sh FROM w),
one AS (SELECT id, CAST(len(sh) AS BIGINT) AS n, unnest(sh) AS g FROM s),
shared AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM one x JOIN one y ON x.g = y.g AND x.id < y.id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
{components("s", "links")},
r AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
SELECT s.id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN r ON s.id = r.id"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op4() -> str:
    places = []
    for label, phrase in PHRASES:
        words = phrase.split()
        test = " AND ".join(f"ws[i + {k + 1}] = {_quote(x)}" for k, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(0, len(ws)), lambda i: {test}), lambda i: {{'i': i, 'label': {_quote(label)}}})")
    templates = ", ".join(f"({no}, {_quote(label)}, {_quote(text)})" for no, (label, text) in enumerate(TEMPLATES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER} AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS ws FROM d),
p AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS places FROM w),
b AS (SELECT rid, doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(list_transform(places, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(places, lambda x: x.i)) AS BIGINT) AS last_word,
 list_sort(list_distinct(list_transform(places, lambda x: x.label))) AS base FROM p),
templates AS (SELECT no, label, list_distinct({_WORDS.format("lower(text)")}) AS tokens FROM (VALUES {templates}) AS v(no, label, text)),
split AS (SELECT rid, string_split(t, chr(10)) AS ls FROM d WHERE contains(t, 'licen') OR contains(t, 'permi') OR contains(t, 'redis') OR contains(t, 'this') OR contains(t, 'right') OR contains(t, 'copy') OR contains(t, 'under')),
lines AS (SELECT rid, unnest(range(1, len(ls) + 1)) AS no, {_WORDS.format("unnest(ls)")} AS tokens FROM split),
runs AS (SELECT *, sum(CASE WHEN len(tokens) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY no) AS run FROM lines),
blocks AS (SELECT rid, 'l' || no AS block, list_distinct(tokens) AS tokens, false AS several FROM lines WHERE len(tokens) > 0
 UNION ALL SELECT rid, 'r' || run, list_distinct(flatten(list(tokens))), true FROM runs WHERE len(tokens) > 0 GROUP BY rid, run HAVING count(*) > 1),
found AS (SELECT rid, block, no, label, t.tokens, len(list_intersect(t.tokens, b.tokens)) * 1.0::DOUBLE / len(t.tokens) AS share FROM blocks b JOIN templates t ON 10 * len(list_intersect(t.tokens, b.tokens)) >= 9 * len(t.tokens) AND (NOT several OR len(t.tokens) >= {WRAPPED})),
top AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.rid = f.rid AND g.block = f.block AND len(g.tokens) > len(f.tokens) AND list_has_all(g.tokens, f.tokens))),
more AS (SELECT rid, list(DISTINCT label) AS labels FROM top GROUP BY rid), best AS (SELECT rid, max(share) AS score FROM found GROUP BY rid)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more.labels, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM b LEFT JOIN more ON b.rid = more.rid LEFT JOIN best ON b.rid = best.rid"""


OP4 = _op4()


def _op3() -> str:
    """The rules, and the two character models with their calibrated threshold."""
    from causalframe.llm.url_filter import RULES

    cases = []
    for _, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = {_quote(host)} OR ends_with(host, {_quote('.' + host)})) AND starts_with(path, {_quote(slash + rest)}) THEN {_quote(rule)}")
    allow = ", ".join(_quote(r) for v, r in RULES if v == "allow")
    return f"""WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, host || path AS text, CASE {' '.join(cases)} END AS rule FROM named),
texts AS (SELECT text, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 5 = 0 AS held,
 list_concat([0, 0], list_concat(list_transform(list_filter(string_split(translate(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9/.\\-]', chr(127), 'g'), '0123456789/.-', '{{{{{{{{{{{{{{{{{{{{|}}~'), ''), lambda c: c <> ''), lambda c: ascii(c) - 96), [0])) AS s
 FROM (SELECT DISTINCT text FROM judged)),
grams AS (SELECT text, held, unnest(list_transform(range(3, len(s) + 1), lambda i: (s[i - 2] * 32 + s[i - 1]) * 32 + s[i])) AS g FROM texts),
labelled AS (SELECT DISTINCT text, rule IN ({allow}) AS accepted FROM judged WHERE rule IS NOT NULL),
counted AS (SELECT accepted, g, count(*) AS n FROM grams JOIN labelled ON grams.text = labelled.text WHERE NOT held GROUP BY accepted, g),
grid AS (SELECT y.accepted, x.g AS g, coalesce(n, 0) AS n, x.g % 32 AS c, x.g // 32 % 32 AS b, x.g // 1024 AS a FROM (SELECT unnest([true, false]) AS accepted) y, (SELECT range AS g FROM range(0, 32768)) x
 LEFT JOIN counted k ON k.accepted = y.accepted AND k.g = x.g),
sums AS (SELECT *, sum(n) OVER (PARTITION BY accepted) AS n_all, sum(n) OVER (PARTITION BY accepted, c) AS n_c, sum(n) OVER (PARTITION BY accepted, b, c) AS n_bc, sum(n) OVER (PARTITION BY accepted, b) AS n_b, sum(n) OVER (PARTITION BY accepted, a, b) AS n_ab FROM grid),
p0 AS (SELECT *, (n_c + 1)::DOUBLE / (n_all + 32) AS p0 FROM sums), p1 AS (SELECT *, (n_bc + 4 * p0) / (n_b + 4) AS p1 FROM p0),
p2 AS (SELECT g, accepted, ln(CASE WHEN n_ab >= 8 THEN (n + 4 * p1) / (n_ab + 4) ELSE p1 END) AS p FROM p1),
ratio AS (SELECT g, sum(CASE WHEN accepted THEN p ELSE -p END) AS r FROM p2 GROUP BY g),
scored AS (SELECT text, held, avg(r) AS score FROM grams JOIN ratio ON grams.g = ratio.g GROUP BY text, held),
stats AS (SELECT accepted, avg(score) AS m, coalesce(stddev_pop(score), 0) AS d FROM scored JOIN labelled ON scored.text = labelled.text WHERE held GROUP BY accepted),
bound AS (SELECT CASE WHEN count(*) < 2 THEN 0.0 WHEN sum(d) = 0 THEN avg(m) ELSE (max(m) FILTER (WHERE accepted) * max(d) FILTER (WHERE NOT accepted) + max(m) FILTER (WHERE NOT accepted) * max(d) FILTER (WHERE accepted)) / sum(d) END AS t FROM stats)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN score >= t THEN 'allow' ELSE 'block' END AS verdict FROM judged JOIN scored ON judged.text = scored.text, bound"""


OP3 = _op3()
