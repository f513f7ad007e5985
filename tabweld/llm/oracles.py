"""SQL equivalents of the corpus queries, where SQL can express them."""

from __future__ import annotations

from tabweld.llm import line_dedup, quality

URL_FILTERS = r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'),
  ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split
), fits AS (
  SELECT p.page_id, r.rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n
  FROM parsed p JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
"""

LINE_DEDUP = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, n_chars, text, coalesce(source, '') AS site,
    string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
), places AS (
  SELECT r, site, unnest(raw) AS line, generate_subscripts(raw, 1) AS place FROM docs
), trimmed AS (
  SELECT r, site, place, line AS raw, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line FROM places
), once AS (
  SELECT DISTINCT r, site, line FROM trimmed WHERE line <> ''
), shared AS (SELECT line FROM once GROUP BY line HAVING count(DISTINCT site) >= %d),
signed AS (
  SELECT r, list(line ORDER BY length(line) DESC, line DESC)[1:2] AS longest,
    list(line ORDER BY length(line) DESC, line DESC) FILTER (WHERE line NOT IN (SELECT line FROM shared))[1:2] AS own
  FROM once GROUP BY r
), bad AS (
  SELECT line FROM once JOIN shared USING (line) JOIN signed USING (r) GROUP BY line
  HAVING 2 * count(DISTINCT (longest, coalesce(own, []))) >= %d
), rest AS (
  SELECT t.r, count(b.line) AS n_removed, string_agg(t.raw, chr(10) ORDER BY t.place) FILTER (WHERE b.line IS NULL) AS text
  FROM trimmed t LEFT JOIN bad b ON b.line = t.line GROUP BY t.r
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.raw) END::INTEGER AS n_lines,
  coalesce(x.n_removed, 0)::INTEGER AS n_removed,
  CASE WHEN x.n_removed > 0 THEN length(coalesce(x.text, '')) ELSE d.n_chars END AS n_chars,
  CASE WHEN x.n_removed > 0 THEN coalesce(x.text, '') ELSE d.text END AS text
FROM docs d LEFT JOIN rest x ON x.r = d.r
""" % (line_dedup.MIN_SITES, line_dedup.MIN_SITES)


TOP_K = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: Words of documents in runs of each length that a window has, joined with the windows.
DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
grams AS (
  SELECT r, i, n, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), found AS (SELECT r, i, n, item FROM grams JOIN windows USING (g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def quality_sql() -> str:
    """The measures, then EM unrolled: one aggregation over the vote patterns for each round."""
    rules = quality.RULES
    votes = ", ".join(
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{name}" for name, (bad, good) in rules.items()
    )
    names = ", ".join(f"v_{r}" for r in rules)

    def product(share: str, kind: str) -> str:
        rates = (f"CASE v_{r} WHEN 1 THEN {r}_up_{kind} WHEN -1 THEN 1 - {r}_up_{kind} ELSE 1 END" for r in rules)
        return " * ".join([share, *rates])

    posterior = f"({product('share', 'good')}) / (({product('share', 'good')}) + ({product('(1 - share)', 'bad')}))"
    def rate(r: str, kind: str, weight: str) -> str:
        up, down = (f"coalesce(sum({weight}) FILTER (WHERE v_{r} = {v}), 0) + 1" for v in (1, -1))
        return f"({up}) / (({up}) + ({down})) AS {r}_up_{kind}"

    fits = ", ".join(rate(r, kind, weight) for r in rules for kind, weight in (("good", "good"), ("bad", "docs - good")))
    first = ", ".join(
        f"{value} AS {r}_up_{kind}" for r in rules for kind, value in (("good", quality.FIRST_GOOD), ("bad", 1 - quality.FIRST_BAD))
    )
    least, most = quality.SHARES
    rounds = ", ".join(
        f"p{k} AS MATERIALIZED (SELECT least(greatest(sum(good) / sum(docs), {least}), {most}) AS share, {fits} "
        f"FROM (SELECT *, docs * ({posterior}) AS good FROM patterns, p{k - 1}))"
        for k in range(1, quality.ROUNDS + 1)
    )
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), split AS MATERIALIZED (
  SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM docs
), windows AS MATERIALIZED (
  SELECT r, unnest(g) AS g, generate_subscripts(g, 1) AS i
  FROM (SELECT r, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM split)
), twice AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (r, g)) GROUP BY r
), measured AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[{quality.UPPER}]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
    length(t) - length(translate(t, '.,;:?', '')) AS n_stops,
    length(regexp_replace(t, '[^{quality.ALPHANUMERIC}]', '', 'g')) AS n_alnum,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[{quality.ALPHANUMERIC}]'))) AS n_bare
  FROM split LEFT JOIN covered c USING (r)
), voted AS MATERIALIZED (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {votes} FROM measured
), patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS docs FROM voted WHERE NOT base_failed GROUP BY {names}),
p0 AS (SELECT {quality.FIRST_SHARE} AS share, {first}), {rounds}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(({posterior}) >= 0.5, false) AS kept
FROM voted, p{quality.ROUNDS}
"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op5_top_k": TOP_K,
    "op8_url_filters": URL_FILTERS,
    "op9_quality_rules": quality_sql(),
    "op13_decontamination": DECONTAMINATION,
}
