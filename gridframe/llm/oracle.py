"""DuckDB SQL of the registered queries that SQL can express.

The others are trained (toxicity, PII), approximate (nearest neighbours), or
depend on a vocabulary file or a dynamic program; tests/llm compares those with
brute force, the tokenizer library or held-out rows."""

from __future__ import annotations

from gridframe.llm.queries import URL_RULES
from gridframe.llm.url_filter import BLOCK_AT, LEAST_STRENGTH, MOST_STRENGTH, TWO_LABEL_SUFFIXES, Z

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT *, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS last_id FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to FROM m)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r"""

_TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND (c.vec_id <> q.vec_id OR c.e <> q.e) AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 5"""

_CHAT = """
WITH whole AS (
  SELECT conv_id, count(*)::INTEGER AS n_turns, list({'role': role, 'text': text} ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM conversations GROUP BY conv_id),
prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns
  FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole))
SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS copies, any_value(rendered) AS rendered
FROM whole ANTI JOIN prefixes USING (turns)
GROUP BY turns"""

_WORDS = f"regexp_extract_all({_LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATE = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))
                                    ELSE [array_to_string(w, ' ')] END) AS g,
         least(len(w), 10) AS size
  FROM items WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS i, w
  FROM docs JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size),
grams AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM places),
hits AS (SELECT rid, i, grams.size, item FROM grams JOIN windows ON grams.g = windows.g AND grams.size = windows.size),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""

_JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = doc_id) AS component_id
FROM sets"""


def _longest_rule(value: int) -> str:
    """CASE over the rules, longest first; ``value`` 0: the action, 1: the rule."""
    out = "CASE"
    for rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule[1].partition("/")
        out += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{rule[value]}'"
    return out + " END"


def _labels(n: int) -> str:
    """The last ``n`` dot-separated labels of the host."""
    return f"array_to_string(string_split(host, '.')[-{n}:], '.')"


def _shrunk(name: str, level: str, above: str, up: str) -> str:
    """Posterior beta parameters of a level's rows under the prior of the level above."""
    return f"""
{name}_in AS (SELECT l.*, u.mean AS prior FROM {level} l JOIN {above} u USING ({up})),
{name}_rho AS (
  SELECT (sum(pow(bad - pages * prior, 2)) - sum(pages * prior * (1 - prior)))
         / nullif(sum(pages * (pages - 1) * prior * (1 - prior)), 0) AS rho FROM {name}_in),
{name}_m AS (
  SELECT CASE WHEN rho > 0 THEN least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / rho - 1)) ELSE {MOST_STRENGTH} END AS m FROM {name}_rho),
{name} AS (
  SELECT *, bad + m * prior AS a, pages - bad + m * (1 - prior) AS b, (bad + m * prior) / (pages + m) AS mean
  FROM {name}_in, {name}_m)"""


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_URL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce({_LOWERED.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (SELECT *, {_longest_rule(0)} AS action, {_longest_rule(1)} AS rule FROM parts),
hosts AS (
  SELECT host, count(action)::DOUBLE AS pages, count(*)::DOUBLE AS every, (count(*) FILTER (action = 'block'))::DOUBLE AS bad,
         CASE WHEN {_labels(2)} IN ({_TWO}) THEN {_labels(3)} ELSE {_labels(2)} END AS domain,
         CASE WHEN {_labels(2)} IN ({_TWO}) THEN {_labels(2)} ELSE {_labels(1)} END AS suffix
  FROM judged GROUP BY host),
domains AS (SELECT domain, suffix, sum(every) AS pages, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 1 AS one, sum(pages) AS pages, sum(bad) AS bad FROM domains GROUP BY suffix),
everything AS (SELECT 1 AS one, (sum(bad) + 0.5::DOUBLE) / (sum(pages) + 1) AS mean FROM suffixes),
{_shrunk('by_suffix', 'suffixes', 'everything', 'one')},
{_shrunk('by_domain', 'domains', 'by_suffix', 'suffix')},
{_shrunk('by_host', 'hosts', 'by_domain', 'domain')},
bounds AS (SELECT host, mean, greatest(0.0::DOUBLE, mean - {Z} * sqrt(mean * (1 - mean) / (a + b + 1))) AS lower FROM by_host)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN lower >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_rate, round(lower, 6) AS bad_rate_lower
FROM judged JOIN bounds USING (host)"""

SQL: dict[str, str] = {
    "op4_warc": _WARC,
    "op5_topk": _TOP_K,
    "op6_chat_collapse": _CHAT,
    "op7_ngram_jaccard": _JACCARD,
    "op9_url_reputation": _URL,
    "op11_decontaminate": _DECONTAMINATE,
}
