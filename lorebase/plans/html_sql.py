"""The tag tree of a page in SQL: a walk over its tokens with a stack of open elements."""

from __future__ import annotations

from lorebase import fixed
from lorebase.plans.catalog_text import _strip_sql, _unescape_sql
from lorebase.plans.corpus import single_spaced_sql

_TOKEN = r"(?is)<!--.*?-->|<![^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>|[^<]+|<"


def _listed(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _value(name: str) -> str:
    return f"""regexp_extract(t, '(?is)\\s{name}\\s*=\\s*("[^"]*"|[^\\s>]*)', 1)"""


#: tokens: one row a token with its number in the page; walk: the stack of open elements after each of them.
WALK_SQL = f"""
raw AS (SELECT page_id, url, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '{_TOKEN}') AS x FROM pages)),
tokens AS (
  SELECT page_id, i, t,
    CASE WHEN regexp_matches(t, '(?i)^<(!|script\\b|style\\b)') THEN 'none' WHEN regexp_matches(t, '(?i)^</[a-z]') THEN 'end'
         WHEN regexp_matches(t, '(?i)^<[a-z]') THEN 'start' ELSE 'text' END AS kind,
    lower(regexp_extract(t, '(?i)^</?([a-z][^\\s/>]*)', 1)) AS tag,
    regexp_matches({_value('class')}, '(?i){fixed.BOILERPLATE_ATTR}') OR regexp_matches({_value('id')}, '(?i){fixed.BOILERPLATE_ATTR}') AS marked
  FROM raw),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(tag VARCHAR, pos BIGINT, hid BOOLEAN)[]) AS stack FROM pages
  UNION ALL
  SELECT w.page_id, k.i,
    CASE WHEN kind = 'start' AND tag NOT IN {_listed(fixed.VOID_TAGS)} AND NOT ends_with(t, '/>')
           THEN list_append(stack, {{'tag': tag, 'pos': k.i, 'hid': coalesce(stack[-1].hid, false) OR marked OR tag IN {_listed(fixed.STRIPPED_TAGS)}}})
         WHEN kind = 'end' AND list_contains(list_transform(stack, lambda s: s.tag), tag)
           THEN stack[1:len(stack) - list_position(list_reverse(list_transform(stack, lambda s: s.tag)), tag)]
         ELSE stack END
  FROM walk w JOIN tokens k ON k.page_id = w.page_id AND k.i = w.i + 1),
pieces AS (
  SELECT page_id, i, stack, {_strip_sql(_unescape_sql('t'))} AS piece
  FROM walk JOIN tokens USING (page_id, i) WHERE kind = 'text' AND NOT coalesce(stack[-1].hid, false))"""

#: extracted: the text of every page.
EXTRACT_SQL = f"""{WALK_SQL},
parts AS (
  SELECT page_id, pos, string_agg(piece, '' ORDER BY i) AS part
  FROM (SELECT page_id, i, piece, unnest(stack).tag AS tag, unnest(stack).pos AS pos FROM pieces WHERE piece <> '')
  WHERE tag IN {_listed(fixed.SEMANTIC_TAGS)} GROUP BY page_id, pos HAVING length(part) > {fixed.MIN_FRAGMENT_CHARS}),
joined AS (SELECT page_id, count(*) AS n, string_agg(part, chr(10) || chr(10) ORDER BY pos) AS content FROM parts GROUP BY page_id),
whole AS (SELECT page_id, string_agg(piece, chr(10) ORDER BY i) AS content FROM pieces WHERE piece <> '' GROUP BY page_id),
extracted AS (
  SELECT page_id, url, CASE WHEN coalesce(joined.n, 0) < {fixed.MIN_SEMANTIC_PARTS} THEN coalesce(whole.content, '') ELSE joined.content END AS content
  FROM pages LEFT JOIN joined USING (page_id) LEFT JOIN whole USING (page_id))"""

HTML_EXTRACT_SQL = f"WITH RECURSIVE {EXTRACT_SQL} SELECT page_id, content FROM extracted"

#: Elements by the order of their starts and of their ends; elements that one token ends, end from the inside.
HTML_BLOCKS_SQL = f"""
WITH RECURSIVE {WALK_SQL},
open AS (SELECT page_id, i, unnest(stack) AS e, generate_subscripts(stack, 1) AS depth FROM walk),
el AS (SELECT page_id, e.pos AS pos, max(i) AS last, e.tag AS tag, max(depth) AS depth, bool_or(e.hid) AS removed FROM open GROUP BY page_id, e.pos, e.tag),
tx AS (SELECT page_id, pos, string_agg(piece, '' ORDER BY i) AS text FROM (SELECT page_id, i, piece, unnest(stack).pos AS pos FROM pieces WHERE piece <> '') GROUP BY page_id, pos)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS pre,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY last, depth DESC) AS INTEGER) AS post,
       CAST(depth AS INTEGER) AS depth, tag, removed, coalesce(text, '') AS text
FROM el LEFT JOIN tx USING (page_id, pos)"""

WEBSITE_DOCUMENTS_SQL = f"""
WITH RECURSIVE {EXTRACT_SQL},
texts AS (SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS site, page_id, content FROM extracted WHERE length({_strip_sql('content')}) > 0),
p AS (SELECT site, page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS paragraph FROM (SELECT site, page_id, string_split(content, chr(10) || chr(10)) AS x FROM texts)),
k AS (SELECT *, lower({single_spaced_sql('paragraph')}) AS key FROM p),
sizes AS (SELECT site, count(*) AS site_pages FROM texts GROUP BY 1),
b AS (
  SELECT k.site, key FROM k JOIN sizes USING (site) WHERE length(key) >= {fixed.MIN_BOILERPLATE_KEY} AND site_pages >= {fixed.BOILERPLATE_MIN_PAGES}
  GROUP BY k.site, key, site_pages HAVING count(DISTINCT page_id) > {fixed.BOILERPLATE_THRESHOLD} * site_pages),
kept AS (SELECT site, page_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY pos) AS content FROM k WHERE (site, key) NOT IN (SELECT (site, key) FROM b) GROUP BY site, page_id)
SELECT * FROM kept WHERE length({_strip_sql('content')}) > 0"""
