"""Pages, links, crawling and content trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions import formats, html, urls
from lorebase.functions.text import is_blank
from lorebase.operators import crawl as crawling
from lorebase.operators.boilerplate import without_boilerplate
from lorebase.operators.markup import page_blocks
from lorebase.operators.tree import link_counts, read_answers, space_paths, tree_documents
from lorebase.plans.catalog_text import _strip_sql, _unescape_sql, strip_html_sql
from lorebase.plans.corpus import single_spaced_sql
from lorebase.plans.html_sql import HTML_BLOCKS_SQL, HTML_EXTRACT_SQL, WEBSITE_DOCUMENTS_SQL
from lorebase.session import checkpoint
from lorebase.sources.tables import broadcast_if_small, table

PLATFORM_DOMAIN = "platform.example"
CRAWL_LIMIT = 6
INTERNAL_BASE = "https://store.example:8443/graphql"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", html.extract_title("html").alias("title"))


HTML_TITLE_SQL = f"""
SELECT page_id, {_unescape_sql(_strip_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS title FROM pages"""


def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", html.extract_text("html").alias("content"))


def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every page with its pre and post numbers, depth and text."""
    return page_blocks(_pages(spark, folder).select("page_id", "html"))


def website_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a site ingest sees them: text, no blank pages, no recurring paragraphs."""
    pages = _pages(spark, folder).select(
        urls.netloc(F.col("url")).alias("site"), "page_id", html.extract_text("html").alias("content")
    )
    texts = checkpoint(pages.filter(~is_blank(F.col("content"))))  # read three times, parsed once
    return without_boilerplate(texts)


def _content_type() -> Column:
    return F.when(F.contains("url", F.lit("?")), "TEXT/HTML; charset=utf-8").when(F.contains("url", F.lit("#")), "application/octet-stream").otherwise("")


def link_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds by declared type, and by leading bytes where the type says nothing."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", formats.kind_of(F.encode("html", "UTF-8"), _content_type()).alias("kind"))


LINK_KIND_SQL = """
SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'html' WHEN lower(html) LIKE '<!doc%' OR lower(html) LIKE '<html%'
  OR lower(html) LIKE '<?xml%' THEN 'html' WHEN lower(html) LIKE '%pdf%' AND lower(left(html, 4)) = '%pdf' THEN 'pdf' END AS kind
FROM pages"""


def link_text(spark: SparkSession, folder: str) -> DataFrame:
    body = F.encode("html", "UTF-8")
    return _pages(spark, folder).select("page_id", formats.linked_text(body, _content_type()).alias("content"))


_REST = "regexp_replace(url, '#.*$', '')"
_PATH = f"regexp_extract({_REST}, '^[^:]+://[^/?]*([^?]*)', 1)"
_AUTHORITY = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_NORMAL = f"""lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || {_AUTHORITY} ||
  CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END ||
  CASE WHEN regexp_extract({_REST}, '\\?(.+)$', 1) <> '' THEN '?' || regexp_extract({_REST}, '\\?(.+)$', 1) ELSE '' END"""


def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


URL_NORMALIZE_SQL = f"SELECT page_id, {_NORMAL} AS url FROM pages"


def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Domain, file-ending and safety tests, and collection names, for every page address."""
    pages = _pages(spark, folder)
    file_url = F.concat(urls.normalize(F.col("url")), F.lit("/Report.PDF"))
    return pages.select(
        "page_id",
        urls.same_domain(F.col("url"), F.concat(F.lit("http://"), urls.netloc(F.col("url")), F.lit("/x"))).alias("inside"),
        urls.same_domain(F.col("url"), F.concat(F.lit("http://"), urls.netloc(F.col("url")), F.lit(":8080/x"))).alias("other_port"),
        urls.skipped_file(F.col("url")).alias("skipped"),
        urls.skipped_file(F.regexp_replace(file_url, r"\?[^/]*", "")).alias("skipped_file"),
        urls.is_safe("url").alias("safe"),
        urls.website_collection(F.col("url")).alias("collection"),
        urls.tree_collection(F.col("page_id").cast("string"), F.lit("knowledge")).alias("tree_collection"),
    )


URL_FILTERS_SQL = f"""
SELECT page_id, true AS inside, false AS other_port,
       regexp_matches(lower({_PATH}), '\\.({"|".join(fixed.SKIP_EXTENSIONS)})$') AS skipped, true AS skipped_file,
       regexp_matches(url, '^https?://') AS safe, replace({_AUTHORITY}, ':', '-') || '-knowledge' AS collection,
       page_id || '-knowledge' AS tree_collection
FROM pages"""


def uri_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Internal storage addresses move to the configured host; page addresses stay."""
    pages = table(spark, folder, "pages")
    stored = F.concat(F.lit("https://docs.platform.example/api/private/rest/storage/document/"), F.col("page_id"), F.lit("?v=1"))
    base = F.lit(INTERNAL_BASE)
    return pages.select(
        "page_id", urls.rewrite_internal(stored, base, PLATFORM_DOMAIN).alias("stored"),
        urls.rewrite_internal(F.col("url"), base, PLATFORM_DOMAIN).alias("external")
    )


URI_REWRITE_SQL = """
SELECT page_id, 'https://store.example:8443/api/private/rest/storage/document/' || page_id || '?v=1' AS stored, url AS external FROM pages"""


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = crawling.page_links(_pages(spark, folder).select("page_id", "url", "html"))
    return links.select("page_id", "link_pos", "href", "target")


_HREFS_SQL = """
links AS (
  SELECT page_id, url, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS link_pos, unnest(h) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
resolved AS (
  SELECT page_id, url, link_pos, href, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || regexp_extract(url, '^[^:]+://([^/?#]*)', 1) ||
    CASE WHEN regexp_replace(href, '/+$', '') = '' THEN '/' ELSE regexp_replace(href, '/+$', '') END AS target
  FROM links)"""
PAGE_LINKS_SQL = f"WITH {_HREFS_SQL} SELECT page_id, link_pos, href, target FROM resolved"


def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that every page would add to its site's queue: inside, no files, each once."""
    links = crawling.page_links(_pages(spark, folder).select("page_id", "url", "html"))
    inside = links.filter(crawling.followable(F.col("url"), F.col("target")))
    return inside.groupBy(urls.netloc(F.col("url")).alias("site"), "target").agg(F.count("*").alias("links"))


CRAWL_FRONTIER_SQL = f"""WITH {_HREFS_SQL}
SELECT regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS site, target, count(*) AS links FROM resolved
WHERE NOT regexp_matches(lower(target), '\\.({"|".join(fixed.SKIP_EXTENSIONS)})$') GROUP BY ALL"""


def crawl_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Breadth-first crawl of the page table, seeded with every address in it."""
    pages = _pages(spark, folder)
    found = crawling.crawl(pages.select("url", "html", F.col("page_id").alias("position")), pages.select(F.col("url").alias("base_url")))
    return found.select("base_url", "url", "rank", F.length("html").alias("html_chars"))


# No given page links to another given page; the check returns nothing if that ever changes.
CRAWL_SITES_SQL = f"""WITH {_HREFS_SQL},
n AS (SELECT page_id, {_NORMAL} AS url FROM pages),
known AS (SELECT url, min(page_id) AS page_id FROM n GROUP BY 1),
first AS (SELECT p.url AS base_url, n.url, 1 AS rank FROM pages p JOIN n USING (page_id)),
second AS (
  SELECT DISTINCT p.url AS base_url, r.target AS url FROM pages p JOIN n USING (page_id) JOIN resolved r ON r.page_id = p.page_id
  JOIN known k ON k.url = r.target WHERE r.target <> n.url)
SELECT base_url, f.url, CAST(rank AS INTEGER) AS rank, CAST(length(html) AS INTEGER) AS html_chars
FROM first f JOIN known k ON k.url = f.url JOIN pages p ON p.page_id = k.page_id
WHERE (SELECT count(*) FROM second) = 0"""


def _linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages with links added to the next two pages of their site, in the order of page_id, and from the last to the first."""
    pages = _pages(spark, folder).select("page_id", "url", "html", urls.netloc(F.col("url")).alias("site"))
    order = Window.partitionBy("site").orderBy("page_id")  # a site's pages; the largest of the given sites has some tens
    ahead = [F.lead("url", k).over(order) for k in (1, 2)]
    first = F.first("url").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = F.concat(*[F.concat(F.lit('<a href="'), F.coalesce(u, first), F.lit('">more</a>')) for u in ahead])
    return pages.withColumn("html", F.concat("html", links))


def crawl_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl of sites whose pages link to each other, seeded with every page: many hops, and a page limit that binds."""
    pages = _linked_pages(spark, folder)
    found = crawling.crawl(pages.select("url", "html", F.col("page_id").alias("position")), pages.select(F.col("url").alias("base_url")), CRAWL_LIMIT)
    return found.select("base_url", "url", "rank")


# One queue a seed: in a step its first address is taken, fetched if it is known, and its new targets are appended.
CRAWL_HOPS_SQL = f"""
WITH RECURSIVE n AS (SELECT page_id, url, html, {_NORMAL} AS address, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS site FROM pages),
ahead AS (
  SELECT *, coalesce(lead(url, 1) OVER w, first_value(url) OVER w) AS one, coalesce(lead(url, 2) OVER w, first_value(url) OVER w) AS two
  FROM n WINDOW w AS (PARTITION BY site ORDER BY page_id)),
given AS (
  SELECT page_id, address, site, regexp_extract(url, '^([^:]+)://', 1) AS scheme,
         list_concat(regexp_extract_all(html, '<a href="([^"]*)"', 1), [one, two]) AS hrefs FROM ahead),
spread AS (SELECT page_id, address, site, scheme, generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS href FROM given),
whole AS (SELECT page_id, site, pos, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE lower(scheme) || '://' || site || href END AS url FROM spread),
targets AS (
  SELECT page_id, list(address ORDER BY pos) AS targets FROM (SELECT page_id, pos, site, {_NORMAL} AS address FROM whole) t
  WHERE regexp_extract(address, '^[^:]+://([^/?#]*)', 1) = site AND NOT regexp_matches(lower(address), '\\.({"|".join(fixed.SKIP_EXTENSIONS)})$') GROUP BY page_id),
known AS (SELECT address, arg_min(coalesce(targets, []), page_id) AS targets FROM n LEFT JOIN targets USING (page_id) GROUP BY 1),
walk AS (
  SELECT url AS base_url, [address] AS queue, [address] AS seen, CAST([] AS VARCHAR[]) AS done FROM n
  UNION ALL
  SELECT base_url, list_concat(queue[2:], fresh), list_concat(seen, fresh), CASE WHEN found THEN list_append(done, queue[1]) ELSE done END
  FROM (
    SELECT w.*, k.address IS NOT NULL AS found,
           list_filter(coalesce(k.targets, []), lambda x, i: NOT list_contains(w.seen, x) AND list_position(k.targets, x) = i) AS fresh
    FROM walk w LEFT JOIN known k ON k.address = w.queue[1] WHERE len(queue) > 0 AND len(done) < {CRAWL_LIMIT}) s),
last AS (SELECT base_url, arg_max(done, len(done)) AS done FROM walk GROUP BY 1)
SELECT base_url, unnest(done) AS url, CAST(generate_subscripts(done, 1) AS INTEGER) AS rank FROM last"""


# -- trees ----------------------------------------------------------------------------
# A region is a body of knowledge, its nations are spaces and their customers subspaces;
# suppliers are callouts of a nation and the parts they have shipped the contributions.


def _tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    supplier, part, lineitem = (table(spark, folder, t) for t in ("supplier", "part", "lineitem"))
    none = F.lit(None).cast("string")
    name_of = F.concat(F.lit("region-"), F.col("n_regionkey"))
    nations = nation.select("n_nationkey", name_of.alias("collection"))
    spaces = (
        region.select(
            F.concat(F.lit("region-"), F.col("r_regionkey")).alias("collection"), none.alias("parent_id"), F.lit(0).cast("long").alias("pos"),
            F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"),
            F.concat(F.lit("<p>All of <b>"), "r_name", F.lit("</b> &amp; more</p>")).alias("description"), none.alias("url"),
        )
        .unionByName(nation.select(
            name_of.alias("collection"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_nationkey").cast("long").alias("pos"),
            F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"),
            F.concat(F.lit("Nation<br/>"), "n_name").alias("description"), F.lit("").alias("url"),
        ))
        .unionByName(customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "collection", F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.col("c_custkey").alias("pos"),
            F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("<div>Segment: "), "c_mktsegment", F.lit("</div>")).alias("description"),
            F.concat(F.lit("https://tree.example/"), F.col("c_custkey")).alias("url"),
        ))
        .withColumn("top_type", none)
    )
    placed = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    callouts = placed.select(
        "collection", F.concat(F.lit("n"), F.col("s_nationkey")).alias("space_id"), F.col("s_suppkey").alias("pos"),
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("<p>Offers of "), "s_name", F.lit("</p><p>Ask   first</p>")).alias("description"), none.alias("url"),
    )
    shipped = lineitem.select("l_suppkey", "l_partkey").distinct()
    makers = broadcast_if_small(supplier.select("s_suppkey", "s_nationkey"))
    offered = (
        shipped.join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    kind = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "post").when(F.col("p_type").isin("PROMO", "MEDIUM"), "whiteboard").otherwise("link")
    uri = F.when((kind == "link") & (F.col("p_size") % 2 == 1), F.concat(F.lit("https://parts.example/"), F.col("p_partkey")))
    contributions = offered.select(
        "collection", F.concat(F.lit("s"), F.col("s_suppkey")).alias("callout_id"), F.col("p_partkey").alias("pos"), kind.alias("kind"),
        F.concat(F.lit("p"), F.col("s_suppkey"), F.lit("-"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("<i>"), "p_name", F.lit("</i> by "), "p_brand").alias("body"), uri.alias("uri"),
        F.concat(F.lit("https://tree.example/p/"), F.col("p_partkey")).alias("url"),
    )
    fetched = part.filter((F.col("p_size") % 2 == 1) & (F.col("p_size") > 25)).select(
        F.concat(F.lit("https://parts.example/"), F.col("p_partkey")).alias("uri"),
        F.concat(F.lit("Full text of "), "p_name", F.lit(" number "), F.col("p_partkey")).alias("fetched_text"),
    )
    return spaces, callouts, contributions, fetched


def tree_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Spaces and callouts read from one nested answer a region: nations inside, customers inside these, suppliers as callouts."""
    region, nation, customer, supplier = (table(spark, folder, t) for t in ("region", "nation", "customer", "supplier"))
    profile = lambda name, text: F.struct(F.col(name).alias("displayName"), text.alias("description")).alias("profile")
    inner = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("id"), profile("c_name", F.col("c_mktsegment")),
    ))).alias("subspaces"))
    called = supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("id"), F.struct(profile("s_name", F.lit("of a nation"))).alias("framing"),
    ))).alias("callouts"))
    nations = nation.join(inner, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(called, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    middle = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0")).alias("id"), profile("n_name", F.lit("a nation")),
        F.struct(F.struct("callouts").alias("calloutsSet")).alias("collaboration"), "subspaces",
    ))).alias("subspaces"))
    answers = region.join(middle, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.concat(F.lit("region-"), "r_regionkey").alias("collection"), F.lit("platform-space").alias("bok_type"),
        F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("r"), "r_regionkey").alias("id"), profile("r_name", F.lit("a region")), "subspaces").alias("space")).alias("lookup"))).alias("body"),
    )
    spaces, callouts, _ = read_answers(answers)
    placed = space_paths(spaces)
    above = placed.select("collection", F.col("id").alias("space_id"), F.col("depth").alias("_depth"))
    return placed.select("collection", "parent_id", "id", F.col("pos").cast("int").alias("pos"), "depth", "name", "description", F.lit("space").alias("kind")).unionByName(
        callouts.join(above, ["collection", "space_id"]).select(
            "collection", F.col("space_id").alias("parent_id"), "id", F.col("pos").cast("int").alias("pos"), F.col("_depth").alias("depth"), "name", "description", F.lit("callout").alias("kind")))


TREE_FROM_JSON_SQL = """
WITH n AS (SELECT 'region-' || n_regionkey AS collection, 'r' || n_regionkey AS parent_id, 'n' || lpad(n_nationkey::VARCHAR, 12, '0') AS id, * FROM nation)
SELECT 'region-' || r_regionkey AS collection, NULL AS parent_id, 'r' || r_regionkey AS id, 0 AS pos, 0 AS depth, r_name AS name, 'a region' AS description, 'space' AS kind FROM region
UNION ALL
SELECT collection, parent_id, id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY id) - 1 AS INTEGER), 1, n_name, 'a nation', 'space' FROM n
UNION ALL
SELECT collection, n.id, 'c' || lpad(c_custkey::VARCHAR, 12, '0'), CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER), 2, c_name, c_mktsegment, 'space'
FROM customer JOIN n ON c_nationkey = n_nationkey
UNION ALL
SELECT collection, n.id, 's' || lpad(s_suppkey::VARCHAR, 12, '0'), CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER), 1, s_name, 'of a nation', 'callout'
FROM supplier JOIN n ON s_nationkey = n_nationkey"""


def tree_flatten(spark: SparkSession, folder: str) -> DataFrame:
    documents = tree_documents(*_tree(spark, folder))
    return documents.select("collection", "document_id", "source", "type", "title", "uri", "content")


def tree_order(spark: SparkSession, folder: str) -> DataFrame:
    """Pre-order path of every kept document."""
    return tree_documents(*_tree(spark, folder)).select("collection", "document_id", "path")


_TREE_SQL = f"""
WITH sp AS (
  SELECT 'region-' || r_regionkey AS collection, lpad('0', 20, '0') AS path, 'r' || r_regionkey AS id, r_name AS name,
         '<p>All of <b>' || r_name || '</b> &amp; more</p>' AS description, NULL AS url, 'space' AS type FROM region
  UNION ALL
  SELECT 'region-' || n_regionkey, lpad('0', 20, '0') || '/s' || lpad(CAST(n_nationkey AS VARCHAR), 20, '0'), 'n' || n_nationkey, n_name,
         'Nation<br/>' || n_name, '', 'subspace' FROM nation
  UNION ALL
  SELECT 'region-' || n_regionkey, lpad('0', 20, '0') || '/s' || lpad(CAST(n_nationkey AS VARCHAR), 20, '0') || '/s' || lpad(CAST(c_custkey AS VARCHAR), 20, '0'),
         'c' || c_custkey, c_name, '<div>Segment: ' || c_mktsegment || '</div>', 'https://tree.example/' || c_custkey, 'subspace'
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ca AS (
  SELECT 'region-' || n_regionkey AS collection, s_suppkey, s_name,
         lpad('0', 20, '0') || '/s' || lpad(CAST(n_nationkey AS VARCHAR), 20, '0') || '/c' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') AS path,
         s_name || chr(10) || chr(10) || 'Offers of ' || s_name || chr(10) || chr(10) || 'Ask first' AS context
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
co AS (
  SELECT collection, ca.path || '/p' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') ||
           CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN '0' WHEN p_type IN ('PROMO', 'MEDIUM') THEN '1' ELSE '2' END AS path,
         'p' || s_suppkey || '-' || p_partkey AS id, p_name, p_partkey, p_size, context, '<i>' || p_name || '</i> by ' || p_brand AS body,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'post' WHEN p_type IN ('PROMO', 'MEDIUM') THEN 'whiteboard' ELSE 'link' END AS kind
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN ca ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
raw AS (
  SELECT collection, path, id, 'space:' || id AS source, type, name AS title, url, name || chr(10) || chr(10) || description AS content FROM sp
  UNION ALL
  SELECT collection, path, 's' || s_suppkey, 'callout:s' || s_suppkey, 'callout', s_name, NULL,
         s_name || chr(10) || chr(10) || '<p>Offers of ' || s_name || '</p><p>Ask   first</p>' FROM ca
  UNION ALL
  SELECT collection, path, id, kind || ':' || id, kind, p_name,
         CASE WHEN kind = 'link' AND p_size % 2 = 1 THEN 'https://parts.example/' || p_partkey ELSE 'https://tree.example/p/' || p_partkey END,
         CASE WHEN kind = 'link' AND p_size % 2 = 1 AND p_size > 25
              THEN '# ' || p_name || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Full text of ' || p_name || ' number ' || p_partkey
              ELSE context || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || body ||
                   CASE WHEN kind = 'link' AND p_size % 2 = 1 THEN chr(10) || chr(10) || 'URL: https://parts.example/' || p_partkey ELSE '' END END
  FROM co),
cleaned AS (SELECT * EXCLUDE (content), {strip_html_sql('content')} AS content FROM raw),
keyed AS (SELECT *, row_number() OVER (PARTITION BY collection, lower({single_spaced_sql('content')}) ORDER BY path) AS f FROM cleaned WHERE content <> '')"""
TREE_FLATTEN_SQL = f"""{_TREE_SQL}
SELECT collection, id AS document_id, source, type, title, nullif(url, '') AS uri, content FROM keyed WHERE f = 1"""
TREE_ORDER_SQL = f"{_TREE_SQL} SELECT collection, id AS document_id, path FROM keyed WHERE f = 1"


def tree_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, _, contributions, fetched = _tree(spark, folder)
    return link_counts(contributions, fetched)


TREE_LINK_COUNTS_SQL = f"""{_TREE_SQL}
SELECT collection, count(*) FILTER (WHERE p_size > 25) AS fetched, count(*) FILTER (WHERE p_size <= 25) AS skipped
FROM co WHERE kind = 'link' AND p_size % 2 = 1 GROUP BY collection"""

QUERIES = {
    "html_title": (html_title, HTML_TITLE_SQL),
    "html_blocks": (html_blocks, HTML_BLOCKS_SQL),
    "html_extract": (html_extract, HTML_EXTRACT_SQL),
    "website_documents": (website_documents, WEBSITE_DOCUMENTS_SQL),
    "link_kind": (link_kind, LINK_KIND_SQL),
    "link_text": (link_text, None),
    "url_normalize": (url_normalize, URL_NORMALIZE_SQL),
    "url_filters": (url_filters, URL_FILTERS_SQL),
    "uri_rewrite": (uri_rewrite, URI_REWRITE_SQL),
    "page_links": (page_links, PAGE_LINKS_SQL),
    "crawl_frontier": (crawl_frontier, CRAWL_FRONTIER_SQL),
    "crawl_hops": (crawl_hops, CRAWL_HOPS_SQL),
    "crawl_sites": (crawl_sites, CRAWL_SITES_SQL),
    "tree_from_json": (tree_from_json, TREE_FROM_JSON_SQL),
    "tree_flatten": (tree_flatten, TREE_FLATTEN_SQL),
    "tree_order": (tree_order, TREE_ORDER_SQL),
    "tree_link_counts": (tree_link_counts, TREE_LINK_COUNTS_SQL),
}
