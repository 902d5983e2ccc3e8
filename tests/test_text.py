from __future__ import annotations

import hashlib
import html as stdlib_html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import SLICE_ROWS, arrow_function
from lorebase.functions.html import outline
from lorebase.functions import hashing, html, urls
from lorebase.functions import text as tx
from lorebase.functions.splitting import recursive_chunks, split_text, window_chunks


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw", [
    "  a  ", " x　", "", " \t\n", "plain", "\x1ca\x1f", "a  b\n\n c", "\x85é ",
])
def test_strip_is_unicode_aware(spark, raw):
    assert one(spark, tx.strip(F.col("s")), s=raw) == raw.strip()
    assert one(spark, tx.is_blank(F.col("s")), s=raw) == (not raw.strip())
    assert one(spark, tx.single_spaced(F.col("s")), s=raw) == " ".join(raw.split())


def test_blank_counts_null(spark):
    assert one(spark, tx.is_blank(F.col("s")), s=None) is True


@pytest.mark.parametrize("raw,want", [
    ("<p>One</p><p>Two &amp; more</p>", "One\n\nTwo & more"),
    ("a<script>x<b></script>b<STYLE>p{}</style>c", "abc"),
    ("<div>x</div>\n\n\n\n<div>y</div>", "x\n\ny"),
    ("5 &lt; 6&nbsp;<span>ok</span>", "5 < 6 ok"),
    ("", ""),
])
def test_strip_html(spark, raw, want):
    assert one(spark, tx.strip_html(F.col("s")), s=raw) == want


def test_chunk_hash_separates_fields(spark):
    def address(*fields):
        return one(spark, hashing.chunk_hash(*[F.col(c) for c in "abcde"]), **dict(zip("abcde", fields)))

    base = address("text", "ab", "cd", "knowledge", "d1")
    assert base == hashlib.sha256("\0".join(["text", "ab", "cd", "knowledge", "d1"]).encode()).hexdigest()
    assert base != address("text", "abc", "d", "knowledge", "d1")
    for i in range(5):
        changed = ["text", "ab", "cd", "knowledge", "d1"]
        changed[i] += "!"
        assert address(*changed) != base
    assert address("t", None, "s", "k", "d") == address("t", "", "s", "k", "d")


def test_content_key_ignores_case_and_space(spark):
    key = lambda s: one(spark, hashing.content_key(F.col("s")), s=s)
    assert key("Hello   World\n") == key("hello world") != key("hello worlds")


def test_render_keeps_braces_of_values(spark):
    text = tx.render("Q: {q}\nK: {k} {{x}}", q=F.col("q"), k=F.col("k"))
    assert one(spark, text, q="{k}", k=None) == "Q: {k}\nK:  {x}"


def test_labels_and_masks(spark):
    assert one(spark, tx.safe_label(F.col("s")), s="--a b/c!!") == "a-b-c"
    assert one(spark, tx.mask_secret(F.lit("my_api_key"), F.col("s")), s="abcdef") == "abc****"
    assert one(spark, tx.mask_secret(F.lit("my_api_key"), F.col("s")), s="abc") == "****"
    assert one(spark, tx.mask_secret(F.lit("model"), F.col("s")), s="abcdef") == "abcdef"
    assert one(spark, tx.mask_secret(F.lit("my_api_key"), F.col("s")), s=None) == "None"
    assert one(spark, tx.strip_citations(F.col("s")), s=" Yes【4:0†source】. ") == "Yes."


# -- pages ------------------------------------------------------------------------------


def test_semantic_text_removes_structure_and_banners():
    page = (
        "<html><body><nav>Navigation links here</nav><div class='x cookie-banner'>Accept cookies</div>"
        "<div id='gdpr-modal'>Accept policy</div><aside>Sidebar content here.</aside><form>Submit this form</form>"
        "<h1>Article Title Here Now</h1><section><p>First paragraph of it.</p></section>"
        "<p>Second one <b>with bold</b> text.</p><p>short</p><footer>Footer content</footer></body></html>"
    )
    assert html.page_text(page) == (
        "Article Title Here Now\n\nFirst paragraph of it.\n\nFirst paragraph of it.\n\nSecond onewith boldtext."
    )


def test_fallback_to_full_text():
    page = "<body><div class='newsletter'>Subscribe</div><div>Content <i>without</i></div><p>A paragraph of text.</p></body>"
    assert html.page_text(page) == "Content\nwithout\nA paragraph of text."


def test_unclosed_and_void_tags():
    assert html.page_text("<p>alpha beta gamma<br>x<img src=a>y<p>delta epsilon zeta") == "alpha beta gamma\nx\ny\ndelta epsilon zeta"
    page = "<p>alpha beta gamma<p>delta epsilon zeta<p>eta theta iota kappa"
    assert html.page_text(page).split("\n\n") == [
        "alpha beta gammadelta epsilon zetaeta theta iota kappa", "delta epsilon zetaeta theta iota kappa", "eta theta iota kappa",
    ]


def test_titles():
    assert html.page_title("<title> My &amp; Page </title><h1>H</h1>") == "My & Page"
    assert html.page_title("<body><h1>Head<b>ing</b></h1></body>") == "Heading"
    assert html.page_title("<p>x</p>") == ""


# -- splitting ----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.é", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_split_bounds_and_coverage(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    squeezed = "".join(text.split())
    joined = "".join("".join(c.split()) for c in chunks)
    assert len(joined) >= len(squeezed)
    if overlap == 0:
        assert joined == squeezed


def test_split_prefers_paragraphs():
    text = "first paragraph here\n\nsecond paragraph here\n\nthird"
    assert split_text(text, 25, 0) == ["first paragraph here", "second paragraph here", "third"]
    assert split_text("one two three four", 9, 4) == ["one two", "three", "four"]
    assert split_text("one two three four", 10, 4) == ["one two", "two three", "four"]


def test_chunks_keep_metadata_and_indices(spark, rows):
    docs = spark.createDataFrame([("d1", "word " * 100), ("d2", ""), ("d3", None)], "document_id string, content string")
    chunks = recursive_chunks(docs, 100, 20)
    found = rows(chunks, "document_id", "chunk_index", "embedding_type")
    assert found == [("d1", i, "chunk") for i in range(len(found))] and len(found) > 3
    small = recursive_chunks(docs, 50, 10)
    assert small.count() > chunks.count()
    with pytest.raises(ValueError):
        recursive_chunks(docs, 10, 10)


@pytest.mark.parametrize("length,want", [(0, 0), (1, 1), (10, 1), (11, 2), (18, 2), (19, 3)])
def test_windows(spark, length, want):
    docs = spark.createDataFrame([("d", "x" * length)], "document_id string, content string")
    assert window_chunks(docs, 10, 2).count() == want


# -- addresses --------------------------------------------------------------------------------


@pytest.mark.parametrize("url,want", [
    ("https://A.com/x/#top", "https://A.com/x"), ("https://a.com", "https://a.com/"), ("HTTP://a.com//", "http://a.com/"),
    ("https://a.com/p/?q=1#f", "https://a.com/p?q=1"), ("https://a.com/p?", "https://a.com/p"), ("https://a.com:80/x", "https://a.com:80/x"),
])
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,want", [
    ("https://a.com/f.PDF", True), ("https://a.com/f.pdf?x=1", True), ("https://a.com/f?x=.pdf", False),
    ("https://a.com/a.tar.gz", True), ("https://a.com/page.html", False), ("https://a.com/x.rs", True), ("https://a.com/pdf", False),
])
def test_skipped_files(spark, url, want):
    assert one(spark, urls.skipped_file(F.col("u")), u=url) is want


@pytest.mark.parametrize("url,want", [
    ("http://example.com/", True), ("ftp://example.com/", False), ("http://127.0.0.1/", False), ("http://10.1.2.3/x", False),
    ("http://169.254.169.254/", False), ("http://[::1]/", False), ("http://8.8.8.8/", True), ("http:///x", False), (None, False),
])
def test_safety(spark, url, want):
    assert one(spark, urls.is_safe("u"), u=url) is want


@pytest.mark.parametrize("url,want", [
    ("https://platform.io/api/private/rest/storage/document/1?x=2", "http://localhost:3000/api/private/rest/storage/document/1?x=2"),
    ("/rest/storage/1", "http://localhost:3000/rest/storage/1"),
    ("https://other.org/api/x", "https://other.org/api/x"), ("https://platform.io/about", "https://platform.io/about"), ("", ""),
])
def test_rewrite(spark, url, want):
    assert one(spark, urls.rewrite_internal(F.col("u"), F.lit("http://localhost:3000/graphql"), "platform.io"), u=url) == want


def test_collection_names(spark):
    assert one(spark, urls.website_collection(F.col("u")), u="https://a.com:8080/x") == "a.com-8080-knowledge"
    assert one(spark, urls.question_collection(F.col("u")), u="") == "default-knowledge"
    assert one(spark, urls.question_collection(F.col("u")), u="b1") == "b1-knowledge"


def test_entities_match_the_standard_library(spark):
    raw = "&amp;lt; &copy &#233; &#x1F600; &notit; &unknown; &middot;"
    assert one(spark, tx.unescape("s"), s=raw) == stdlib_html.unescape(raw)


def test_python_functions_hold_a_slice_of_a_batch(spark):
    """A full batch is not turned into Python objects at once, and large rows make shorter slices."""
    @arrow_function(T.IntegerType())
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(texts) for t in texts], dtype="object")

    small = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
    found = small.select("id", together("t").alias("n")).collect()
    assert all((r.n is None) == (r.id % 7 == 0) for r in found) and max(r.n or 0 for r in found) == SLICE_ROWS
    large = spark.range(100, numPartitions=1).select(together(F.repeat(F.lit("x"), 200_000)).alias("n"))
    assert max(r.n for r in large.collect()) <= 5
    both = spark.range(600, numPartitions=1).select("id", outline(F.concat(F.lit("<p>"), "id", F.lit("</p>"))).alias("o")).collect()
    assert [r.o["pieces"][0]["text"] for r in both] == [str(r.id) for r in both]
    assert small.filter("id < 0").select(together("t")).collect() == []
