"""Blocks by pre and post numbers against the stack of the page reader; boilerplate on repeated rows."""

from __future__ import annotations

from collections import Counter

from lorebase import fixed
from lorebase.functions.html import page_outline, page_text
from lorebase.operators.boilerplate import without_boilerplate
from lorebase.operators.markup import page_blocks

PAGES = [
    "<html><body><p>Hello there, world</p><section><h2>Title of it all</h2><p>Nested text of a paragraph</p></section></body></html>",
    "<p>open <b>bold <p>inner one is nested</p> and the rest of it</div></p><li>item of a long list",
    '<div class="Cookie-bar"><p>accept all the cookies</p></div><p id="x">A paragraph to keep</p><p>And &amp; a second one</p><p>third of the lot</p>',
    "<script>var a = '<p>no</p>';</script><style>p{}</style><p>first paragraph<br>goes on<img src=x/></p><!-- <p>not this one</p> --><article>short</article>",
    "plain text only", "", None, "<nav><p>menu menu menu</p></nav></p></section>tail of the page",
    "<section>" * 60 + "deep inside of it all" + "</section>" * 40,
]


def test_numbers_nest(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")
    blocks = page_blocks(pages).collect()
    by_page = {i: sorted((b for b in blocks if b.page_id == i), key=lambda b: b.pre) for i in range(len(PAGES))}
    for page, html in enumerate(PAGES):
        own = by_page[page]
        assert sorted(b.post for b in own) == [b.pre for b in own] == list(range(1, len(own) + 1))
        for a in own:  # intervals nest or are apart
            for b in own:
                assert not (a.pre < b.pre and a.post < b.post) or all(not (a.pre <= p["starts"] and a.post > p["ends"] and b.pre <= p["starts"] and b.post > p["ends"]) for p in page_outline(html)["pieces"])
        parts = [b.text for b in own if b.tag in fixed.SEMANTIC_TAGS and not b.removed and len(b.text) > fixed.MIN_FRAGMENT_CHARS]
        if len(parts) >= fixed.MIN_SEMANTIC_PARTS:
            assert "\n\n".join(parts) == page_text(html)
    assert by_page[8][-1].depth == 60 and by_page[8][0].text == "deep inside of it all"
    assert [b.removed for b in by_page[2]] == [True, True, False, False, False]


def test_both_forms_keep_repeated_rows(spark):
    shared = "This paragraph is found on every page of it."
    rows = [("s", i if i != 7 else 6, f"Own text of row number {i}.\n\n{shared}\n\nEnd of {i // 2}") for i in range(8)] + [("s", 1, f"{shared}\n\nTwice\n\nTwice")] * 2 + [("t", 1, "x")]
    pages = spark.createDataFrame(rows, "site string, page_id int, content string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    near = Counter(map(tuple, without_boilerplate(pages).collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        far = Counter(map(tuple, without_boilerplate(pages).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert near == far and sum(near.values()) == 11 and near["s", 1, "Twice\n\nTwice"] == 2
