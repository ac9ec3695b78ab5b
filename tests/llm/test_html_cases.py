"""What the article keeps and what goes, and time in proportion to depth."""

import time

import pytest

from plenum.llm import html

LONG = "A sentence of the story, with commas, that goes on for a good while, and then, at last, comes to its end after more than eighty characters. "


def test_short_parts_around_a_long_inner_block_stay():
    page = f'<body><div>Home</div><article><p>{LONG}</p><p>Yes.</p><ul><li>one</li><li>two</li></ul><div class="content">{f"<p>{LONG}</p>" * 7}</div><p>End.</p></article></body>'
    assert html.extract(page).split("\n") == [LONG.strip(), "Yes.", "one", "two", *[LONG.strip()] * 7, "End."]


def test_siblings_of_one_long_block_stay():
    parts = ["First part.", "Second part.", LONG * 4, "Fourth part.", "Fifth part."]
    short = "x" * 40 + ", and so on, to be of some length."
    page = "<body><ul class='menu'><li><a href=a>Home</a></ul><div id=wrap>" + "".join(f"<div><p>{p} {short}</p></div>" for p in parts) + "</div></body>"
    assert html.extract(page).count("\n") == 4


def test_heading_between_two_content_blocks_stays():
    page = f'<body><div class="nav"><a href=x>Home</a></div><div class="content"><p>{LONG * 3}</p></div><h2>Then</h2><div class="content"><p>{LONG}</p></div></body>'
    assert html.extract(page).split("\n") == [(LONG * 3).strip(), "Then", LONG.strip()]


@pytest.mark.parametrize("cls", ["responses", "comment-body", "comments-area", "comment", "disqus_thread"])
def test_reader_comments_inside_the_article_go(cls):
    page = f'<article><h1>Title</h1><p>{LONG}</p><div class="{cls}"><p>I disagree, strongly, {LONG * 3}</p></div></article>'
    assert html.extract(page).split("\n") == ["Title", LONG.strip()]
    each = f'<body><main><article><p>{LONG}</p></article></main><section id="comments">{f"<article class=comment><p>I, too, {LONG}</p></article>" * 5}</section></body>'
    assert html.extract(each) == LONG.strip()


def test_time_follows_length_not_depth():
    for open_, close in (("<div>", "</div>"), ("<b>", "</b>"), ("<article>", "</article>"), ("<div>x", "</i>")):
        began = time.process_time()
        assert LONG.strip() in html.extract(open_ * 20000 + f"<p>{LONG}</p>" + close * 20000)
        assert time.process_time() - began < 2


def test_page_whose_text_is_all_in_what_looks_like_furniture():
    ad = '<div class="ad">Buy, now, and save.</div>'
    assert html.extract(f"<html><body>{ad}<article><h1></h1><p><b><br></article><footer>f</footer></body></html>") == ""
    assert html.extract(f"<body>{ad}<div><h1>Title</h1></div></body>") != ""
    assert html.extract(f'<body><div class="sidebar"><p>{LONG * 3}</p></div><div>short</div></body>') == (LONG * 3).strip()


def test_numbers_of_characters_of_any_length():
    assert html.extract("<p>&#" + "9" * 5000 + ";a&#" + "0" * 5000 + "65;&#65;&#0;&#1114112;&#x41;&#;</p>") == "�aAA��A&#;"


def test_memory_of_a_long_tag():
    import subprocess
    import sys

    code = "import resource; from plenum.llm import html; assert html.extract('<p>b</p><a ' + 'x=y ' * 1_500_000 + '>a</a>').endswith('a'); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    took = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(took.stdout) < 600_000


def test_bytes_that_are_no_text(spark):
    pages = spark.sql("select 1 as page_id, 'u' as url, cast(unhex('3C703E41FF42') as string) as html")
    assert [(r.text, r.n_chars) for r in html.extract_pages(pages).collect()] == [("A�B", 3)]
