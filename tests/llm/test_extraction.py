"""Main text of hand-written pages, which share neither words nor layouts with the generated training pages, and the
time that odd markup takes."""

import re
import time

import pytest

from packetloom.llm import extraction

STORY = "The river rose overnight and flooded the lower town before the sirens sounded."
SECOND = "By noon the water had reached the steps of the old library, where volunteers carried books upstairs."
PAGES = {
    "links inside the article": (
        f"<html><body><nav><a href='/'>Home</a> <a href='/w'>World</a></nav><article><h1>Flood</h1><p>{STORY}</p><p><a href='/list'>See the whole list here</a></p><p>{SECOND}</p></article><footer>Contact us</footer></body></html>",
        ["Flood", STORY, "See the whole list here", SECOND],
    ),
    "link inside a sentence": (f"<main><p>{STORY} Read <a href='x'>our earlier report</a> on the dam.</p><p>{SECOND}</p></main>", [f"{STORY} Read our earlier report on the dam.", SECOND]),
    "copyright in a plain div": (f"<body><article><h2>Flood</h2><p>{STORY}</p><p>{SECOND}</p></article><div>&copy; 2024 River Gazette. All rights reserved.</div></body>", ["Flood", STORY, SECOND]),
    "remarks of readers in an unknown class": (
        f"<body><article><p>{STORY}</p><p>{SECOND}</p></article><div class='zqx-thread'><div><b>anna</b><p>So sad to see this happen again.</p></div><div><b>joe</b><p>Thanks for the report!</p></div></div></body>",
        [STORY, SECOND],
    ),
    "table layout": (
        f"<table class='layout'><tr><td class='leftnav'><a href='a'>One</a><br><a href='b'>Two</a></td><td class='post-content'><h1>Flood</h1><p>{STORY}</p><p>{SECOND}</p></td></tr></table>",
        ["Flood", STORY, SECOND],
    ),
    "cookie dialog, share bar and sidebar": (
        f"<body><div id='cookieConsent' role='dialog'><p>We use cookies to improve your visit. Accept all?</p><button>Accept</button></div><header><p>River Gazette</p></header><main id='mainContent'><h1>Flood</h1><div class='share-buttons'><a>Tweet</a><a>Mail</a></div><p>{STORY}</p><blockquote>We lost everything, she said.</blockquote><p>{SECOND}</p></main><aside><h3>Most read</h3><ul><li><a>Storm</a></li></ul></aside></body>",
        ["Flood", STORY, "We lost everything, she said.", SECOND],
    ),
    "entities, white space and markup in a block": ("<article><p>Tom &amp; Jerry&#39;s   <em>big</em>\n\tday &mdash; at 5&nbsp;pm</p><p>Second paragraph of the page, long enough to read.</p></article>", ["Tom & Jerry's big day — at 5 pm", "Second paragraph of the page, long enough to read."]),
    "lists and headings": (f"<body><nav>Menu</nav><article><h1>Guide</h1><p>{STORY}</p><h2>Steps</h2><ol><li>Boil the water.</li><li>Add salt and wait.</li></ol><p>{SECOND}</p></article></body>", ["Guide", STORY, "Steps", "Boil the water.", "Add salt and wait.", SECOND]),
    "forms and adverts between paragraphs": (
        f"<article><p>{STORY}</p><div class='ad-slot'>Buy two, pay one!</div><form class='newsletter'><label>Your mail</label><input><button>Join</button></form><p>{SECOND}</p><script>var p = '<p>no</p>';</script></article>",
        [STORY, SECOND],
    ),
    "no markup that tells": (f"<p>{STORY}</p><p>{SECOND}</p><p>And that was the third paragraph of this story.</p>", [STORY, SECOND, "And that was the third paragraph of this story."]),
    "an article that begins with an empty block": (f"<article><p></p><p> </p><p>{STORY}</p>\n<p>{SECOND}</p></article>", [STORY, SECOND]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(name):
    page, blocks = PAGES[name]
    assert extraction.main_text(page, extraction.default_field()).split("\n") == blocks


HOSTILE = {
    "quotes that never close": lambda n: '<a b="' * n,
    "quotes that close once": lambda n: '<a b="' * n + "'>",
    "nested elements": lambda n: "<div>" * n + "text",
    "nested elements with text": lambda n: "<div><p>t " * n,
    "nested classes": lambda n: "".join(f'<div class="c{i}"><p>t</p>' for i in range(n)),
    "unclosed inline tags": lambda n: "<b>" * n + "<p>x" * n,
    "stray closing tags": lambda n: "<div>" * n + "</b>" * n,
    "scripts that do not end": lambda n: "<script></scripts" * n + "</script" * n,
    "open comments": lambda n: "<!-- " * n,
    "lone brackets": lambda n: "<" * n + "x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    field = extraction.default_field()
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        extraction.main_text(HOSTILE[name](n), field)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3


def test_tags():
    found = [(name, closing, raw.strip()) for _, _, name, closing, raw in extraction.tags("<A HREF='x>y' b=\"1\">t</a ><!-- <p> --><br/><1><p")]
    assert found == [("a", False, "HREF='x>y' b=\"1\""), ("a", True, ""), ("", False, ""), ("br", False, "/")]


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>One page with a sentence.</p></article>")] * 2, "page_id long, url string, html string").selectExpr("*", "5 AS n_chars", "'x' AS text")
    rows = extraction.extract(df).collect()
    assert rows[0] == rows[1] and rows[0].text == "One page with a sentence." and rows[0].n_chars == 25
    assert extraction.extract(df.limit(0)).count() == 0


def test_against_a_plain_walk_of_all_paths():
    """Features kept on the stack equal those gathered from the whole path."""
    for blocks, _, _ in extraction.training_pages(40, seed=5):
        for b in blocks:
            seen = extraction.place_features(b.place)
            assert len(seen) == len(set(seen))
            words = {f for f in seen if re.match("(tag|word|kind)=", f)}
            up, again = b.place, set()
            while up is not None:
                again |= {f for f in up.fresh if re.match("(tag|word|kind)=", f)}
                up = up.above
            assert words == again


SCRIPTS = ['<script>var t="<!--";</script>', "<style><!-- p{} </style>", "<script>if(a<b){x='<p'}</script>", '<script>it"s</script>', '<textarea><!-- "</textarea>', '<title>"</title>', '<SCRIPT>"</scr"+"ipt></SCRIPTER>"</SCRIPT>', "<template><article></template>"]


@pytest.mark.parametrize("hidden", SCRIPTS)
def test_nothing_inside_scripts_is_a_tag(hidden):
    page = f'<html><head>{hidden}</head><body><p>One "two" three.</p>{hidden}<article><h1>Head</h1><p>Some <b>words</b>.</p></article></body></html>'
    assert [b.text for b in extraction.leaf_blocks(page)] == ['One "two" three.', "Head", "Some words."]
    assert [b.text for b in extraction.leaf_blocks(f"<p>One.</p>{hidden.split('</')[0]}<p>Two.</p>")] == ["One."]
