import hashlib
import io
import re
import struct
import uuid

import duckdb
import pytest
import zstandard

from tests.llm.conftest import SF
from yearlink.llm import html_extract as H
from yearlink.llm import warc as W
from yearlink.llm.common import read
from yearlink.session import ensure_checkpoint_dir

PAGES = "page_id long, url string, html string, `key` string, digest string"


def frames(data):
    """The dictionary and every frame after it, one at a time."""
    magic, size = struct.unpack_from("<II", data)
    assert magic == W.MAGIC
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    rest = data[8 + size :]
    while rest:
        z = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        yield z.decompress(rest)
        rest = z.unused_data


@pytest.mark.parametrize("n", [1, 3, 400])
def test_a_file_is_a_dictionary_and_one_frame_a_record(n):
    records = [W.record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 30, 1, "00", None, "2024-01-01T00:00:00Z") for i in range(n)]
    files = list(W.archives(iter(records)))
    assert sum(k for _, k in files) == n
    assert [f for data, _ in files for f in frames(data)] == records
    assert [b.count(b"page") for data, _ in files for _, b in W.parse(data)] == [30] * n


def test_files_are_split_and_damage_is_seen(monkeypatch):
    monkeypatch.setattr(W, "FILE", 2000)
    monkeypatch.setattr(W, "SAMPLE", 3000)
    import random

    rng = random.Random(1)
    records = [W.record(i, None, rng.randbytes(500), 500, "00", None, "2024-01-01T00:00:00Z") for i in range(50)]
    files = [d for d, _ in W.archives(iter(records))]
    assert len(files) > 3
    assert [f for d in files for f in frames(d)] == records
    broken = bytearray(files[0])
    broken[-40] ^= 255
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(W.parse(bytes(broken)))
    with pytest.raises(ValueError, match="dictionary"):
        list(W.parse(b"x" * 20))


def test_round_trip_with_odd_pages(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [
        (1, "http://a", big), (7, "http://b", big), (7, "http://b", big), (None, "http://c", big),
        (2, None, "short"), (3, "u", "short"), (4, "u\r\nX: y", None), (5, "u", ""),
        (None, "d", other), (None, "e", other), (-8, "f", "z" * 5_000_000), (9, "g", "a\r\n\r\nWARC/1.1\r\nb"),
    ]
    pages = spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES).repartition(3)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [
        (i, size(t), sha(t), *(("revisit", 7) if t == big and i != 7 else ("response", None))) for i, _, t in rows
    ]
    got = [tuple(r) for r in W.round_trip(pages).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = W.write_archives(pages, folder)
    urls = {r.url for r in W.read_archives(spark, files).collect()}
    assert "u%0D%0AX:%20y" in urls and None in urls
    assert W.round_trip(pages.limit(0)).count() == 0


def test_round_trip_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = sorted((tuple(r) for r in W.round_trip(read(spark, SF, "pages")).collect()), key=repr)
    assert got == sorted((tuple(r) for r in con.sql(W.SQL).fetchall()), key=repr)


def test_pages_give_their_documents(spark):
    """The pages wrap documents: title line, then the lines of the text."""
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in read(spark, folder, "documents").collect()}
    import re

    rows = H.main_texts(read(spark, folder, "pages")).collect()
    assert len(rows) == read(spark, folder, "pages").count()
    for r in rows:
        doc = docs.get(int(re.search(r"/(?:en|fr|de|es)/(\d+)", r.url)[1]))
        if doc is not None:
            lines = [" ".join(x.split()) for x in doc.split("\n") if x.split()]
            assert r.text.split("\n")[1:] == lines
        assert r.n_chars == len(r.text)


ARTICLE = "<p>" + "First long paragraph of the story. " * 4 + "</p><p>Short.</p><p>" + "Second &amp; last, caf&eacute; &#8364;&nbsp;5. " * 3 + "</p>"
TEXT = [("First long paragraph of the story. " * 4).strip(), "Short.", ("Second & last, café € 5. " * 3).strip()]
NOISE = (
    "<div class='cookie-notice'>We use cookies to make this site work for you and all others, please agree to them now.</div>"
    "<ul class=menu><li><a href=/a>Home</a><li><a href=/b>News of the day</a></ul>"
)
AFTER = (
    "<section id='comments'><p>I do not agree with this article at all, said a reader in a very long comment here.</p></section>"
    "<aside>Read also these stories of interest to you and your friends and family</aside>"
    "<form><label>Subscribe to our weekly letter of news and more</label><input></form><footer>&copy; 2024 The Paper</footer>"
)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{NOISE}<article>{ARTICLE}</article>{AFTER}</body></html>",
        f"<body>{NOISE}<div><div>{ARTICLE}</div></div>{AFTER}",
        f"<BODY><header><h1>The Paper</h1></header><script>var a='<p>no</p>';</script><style>p{{}}</style>{ARTICLE}{AFTER}",
        f"{ARTICLE}<div class=ad>Buy this wonderful thing today for only ten coins, free delivery to all places</div>{AFTER}",
        ARTICLE.replace("<p>", "<p><b>").replace("</p>", "<br></p>") + "<!-- <p>hidden comment text</p> -->",
        ARTICLE.replace("</p>", ""),
    ],
)
def test_layouts(page):
    assert H.main_text(page).split("\n") == TEXT


def test_odd_pages(spark):
    assert [H.main_text(p) for p in (None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<", "plain  text\n here")] == [
        "", "", "", "", "", "", "<", "plain text here",
    ]
    assert H.main_text("<p>a linked <a href=x>word</a> in a line of text that goes on for a while</p>").startswith("a linked word in")
    assert H.main_text("<article><p><a href=x>all of this paragraph is one link</a></p></article>") == "all of this paragraph is one link"
    assert H.main_text("<div>" * 30_000 + "deep text" + "</div>" * 30_000) == "deep text"
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", long), (None, None, None), (1, "u", long), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES)
    got = H.main_texts(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 999_999), (1, 999_999), (2, 0)]
    assert H.main_texts(pages.limit(0)).count() == 0


def test_surge_and_dive_without_named_regions():
    menu = "".join(f"<div><a href=/{i}>entry number {i}</a></div>" for i in range(12))
    page = f"{menu}{ARTICLE}{menu}"
    assert H.main_text(page).split("\n") == TEXT
    assert H.main_text("<p>tiny</p>") == "tiny"
    assert io.StringIO(H.main_text(page)).readline().startswith("First")


def test_short_text_beside_excluded_lines_is_kept():
    """Lines of excluded regions used to end a span with weight 0."""
    long, three = "A long paragraph of the story. " * 5, "<li>one</li><li>two</li><li>three</li>"
    want = ["Short title", long.strip(), "The end."]
    for tag in ("article", "div"):
        page = f"<{tag}><h1>Short title</h1><ul class='share'>{three}</ul><p>{long}</p><ul class=ad>{three}</ul><p>The end.</p></{tag}>"
        assert H.main_text(page).split("\n") == want
    linked = f"<p>{long}</p><p><a href=x>All of this is a link</a></p><p>{long}</p>"
    assert H.main_text(linked).split("\n") == [long.strip(), "All of this is a link", long.strip()]


@pytest.mark.parametrize(
    "wrapper",
    ["div class='container has-sidebar'", "div class=no-sidebar", "div class=right-sidebar", "div class=menu-open", "div id=search-page",
     "form", "div data-hidden", "div class=sidebar"],
)
def test_wrappers_of_the_page_are_no_regions(wrapper):
    tag = wrapper.split()[0]
    for inner in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div>{ARTICLE}</div>"):
        page = f"<body><{wrapper}>{NOISE}{inner}{AFTER if tag != 'form' else ''}</{tag}></body>"
        assert H.main_text(page).split("\n") == TEXT


@pytest.mark.parametrize("name", ["ad", "site-footer", "comment-list", "related-posts", "share-buttons", "main-menu nav", "x sidebar", "cookie_banner"])
def test_regions_are_known_by_whole_names(name):
    other = f"<div class='{name}'><article><p>{'Some other text of the page. ' * 3}</p></article></div>"
    assert H.main_text(f"<div>{ARTICLE}</div>{other}").split("\n") == TEXT
    assert H.main_text(f"<article>{ARTICLE}</article>{other}").split("\n") == TEXT
    assert H.main_text(f"<article>{ARTICLE}<div hidden>not shown</div></article>").split("\n") == TEXT


LONG = "This is a long paragraph of real article text that goes on and on. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p class=ad>Buy now<p>{LONG}<p>{LONG}</article>", [LONG, LONG]),
        (f"<div><p class=ad>Buy now<p>{LONG}<p>{LONG}</div>", [LONG, LONG]),
        (f"<article><ul><li class=ad>Buy<li>Real item<li>Two</ul><p>{LONG}</article>", ["Real item", "Two", LONG]),
        (f"<article><dl><dt>T<dd class=promo>x<dt>U<dd>{LONG}</dl></article>", ["T", "U", LONG]),
        (f"<article><table><tr><td class=ads>a<td>b<tr><td>c</table><p>{LONG}</article>", ["b", "c", LONG]),
        (f"<article><h2 id=recommendations>Head</h2><p class=navy>{LONG}</p><p class='text promoted'>x</p></article>", ["Head", LONG, "x"]),
        (f"<article><h2 id=comments>On comments</h2><p>{LONG}</p><div class=comments>First!</div></article>", ["On comments", LONG]),
        ("<div>" * 12_000 + f"<nav>menu</nav><p>{LONG}</p>" + "</div>" * 12_000 + f"<p>{LONG}", [LONG, LONG]),
    ],
)
def test_implied_end_tags_and_names_of_text(page, text):
    assert H.main_text(page) == "\n".join(t.strip() for t in text)


def test_the_distribution_alone_gives_the_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert H.main_text(r.html) == H.main_text(re.sub("(</?)article", r"\1div", r.html))
