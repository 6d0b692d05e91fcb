import html as entities
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import prose
from trackline.llm.extract import extract
from trackline.llm.pages import parse
from trackline.llm.wrappers import Member, article, main_path, merged, template

PAGES = "page_id long, url string, html string"


def alone(html):
    return article(parse(html), None)


def site(i, body, extra=""):
    return f"""<html><head><title>T {i}</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
<div id="nav-{i}" class="menu"><ul><li>Home<li>News {i}</ul></div><div class="layout"><div class="story">{body}
<div class="box">Read our other pages, {"x"}!</div></div><div class="sidebar"><p>{prose(i, 90)}</p></div></div>
<form><input><label>Mail {i}</label></form><section class="comments"><p>{prose(i + 1, 200)}</p></section>{extra}
<footer>&copy; me</footer></body></html>"""


def plain(html):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_against_their_markup(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_given_pages_with_the_article_unnamed(spark, sf_dir):
    """The same texts come out when neither the article nor the advert is marked, and only the pages' shape tells."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    unnamed = F.regexp_replace(F.regexp_replace("html", "<(/?)article>", "<$1div>"), 'class="ad"', 'class="q"')
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in extract(pages.withColumn("html", unnamed)).collect()} == want


def test_a_host_without_article_elements(spark):
    """The wrapper finds the story by its text and drops what all pages of the host say at one place."""
    rows = [(i, f"https://h.example/{i}", site(i, f"<h1>Title {i}</h1><p>{prose(50 + i, 150)}</p><p>More&nbsp;of   <b>it</b> {i}</p>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\n{' '.join(prose(50 + i, 150).split())}\nMore of it {i}"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"),
        ("<article>a<script>x</p></script>b<!-- c --> d<style>e", "ab d"),
        ("<body><nav>n</nav><main><h1>t</h1><p>a<br>b</p><aside>s</aside><ul><li>x<li>y</ul></main>z", "t\na b\nx\ny"),
        ("<article><header><h2>t</h2></header><p>a&#233;&lt;b&gt;</p><footer>f</footer></article>", "t\naé<b>"),
        ("<ARTICLE CLASS='Post'><P>a</P><DIV class=ad>x</DIV><div class='cookie-notice'>y</div>b</ARTICLE>", "a\nb"),
        ("<article>long enough text</article><article class=comment>no no no no no no no no no</article>", "long enough text"),
        ("<article><p>a</b></i></div> c <b>d<p>e</b>f</article>", "a c d\nef"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><p hidden>h</p></article>", "1\n2\n3"),
        ("<article><a title='x>y' href=\"q\">l</a> <img alt='>'>m</article>", "l m"),
        ("<article>a<textarea>t</article>", "a"),
        ("<article>a <a href='/hidden-gems/1'>b</a> <a href=\"/x?id=login\">c</a> <b title='the hidden valley'>d</b></article>", "a b c d"),
        ("<article>a<p aria-hidden=false>b</p><p data-role='search'>c</p><p data-id = login>d</p><p x=hidden>e</p></article>", "a\nb\nc\nd\ne"),
        ("<article>a <a href=/tag/hidden/id=login>b</a><p data-x=1 HIDDEN>c</p><p hidden=''>d</p><p x='y'hidden>e</p><p ID = login>f</p></article>", "a b"),
        ("<main><div class=crumbs>x</div><article><h1>t</h1><p>long enough</p></article></main>", "t\nlong enough"),
        ("<div id=page><div class=post><h1>t</h1><p>one single paragraph</p></div><div class=x>y</div></div>", "t\none single paragraph"),
        ("<body><div><div id=wrap><h1>t</h1><div class=body>much more text here</div></div></div>", "t\nmuch more text here"), ("<div class='with-sidebar'><article>in</article></div>", "in"),
    ],
)
def test_single_pages(html, text):
    found = alone(html)
    assert (found or "") == text


def test_awkward_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (None, "https://h.example", "<p>x"), (4, "no url", deep), (5, "https://h.example", "<article>y</article>")]
    rows += [(6, "HTTPS://u@H.example:80/p", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (5, "https://h.example", "<article>y</article>")]
    df = spark.createDataFrame([(*r, "own", 7, "key") for r in rows], PAGES + ", text string, n_chars int, host string")
    got = extract(df).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == sorted(
        [("1", 0), ("2", 0), ("None", 1), ("4", 4), ("5", 1), ("5", 1), ("6", 20_000 * 5 - 1)]
    )
    assert {r["host"] for r in got} == {"key"}
    assert extract(df.limit(0)).count() == 0


def test_alignment_marks_optional_and_repeated_members_and_slots():
    one = template(parse("<div><h1>A</h1><p>x</p><p>y</p><i>same</i></div>"))
    two = template(parse("<div><h1>B</h1><p>z</p><table><tr><td>1</table><i>same</i></div>"))
    both = merged([one, two])
    div = both.members["div"]
    assert list(div.members) == ["h1", "p", "table", "i"] and div.pages == 2
    assert div.members["p"].repeated and not div.members["h1"].repeated
    assert div.members["table"].pages == 1 and div.members["h1"].pages == 2
    assert div.members["h1"].slot and div.members["p"].slot
    assert div.texts and not div.slot
    assert main_path(both) == (["#page", "div"], False)
    assert both.expression() == "<#page><div>*<h1>*</><p>*</>+<table><tr><td>*</></></>?<i></></></>"


@pytest.mark.parametrize(
    "pages, expression",
    [
        (["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"], "(<h2>*</><p>*</>)+"),
        (["<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"], "(<h2>*</><p>*</>)+"),
        (["<h2>a</h2><p>b</p><ul></ul>", "<p>b</p><h2>a</h2>"], "(<h2>*</><p>*</>)+<ul></>?"),
        (["<h2>a</h2><ul></ul><h2>c</h2>", "<h2>a</h2><p>b</p><hr><h2>c</h2>"], "(<h2>*</><p>*</>?<hr></>?<ul></>?)+"),
        (["<p>a</p>", "<hr><p>a</p><ul></ul>", "<ul></ul>"], "<hr></>?<p>*</>?<ul></>?"),
    ],
)
def test_mismatches_become_optional_members_or_repeated_groups(pages, expression):
    made = merged(template(parse(p)) for p in pages)
    assert made.expression() == f"<#page>{expression}</>"
    assert Member.of(made.data()).expression() == made.expression()


def texts(spark, pages, host="https://h.example"):
    rows = [(i, f"{host}/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in extract(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def test_names_that_only_sound_like_other_parts(spark):
    """Only a name all of whose words speak of something else marks an element as beside the article."""
    menu = "<ul class=menu><li><a href=/>Home</a><li><a href=/n>News</a></ul>"
    inside = (
        "<p class='story-share-price'>Shares rose by {i}</p><div class='login-guide'>Type {i} first</div>"
        "<section id='search-algorithms'><p>Search takes {i} steps</p></section>"
    )
    story = [f"<h1>Title {i}</h1><p>{prose(i, 40).strip()}</p>" + inside.format(i=i) for i in range(8)]
    want = [
        f"Title {i}\n{' '.join(prose(i, 40).split())}\nShares rose by {i}\nType {i} first\nSearch takes {i} steps" for i in range(8)
    ]
    assert texts(spark, [f"<body>{menu}<div class='content no-sidebar'>{s}</div></body>" for s in story]) == want
    assert texts(spark, [f"<body>{menu}<article>{s}</article></body>" for s in story]) == want


@pytest.mark.parametrize("tags", [("article", "article"), ("div class=q7", "div")])
def test_labels_alike_on_all_pages_stay_and_notices_go(spark, tags):
    pages = [
        f"<body><{tags[0]}><h1>Dish {i}</h1><p>{prose(i, 60)}</p><h2>Facts</h2><dl><dt>Servings</dt><dd>{i + 2} people</dd></dl>"
        f"<p>Ingredients:</p><table><tr><th>Flour<td>{i} g</table><p><b>Time</b> {i} min</p>"
        f"<div class=z><h3>Our book</h3><p>Buy the book of dishes.</p></div></{tags[1]}></body>"
        for i in range(8)
    ]
    for i, text in enumerate(texts(spark, pages)):
        words = " ".join(prose(i, 60).split())
        assert text == f"Dish {i}\n{words}\nFacts\nServings\n{i + 2} people\nIngredients:\nFlour\n{i} g\nTime {i} min"


@pytest.mark.parametrize("names", [("", "", ""), (" class=a1", " class=b2", " class=c3"), (" class=x", " class=x", " class=x")])
def test_short_pages_without_telling_names(spark, names):
    """Menus and link lists go although nothing but their place and their texts speaks for it."""
    a, b, c = names
    pages = [
        f"<body><div{a}><a href=/>Home</a> <a href=/n>News</a><ul><li><a href=/1>Sports today</a><li><a href=/2>Weather map</a></ul></div>"
        f"<div{b}><h1>Title {i}</h1><p>{prose(i, 12)}</p><p>End of {i}.</p></div>"
        f"<div{c}><ul><li><a href=/{i}>{prose(i + 20, 6)}</a><li><a href=/x{i}>{prose(i + 40, 6)}</a></ul></div><p>Imprint and terms</p></body>"
        for i in range(9)
    ]
    assert texts(spark, pages) == [f"Title {i}\n{' '.join(prose(i, 12).split())}\nEnd of {i}." for i in range(9)]


def test_near_copies_of_one_article_stay_whole(spark):
    body = "".join(f"<p>{prose(k, 30)}</p>" for k in range(4))
    for text in texts(spark, [f"<article><h1>Title</h1>{body}<p>Edition {i}</p></article>" for i in range(8)]):
        assert len(text.split("\n")) == 6


def test_templates_grow_with_kinds_of_elements_only():
    """Ids and deep nesting of thousands of pages: one member per kind, in time linear in the pages."""

    def page(i):
        heads = "".join(f"<h2 id='slug-{chr(97 + i % 26)}x{k}q{'z' * (i % 50)}'>H {i}</h2><p>t {i} {k}</p>" for k in range(6))
        return template(parse(f"<article>{heads}</article>"))

    made = merged(page(i) for i in range(3_000))
    assert made.expression() == "<#page><article>(<h2>*</><p>*</>)+</></>"
    deep = template(parse("<div>" * 2_000 + "a" + "</div>" * 2_000))
    again = Member.of(deep.data())
    assert len(merged([deep, again]).data()) == 2_001
