import html
import itertools
import random
import re

import numpy as np
import pytest

from adega.llm.blocks import page_blocks
from adega.llm.catalog import QUERIES
from adega.llm.extract import ChainModel, default_model, extract, main_text, train_chain
from adega.llm.labelled_pages import labelled_pages


def texts(page):
    return [b.text for b in page_blocks(page)]


def test_blocks_of_awkward_pages():
    assert texts(None) == texts("") == texts("<html><body></body></html>") == texts("<!-- a") == texts("<script>x") == []
    assert texts("a &amp; b&nbsp;c&#x41;&eacute;&#0;") == ["a & b cAé�"]
    assert texts("<p>one <b>t</b>wo<br>three\n four<p>five</div><li>six<li>seven") == ["one two three four", "five", "six", "seven"]
    assert texts("<style>p{}</style><p title='a>b' class=x>in</p><!-- <p>no</p> -->out<script>var a='</p>'</script>") == ["in", "out"]
    assert texts("a < b <p>c <3 d") == ["a < b", "c <3 d"]
    assert texts("<TABLE><TR><TD>x<TD>y<TR><TD>z</TABLE>") == ["x", "y", "z"]
    assert texts("<p>" + "long " * 200000) == [("long " * 200000).strip()]
    assert texts("<template>a<p>b") == ["a", "b"]  # unclosed: nothing after it is lost


def test_viterbi_finds_the_best_path():
    rng = random.Random(1)
    for _ in range(60):
        model = ChainModel({f: rng.uniform(-2, 2) for f in "abcd"}, tuple(tuple(rng.uniform(-2, 2) for _ in "01") for _ in "01"))
        blocks = [rng.choices("abcd", k=2) for _ in range(rng.randint(1, 7))]

        def score(y):
            return sum(model.weights[f] for b, k in zip(blocks, y) if k for f in b) + sum(model.step[i][j] for i, j in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert abs(score(best) - score(model.decode(blocks))) < 1e-9
    assert model.decode([]) == []


def test_training_reaches_the_likelihoods_maximum():
    pages = [([["a"], ["b"], ["a"]], [0, 1, 1]), ([["b"], ["b"]], [1, 1]), ([["a"]], [0]), ([["b"], ["a"]], [1, 0])]
    model = train_chain(pages, rounds=3000, rate=0.02, penalty=0.1)

    def objective(w, step):
        total = 0.0
        for blocks, y in pages:
            def s(y):
                return sum(w[f] for b, k in zip(blocks, y) if k for f in b) + sum(step[i][j] for i, j in zip(y, y[1:]))
            total += s(y) - np.logaddexp.reduce([s(z) for z in itertools.product((0, 1), repeat=len(y))])
        return total - 0.05 * (sum(v * v for v in w.values()) + sum(v * v for r in step for v in r))

    best = objective(model.weights, model.step)
    rng = random.Random(2)
    for _ in range(50):
        near = {f: v + rng.gauss(0, 0.1) for f, v in model.weights.items()}
        assert objective(near, [[v + rng.gauss(0, 0.1) for v in r] for r in model.step]) < best + 1e-3


def test_held_out_pages():
    model, right, total = default_model(), 0, 0
    for page, main in labelled_pages(300, seed=77):
        blocks = page_blocks(page)
        for b, got in zip(blocks, model.decode([b.features for b in blocks])):
            right, total = right + (got == (b.text in main)), total + 1
    assert right / total >= 0.99


def test_furniture_goes_and_the_article_stays():
    page = """<html><head><title>T</title></head><body><div class="cookie-banner"><p>We use cookies. Fine?</p></div>
    <header><a href=/>Site</a><nav><ul><li><a href=/a>A</a></ul></nav></header><aside class="sidebar"><p>Buy this now, it is good.</p></aside>
    <div class="post"><h1>Title &amp; more</h1><p>First   paragraph of the text.</p><div class="ad">Cheap things for sale here.</div><p>Second one.</p></div>
    <section id="comments"><h3>Comments</h3><p>I liked the text very much, thanks.</p></section>
    <form><label>Mail</label><button>Go</button></form><footer>&copy; Site</footer></body></html>"""
    assert main_text(page, default_model()) == "Title & more\nFirst paragraph of the text.\nSecond one."


HEAD = '<header><a href="/">Site</a><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav></header>'
FOOT = "<footer>&copy; 2024 Site name</footer>"
ARTICLE = ("<h1>Title of this</h1><p>First paragraph of the text, with several words in it.</p>"
           "<p>Second paragraph follows here, and it is also rather long.</p><p>Third one ends the text.</p>")
PLAIN = ("Title of this\nFirst paragraph of the text, with several words in it.\nSecond paragraph follows here, and it is also rather long.\n"
         "Third one ends the text.")


@pytest.mark.parametrize("page", [
    f'<body>{HEAD}<div class="wrap">{ARTICLE}</div></body>', f'<body>{HEAD}<div class="col-md-8">{ARTICLE}</div>{FOOT}</body>',
    f"<body><div>{ARTICLE}</div>{FOOT}</body>", f"<body>{HEAD}<div>{ARTICLE}</div>{FOOT}</body>", f"<body>{HEAD}<section>{ARTICLE}</section>{FOOT}</body>",
    f"<body>{ARTICLE}</body>", f"<body>{HEAD}{ARTICLE}{FOOT}</body>",
    f'<body><div class="cookie-banner"><p>We use cookies. Fine?</p></div>{HEAD}<aside class="sidebar"><p>Buy this now, it is good.</p></aside><div>{ARTICLE}'
    '<div class="ad">Cheap things for sale here.</div></div><section id="comments"><h3>Comments</h3><p>I liked the text very much, thanks.</p></section>'
    f"<form><label>Mail</label><button>Go</button></form>{FOOT}</body>"])
def test_articles_in_containers_whose_names_say_nothing(page):
    assert main_text(page, default_model()) == PLAIN


def test_pieces_of_all_kinds_stay():
    page = f"""<body>{HEAD}<article><h1>T one</h1><h3>Sub head</h3><p>Some text of the thing here.</p><ol><li>one thing</li><li>two things</li></ol>
    <h4>Deeper</h4><dl><dt>Term</dt><dd>Meaning of the term</dd></dl><figure><figcaption>A caption of it.</figcaption></figure>
    <p>The mass is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in it.</p></article>{FOOT}</body>"""
    assert main_text(page, default_model()) == ("T one\nSub head\nSome text of the thing here.\none thing\ntwo things\nDeeper\nTerm\nMeaning of the term\n"
                                                "A caption of it.\nThe mass is E=m in it.")
    listed = "<body><h1>Title</h1><p>First paragraph of it all.</p><ol><li>one item here</li><li>another item here</li></ol><p>Second paragraph of it all.</p></body>"
    assert main_text(listed, default_model()).count("\n") == 4


@pytest.mark.parametrize("piece", ['<p class="more">{}</p>', '<div class="tags-intro">{}</div>', '<div class="tags-intro"><p>{}</p></div>', '<p class="top">{}</p>'])
def test_class_names_of_looks_inside_an_article(piece):
    odd = piece.format("More of this text is standing here.")
    page = f"<body>{HEAD}<article><h1>T one</h1><p>First paragraph of the text here.</p>{odd}<p>The last one of the text.</p></article>{FOOT}</body>"
    assert main_text(page, default_model()) == "T one\nFirst paragraph of the text here.\nMore of this text is standing here.\nThe last one of the text."


def test_pages_without_an_article_are_empty():
    for page in ("<nav>only</nav>", '<body><div class="cookie-notice"><p>We use cookies on this site.</p></div></body>', f"<body>{HEAD}{FOOT}</body>"):
        assert main_text(page, default_model()) == ""


def test_names_are_read_in_pieces():
    page = """<body><div id="adBox"><p>Some words to sell.</p></div><ol class="commentlist"><li><p>Nice text here.</p></li></ol>
    <div class="sidebarLeft"><p>Words on the side here.</p></div><article><h1>Head</h1><p>Text of it.</p></article></body>"""
    assert main_text(page, default_model()) == "Head\nText of it."


def test_rows_and_columns(spark):
    page = "<body><nav><a href=/>x</a></nav><article><h1>Hé</h1><p>Some text.</p></article></body>"
    rows = [(1, "u", page, "mine"), (1, "u", page, "mine"), (2, None, None, "mine"), (None, "v", "", None), (3, "w", "<nav>only</nav>", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text", "text_", "n_chars"]
    assert sorted((r["text_"], r["n_chars"]) for r in got.collect()) == [("", 0)] * 3 + [("Hé\nSome text.", 13)] * 2
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:  # these pages mark their article: its paragraphs and heading are the text
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article))
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])
