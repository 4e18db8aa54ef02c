import html
import random
import re
from collections import Counter

import pytest

from veilspan.llm import html_text
from veilspan.llm.html_text import extract, main_text

RUN = "the cat of the house and a dog is in the garden for it was late and the sun was on the hill with a bird "


def gold(page):
    a = page[page.index("<article>") + 9 :].split("</article>")[0].split("<footer>")[0]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", a)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert sum(got[r["page_id"]]["text"] == gold(r["html"]) for r in rows) > 0.98 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def found_and_wanted(rows):
    """Share of blocks found that are wanted, and of wanted ones that are found, on pages whose tags and classes tell nothing."""
    hits = found = wanted = 0
    for r in rows:
        plain = re.sub("<(/?)(article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        want, got = Counter(gold(r["html"]).split("\n\n")), Counter(main_text(plain).split("\n\n"))
        hits, found, wanted = hits + (want & got).total(), found + got.total(), wanted + want.total()
    return hits / found, hits / wanted


def test_rules_decide_where_tags_tell_nothing(spark, monkeypatch):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    assert min(found_and_wanted(rows)) > 0.97
    for name, value, most in (("LINKS", 2, 0.7), ("SHORT", 10**9, 0.95)):
        with monkeypatch.context() as m:
            m.setattr(html_text, name, value)
            if name == "SHORT":
                m.setattr(html_text, "LONG", value)
            assert min(found_and_wanted(rows)) < most, name


def test_first_pass_by_hand():
    dense, sparse = "the cat of the house " * 20, "quartz river stone amber " * 20
    cases = [(dense, 0, True), (dense[:60], 0, None), (dense, len(dense), False), (sparse, 0, False), (sparse[:150], 0, None), (dense[:100], 0, True), ("© " + dense, 0, True), ("© 2024 of the house", 0, False)]
    for text, linked, want in cases:
        assert html_text.decide(html_text.Block(text, linked, False, 1, False, False)) is want
    assert html_text.decide(html_text.Block(sparse, 0, False, 1, True, False)) is None
    assert html_text.decide(html_text.Block(dense, 0, True, 1, False, False)) is False
    assert html_text.decide(html_text.Block(dense, 0, False, 1, False, True)) is None
    assert html_text.decide(html_text.Block(sparse, 0, False, 1, False, False), unknown=True) is True


def test_second_pass_against_brute_force(monkeypatch):
    rng = random.Random(5)
    decisions = {"main": True, "other": False, "short": None}
    monkeypatch.setattr(html_text, "decide", lambda b, unknown: decisions[b.text])
    for _ in range(400):
        articles = set(rng.sample(range(4), rng.randrange(3)))
        blocks = []
        for h in sorted(rng.randrange(4) for _ in range(rng.randrange(1, 14))):
            blocks.append(html_text.Block(rng.choice(["main", "other", "short", "short"]), 0, False, h, h in articles, False))
        html_text.label(blocks)
        first = [decisions[b.text] for b in blocks]
        decided = [i for i, x in enumerate(first) if x is not None]
        for i, b in enumerate(blocks):
            inner = [j for j in decided if blocks[j].inner]
            own = [j for j in decided if blocks[j].holder == b.holder]
            nearest = lambda among, i=i: any(first[j] for j in among if abs(i - j) == min(abs(i - k) for k in among))
            if first[i] is not None:
                want = first[i]
            elif not any(first[j] for j in decided):
                want = b.inner or not any(x.inner for x in blocks)
            elif own:
                want = nearest(own)
            elif b.inner:
                want = not any(first[j] for j in inner) or nearest(inner)
            else:
                want = nearest(decided) and not any(x.inner for x in blocks)
            assert b.label == want


def test_parts_outside_the_main_text():
    page = f"""<html><body class="home menu-open"><header><h1>Site</h1><p>{RUN * 3}</p></header><nav><a href=/>the</a></nav>
    <div class="cookie-notice"><p>{RUN * 3}</p></div><main><article><h1>A title</h1><p>{RUN * 3}&eacute;&nbsp;x &lt;b&gt;</p><p>Yes.</p>
    <aside class="related"><p>{RUN * 3}</p></aside><form><p>{RUN * 3}</p></form><script>var p = "<p>{RUN}</p>"</script>
    <ul><li><a href=/x>{RUN}</a></li></ul><p>{RUN} <a href=/y>link</a></p></article>
    <section id="comments"><p>{RUN * 3}</p></section></main><div class=sidebar>{RUN * 3}</div><footer>&copy; {RUN}</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["A title", (RUN * 3).strip() + " é x <b>", "Yes.", RUN + "link"]


def test_without_an_article_and_broken_markup():
    page = f"<div id=page><p>{RUN * 3}<p>Short one<br>here<p>{RUN * 3}</div><div><a href=/>Home</a> <a href=/a>About us</a></div><p>(c)<foo"
    assert main_text(page).split("\n\n") == [(RUN * 3).strip(), "Short one here", (RUN * 3).strip()]
    for odd in (None, "", "plain", "<", "<p", "</p></div>", "&amp", "<script>never closed", "<!-- open", "<p>" * 5000, "<div>" * 3000 + "x"):
        main_text(odd)


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "", "t"), (2, "v", f"<p>{RUN * 3}</p>" * 400, "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"] > 0) for r in got) == [("1", False), ("1", False), ("2", True), ("None", False)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_silent_elements_without_an_end_tag():
    p, q = (RUN * 3).strip(), (RUN * 3).strip() + " again"
    for between in ("<select><option>A<option>B</select>", "<select><option>A<option>B<option>C</select>", "<div><button>Go</div>", "<div><video src=v></div>", "<div><canvas></div>", "<div><object data=o>x</div>", "<svg><path d=m>", "<button>", "<video src=v>"):
        assert main_text(f"<article><p>{p}</p>{between}<p>{q}</p></article>").split("\n\n") == [p, q], between
    for head in ("<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=utf-8><link href=x>"):
        assert main_text(f"<html>{head}<article><p>{p}</p><p>{q}</p></article></html>").split("\n\n") == [p, q], head
    kept = "<object data=o><p>fallback</p></object><svg><title>t</title><foreignObject><p>label</p></foreignObject></svg><button><div>Go</div></button>"
    assert main_text(f"<article><p>{p}</p>{kept}<p>{q}</p></article>").split("\n\n") == [p, q]


def test_text_after_a_lone_less_than_sign():
    p = (RUN * 3).strip()
    assert main_text(f"<p>{p} where a < 5 and so on") == f"{p} where a < 5 and so on"
    assert main_text(f"<p>{p} a < 5 <a href=/x") == f"{p} a < 5"


POLISH = "Wczoraj wieczorem nad rzeką pojawiło się wielu mieszkańców miasteczka, którzy chcieli zobaczyć odbudowany most oraz posłuchać koncertu orkiestry przygotowanego przez miejscową szkołę muzyczną; pogoda dopisała, więc zabawa trwała niemal do rana."
CHINESE = "昨天晚上，许多居民来到河边，观看重新修建的大桥，并聆听当地音乐学校准备的音乐会。天气很好，庆祝活动几乎持续到天亮，孩子们在广场上放风筝，老人们坐在树下聊天，谈论着这座城市多年来的变化。"


def test_other_languages_without_an_article():
    for text in (POLISH, CHINESE):
        page = f"<html><body><nav><a href=/>Home</a></nav><div><p>{text}</p><p>Short.</p><p>{text}</p></div><div><a href=/a>{text}</a></div><footer>{text}</footer></body></html>"
        assert main_text(page).split("\n\n") == [text, "Short.", text]
        page = f"<article><p>{text}</p><p>Short.</p><p><a href=/a>Link</a></p><p>{text}</p></article><div>{text}</div>"
        assert main_text(page).split("\n\n")[:3] == [text, "Short.", text]


def test_short_blocks_only():
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div><p>First short line.</p><p>Second one.</p></div><div><a href=/a>More</a></div><footer>(c) us</footer></body></html>"
    assert main_text(page).split("\n\n") == ["First short line.", "Second one."]
    assert main_text(f"<article><p>One.</p><p><a href=/a>Link</a></p><p>Two.</p></article><footer>{RUN * 3}</footer>") == "One.\n\nTwo."
    assert main_text("<p>Hello there") == "Hello there"


RUNNING = "The river had risen in the night and it was not to be crossed by the old bridge, so they took the road that went along the hill to the town."


@pytest.mark.parametrize("name", ["no-sidebar content", "has-sidebar", "share-price", "social-history", "form-factor", "without-menu page", "c-header-less"])
@pytest.mark.parametrize("at", ["class", "id"])
def test_names_that_only_contain_a_word(name, at):
    second = RUNNING.replace("river", "lake")
    page = f"<html><body><div {at}='{name}'><h1>High water</h1><p>{RUNNING}</p><p>{second}</p></div></body></html>"
    assert main_text(page) == f"High water\n\n{RUNNING}\n\n{second}"
    page = f"<html><body><article><h1>High water</h1><p>{RUNNING}</p><div {at}='{name}'><p>{second}</p></div><p {at}='{name}'>A short end.</p></article></body></html>"
    assert main_text(page) == f"High water\n\n{RUNNING}\n\n{second}\n\nA short end."


def test_running_text_overrules_names_in_an_article():
    assert main_text(f"<article><div class='share price'><p>{RUNNING}</p></div><h1>High water</h1><p id='social-history'>{RUNNING}</p></article>") == f"{RUNNING}\n\nHigh water\n\n{RUNNING}"
    own = f"<article><p>{RUNNING}</p>%s<p>© {RUNNING}</p></article>"
    want = f"{RUNNING}\n\n© {RUNNING}"
    for part in ("<div class='share'>Share this</div>", f"<div class='comments'><p>{RUNNING}</p></div>", f"<div class='comment-body'><p>{RUNNING}</p></div>", f"<div class='ad'><p>{RUNNING}</p></div>", "<p class='copyright'>© 2024</p>"):
        assert main_text(own % part) == want, part
    assert main_text(f"<body><div class='sidebar'><p>{RUNNING}</p></div><div><p>{RUNNING}</p></div><div class='site-footer'>All rights reserved</div><p>© 2024 of the house</p></body>") == RUNNING
