"""Whole pages of several templates against their known articles; pages whose names mislead."""

import random
import time

import pytest

from lectern.llm import html_text, queries

BODY = " ".join(f"word{k}" for k in range(300))
OTHER = " ".join(f"o{k}" for k in range(60))


@pytest.mark.parametrize("html", [
    f"<form action=x><article><p>{BODY}</p></article></form>", f'<form id="aspnet"><nav>a b</nav><div class="x"><article><p>{BODY}</p></article></div></form>', f'<article title="The hidden life"><p>{BODY}</p></article>',
    f'<article data-x="a hidden b"><p>{BODY}</p></article>', f'<article class="md:block hidden lg:flex"><p>{BODY}</p></article>', f'<article style="border-display: none"><p>{BODY}</p></article>', f'<article style="color:red" data-hidden aria-hidden="false"><p>{BODY}</p></article>',
])
def test_attributes_are_told_apart(html):
    assert html_text.main_text(html, html_text.Weights()) == BODY


@pytest.mark.parametrize("html", ["<div hidden>{}</div>", '<div aria-hidden="true">{}</div>', '<div style="color: red; DISPLAY : none !important">{}</div>', "<div HIDDEN=''>{}</div>", "<form>{}</form>", '<div class="comments">{}</div>', '<section id="respond">{}</section>'])
def test_what_is_hidden_or_not_the_page(html):
    assert html_text.main_text(f"<div><p>{OTHER}</p></div>" + html.format(BODY), html_text.Weights()) == OTHER


@pytest.mark.parametrize("frame", ['<article class="post sponsored">{}</article>', '<article class="related">{}</article>', '<div id="newsletter">{}</div>', '<div class="share">{}</div>', '<div class="ad"><div class="promo">{}</div></div>'])
def test_names_do_not_take_the_article(frame):
    for other in (OTHER, "o1 o2", " ".join(OTHER.split()[:17])):
        assert BODY in html_text.main_text(frame.format(f"<p>{BODY}</p>") + f"<div><p>{other}</p></div>", html_text.Weights())


def test_formulas_stay():
    assert html_text.main_text("<article><p>Let <math><mi>x</mi><annotation>TeX x</annotation></math> be.</p></article>", html_text.Weights()) == "Let x be."


TEMPLATES = [
    '<html><head><title>t</title><style>p {{ }}</style></head><body><header><a href=/>Home</a> site name</header><nav><ul><li><a>one</a><li><a>two</a></ul></nav><article>{}</article><aside>more to read here</aside><footer>all rights kept</footer></body></html>',
    '<body><div id="wrapper"><div class="navbar"><a>one</a> <a>two</a></div><div id="content"><main>{}</main></div><div class="comments"><h3>Comments</h3><p>someone said a thing</p></div></div></body>',
    '<body class="page"><form method="post" action="/"><div class="cookie-notice">we keep cookies <button>ok</button></div><div role="navigation"><a>a</a></div><article class="post sponsored">{}</article><div class="share">share this</div></form></body>',
    '<table><tr><td class="sidebar"><a>x</a><br><a>y</a></td><td class="text"><article>{}</article></td></tr><tr><td><div class="footer">imprint</div></td></tr></table>',
]


def article(rng):
    """HTML of an article and its text."""
    html, text = [], []
    for _ in range(rng.randint(3, 9)):
        said = [rng.choice(["word", "Übung", "a &amp; b", "x &lt; y", "end."]) for _ in range(rng.randint(8, 40))]
        kind = rng.choice(["p", "h2", "blockquote", "li", "plain"])
        inner = " ".join(f"<b>{w}</b>" if rng.random() < 0.1 else f'<a href="u">{w}</a>' if rng.random() < 0.1 else w for w in said)
        html.append(f"<p>{inner}</p>" if kind == "plain" else f"<ul><li>{inner}</li></ul>" if kind == "li" else f"<{kind} class='c{rng.randint(0, 3)}'>{inner}</{kind}>")
        text.append(" ".join(said).replace("&amp;", "&").replace("&lt;", "<"))
    return "\n".join(html), " ".join(text)


def test_whole_pages_of_several_templates(spark, sf_dir):
    rng = random.Random(11)
    learnt = html_text.fit(queries.read(spark, sf_dir, "pages"))
    for k in range(80):
        html, text = article(rng)
        page = TEMPLATES[k % len(TEMPLATES)].format(html)
        assert html_text.main_text(page, learnt) == text, page
        assert html_text.main_text(page, html_text.Weights()) == text, page


@pytest.mark.parametrize("html", ['<div class="ad">' * 30_000 + BODY + "</div>" * 30_000, '<div class="ad">a b</div>' * 30_000 + BODY, "<b class=x><div>" + "<span class=y>" * 30_000 + "w</b>" * 30_000, "<form>" * 30_000 + BODY, "<p a='b' " + "c " * 30_000 + ">x"])
def test_hostile_names_take_linear_time(html):
    def took(page):
        began = time.process_time()
        html_text.main_text(page, html_text.Weights())
        return time.process_time() - began

    third = min(took(html[: len(html) // 3]) for _ in range(2))
    assert took(html) < 8 * third + 1
