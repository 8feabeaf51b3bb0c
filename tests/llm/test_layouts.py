"""Main text of hand-written layouts: what is around an article varies, the article stays."""

import itertools

import pytest

from tallyport.llm import op3_html

WEIGHTS = op3_html.classifier()
HEAD = "A quiet morning at the harbour"
ONE = "The boats came in before sunrise, and the first crates were on the quay by six o'clock."
TWO = "Nobody spoke much; the work was familiar, and the wind made talking harder than it was worth."
INNER = f"<h1>{HEAD}</h1><p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{HEAD}\n{ONE}\n{TWO}"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
MENU = '<div class="main-menu"><ul><li><a href="/">Start</a></li><li><a href="/shop">Shop</a></li></ul></div>'
SIDE = '<div id="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to paint a door</a></li><li><a href="/2">Old maps found in attic</a></li></ul></div>'
COMMENTS = '<div class="comments-area"><h3>Two comments</h3><div class="comment"><p>I grew up near there and this is exactly how it was, thank you.</p></div><div class="comment"><p>Which harbour is it, though? You never say that anywhere.</p></div></div>'
FOOT = '<footer><p>&copy; 2021 Harbour Times. All rights reserved.</p></footer>'
COOKIES = '<div class="cookie-banner"><p>We use cookies to improve this site. <button>Accept</button></p></div>'

BODY_CLASSES = [
    "single-post with-sidebar", "has-comments", "no-sidebar", "related-on", "menu-open", "search-enabled", "popup-ready", "page-template-sidebar", "sidebar", "comments-open nav-fixed", "home blog header-fixed footer-dark", "modal-open overlay", "ad-free", "widget-area-on newsletter", "site",
]


@pytest.mark.parametrize("names", BODY_CLASSES)
@pytest.mark.parametrize("tag", ["html", "body", "div", "section"])
def test_classes_around_the_page(names, tag):
    inner = f"{NAV}<article>{INNER}</article>{SIDE}{FOOT}"
    page = {
        "html": f'<html class="{names}"><body>{inner}</body></html>', "body": f'<html><body class="{names}" id="menu">{inner}</body></html>',
        "div": f'<body><div class="{names}">{inner}</div></body>', "section": f'<body><div><section id="{names.split()[0]}"><div class="{names}">{inner}</div></section></div></body>',
    }[tag]
    assert op3_html.main_text(page, WEIGHTS) == TEXT


LAYOUTS = {
    "main": f"<header>{NAV}</header><main>{INNER}</main>{SIDE}{FOOT}",
    "main in form": f'<form id="aspnetForm" action="x">{NAV}<main>{INNER}</main>{FOOT}</form>',
    "sidebar wrap": f'<div class="content-sidebar-wrap">{NAV}<div class="content"><article>{INNER}</article></div>{SIDE}</div>{FOOT}',
    "no-comment": f'{NAV}<div class="article-body no-comment">{INNER}</div>{FOOT}',
    "has-sidebar": f'{MENU}<div class="has-sidebar"><div class="entry-content">{INNER}</div>{SIDE}</div>{FOOT}',
    "plain div": f"{NAV}<div>{INNER}</div>{FOOT}",
    "post first": f'<div id="post">{INNER}</div>{COMMENTS}{SIDE}{FOOT}',
    "comments": f"{NAV}<article>{INNER}</article>{COMMENTS}{FOOT}",
    "comments inside": f'<div class="article-with-comments">{NAV}<article>{INNER}</article>{COMMENTS}</div>',
    "long comments": f"{NAV}<article>{INNER}</article>{COMMENTS * 6}{FOOT}",
    "cookies": f"{COOKIES}{MENU}<main><article>{INNER}</article></main>{FOOT}",
    "modal": f'<div class="modal-wrapper"><div class="inner">{NAV}<main>{INNER}</main>{FOOT}</div></div>',
    "layout table": f"<table><tr><td>{MENU}</td><td><article>{INNER}</article></td></tr></table>{FOOT}",
    "header inside": f"<article><header><h1>{HEAD}</h1></header><p>{ONE}</p><p>{TWO}</p></article>{SIDE}{FOOT}",
    "two wrappers": f'<div id="wrap-sidebar"><div class="page menu"><div class="post">{INNER}</div></div></div>{FOOT}',
    "upper case": f'<DIV CLASS="HAS-COMMENTS">{NAV}<ARTICLE>{INNER}</ARTICLE></DIV>{FOOT}',
    "unclosed": f'<div class="layout-sidebar">{NAV}<article><h1>{HEAD}<p>{ONE}<p>{TWO}</article>{FOOT}',
    "site title": f'<header class="banner"><h1>Harbour Times</h1></header>{NAV}<main><h2>{HEAD}</h2><p>{ONE}</p><p>{TWO}</p></main>{FOOT}',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert op3_html.main_text(f"<html><head><title>x</title></head><body>{LAYOUTS[name]}</body></html>", WEIGHTS) == TEXT


def test_link_lists_of_an_article():
    links = '<p>For more on this, see the following pages of the archive.</p><ul><li><a href="/a">The harbour in 1900</a></li><li><a href="/b">The great storm</a></li></ul>'
    for frame in ("<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>'):
        got = op3_html.main_text(f"<body>{NAV}{frame.format(INNER + links + f'<p>{ONE}</p>')}{SIDE}{FOOT}</body>", WEIGHTS)
        assert got == f"{TEXT}\nFor more on this, see the following pages of the archive.\nThe harbour in 1900\nThe great storm\n{ONE}"


def test_buttons_count_inside_paragraphs():
    page = f"<article>{INNER}<p>Press the <button>green</button> button, and wait until it is lit.</p><button>Share this</button><div><button>Subscribe</button></div></article>{FOOT}"
    assert op3_html.main_text(page, WEIGHTS) == f"{TEXT}\nPress the green button, and wait until it is lit."
    assert [b.text for b in op3_html.blocks("<p>a <button>b</p><p>c <button>d</button></p><button>e")] == ["a b", "c d"]


def test_states_in_class_names_say_nothing():
    for name, flag in itertools.chain([(f"{s}-{w}", 0) for s in ("no", "has", "with", "is") for w in ("sidebar", "comments", "menu")], [("main-menu", "nav"), ("comment-body", "comment"), ("cookie-banner", "notice")]):
        bits = op3_html._flags_of("div", f' class="{name}"')
        assert bits == 0 if flag == 0 else bits & op3_html._BIT[flag]
