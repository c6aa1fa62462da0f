"""Main text where attributes and page-wide names speak of boilerplate that is not there."""

import time

import pytest

from tracelens.llm import pages

INNER = "<h1>The hidden valley</h1><p>Some long text about the valley, which nobody has seen, and its people.</p><p>They were here, before us.</p>"
TEXT = "The hidden valley Some long text about the valley, which nobody has seen, and its people. They were here, before us."
WHOLE = [
    '<article title="the hidden valley">{}</article>', "<article onclick=\"x('hidden')\">{}</article>", '<article data-hidden="0">{}</article>', '<article itemid="ad">{}</article>', '<article hidden="until-found">{}</article>',
    '<html class="ads"><body class="page header-fixed sidebar-left"><article>{}</article></body></html>', '<body class="has-cookie-notice home"><article>{}</article></body>', '<body class="no-ads"><article>{}</article></body>', '<body id="header"><article>{}</article></body>',
    '<div class="post has-comments sidebar-right"><article>{}</article></div>', '<div class="post has-comments sidebar-right">{}</div>', '<div id="content" class="no-sidebar">{}</div>', '<article class="post-with-ads">{}<div class="ad">Buy this now.</div></article>',
    '<div class="layout sidebar-right"><main><article class="post">{}</article></main><aside class="sidebar"><p>Buy this now, it is good.</p></aside></div>',
    '<div class="cookie-banner"><p>We use cookies, you know.</p></div><article>{}</article>', "<article>{}</article><div hidden><p>Not to be seen here.</p></div>", '<article>{}</article><div aria-hidden="true"><p>Not to be seen here.</p></div>',
    '<article>{}</article><div class="sidebar-widget"><p>Popular posts of the week are here.</p></div>', '<article>{}</article><div class="page-footer"><p>Some company, since 1999.</p></div>',
    '<nav class="menu"><ul><li><a href="/a">One</a></li></ul></nav><div class="entry-content">{}</div><div class="comments"><article class="comment"><p>I liked it very much, thank you.</p></article></div>',
]


@pytest.mark.parametrize("page", WHOLE)
def test_whole_article_alone(page):
    assert pages.main_text(page.format(INNER), pages.default_model()) == TEXT


def test_names_of_attributes():
    assert pages.names_of("post has-sidebar siteHeader sidebar-right") == ("post", "has-", "site-", "-header", "sidebar-", "-right")
    assert pages.own_names("div", ' title="class=ad" data-class="ad" class=\'main\' hidden') == ("main", "hidden")
    assert pages.own_names("body", ' class="ad" id=x') == ()
    assert pages.own_names("p", ' style="display : none" aria-hidden=false hidden=until-found') == ("hidden",)


@pytest.mark.parametrize("attributes", ['a="' * 100_000, "=" * 200_000, "x='\" " * 100_000, "a" * 300_000])
def test_attributes_in_linear_time(attributes):
    began = time.time()
    pages.own_names("div", attributes)
    assert time.time() - began < 5
