"""Plain pages are read without the library's parser, to the same tree."""

from __future__ import annotations

import pytest

from ringside.sources import html

PLAIN = [
    "", "text", "<p>a<p>b</p></p>c", '<div class="x y" data-link="/a?b=1"><br>t<i> \n u</i></div>', "<tr><td>1<td>2</tr><tr><td>3", "</p>x</div>", '<a class="p" class="q">z</a>', "<ul><li>1<li>2</ul>",
]
LEFT = ["a &amp; b", "<!-- c -->x", "<P>x</P>", "<p/>x", "<a b=c>x</a>", "<script>if (a<b) x</script>", "x < y", "<p", '<a b="<i>">x</a', "<td a='1'>x</td>", "<!doctype html><p>x"]


def shown(n) -> list:
    return [n.tag, n.attrs, [c if isinstance(c, str) else shown(c) for c in n.children]]


def by_library(page: str) -> html.Node:
    b = html._Builder()
    b.feed(page)
    b.close()
    return b.root


@pytest.mark.parametrize("page", PLAIN + LEFT)
def test_the_same_tree(page):
    assert shown(html.tree(page)) == shown(by_library(page))


@pytest.mark.parametrize("page", PLAIN)
def test_plain_pages_take_the_short_way(page):
    assert shown(html._plain_tree(page)) == shown(by_library(page))


@pytest.mark.parametrize("page", LEFT)
def test_others_are_left_to_the_library(page):
    assert html._plain_tree(page) is None
