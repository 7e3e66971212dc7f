"""Deep, unclosed and odd pages of one host; tree matching without recursion."""

import random
import time

import pytest

from offerlake.llm.pages import Node, _heaviest, main_text, parse, simple_tree_match

SCHEMA = "page_id bigint, url string, html string"


def test_deep_pages_of_one_host(spark):
    """Enough pages of a host for a template, each nested so deep that recursion would end."""
    deep = lambda i: "<div>" * 4000 + f"<p>page {i} says</p>" + "</div>" * 4000
    rows = [(i, "http://deep.example/a", deep(i)) for i in range(4)] + [(9, "http://deep.example/b", "<article><p>short</p></article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert got == {i: (f"page {i} says", 11) for i in range(4)} | {9: ("short", 5)}


@pytest.mark.parametrize("source", ["<a " * 40_000, "<span>" * 40_000 + "</b>" * 40_000, "<span>" * 40_000 + "<h1>" * 40_000, "<div>" * 40_000, "<script>" + "</script " * 40_000, "<a '" * 40_000 + ">", "<!--" * 40_000, "<ul>" + "<span>" * 20_000 + "<li>x" * 20_000, "<p>" * 40_000 + "</p>" * 40_000, "&#" * 40_000])
def test_odd_pages_take_linear_time(source):
    began = time.time()
    page = parse(source)
    simple_tree_match(page.root, page.root)
    assert time.time() - began < 15  # seconds at most where a square would take minutes


def test_open_tags_and_comments():
    said = lambda source: [b[1] for b in parse(source).blocks]
    assert said("a <b x") == ["a <b x"] and said("a<!-- b <p>c") == ["a"] and said("<p>a<!-- b --><p>c") == ["a", "c"]
    assert said("<script>if (a < b) x</script y>z") == ["z"] and said("<title>t") == [] and said("a <script>b") == ["a"]
    assert said("<table><tr><td>a<table><tr><td>b</table>c<td>d") == ["a", "b", "c", "d"]
    assert said("<ul><li>a<ul><li>b</ul>c<li>d") == ["a", "b", "c", "d"] and said("<p>a<div>b</div>c") == ["a", "b", "c"]


def plain_match(a, b):
    """By the recurrence over both lists of children."""
    if a.label != b.label:
        return 0
    left, right = list(a.children.values()), list(b.children.values())
    size = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + plain_match(x, y))
    return size[-1][-1] + 1


def tree(rng, depth):
    node = Node("x", "")
    for label in rng.sample("abcdefg", rng.randint(0, 5)) if depth else ():
        child = tree(rng, depth - 1)
        child.label = label
        node.children[label] = child
    return node


def test_matches_equal_the_recurrence():
    rng = random.Random(7)
    for _ in range(300):
        a, b = tree(rng, 3), tree(rng, 3)
        size, pairs = simple_tree_match(a, b)
        assert size == plain_match(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
    assert _heaviest([], []) == [] and _heaviest([5, 1, 1, 1], [3, 0, 1, 2]) == [0] and _heaviest([2, 1, 1, 1], [3, 0, 1, 2]) == [1, 2, 3]
