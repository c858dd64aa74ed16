"""Main text by density: the measure against a plain recursion, pages without
telling tags, names that lie, broken and hostile pages."""

import math
import random
import time

import pytest

from spanloom.llm import html_text
from spanloom.llm.html_text import Node, main_text


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _tree(rng, depth=0):
    if depth == 5 or rng.random() < 0.25:
        return prose(rng.random(), rng.randint(0, 12))
    return rng.choice(["div", "p", "a", "section", "b"]), [_tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def _counts(x):
    """(characters, tags, link characters, link tags) of a subtree."""
    if isinstance(x, str):
        return len(x.replace(" ", "")), 0, 0, 0
    c = t = l = k = 0
    for y in x[1]:
        a, b, d, e = _counts(y)
        c, t, l, k = c + a, t + b, l + d, k + e
        if not isinstance(y, str):
            t, k = t + 1, k + (y[0] == "a")
    return c, t, (c if x[0] == "a" else l), k


def _density(x, body):
    c, t, l, k = _counts(x)
    if not c:
        return 0.0
    big_c, _, big_l, _ = _counts(body)
    base = math.log(c / max(c - l, 1) * l + big_l / big_c * c + math.e)
    t, l, k = max(t, 1), max(l, 1), max(k, 1)
    return c / t * max(0.0, math.log(max(1.0, c / l * t / k))) / math.log(max(base, 1 + 1e-9))


def _html(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(_html, x[1]))}</{x[0]}>"


def test_densities_against_a_recursion():
    rng, met = random.Random(4), 0
    for _ in range(120):
        parts = [("div", [_tree(rng) for _ in range(3)]) for _ in range(3)]

        def build(x, parent):
            if isinstance(x, str):
                return x
            n = Node(x[0], parent)
            n.parts = [build(y, n) for y in x[1]]
            return n

        root = Node("body", None)
        root.parts = [build(x, root) for x in parts]
        html_text.measure(root)
        body = ("body", parts)

        def check(n, x):
            nonlocal met
            assert n.density == pytest.approx(_density(x, body))
            assert n.sum == pytest.approx(sum(_density(y, body) for y in x[1] if not isinstance(y, str)))
            met += 1
            for a, b in zip(n.parts, x[1]):
                if isinstance(a, Node):
                    check(a, b)

        check(root, body)
    assert met > 1500


def test_density_decides_without_telling_tags():
    links = "".join(f'<div><a href="/{i}">{prose(i, 3)}</a></div>' for i in range(40))
    paragraphs = [prose(100 + i, 50) for i in range(5)]
    page = f"<html><body><div>{links}</div><div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div><div><span>{prose(7, 4)}</span>{links}</div></body></html>"
    assert main_text(page) == " ".join(paragraphs)


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-header", "content has-sidebar", "no-comments", "elementor-widget-container", "share-price", "related-work", "social-policy"])
def test_names_that_only_contain_a_cut_name(name):
    p, q = prose(1, 60), prose(2, 60)
    assert main_text(f'<body><div class="{name}"><h1>Head</h1><p>{p}</p><p>{q}</p></div><div>(c) 2024</div></body>') == f"Head {p} {q}"
    assert main_text(f'<body><article><h1>Head</h1><p>{p}</p><div class="{name}"><p>{q}</p></div></article></body>') == f"Head {p} {q}"


def test_named_wrapper_of_the_whole_page_stays():
    p = prose(1, 200)
    for tag in ("form", 'div class="sidebar"', 'div id="header"'):
        assert main_text(f"<body><{tag}><h1>Head</h1><p>{p}</p></{tag.split()[0]}></body>") == f"Head {p}"


def test_broken_tags():
    assert main_text("<body><p title='it>x</p></body>") == "x"
    assert main_text('<body><p title="a > b">x</p></body>') == "x"
    assert main_text("<body><p title='it's>x</p><p>y</p></body>") == "x y"
    assert main_text("<body><div <p>x</p></body>") == "x"
    assert main_text("<body><p>1 < 2 and 3 <4</p></body>") == "1 < 2 and 3 <4"
    assert main_text("<body><p>x</p><!-- never closed <p>y</p>") == "x"
    assert main_text("<body><p>x</p><script>if (a < b) { '</p>' }</script ><p>y</p></body>") == "x y"


@pytest.mark.parametrize("unit", ["<a ", "<p title='", '<p title="', "<textarea>", "<", "<!--", "</b>", "<i><p>", "<ul><li><b>x", "<p a='x\">"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (2_000_000 // len(unit))
    began = time.time()
    main_text(page)
    assert time.time() - began < 20


def test_page_of_five_megabytes_of_open_tags():
    began = time.time()
    assert len(main_text("<a " * 1_700_000)) == 5_099_999
    assert time.time() - began < 10
