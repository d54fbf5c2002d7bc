"""The page reader on odd markup, the ratios against brute force over random trees, and the query's columns."""

import html
import random
import time
from collections import Counter

import pytest

from lodeseam.llm.html_paths import BLOCK, HEADINGS, OUT, PUNCTUATION, THRESHOLD, extract_main_text, main_text
from lodeseam.llm.queries import op3_html

BODY = "A long sentence, with marks. " * 9


def test_whole_page():
    page = "<html><head><title>T</title><style>p{}</style></head><body><header class=top>Site</header><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three <i>four</i>.<script>var a='</p>';</script></p><div class=\"comments\">me too</div></article><aside>x</aside><footer>&copy;</footer>"
    assert main_text(page) == "Head & line\n\nOne two.\n\nThree four."
    assert main_text(page, "\n") == "Head & line\nOne two.\nThree four."
    loose = f"<body><ul class=menu><li><a href=1>a</a><li><a href=2>b</a></ul><div><h2>Title here</h2><p>{BODY}<p>{BODY}</div><div><a href=3>more</a></div>"
    assert main_text(loose).split("\n\n") == ["Title here", BODY.strip(), BODY.strip()]
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("< > <") == ""


def test_ratios_run_beside_articles():
    page = f"<body><article class=card><p>Next story</article><div><p>{BODY}<p>{BODY}</div><article class=card><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article>"
    assert main_text(page) == "\n\n".join([BODY.strip()] * 2)
    inside = f"<body><article><h1>Title</h1><p>{BODY}<p>Short.<ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article>"
    assert main_text(inside) == f"Title\n\n{BODY.strip()}\n\nShort."


def test_names():
    for root in ("<article class='has-sidebar'>", "<article id=related>", "<main class='search-results'>", "<div class='page with-sidebar'><article>", "<div class='widget'><main>"):
        assert main_text(f"<body>{root}<p>One, two.") == "One, two.", root
    for out in ("<div class=Sidebar>", "<div id='top adBanner'>", "<p role=alert>", "<div hidden>", "<div aria-hidden='true'>", "<div style='color:red; display : none'>", "<section class='reader-comments'>"):
        assert main_text(f"<article><p>One, two.</p>{out}me, too.") == "One, two.", out


def test_comments_under_a_heading():
    page = f"<article><h1>T</h1><p>{BODY}</p><section><h3>12 Comments:</h3><div><p>I agree, really.</p></div><h4>Bob</h4><p>Me too, yes.</p></section><h2>Next part</h2><p>Go on, now.</p></article>"
    assert main_text(page) == f"T\n\n{BODY.strip()}\n\nNext part\n\nGo on, now."
    assert main_text(f"<article><h2>Comments on the budget</h2><p>{BODY}") == f"Comments on the budget\n\n{BODY.strip()}"
    same = "<article><p>One, two.</p><h3>Kommentare</h3><p>No, no.</p><h2>Ende</h2><p>Three, four.</p></article>"
    assert main_text(same) == "One, two.\n\nEnde\n\nThree, four."


def test_attributes_and_raw_elements():
    assert main_text("<p title=it's>one, two.</p><p>two, it's so.</p>") == "one, two.\n\ntwo, it's so."
    assert main_text("<p title = 'a > b' x>one, two.</p>") == "one, two."
    assert main_text("<p title='open>one, two.</p>") == "one, two."
    assert main_text('<a href="x"y>one, two</a> 3 < 4 <5, six.') == "one, two 3 < 4 <5, six."
    for raw in ("<svg class=i />", "<svg/><svg><path/></svg>", "<iframe src=x>", "<object data=x>", "<!-->", "<!-- p -->", "<![CDATA[x]]>", "</>", "<?php x ?>"):
        assert main_text(f"<body>{raw}<article><p>One, two.</article>") == "One, two.", raw
    assert main_text("<svg/><article><p>One, two.</article><svg><text>no</text></svg>") == "One, two."
    assert main_text("<article><p>One, two.</article><script>var a = '<p>no, no.'") == "One, two."
    assert main_text("<article><p>One, two.</article><!-- <p>no, no.") == "One, two."
    assert main_text("<article><p>One, two.</article><p class=x no, no.") == "One, two."


@pytest.mark.parametrize("piece", ["<a x ", "<div><span>x. ", "<h2><span>x, y. ", "<p title='", "<p t=\"x>y. ", "<iframe>x. ", "<ul><li>a, b.", "<table><tr><td>a, b.", "<", "<!--", "</ ", "<b></div>", "<h3>Comments</h3><div>a. ", "&#", "<a href=", "<main><p hidden>"])
def test_a_megabyte_of_broken_markup(piece):
    begun = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begun < 10


def test_deep_and_unmatched():
    assert main_text("<div><p>" * 3000 + "x, y." + "</div>") == "x, y."
    begun = time.process_time()
    main_text("<div>" * 50_000 + "</section>" * 50_000 + "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000)
    assert time.process_time() - begun < 10
    assert main_text(f"<article><p>{'word, ' * 200_000}") == ("word, " * 200_000).strip()


def _tree(r, depth):
    """A random well-formed element: (tag, children), where a child is an element or a text."""
    tag = r.choice(["div", "div", "section", "p", "h2", "ul", "a", "b", "nav", "article"] if depth else ["p", "a", "b", "h3"])
    if tag in ("p", "h2", "h3", "a", "b"):
        return tag, [" ".join(r.choice(["alpha", "beta,", "gamma.", "tom & co;", "x<y"]) for _ in range(r.randint(1, 12)))]
    if tag == "ul":
        return tag, [("li", [("a" if r.random() < 0.5 else "b", [f"item {k}, yes."])]) for k in range(r.randint(1, 3))]
    return tag, [_tree(r, depth - 1) for _ in range(r.randint(1, 4))]


def _markup(node):
    return html.escape(node) if isinstance(node, str) else f"<{node[0]}>{' '.join(map(_markup, node[1]))}</{node[0]}>"


def _blocks(node, path=(), out=False, inside=False, link=False):
    """(path, out, inside, text, inside a link) of every text, and None where a block ends."""
    if isinstance(node, str):
        return [(path, out, inside, node, link)]
    tag = node[0]
    block = tag in BLOCK
    found = [None] * block
    for child in node[1]:
        found += _blocks(child, path + (tag,) * block, out or tag in OUT, inside or tag == "article", link or tag == "a")
    return found + [None] * block


def _brute(tree):
    runs, now = [], []
    for x in [*_blocks(tree), None]:
        if x is None:
            if now and not now[0][1]:
                runs.append((now[0][0], now[0][2], " ".join(t for *_, t, _ in now), sum(len(t) for *_, t, link in now if link)))
            now = []
        else:
            now.append(x)
    of = lambda p: [b for b in runs if b[0] == p]
    paths = {b[0] for b in runs}
    ratio = {p: sum(len(b[2]) - b[3] for b in of(p)) / len(of(p)) for p in paths}
    value = {}
    for p in paths:
        family = [ratio[q] for q in paths if q[:-1] == p[:-1]]
        marks = sum(b[2].count(c) for b in of(p) for c in PUNCTUATION) / len(of(p)) + any(b[1] for b in of(p))
        size = sum(len(b[2]) for b in of(p))
        value[p] = (0.75 * ratio[p] + 0.25 * sum(family) / len(family)) * marks * (1 - sum(b[3] for b in of(p)) / size)
    whole = sum(len(b[2]) for b in runs)
    mean = sum(value[b[0]] * len(b[2]) for b in runs) / whole if whole else 0
    good = {p for p in paths if value[p] > 0 and value[p] >= THRESHOLD * mean}
    places = [i for i, b in enumerate(runs) if b[0] in good]
    siblings = {p[:-1] for p in good}
    keep = []
    for i, (p, _, text, linked) in enumerate(runs):
        near = p[:-1] in siblings
        if p in good or (near and places and ((p[-1] in HEADINGS and i <= places[-1]) or (places[0] < i < places[-1] and 2 * linked < len(text)))):
            keep.append(text)
    return "\n\n".join(keep)


def test_ratios_equal_brute_force():
    r = random.Random(4)
    some = 0
    for _ in range(400):
        tree = ("body", [("div", [_tree(r, 3) for _ in range(r.randint(1, 5))])])
        assert main_text(f"<html>{_markup(tree)}</html>") == _brute(("html", [tree])), _markup(tree)
        some += bool(_brute(("html", [tree])))
    assert some > 200


def test_rows_and_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<article><p>a.<p>b.</article>", "m"), (1, "u", "<article><p>a.<p>b.</article>", "m"), (None, None, None, None)], "page_id long, url string, html string, Main_Text string")
    out = extract_main_text(spark, pages)
    assert out.columns == ["page_id", "url", "main_text"]
    assert Counter(map(tuple, out.collect())) == Counter({(1, "u", "a.\n\nb."): 2, (None, None, ""): 1})
    assert extract_main_text(spark, pages.limit(0)).count() == 0
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = op3_html(spark, str(tmp_path))
    assert [(f.name, f.dataType.typeName()) for f in out.schema] == [("page_id", "long"), ("url", "string"), ("text", "string"), ("n_chars", "long")]
    assert Counter(map(tuple, out.collect())) == Counter({(1, "u", "a.\n\nb.", 6): 2, (None, None, "", 0): 1})
