"""Simple tree matching against its textbook recursion, templates that hold every
skeleton, and wrapper induction where only the template tells content."""

import random
import re
import time
from collections import defaultdict
from functools import cache

import pytest

from flowbook.llm import html_extract, trees
from flowbook.llm.queries import table

SF = "/root/testdata/sf0.01"


def tree(rng, depth, labels="abc"):
    return [rng.choice(labels), *[tree(rng, depth - 1, labels) for _ in range(rng.randint(0, 4) if depth else 0)]]


def load(t):
    out = trees.Node(t[0])
    out.children = [load(x) for x in t[1:]]
    return out


def textbook(a, b):
    if a[0] != b[0]:
        return 0
    xs, ys = a[1:], b[1:]

    @cache
    def best(i, j):
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + textbook(xs[i - 1], ys[j - 1])) if i and j else 0

    return 1 + best(len(xs), len(ys))


def test_match_is_the_textbook_score():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ["r", *tree(rng, 3)[1:]], ["r", *tree(rng, 3)[1:]]
        x, y = load(a), load(b)
        assert trees.match(x, y, trees.Pairs(x, y)) == textbook(a, b)


def check_embedded(root, skeleton, places):
    """Each node has a template node of its own, with its label, below its parent's, in order."""
    nodes, own = trees.preorder(root), trees.preorder(skeleton)
    numbers = {id(n): i for i, n in enumerate(nodes)}
    at = {id(n): p for n, p in zip(own, places, strict=True)}
    assert len(set(places)) == len(places)
    for n, p in zip(own, places, strict=True):
        assert nodes[p].label == n.label
        below = [at[id(c)] for c in n.children]
        assert below == sorted(below) and set(below) <= {numbers[id(c)] for c in nodes[p].children}


def test_a_template_holds_each_skeleton_whole():
    rng = random.Random(6)
    for _ in range(60):
        texts = [trees.dumps(load(["r", *tree(rng, 3)[1:]])) for _ in range(rng.randint(1, 8))]
        text = trees.template(texts)
        assert text == trees.template(texts[::-1] + texts)  # neither order nor repeats matter
        root = trees.loads(text)
        numbers = {id(n): i for i, n in enumerate(trees.preorder(root))}
        for t in texts:
            check_embedded(root, trees.loads(t), trees.places(root, numbers, trees.loads(t)))


def shape(page):
    return trees.dumps(html_extract.page_blocks(page)[1])


def test_repeated_records_are_one_node():
    row = "<li><h2>a</h2><p>b<p>c</li>"
    assert shape(f"<ul>{row * 3}</ul>") == shape(f"<ul>{row}<li><h2>x</h2><p>y</li></ul>") == '["",["ul",["li",["h2"],["p"]]]]'
    assert shape("<div><p>a</div><div><ul><li>b</ul></div>") == '["",["div",["p"]],["div",["ul",["li"]]]]'  # no records: little of them matches
    assert shape('<p class="post post-12 x9y">a') == '["",["p.post.post-.x"]]'


@pytest.mark.parametrize("piece", ["<div>a", "<div><p>a</p></div><section><i>b</i><p>a</p></section>", "<b>", "<div>a<b>", "<div><h2>a</h2><ul><li>b</ul></div><p>c</p>", "</x><div>", "<li><b>a"])
def test_large_pages_take_time_in_proportion(piece):
    page = piece * (500_000 // len(piece))
    began = time.time()
    text = shape(page)
    other = shape("<div>" + page)
    trees.template([text, other])
    assert time.time() - began < 20
    words = lambda text: sorted(re.findall(r"\w", text))
    assert words("".join(b.text for b in html_extract.blocks(page))) == words(re.sub("<[^>]*>", "", page.rpartition("<")[0] if page.rfind("<") > page.rfind(">") else page))


# a host's pages without a word in tag or class that tells content from the rest
PAGE = ("<div><div>Daily notes of the coast</div><div><a href=/>Home</a> <a href=/n>News</a></div></div>{notice}"
        "<div><h2>Head {0}</h2>{paragraphs}</div><div><h2>Older notes</h2><p>Read them in the archive</p></div>")


def test_position_tells_content(spark):
    table(spark, "/root/testdata/sf0.001", "pages")  # workers find the package
    rows = [(i, "http://h.x/1", PAGE.format(i, notice="<div><b>We moved.</b></div>" if i % 3 else "",
                                            paragraphs="".join(f"<p>Words {i} {k}.</p>" for k in range(1 + i % 5)))) for i in range(60)]
    out = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "\n".join([f"Head {i}", *[f"Words {i} {k}." for k in range(1 + i % 5)]]) for i in range(60)}


def plain(rows, at_once):
    """The extraction of (id, url, html) rows without Spark."""
    read = {k: (html_extract.page_blocks(h or ""), re.sub(r"^[a-z]+://([^/]+).*", r"\1", u)) for k, u, h in rows}
    kinds = defaultdict(set)
    for (_, root, found), host in read.values():
        if found:
            kinds[host].add(trees.dumps(root))
    out = {}
    for host, texts in kinds.items():
        root = trees.loads(trees.template(list(texts)))
        numbers = {id(n): i for i, n in enumerate(trees.preorder(root))}
        tags = [n.label.split(".")[0] for n in trees.preorder(root)]
        placed, pages, holders, sums = {}, defaultdict(set), defaultdict(set), defaultdict(lambda: [0, 0])
        for k, ((stands, skeleton, found), h) in read.items():
            if h == host and found:
                places = trees.places(root, numbers, trees.loads(trees.dumps(skeleton)))
                placed[k] = [(places[i], b.text, html_extract.signed(b.text), b.inside) for i, b in found]
                for (i, _, t, _), (_, b) in zip(placed[k], found, strict=True):
                    pages[i].add(stands)
                    holders[i, t].add(stands)
                    sums[i][0] += len(b.text)
                    sums[i][1] += b.linked
        slots = {i: html_extract.Slot(len(p), *sums[i], sum(j == i for j, _ in holders), [t for (j, t), s in holders.items() if j == i and len(p) >= 5 and len(s) >= 0.8 * len(p)])
                 for i, p in pages.items()}
        known = html_extract.wrapper(root, slots)
        out |= {k: html_extract.main_text(b, known, tags) for k, b in placed.items()}
    return {k: out.get(k, "") for k in read}


def bare(html):
    """The page with div for every element that says what it holds."""
    return re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|form)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", html or ""))


def test_against_a_plain_version(spark):
    pages = table(spark, SF, "pages").select("page_id", "url", "html").collect()
    rows = [(r.page_id, r.url, bare(r.html)) for r in pages]
    want = plain(rows, 64)
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in out} == want
    asked = html_extract.extract(spark.createDataFrame([(r.page_id, r.url, r.html) for r in pages], "page_id long, url string, html string"))
    truth = {r.page_id: r.main_text for r in asked.collect()}
    assert plain([(r.page_id, r.url, r.html) for r in pages], 64) == truth
    # only the template tells content in the bare pages, and it tells nearly all of it
    alone = {k: "\n".join(b.text for b in html_extract.blocks(h)) for k, _, h in rows}
    assert sum(alone[k] == truth[k] for k in truth) < 0.05 * len(truth)
    assert sum(want[k] == truth[k] for k in truth) >= 0.95 * len(truth)


def test_the_result_is_the_same_without_broadcast(spark, monkeypatch):
    rows = [(i, f"http://{'h' if i % 3 else 'k'}.x/1", PAGE.format(i, notice="", paragraphs=f"<p>Words {i}.</p>" + "<ul><li>a<p>b</ul>" * (i % 4))) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(html_extract.extract(df).collect())
    monkeypatch.setattr(html_extract, "bounded", lambda small: (small, False))
    monkeypatch.setattr(html_extract, "AT_ONCE", 2)
    assert sorted(html_extract.extract(df).collect()) == one


def test_large_trees_are_matched_like_small_ones():
    """Over 10,000 pairs of children, and more than 4 million pairs of nodes: the best alignment still."""
    rng = random.Random(8)
    a, b = (["r", *[["a", *[[rng.choice("xyz")] for _ in range(rng.randint(1, 3))]] if rng.random() < 0.5 else ["b", ["c"]] for _ in range(n)]] for n in (130, 140))
    x, y = load(a), load(b)
    best = textbook(a, b)
    assert trees.match(x, y, trees.Pairs(x, y)) == best
    both = len(trees.preorder(x)) + len(trees.preorder(y)) - best
    trees.merge(x, y)
    assert len(trees.preorder(x)) == both  # the places are those of the score
    wide = [["a", ["x"]] if i % 2 else ["b", ["y"]] for i in range(3000)]
    x, y = load(["r", *wide]), load(["r", ["a", ["z"]], *wide[:1500], ["c"], *wide[1500:], ["b", ["z"]]])
    assert trees.match(x, y, trees.Pairs(x, y)) == 6001
