"""Broken pages take time in proportion; class names are read whole; inline elements."""

import time

import pytest

from flowbook.llm.html_extract import blocks


def kept(page):
    return [b.text for b in blocks(page) if not b.out]


@pytest.mark.parametrize("piece", ["<a b ", '<a "', "<!x ", "<a x='", '<p a="', "<", "</", "<!--", "<a b=c d", "<x='\""])
def test_a_megabyte_of_unclosed_tags(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    blocks(page)
    assert time.time() - began < 5


@pytest.mark.parametrize("page, texts", [
    ('<article class="related-work"><p>T</p></article>', ["T"]),
    ('<article><div class="social-science">A</div><p id="menu-ideas">B</p><p class="no-comment">C</p></article>', ["A", "B", "C"]),
    ('<article><p>x</p><div class="cookie-banner">n</div><div class="ad-slot-300">n</div><ul id="share-buttons"><li>n</ul><div class="comments">n</div></article>', ["x"]),
    ('<article class="teaser"><p>n</p></article><article><p>T</p></article>', ["T"]),
    ("<article><p>a <script>x</script>b <svg><text>q</text></svg>c <picture><img src=i></picture>d</p></article>", ["a b c d"]),
    ("<article><p>e <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <button>Buy</button>f</p></article>", ["e x=1 f"]),
    ('<article><p>a <span class="advert">BUY</span>b<i style="display: none">h</i> <a href=x>c</a></p></article>', ["a b c"]),
    ("<article><p class=it's>T</p><p title='a > b'>U</p><p title=\"c\"d>V</p></article>", ["T", "U", "V"]),
    ("<article><p>1 < 2 and 3 > 2</p></article>", ["1 < 2 and 3 > 2"])])
def test_main_text(page, texts):
    assert kept(page) == texts
