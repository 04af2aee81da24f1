"""Pages with many siblings: the share of siblings of one kind is exact at any number."""

import pytest

from habitrace.llm import html_extract
from habitrace.llm.html_dom import parse

ALIKE = 12


@pytest.mark.parametrize("n", [20, 48, 49, 50, 400])
def test_alike_is_exact(n):
    blocks = parse("<html><body><article>" + "".join(f"<p>text {i}.</p>" for i in range(n)) + "<aside>advert</aside></article></body></html>")
    share = {b.tag: a for b, a in zip(blocks, html_extract.features(blocks)[:, ALIKE])}
    assert share["aside"] == pytest.approx(1 / (n + 1)) and share["p"] == pytest.approx(n / (n + 1))


def test_training_has_long_pages():
    longest = [max(len(b.children) for b in parse(p)) for p in html_extract.training_pages(80)]
    assert sum(n > 50 for n in longest) >= 3
