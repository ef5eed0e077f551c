"""Pages whose lists, quotes, tables, headings and formulas belong to the article."""

import pytest

from chunkweave.llm.html import main_text
from tests.llm.test_html import LONG

TEXT = LONG.strip()
MENU = "".join(f"<li><a href={i}>go {i}</a></li>" for i in range(8))

PAGES = [
    (f"<body><div class=nav><ul>{MENU}</ul></div><div><p>{LONG}</p><ul><li>a</li><li>b</li></ul><p>{LONG}</p></div></body>", f"{TEXT} a b {TEXT}"),
    (f"<body><div class=nav><ul>{MENU}</ul></div><div><p>{LONG}</p><blockquote>So.</blockquote><ol><li>x</ol><dl><dt>k<dd>v</dl><p>{LONG}</p></div></body>", f"{TEXT} So. x k v {TEXT}"),
    (f"<body><div class=nav><ul>{MENU}</ul></div><div><p>{LONG}</p><table><tr><td>1</td><td>2</td></tr></table><p>{LONG}</p></div></body>", f"{TEXT} 1 2 {TEXT}"),
    (f"<nav><ul>{MENU}</ul></nav><main><h1>Head</h1><article><p>{LONG}</p></article></main>", f"Head {TEXT}"),
    (f"<main><h1>Head</h1><article><p>{LONG}</p></article><p>End.</p></main><footer>{LONG}</footer>", f"Head {TEXT} End."),
    (f"<article><p>{LONG}</p><p>where <math><mi>m</mi></math> is</p><svg><title>t</title><text>Axis</text></svg><object>shown</object></article>", f"{TEXT} where m is Axis shown"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_whole_article(page, want):
    assert main_text(page) == want
