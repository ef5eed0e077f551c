"""The ratios decide: pages without article and main, comments without telling names, and a second, plain form of the method."""

import math
import re

import numpy as np
import pytest

from chunkweave.llm import html as method
from chunkweave.llm.html import main_text
from tests.llm.test_html import LONG

TEXT = LONG.strip()
MENU = "".join(f"<li><a href={i}>go {i}</a></li>" for i in range(9))
COMMENT = "<div class=c><b>{}</b> wrote 2 days ago<p>" + "I have read this twice and I still think that it is right. " * 3 + "</p><a href=#>Reply</a></div>"

NEUTRAL = [
    (f"<body><div class=x1><ul>{MENU}</ul></div><div class=x2><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class=x3><ul>{MENU}</ul></div></body>", f"Head {TEXT} {TEXT}"),
    (f"<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a><br><a href=4>d</a><br><a href=5>e</a></div><section><p>{LONG}<p>{LONG}<p>{LONG}</section><div><ul>{MENU}</ul></div>", f"{TEXT} {TEXT} {TEXT}"),
    (f"<table><tr><td><div>{'<br>'.join('<a href=x>go there now again</a>' for _ in range(12))}</div><td><div><p>{LONG}<p>{LONG}</div></table>", f"{TEXT} {TEXT}"),
]


@pytest.mark.parametrize("page,want", NEUTRAL)
def test_ratios_choose_on_pages_without_names(page, want, monkeypatch):
    assert main_text(page) == want
    monkeypatch.setattr(method, "threshold", lambda scores: (-math.inf, -math.inf))
    assert main_text(page) != want


def test_smoothing_counts(monkeypatch):
    page = f"<div><ul>{MENU}</ul></div><div><p>{LONG}</p><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><ul><li>a<li>b</ul></div>"
    scores = []
    monkeypatch.setattr(method, "threshold", lambda s, real=method.threshold: scores.append(s) or real(s))
    main_text(page)
    monkeypatch.setattr(method, "smoothed", lambda ratios: ratios)
    main_text(page)
    assert scores[0][-4] > scores[1][-4] + 1  # a short line among long ones


def test_names_are_evidence_only():
    page = f"<article><p>{LONG}</p><div class='legal'><p>{LONG * 60}</p><p>{LONG * 60}</p></div><p>{LONG}</p></article><nav><ul>{MENU}</ul></nav>"
    assert LONG * 60 in main_text(page) + " " and "go 1" not in main_text(page)


@pytest.mark.parametrize("around", ["<div class='user-feedback'>{}</div>", "<div class=zz>{}</div>", "<section><h3>3 Comments</h3>{}</section>"])
def test_comments_in_an_article(around):
    comments = around.format("".join(COMMENT.format(n) for n in ("Ann", "Bo", "Cy")))
    page = f"<nav><ul>{MENU}</ul></nav><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>{comments}</article><footer>f</footer>"
    assert main_text(page) == f"Head {TEXT} {TEXT}"


def test_sections_alike_are_no_comments():
    page = f"<article><h1>T</h1>{''.join(f'<section class=s><h2>Part {i}</h2><p>{LONG}</p></section>' for i in range(3))}</article>"
    assert main_text(page) == " ".join(["T", *(f"Part {i} {TEXT}" for i in range(3))])


def test_unclosed_tags():
    page = f"<nav><ul>{MENU}<li><a>go</nav><div class=text><p>{LONG}<p>{LONG}<b>x"
    assert TEXT in main_text(page)
    assert main_text(f"<article><p>{LONG}<ul><li>a<li>b<p>{LONG}") == f"{TEXT} a b {TEXT}"


def plain(page):
    """Lines by regular expressions, for pages of flat div, ul, li, p and a elements; no evidence."""
    lines, box, tags, parts = [], 0, 0, ""
    boxes = 0
    for tag, text in re.findall(r"<([^>]*)>|([^<]+)", page):
        name = tag.split(" ")[0]
        if tag and name.strip("/") != "a" and parts.strip():
            lines.append((" ".join(parts.split()), max(tags + 1, 1), box))
            tags, parts = 0, ""
        elif tag:
            tags += 1
        if name == "div":
            boxes += 1
            box = boxes
        elif name == "/div":
            box = 0
        parts += text
    x = [math.log(len(t) / n) for t, n, _ in lines]
    weight = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    scores = [sum(weight(i - j) * x[j] for j in range(len(x))) / sum(weight(i - j) for j in range(len(x))) for i in range(len(x))]
    cut = sum(scores) / len(scores)
    for _ in range(50):
        low, high = [s for s in scores if s < cut], [s for s in scores if s >= cut]
        if not low or not high:
            break
        cut = (sum(low) / len(low) + sum(high) / len(high)) / 2
    kept = {b for _, _, b in lines if 2 * sum(len(t) for (t, _, c), s in zip(lines, scores) if c == b and s >= cut) >= sum(len(t) for t, _, c in lines if c == b)}
    return " ".join(t for t, _, b in lines if b in kept)


@pytest.mark.parametrize("seed", range(20))
def test_against_a_plain_form(seed):
    r = np.random.default_rng(seed)
    words = lambda n: " ".join(r.choice(["some", "words", "of", "text"], n))
    boxes = []
    for _ in range(r.integers(2, 7)):
        if r.random() < 0.5:
            boxes.append("<div>" + "".join(f"<p><a href=x>{words(1)}</a><a href=y>{words(1)}</a></p>" for _ in range(r.integers(1, 6))) + "</div>")
        else:
            boxes.append("<div>" + "".join(f"<p>{words(r.integers(20, 80))}</p>" for _ in range(r.integers(1, 6))) + "</div>")
    page = "".join(boxes)
    got, want = main_text(page), plain(page)
    assert got == want
