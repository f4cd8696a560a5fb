"""Tokens of pages against one plain pattern, their cost on broken pages, and lists between prose."""

import random
import re
import time

import pytest

from transcurve.llm import html_extract
from transcurve.llm.html_extract import Tokens, features, main_text, train

PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>", re.S)


def test_tokens_equal_a_plain_pattern():
    rng, parts = random.Random(1), ["<", "</", ">", "=", '"', "'", " ", "a", "b", "x=", "<a ", "<!--", "-->", "<![CDATA[", "]]>", "<!", "?>", "/", "\n", "é"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        want, at = [], 0
        while m := PLAIN.search(page, at):
            at = m.end()
            want.append((m.start(), m.end(), m[1] + m[2] if m[2] else "", m[3] or ""))
        tokens, got, at = Tokens(page), [], 0
        while found := tokens.after(at):
            at = found[1]
            got.append(found[:4])
        assert got == want, page


@pytest.mark.parametrize("piece", ['<a x="', "<a ", '<a x="y>"', "<a", "<a =", "<!", "<script", "</script ", "<a x='\"", "<p>x", "<div><b>", "<li><ul>x", "<!--", "&amp;"])
@pytest.mark.parametrize("start", ["", "<script>"])
def test_a_megabyte_of_anything_is_read_in_linear_time(piece, start):
    began = time.process_time()
    html_extract.blocks(start + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def prose(n):
    return "<p>" + " ".join(f"word{i}" for i in range(n)) + ".</p>"


def test_lists_between_prose_stay_whole():
    tree = train()
    three = main_text(f"<body><div>{prose(60)}<ul><li>one<li>two<li>three</ul>{prose(60)}</div>", tree)
    assert "one\ntwo\nthree" in three
    items = [f"item {i} of eight" for i in range(8)]
    assert "\n".join(items) in main_text(f"<body><div>{prose(60)}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{prose(60)}</div>", tree)
    table = main_text(f"<body>{prose(60)}<table><tr><td>a<td>1<tr><td>b<td>2</table>{prose(60)}", tree)
    assert "a\n1\nb\n2" in table
    # a list of links isn't a unit, nor is one at the page's end
    links = "".join(f'<li><a href="#">link {i}</a></li>' for i in range(8))
    assert "link 3" not in main_text(f"<body>{prose(60)}<ul>{links}</ul>{prose(60)}", tree)
    assert "link" not in main_text(f"<body><ul>{links}</ul>{prose(60)}", tree)


def test_neighbours_of_units_stand_outside():
    found = html_extract.blocks(f"<body>{prose(30)}<ul><li>x</li><li>y<ul><li>z</li></ul></li></ul><p>end</p>")
    assert [b.listed for b in found] == [0, 1, 1, 1, 0]
    assert [(f[5], f[7]) for f in features(found)] == [(0, 1), (30, 1), (30, 1), (30, 1), (1, 0)]
