"""Pages whose skipped elements are closed by a slash or not at all, with letters that change length, or nested deeply."""

import time

import pytest

from gristmill.llm import pages


def texts(page):
    return [pages.words(b) for b in pages.parse(page)[1]]


@pytest.mark.parametrize("start", ["<svg width='1'/>", "<math/>", "<SVG />", "<object data='x'>", "<template>", "<select>", "<svg>"])
def test_text_behind_elements_that_do_not_end(start):
    assert texts(f"<p>one {start} two</p><p>three</p>") == ["one two", "three"]


def test_skipped_elements_end_at_their_tag():
    assert texts("<p>a<svg><text>no</text></SVG >b</p><svg/><p>c</p><svg>no</svg><p>d</p>") == ["ab", "c", "d"]
    assert texts("<script>x = '</scripture>'</script>b<style>no") == ["b"]


def test_letters_that_change_length():
    dotted = "İ" * 40
    assert texts(f"<p>{dotted}</p><script>no</script><p>first words</p><style>no</style><p>then</p><svg>no</svg>last") == [dotted, "first words", "then", "last"]


def test_end_tags_of_deep_elements_close_only_these():
    deep = 300
    root, blocks = pages.parse("<article><div>" + "<div>" * deep + "x" + "</div>" * deep + "inside</div>after</article>out")
    assert [pages.words(b) for b in blocks] == ["x", "inside", "after", "out"]
    assert [b.parent.tag for b in blocks[1:]] == ["div", "article", "#root"]


def test_broken_pages_stay_linear():
    begun = time.time()
    for part in ("<object>", "<select>a", "<div></p></section>", "<div><li>", "<table><td><div>"):
        pages.parse(part * 20_000)
    assert time.time() - begun < 20
