"""op7 on pages that aren't of the training pages' maker, and on markup that is hard to read."""

from pages_by_hand import PAGES

from tidefold.llm import html_text


def test_pages_written_by_hand():
    """Of all blocks at least 95 in 100 are judged right, and most pages come out exactly."""
    model, right, blocks, whole = html_text.default_model(), 0, 0, 0
    for html, article in PAGES:
        page = html_text.Page(html)
        texts = [t for t in page.text if t]
        found = model.blocks(html)
        right += sum((t in article) == (t in found) for t in texts)
        blocks += len(texts)
        whole += found == article
    assert right >= 0.95 * blocks and whole >= 8


def test_link_lists_and_names_sink_no_article():
    for html, article in PAGES[1:5]:
        found = html_text.default_model().blocks(html)
        assert set(article) <= set(found)


def test_markup_that_is_hard_to_read():
    text = lambda html: [t for t in html_text.Page(html).text if t]
    assert text("<p data-t=it's>Hello world</p><p>don't stop</p><p>end</p>") == ["Hello world", "don't stop", "end"]
    assert text('<p title="foo>Hello</p>') == ["Hello"] and text('<p title="a>b" x>in</p>') == ["in"]
    assert text("<script src=/a/b/>var leak=1;</script>x") == ["x"]
    assert text("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b</p>") == ["a x=2 b"]
    assert text("<svg><title>Logo</title><text>in</text></svg>out<svg/>q") == ["inoutq"]
    assert text("<svg><p>open</p>") == ["open"] and text("<p>x<template>in") == ["xin"] and text("a <script>never") == ["a"]
    assert text("<title>T &amp; u</title><p>b") == ["T & u", "b"] and text("<textarea>no</textarea>yes") == ["no", "yes"]
    assert text("<video>old browser</video> <object>fall</object><canvas>back</canvas>") == ["old browser fallback"]
    assert text("<!-->hi<!-- x --!>yo") == ["hiyo"] and text("<div" + " x='" * 2000 + ">in</div>") == ["in"]
