"""Raw elements of pages hide their own content and nothing after it."""

import pytest

from lumaspark.llm import html_crf


def texts(page):
    return [b.text for b in html_crf.blocks(page)]


@pytest.mark.parametrize("tag", ["svg", "iframe", "object", "noscript", "template"])
def test_raw_tags_closed_in_themselves_or_never(tag):
    assert texts(f'<article><p>One <{tag} class="icon" /> two.</p><p>Three.</p></article><p>Four.') == ["One two.", "Three.", "Four."]
    assert texts(f"<p>One.</p><{tag} a='b'/><p>Two.</p><{tag}>gone</{tag}><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts(f"<div><p>One <{tag} width=1>gone</p><p>Two.</p></div><p>Three.</p>") == ["One", "Two.", "Three."]
    assert texts(f"<div><{tag}><a>gone</a><p>One.</p></div>Two.<{tag}>gone<p>Three.") == ["One.", "Two.", "Three."]
    assert texts(f"<p>One <{tag}><p>gone</p></{tag}> two.</p>") == ["One two."]


@pytest.mark.parametrize("tag", ["script", "style", "textarea"])
def test_code_runs_to_its_end(tag):
    assert texts(f"<p>One.</p><{tag} src='x'/>gone</{tag}><p>Two.</p><{tag}>gone<p>gone</p>") == ["One.", "Two."]


def test_quotes_open_values_only_behind_an_equals_sign():
    assert texts("<article><p title=Bob's>Hello world.</p><p>It's fine.</p><p>More text.</p></article>") == ["Hello world.", "It's fine.", "More text."]
    assert texts("<p title=Bob's>Hello world.") == ["Hello world."]
    assert texts("<p title='a > b' data-x=\"<p>\">One.</p><p a=\"b>Two.</p><p>Three.") == ["One.", "Two.", "Three."]
    assert texts('<p "x">One.</p><p a = "1>2" b>Two.</p>') == ["One.", "Two."]


def test_sections_of_characters_are_no_text():
    assert texts("<p>One. <![CDATA[ x > y ]]></p><p>Two.<![CDATA[ z </p><p>Three.") == ["One.", "Two.", "Three."]


def test_controls_without_an_end_hide_only_their_text():
    assert texts("<label>Name<p>Article para.</p><p>Another.</p>") == ["Article para.", "Another."]
    assert texts("<p>A <button>go<p>Lost?</p>") == ["A", "Lost?"]
    assert texts("<form><label>Name</label><select><option>a<option>b</select><button>go</button></form><p>One.</p>") == ["One."]
    assert texts("<head><title>T</title><body><p>One.") == ["One."] and texts("<head><meta x><p>One.") == ["One."]


@pytest.mark.parametrize("part", ["<div>x", "<a \"", "<a x='", "<p><b><i>y", "<li><ul><div>z<li>", "<label>q<p>", '<div class="a{n} b">w', "<x-{n}>v", "<td><div>t", "<!--", "<![CDATA["])
def test_a_megabyte_of_broken_markup_takes_seconds(part):
    import time

    n = 1_000_000 // len(part)
    page = "".join(part.replace("{n}", "".join(chr(97 + int(d)) for d in str(i))) for i in range(n))
    model = html_crf.train([], composed=8)
    started = time.process_time()
    html_crf.main_text(model, page)
    assert time.process_time() - started < 12
