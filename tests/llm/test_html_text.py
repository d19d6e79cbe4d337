import numpy as np
import pytest

from cairnfield.llm import html_text as H

PARAGRAPHS = ["A first paragraph of some length, with words enough to be one.", "Short.", "Another paragraph that goes on for a while & ends, as <all> do, in a full stop.", "The last of them says little but says it at length, for the sake of its ratio."]
ESCAPED = [p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for p in PARAGRAPHS]
BODY = "".join(f"<p>{p}</p>" for p in ESCAPED)
TEXT = " ".join(["Title", *PARAGRAPHS])
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(12)) + "</ul>"
NOISE = "Words that nobody came for, though there are many of them in this place. " * 9

LAYOUTS = {
    "plain": f"<article><h1>Title</h1>{BODY}</article>",
    "around": f"<header><p>{NOISE}</p></header><nav>{MENU}</nav><main><article><h1>Title</h1>{BODY}</article></main><aside><p>{NOISE}</p></aside><footer><p>{NOISE}</p></footer>",
    "classes": f'<div class="top-menu">{MENU}</div><div id="cookieNotice"><p>{NOISE}</p></div><div class="ad">{NOISE}</div><div id="content"><h1>Title</h1>{BODY}</div><div class="side sidebar"><p>{NOISE}</p></div><div id="comments"><p>{NOISE * 9}</p></div>',
    "inside": f'<article><h1>Title</h1><form><label>Mail</label><input><button>Send</button><p>{NOISE}</p></form><div class="ad-slot ad">{NOISE}</div>{BODY}<section class="comments"><article><p>{NOISE}</p></article></section><footer>By us</footer></article>',
    "soup": f"<table><tr><td>{MENU}</td><td><h1>Title</h1>{BODY}</td></tr></table>",
    "roles": f'<div role="navigation">{MENU}</div><div role="banner">{NOISE}</div><main><h1>Title</h1>{BODY}<div role="complementary">{NOISE}</div><p hidden>{NOISE}</p><div style="display: none">{NOISE}</div></main>',
    "unclosed": f'<nav>{MENU}</nav><div class="ad">{NOISE}<article><h1>Title</h1>' + "".join(f"<p><b>{p}<br>" for p in ESCAPED),
    "form around": f"<form><div>{MENU}</div><div><h1>Title</h1>{BODY}</div></form>",
    "teasers": f'<div class="related"><article><p>{NOISE}</p></article></div><article><p>A teaser</p></article><article><h1>Title</h1>{BODY}</article>',
    "scripts": f"<script>var t = '</p>{NOISE}';</script><style>p {{ margin: 0 }}</style><noscript>{NOISE}</noscript><article><h1>Title</h1>{BODY}<script>x</script><!-- {NOISE} --></article>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert H.main_text(f"<!DOCTYPE html><html><head><title>{NOISE}</title></head><body>{LAYOUTS[layout]}</body></html>") == TEXT


def test_white_space_markup_and_references():
    html = "<article><p>a\n\t b<br>c<i>d</i>e <span>f</span></p><p>&eacute;&#33;&amp&nbsp;x &notaword; &am</p><ul><li>one<li>two</ul>tail</article>"
    assert H.main_text(html) == "a b cde f é!& x ¬aword; &am one two tail"
    assert H.main_text("") == H.main_text("<p>") == H.main_text("<nav>only</nav>") == H.main_text("</div></p><!--") == ""
    assert H.main_text(f"<div>{NOISE}</div><main><article><p>Be.</p></article></main>") == "Be."
    assert H.main_text("just words") == "just words"


def test_ratios_are_smoothed_and_clustered():
    ratios = np.array([1, 1, 1, 1, 1, 1, 1, 1, 90, 2, 80, 95, 70, 1, 1, 1, 1, 1, 1, 1, 1.0])
    flat = H.smoothed(ratios)
    assert len(flat) == len(ratios) and flat.sum() == pytest.approx(ratios.sum(), rel=0.05) and flat.std() < ratios.std()
    assert np.flatnonzero(H.clustered(ratios)).tolist() == list(range(7, 15))
    assert H.smoothed(np.zeros(0)).size == 0 and H.clustered(np.zeros(0)).size == 0


def test_long_and_deep_pages():
    many = "<article>" + "<p>word word word</p>" * 60000 + "</article>"
    assert H.main_text(many) == " ".join(["word word word"] * 60000)
    deep = "<div>" * 20000 + "<p>" + "x " * 20000 + "</p>"
    assert H.main_text(deep) == ("x " * 20000).strip()
    assert H.main_text("<article><p>" + "y" * 5_000_000) == "y" * 5_000_000


def test_rows(spark):
    table = "page_id long, url string, html string, text string, lang string"
    rows = [(1, "u", LAYOUTS["around"], "old", None), (1, "u", LAYOUTS["around"], "old", None), (None, None, None, None, None), (2, "v", "", None, "x")]
    got = H.extract(spark.createDataFrame(rows, table))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert H.extract(spark.createDataFrame([], table)).collect() == []
    assert H.extract(spark.createDataFrame(rows, table), keep=("html", "lang")).columns == ["html", "lang", "text", "n_chars"]
    with pytest.raises(ValueError, match="text"):
        H.extract(spark.createDataFrame(rows, table), keep=("page_id", "text"))
