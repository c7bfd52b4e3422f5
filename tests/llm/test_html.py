from ballot.llm import html_extract as H

FIELD = H.default_field()


def test_held_out_layouts():
    pages = H.labelled(H.labelled_pages(60, seed=99))
    wrong = sum(a != b for names, gold in pages for a, b in zip(FIELD.decode(names), gold, strict=True))
    assert wrong <= 0.02 * sum(len(gold) for _, gold in pages)


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    names = H.features(H.leaf_blocks("<nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>Some text. And more.</p></article><footer>&copy; x</footer>"))
    emit = [[sum(FIELD.weights[FIELD.number[x], k] for x in f if x in FIELD.number) for k in (0, 1)] for f in names]
    score = lambda y: sum(e[k] for e, k in zip(emit, y, strict=True)) + sum(FIELD.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B905, E731
    assert tuple(FIELD.decode(names)) == max(product((0, 1), repeat=len(names)), key=score)


def test_blocks():
    got = H.leaf_blocks("<p>a <b>b</b>&amp;c<br>d<p>e&nbsp;f<script>var t='</p>';</script><ul><li>g<li>h</ul><!-- x --><div hidden>no</div>tail <foo")
    assert [b.text for b in got] == ["a b&c d", "e f", "g", "h", "no", "tail"]


def test_marks_of_input_pages_mean_nothing():
    for mark in ('data-gold="x"', 'data-gold=""', 'data-gold="1"', "data-gold"):
        (block,) = H.leaf_blocks(f"<p {mark}>hi</p>")
        assert block.text == "hi" and block.place.gold is None
    assert H.leaf_blocks('<p data-gold="1">hi</p>', marked=True)[0].place.gold == 1


def test_what_is_not_code_stays_with_the_field():
    got = H.leaf_blocks("<p>a <svg><text>in a picture</text></svg> b</p><noscript><p>no script</p></noscript><iframe><p>x</p></iframe><textarea>y</textarea><template><p>t</p></template>")
    assert [b.text for b in got] == ["a in a picture b", "no script", "t"]


def test_deep_pages_take_linear_time():
    import time

    def seconds(n, part, end=""):
        began = time.perf_counter()
        blocks = H.leaf_blocks(part * n + end * n)
        H.features(blocks)
        return time.perf_counter() - began, len(blocks)

    for part, end in (("<div>x", ""), ("<div>x", "</div>"), ("<b><p>x", ""), ("<span>x</i>", ""), ("<tbody><div>x</div>", ""), ("<li>x", "</ul>")):
        small, _ = seconds(5_000, part, end)
        large, _ = seconds(50_000, part, end)
        assert large < 30 * small + 0.5, (part, small, large)
    assert seconds(50_000, "<div>x")[1] == 50_000


def test_null_empty_and_cut_pages():
    assert [FIELD.text(x) for x in (None, "", "   ", "<div", "<!-- ")] == [""] * 5
    assert H.leaf_blocks(None) == [] and H.leaf_blocks("<!-- x") == []


def test_formulas_are_text():
    got = H.leaf_blocks("<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=tex>x = 2 tex</annotation><annotation-xml><ci>x</ci></annotation-xml></semantics></math> holds.</p>")
    assert [b.text for b in got] == ["So x=2 holds."]


def test_main_text_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Site</a></header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div>
    <article><h1>The &lt;title&gt;</h1><p>First  paragraph&nbsp;here, with <em>words</em>.</p><div class="ad">Buy this now.</div><p>Second one.</p></article>
    <section id="comments"><div class="comment"><p>I don't agree with any of this.</p></div></section>
    <form><label>Mail</label><button>Send</button></form><footer>&copy; 2020 Somebody</footer></body></html>"""
    assert FIELD.text(page) == "The <title> First paragraph here, with words . Second one.".replace("words .", "words.")


def test_articles_of_the_pages_table(spark):
    import re
    from html import unescape

    from ballot.llm.common import table
    from ballot.llm.queries import op9_main_text

    html = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.001", "pages").collect()}
    for r in op9_main_text(spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<[^>]*\Z|\Z)", html[r.page_id], re.S)
        want = " ".join(unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner[1]).replace("<b>", "")).split()) if inner else ""
        assert r.text == want and r.n_chars == len(want)
