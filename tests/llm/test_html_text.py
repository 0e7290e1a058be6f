from codeloom.llm.html_text import extract, main_text


def test_article_without_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">Buy.</div><article><h1>Head &amp; tail</h1><p><b>One<br><p>Be.</p>
    <p>Two&nbsp;  <i>th</i>ree</p><div class="ad">Ad inside</div><p>Four</p><section id="comments"><p>Bad comment</p></section></article>
    <aside>side</aside><div class="cookie-notice">We use cookies</div><form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & tail One Be. Two three Four"


def test_without_article_the_largest_run_stays():
    page = "<body><div id=menu><a>Home</a></div><p>Some long text of the page itself.</p><p>And more.</p><div class='sidebar'>other</div><p>x</p></body>"
    assert main_text(page) == "Some long text of the page itself. And more."


def test_odd_pages():
    for page in ("", "plain text", "<", "<p", "a < b", "<script>never ends", "<nav><article><p>kept</p>", "</p></div>", "<p>&#0;&#x110000;</p>"):
        main_text(page)
    assert main_text("plain text") == "plain text"
    assert main_text("<nav>menu<article><p>kept</p>") == "kept"
    assert len(main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").split()) == 50_000


def test_rows(spark):
    rows = [(1, None, None), (1, "u", "<article>x</article>"), (None, "u", "")]
    got = sorted(map(str, extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == sorted(["Row(page_id=1, url=None, text='', n_chars=0)", "Row(page_id=1, url='u', text='x', n_chars=1)", "Row(page_id=None, url='u', text='', n_chars=0)"])


def test_end_tags_that_pages_omit():
    assert main_text("<article><p class=ad>Buy<p>Two</p><p>Three</p></article>") == "Two Three"
    assert main_text("<ul><li class=ad>Buy<li>Two<li>Three</ul>") == "Two Three"
    assert main_text("<table><tr><td class=ad>Buy<td>Two<tr><td>Three</table>") == "Two Three"
    assert main_text("<article><dl><dt>One<dd class=promo>Buy<dt>Two<dd>Three</dl></article>") == "One Two Three"
    assert main_text("<div><nav>menu</div><p>Two") == "Two"
    assert main_text("<head><title>T</title><body><p>Two") == "Two"


def test_marked_wrappers_of_the_content_stay():
    side = "<p>Long text of the page itself.</p><div class=sidebar>other</div>"
    for mark in ("layout has-sidebar", "page with-banner", "nav-open"):
        for around in ("<body>{}</body>", "<main>{}</main>"):
            assert main_text(around.format(f"<div class='{mark}'>{side}</div>")) == "Long text of the page itself."
    assert main_text("<article><p>Short.</p><div id=comments>a discussion that is longer</div></article>") == "Short."


def test_without_article_both_sides_of_boilerplate_stay():
    for between in ("<aside>ad</aside>", "<form>mail</form>", "<div class=ad>Buy</div>", "<button>Share</button>", "<video>v</video>"):
        assert main_text(f"<div class=content><h1>T</h1><p>AAAA</p>{between}<p>BBBB</p></div>") == "T AAAA BBBB"
        assert main_text(f"<body><h1>T</h1>{between}<p>{'Some words. ' * 40}</p>{between}<p>word</p>{between}<p>The end.</p></body>") == f"T {'Some words. ' * 40}word The end."
        assert main_text(f"<div><div class=content><p>{'Some words. ' * 40}</p>{between}<p>end</p></div><div>{between}x</div></div>") == f"{'Some words. ' * 40}end"
    assert main_text("<table><tr><td>" + "word " * 40 + "<aside>ad</aside><p>end") == "word " * 40 + "end"


def test_plain_menus_and_copyright_lines_outside_an_article_go():
    text = "A first paragraph that goes on for a while and says something. " * 4
    menu, foot = "<div>Home About Contact</div><div><a href=/a>Some</a> <a href=/b>of the longer links of this site here</a></div>", "<div>Copyright 2024 The Company and all others. All rights reserved.</div><div>Imprint</div>"
    want = f"Head {text}short {text}".strip()
    assert main_text(f"<body>{menu}<h1>Head</h1><p>{text}</p><p>short</p><p>{text}</p>{foot}</body>") == want
    assert main_text(f"<body>{menu}<div class=content><h1>Head</h1><p>{text}</p><p>short</p><p>{text}</p></div>{foot}</body>") == want


def test_formulas_and_words_of_boilerplate_inside_the_article_stay():
    assert main_text("<article><p>Sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is.</p></article>") == "Sum x+y is."


def test_hostile_pages_take_linear_time():
    import time

    for unit in ("<a ", "<a '", '<p title="', "<div>", "<p><b>", "<!--", "<script>", "<a href='x'>y</a> ", "</p>", "<li>", "&amp;", "<article><div><p>"):
        start = time.time()
        main_text(unit * 20_000)
        assert time.time() - start < 5, unit


def test_windows_equal_plain_sums():
    """Surge and dive against sums taken anew at every line."""
    import random

    from codeloom.llm import html_text

    rng = random.Random(3)
    for _ in range(100):
        page = "".join(rng.choice(["<p>word word.</p>", "<aside>x</aside>", "<article><p>in it</p></article>", "<div>menu</div>", "<nav>n</nav>", "<h2>Head</h2>"]) for _ in range(rng.randint(1, 12)))
        lines = html_text.lines_of(html_text._Tree(page))
        sums = [sum(len(t) for t, *_ in lines[max(0, i - html_text.WINDOW + 1) : i + 1]) for i in range(len(lines))]
        if "<article>" in page:
            runs, own = [], []
            for i, total in enumerate([*sums, 0]):
                if total:
                    own.append(i)
                elif own:
                    runs.append(own)
                    own = []
            want = " ".join(lines[i][0] for r in runs if any(lines[i][1] and lines[i][0] for i in r) for i in r if lines[i][0])
            assert main_text(page) == want


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, "u", "<p>One two.</p>", "x", 5)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert [tuple(r) for r in extract(spark.createDataFrame(rows, schema)).collect()] == [(1, "u", "One two.", 8)]
    assert extract(spark.createDataFrame([], schema)).count() == 0
