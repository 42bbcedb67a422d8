"""Selectors over markup of all kinds, and the pages against a plain reading."""

import pytest

from witnessframe.operators.markup import Reader, parse_selector, selector_values

PAGE = """<!doctype html><HTML lang='e&amp;n'><head><title> A &copy; &lt;b&gt; &hearts;
 c </title><style>p { color: red }</style></head>
<body id=main class="one two"><!-- <p class=x>no</p> -->
<p class=x data-n=1>first<p CLASS='x y' data-n="2">second <b>bold</b><script>var s = "<p>";</script>
<div class="box inner"><ul><li>a<li class="x">b <a href=/plain>plain</a><li>c<ul><li><a HREF='/q?a=1&amp;b=2'>q</a></ul></ul></div>
<div><span><a href="/deep" target>deep</a></span></div><img src=x.png alt=""><br/><div/>open
<table><tr><td>1<td class=x>2<tr><td>3</table></p>tail</body>"""

CASES = [
    ("count", "p", None, 3), ("count", "p.x", None, 2), ("count", ".x", None, 4), ("count", "p.x.y", None, 1), ("count", "li", None, 4), ("count", "ul li", None, 4),
    ("count", "div > ul > li", None, 3), ("count", "ul ul > li", None, 1), ("count", "a[href]", None, 3), ("count", "a[target]", None, 1), ("count", "a[href^='/']", None, 3),
    ("count", "a[href$=deep], li.x a", None, 2), ("count", "[data-n='2']", None, 1), ("count", "body#main.two", None, 1), ("count", "*", None, 31), ("count", "td", None, 3),
    ("count", "tr", None, 2), ("count", "div span > a", None, 1), ("count", "div > a", None, 0), ("count", "span a[href*=ee]", None, 1), ("count", "html body > p", None, 2),
    ("text", "title", None, "A © <b> ♥ c"), ("text", "p.y", None, "second bold"), ("text", "li.x", None, "b plain"), ("text", "td.x", None, "2"), ("text", "nothing", None, None),
    ("text", "img", None, ""), ("attribute", "html", "lang", "e&n"), ("attribute", "ul ul a", "href", "/q?a=1&b=2"), ("attribute", "li a", "href", "/plain"),
    ("attribute", "img", "alt", ""), ("attribute", "img", "title", None), ("attribute", "nav", "id", None), ("attribute", "p", "DATA-N".lower(), "1"),
]


@pytest.mark.parametrize("kind,selector,attribute,expected", CASES)
def test_selector(kind, selector, attribute, expected):
    assert Reader([(kind, parse_selector(selector), attribute)]).read(PAGE) == [expected]


@pytest.mark.parametrize("text", ["", "p >", "> p", "p,,q", "p:first-child", "a[", "p..x", ", p"])
def test_unknown_selectors_raise(text):
    with pytest.raises(ValueError):
        parse_selector(text)


def test_all_in_one_pass_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, PAGE, "k"), (2, None, None), (3, "", "e"), (4, "<<p <p>x</q></p></p>&#65;&bogus; <a href", "o"), (5, "<div>" * 3000 + "<p>deep" + "</q>" * 3000, "d")], "id int, html string, own string")
    wanted = {"n": ("count", "p"), "deep": ("count", "div div div > div div p"), "t": ("text", "p"), "h": ("attribute", "a", "href")}
    out = {r.id: (r.own, r.n, r.t, r.h) for r in selector_values(pages, wanted).collect()}
    assert out[1] == ("k", 3, "first", "/plain") and out[2] == (None, 0, None, None) and out[3] == ("e", 0, None, None) and out[5] == ("d", 1, "deep", None)
    assert out[4][1] >= 2
    with pytest.raises(ValueError):
        selector_values(pages, {"x": ("attribute", "a")})
