import numpy as np
import pytest

from kelpforge.llm import dom, wrapper


def sentence(rng, n=12):
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def site(rng, kind, copies=None):
    """A page of one layout and the text that it should give."""
    title, body = sentence(rng, 5), copies or [sentence(rng, 20) for _ in range(rng.integers(1, 6))]
    menu = "".join(f"<li><a href='/{k}'>{sentence(rng, 1)}</a></li>" for k in range(4))
    ad, foot, remark = sentence(rng), sentence(rng), sentence(rng)
    if kind == "article":
        html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav><!-- x --><div class='ad'>{ad}</div><article><h1>{title}</h1>"
        html += "".join(f"<p>{x.replace('é', '&eacute;')}</p>" for x in body)
        html += f"<div class=share>Share this</div><p>All rights are with the authors of this site.</p><section class='comments'><p>{remark}</p></section></article><footer>&copy; {foot}</footer>"
    elif kind == "divs":
        html = f"<html><body><div id=top-menu><ul>{menu}</ul></div><div class='cookie-notice'>We use cookies</div><div id='wrap'><div class='post-content'><h2>{title}</h2>"
        html += "".join(f"<p>{x}<br>" for x in body)
        html += f"<form><input name=q>Search</form></div><div class=sidebar>{ad}</div></div><div id=comments><h3>Comments</h3><p>{remark}</p></div><div id=footer>{foot}</div>"
    else:
        html = f"<body><header><a>Site</a></header><main><h1>{title}</h1><ul>" + "".join(f"<li>{x}" for x in body)
        html += f"</ul><aside>{ad}</aside></main><div class='modal popup'><p>{remark}</p></div></body>"
    return html, "\n\n".join([title, *body])


@pytest.mark.parametrize("pages", [1, 40])
def test_layouts(spark, pages):
    rng = np.random.default_rng(pages)
    rows, want = [], {}
    for kind in ("article", "divs", "main"):
        for _ in range(pages):
            html, text = site(rng, kind)
            want[len(rows)] = text + ("\n\nAll rights are with the authors of this site." if kind == "article" and pages == 1 else "")
            rows.append((len(rows), f"https://{kind}.example.org:80/x{len(rows)}?a=b", html, "clash"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    got = {r.page_id: r.text for r in wrapper.extract(frame).collect()}
    assert got == want


@pytest.mark.parametrize("pages", [3, 11])
def test_notices_of_small_hosts_are_template(spark, pages):
    rng = np.random.default_rng(pages)
    made = [site(rng, "article") for _ in range(pages)]
    made.append((made[0][0].replace("<nav>", "<nav>Other menu"), made[0][1]))
    frame = spark.createDataFrame([(k, "http://small.example/", html) for k, (html, _) in enumerate(made)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.extract(frame.repartition(2)).collect()} == {k: text for k, (_, text) in enumerate(made)}
    copies = spark.createDataFrame([(k, "http://c.example/", made[0][0].replace("<nav>", f"<nav>{k}")) for k in range(pages)], "page_id long, url string, html string")
    assert all(made[0][1] in r.text for r in wrapper.extract(copies).collect())


def test_notice_beside_many_paragraphs_is_template():
    known, pages = wrapper.Wrapper(), []
    for k in range(4):
        pages.append("<article>" + "".join(f"<p>a{k} paragraph {n}</p>" for n in range(90)) + "<p>zz all rights reserved</p></article>")
        known.add(wrapper.Wrapper.load(wrapper.Wrapper.of_page(pages[-1]).dump()))
    for k, html in enumerate(pages):
        assert wrapper.extract_text(html, known) == "\n\n".join(f"a{k} paragraph {n}" for n in range(90))


def test_pruning_breaks_ties():
    root = ["html", 2, [], [[f"div.a{k}", 2, [], [["p", 1, [], []]]] for k in range(3000)]]
    left = wrapper._prune(root)
    assert [x[0] for x in left[3]] == [f"div.a{k}" for k in range(wrapper.MAX_NODES - 1)] and not any(x[3] for x in left[3])


def test_copies_on_a_host_are_not_template(spark):
    rng = np.random.default_rng(9)
    body = [sentence(rng) for _ in range(3)]
    html, text = site(rng, "main", copies=body)
    rows = [(k, "http://h.example/", html) for k in range(60)]
    assert {r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {text}


def test_broken_markup_keeps_text():
    page = "<article><h1>A&amp;B &am; &amp</h1><p><b>One<br>two &nbsp; three<p>x < y<table><tr><td>1<td>2<tr><td>3</table><![CDATA[raw]]> tail<!-- open"
    assert wrapper.extract_text(page, wrapper.Wrapper()) == "\n\n".join(["A&B &am; &", "One two three", "x < y", "1", "2", "3", "raw tail"])
    deep = "<div>" * 5000 + "<p>deep</p>" + "<b>" * 5000 + "more"
    assert wrapper.extract_text(deep, wrapper.Wrapper()).split() == ["deep", "more"]
    assert wrapper.extract_text("just text", wrapper.Wrapper()) == "just text"
    assert wrapper.extract_text("<p>" + "long " * 300_000, wrapper.Wrapper()).count("long") == 300_000


def brute_matching(a, b):
    """The most pairs over all order-keeping matchings."""
    if a[0] != b[0]:
        return 0

    def forest(p, q):
        if not p or not q:
            return 0
        return max(forest(p[1:], q), forest(p, q[1:]), brute_matching(p[0], q[0]) + forest(p[1:], q[1:]))

    return 1 + forest(a[3], b[3])


def test_simple_tree_matching():
    rng = np.random.default_rng(4)

    def tree(depth):
        return [str(rng.choice(list("abc"))), 1, [], [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    def matched(x, y):
        return 1 + sum(matched(p, q) for p, q in wrapper.match(x, y))

    for _ in range(60):
        a, b = tree(3), tree(3)
        b[0] = a[0]
        assert matched(a, b) == brute_matching(a, b)


def test_nulls_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    rows = [(None, None, None), (1, "not a url", ""), (1, None, "<p>x</p>")]
    got = wrapper.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == [("1", "None", "x"), ("1", "not a url", ""), ("None", "None", "")]
    assert wrapper.extract(spark.createDataFrame([], schema)).count() == 0


def test_host():
    assert dom.clean([" a&nbsp;b\n", " c "]) == "a b c"


def test_deep_menus_and_names_around_the_title():
    deep = "<div>" * 160 + "<nav>menu</nav><p>kept</p>" + "</div>" * 160
    assert wrapper.extract_text(f"<body>{deep}</body>", wrapper.Wrapper()) == "kept"
    page = '<body><div class="related-work"><h1>Title</h1><p>Text of the page.</p></div><div class="related"><p>More like this</p></div><div class="comments"><h1>Remarks</h1></div></body>'
    assert wrapper.extract_text(page, wrapper.Wrapper()) == "Title\n\nText of the page."
    known = wrapper.Wrapper()
    for k in range(3):
        known.add(wrapper.Wrapper.of_page("<div>" * 900 + f"<p>page {k}</p>"))
    assert wrapper.extract_text("<div>" * 900 + "<p>page 7</p>", known) == "page 7"
