import json
import random

import pytest

from emendra.llm import html_wrapper as W
from emendra.llm.html_tree import read

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article_page(rng, main="article"):
    paras = [text(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
    body = "".join(f"<p>{p}</p>\n" if rng.random() < 0.7 else f"<p><b>{p}</b><br>" for p in paras)
    page = (
        f'<!DOCTYPE html><html><head><title>T &amp; {text(rng, 3)}</title><style>p{{}}</style><script>var a = "</p><b>";</script></head><body>'
        f'<header><h2>Site</h2></header><nav><ul>{"".join(f"<li><a href=/x>{text(rng, 2)}</a></li>" for _ in range(rng.randrange(2, 6)))}</ul></nav>'
        f'<div class="cookie-notice">We use cookies {text(rng, 9)}</div><!-- <p>hidden</p> --><div class="ad">Buy {text(rng, 12)}</div>'
        f"<{main}><h1>Head</h1>{body}<form><input name=a><label>Your mail</label></form></{main.split()[0]}>"
        f'<aside>{text(rng, 30)}</aside><section id="comments"><h3>Comments</h3><p>{text(rng, 60)}</p><p>{text(rng, 60)}</p></section>'
        f"<footer>&copy; 2020 {text(rng, 6)}</footer>" + ("</body></html>" if rng.random() < 0.5 else "")
    )
    return page, " ".join(["Head", *paras])


@pytest.mark.parametrize("main", ["article", "main", 'div class="post-content"', 'div class="xq1"'])
def test_main_text_of_templates(spark, main):
    rng = random.Random(5)
    made = [article_page(rng, main) for _ in range(40)]
    rows = [(k, f"https://h{k % 2}.example/{k}", page, "clash") for k, (page, _) in enumerate(made)]
    found = W.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    for r in found:
        assert r.text == made[r.page_id][1] and r.n_chars == len(r.text)


def test_odd_pages(spark):
    pages = {
        1: None,
        2: "",
        3: "just words &lt;b&gt; a &nbsp; b",
        4: "<p>one<p>two<table><tr><td>three<td>four</table>",
        5: "<article>a<b>b</b>c <i>d</i>\n\n e&#233;&amp;amp;</article><article>second</article>",
        6: "<div>" * 3000 + "deep" + "</div>" * 3000,
        7: "<article><p title='a > b'>x < y</p><script>if (a < b) { '</p>' }</script><p>z</article>",
        8: "<article><p>" + "long text " * 50_000 + "</p></article>",
        9: "<nav>only a menu</nav>",
        10: "<",
    }
    rows = [(k, None if k % 2 else f"http://u:p@H{k}.example:80/?q", p) for k, p in pages.items()] + [(5, None, pages[5])]
    found = {r.page_id: r for r in W.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "" and found[2].text == "" and found[2].n_chars == 0
    assert found[3].text == "just words <b> a b"
    assert found[4].text == "one two three four"
    assert found[5].text == "abc d eé&amp; second"
    assert found[6].text == "deep"
    assert found[7].text == "x < y z"
    assert found[8].n_chars == 10 * 50_000 - 1
    assert found[9].text == "" and found[10].text in ("", "<")
    assert W.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_size_bound_takes_the_other_join(spark):
    rng = random.Random(6)
    made = [article_page(rng) for _ in range(6)]
    frame = spark.createDataFrame([(k, f"http://h{k}/", p) for k, (p, _) in enumerate(made)], "page_id long, url string, html string")
    assert all(r.text == made[r.page_id][1] for r in W.extract_main_text(frame, broadcast_bytes=0).collect())


def test_wrapper_resolves_mismatches():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><h2>new</h2><p>y</p><p>x</p>"]
    wrapper = None
    for p in pages:
        wrapper = W.merge(wrapper, W.expression(read(p)))
    wrapper = json.loads(json.dumps(wrapper))
    by_key = {c[W.KEY]: c for c in wrapper[W.REST]}
    assert [c[W.KEY] for c in wrapper[W.REST]] == ["ul", "h2", "p"]
    assert by_key["h2"][W.OPTIONAL] and not by_key["ul"][W.OPTIONAL]
    assert by_key["p"][W.REPEATED] and by_key["ul"][W.REST][0][W.REPEATED]
    new, slot = by_key["h2"][W.REST][0], by_key["p"][W.REST][0]
    assert new[4] == new[5] == W._hash("new") and slot[4] != slot[5]


def test_large_wrappers_lose_names_but_no_weight(monkeypatch):
    pages = [read(f"<article><p>x{k}</p></article><div class='c{chr(97 + k % 26)}{chr(97 + k // 26)}'>y</div><i>z</i>") for k in range(60)]
    plain = coarse = None
    for page in pages:
        plain = W.merge(plain, W.expression(page))
    monkeypatch.setattr(W, "NODES", 30)
    for page in pages:
        coarse = W.merge(coarse, W.expression(page))
    assert W._count(plain) > 60 > 40 > W._count(coarse)
    chars = lambda n: n[6] if n[W.KEY] == "#" else sum(map(chars, n[W.REST]))
    assert chars(plain) == chars(coarse) and W.main_paths(coarse) == (["/article"], True)


@pytest.mark.parametrize("url,host", [(None, ""), ("https://A.b/c", "a.b"), ("http://u:p@x.y:8080?q", "x.y:8080"), ("x.y/z", "x.y"), ("ftp://q#f", "q"), ("\u2003https://A.b ", "a.b")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "url string").select(W.host_column("url")).first()[0] == host


def plain_template(rng, number, side, teaser):
    """A page without one name or tag that tells its parts apart, and its main text."""
    paras = [text(rng, rng.randrange(6, 25)) for _ in range(rng.randrange(1, 4))]
    head = text(rng, 4)
    links = "".join(f"<div><a href=/{n}>{text(rng, 3)}</a></div>" for n in range(rng.randrange(3, 7)))
    extra = f"<div class=k5>{teaser}</div>" if number % 2 else ""
    page = f"<html><body><div class=k1>{side}</div><div class=k2><div class=k3>{head}</div><div class=k4>{''.join(f'<p>{p}</p>' for p in paras)}{extra}<div class=k6>{links}</div><p>{text(random.Random(0), 5)}</p></div></div><div class=k7>{side}</div></body></html>"
    return page, paras


def test_wrappers_find_what_a_single_page_cannot(spark):
    """Hosts without telling names: template text, an optional box and lists of links go by the wrapper alone."""
    rng = random.Random(4)
    rows, want = [], {}
    for host in range(3):
        side, teaser = text(rng, 90), text(rng, 30)
        for k in range(12):
            page, paras = plain_template(rng, k, side, teaser)
            rows.append((100 * host + k, f"http://h{host}.example/{k}", page))
            want[rows[-1][0]] = " ".join(paras)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {k: W.extract(page, None) for k, _, page in rows}
    got = [{r.page_id: r.text for r in W.extract_main_text(f).collect()} for f in (frame.repartition(1), frame.repartition(5), frame.orderBy("page_id", ascending=False).union(frame.limit(0)))]
    assert got[0] == got[1] == got[2]
    for k, paras in want.items():
        assert all(p in got[0][k] for p in paras.split(". ")) and rows[0][2]
        assert len(got[0][k]) < len(paras) + 60 and len(alone[k]) > len(paras) + 150


def test_template_text_in_the_main_part_goes_but_copies_of_a_page_stay(spark):
    rng = random.Random(8)
    body = [text(rng, 20) for _ in range(8)]
    pages = [(k, "http://a/", f"<article><h1>{text(rng, 3)}</h1><p>{b}</p><div>Always the same line</div></article>") for k, b in enumerate(body)]
    copy = "<article><h1>Same</h1><p>every copy says this</p></article>"
    pages += [(100 + k, "http://b/", copy) for k in range(9)] + [(200 + k, f"http://c/{k}", copy) for k in range(2)]
    got = {r.page_id: r.text for r in W.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k].endswith(b) for k, b in enumerate(body))
    assert {got[k] for k in got if k >= 100} == {"Same every copy says this"}


def test_wrappers_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(9)
    rows = [("h", article_page(rng, rng.choice(["article", "div class=b", "div"]))[0]) for _ in range(60)]
    whole = [W.infer_wrappers(spark.createDataFrame(rng.sample(rows, 60) + rows[:k], "host string, html string").repartition(n)).collect() for k, n in ((0, 1), (9, 7), (3, 3))]
    assert whole[0] == whole[1] == whole[2] and len(whole[0]) == 1


def test_inline_parts():
    one = lambda page: W.extract(page, None)
    assert one("<p>One <span hidden>two</span> three four five.</p><p>six</p>") == "One three four five. six"
    assert one("<h2>Head <a class='hidden-xs' href=x>line</a><a aria-hidden=true>#</a></h2><p>text <span class='ad'>buy</span> goes <b>on</b></p>") == "Head line text goes on"
    assert one("<p>x<script>if (a < b) {}</script>y</p>") == "xy"
    assert one("<p>a <span class=ad>never closed</p><p>b</p>") == "a b"
    assert one("<article><section class='related-work'><h2>Related</h2><p>work</p></section><header><h1>Title</h1></header><div class='related-posts'>more</div></article>") == "Related work Title"
    assert one("<body><form id=all><article><p>text</p></article></form><form><p>mail</p></form></body>") == "text"
    assert one("<div class='block block-system ad'>buy</div><div><p>text</p></div>") == "text"
    deep = "<div>" * 300
    assert one(f"{deep}<nav>menu</nav><p>below</p><div class=ad>buy</div>{'</div>' * 300}<p>after</p>") == "below after"


def test_later_names_mark_boilerplate_and_main_text():
    said = "the story goes on and on " * 10
    page = read(f"<body><div class='wide box article-body'><p>{said}</p><div class='col-md-12 mt-4 comments'>a comment</div><section class='post-section wide' id='comments'>another</section></div><div class='row wide sidebar'>{said * 9}</div></body>")
    assert W.cut(page, W.plan_of(W.expression(page))) == said.strip()
