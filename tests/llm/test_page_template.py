import re
import time
from collections import Counter

import pytest

from paywarden.llm.common import table
from paywarden.llm.page_template import PLAIN, extract_pages, host_templates, main_text, token_counts
from tests.llm.helpers import SF


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    got = main_text(page(
        '<header>H</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">c</div><main><article><h1>A &amp; B</h1>'
        '<p>one <b>two</b>\n three<br>four<p>five &#x41;&nbsp;x</p><aside>side</aside><form>f</form><!-- <p>x</p> -->'
        '<div class="ad">buy</div><ul><li>1<li>2</ul>tail<style>p{}</style><section id="comments"><article class="comment">no</article>'
        "</section></article></main><footer>F</footer>"
    ), None, None, None)
    assert got == "A & B\none two three four\nfive A x\n1\n2\ntail"


def test_broken_markup_and_bare_pages():
    assert main_text("", None, None, None) == ""
    assert main_text("<p>a<p>b</div></p>c", None, None, None) == "a\nb\nc"
    assert main_text(page("<nav>n</nav><div><p>only</p></div>"), None, None, None) == "only"
    assert main_text("<article><p><b>x<br><p>y</p>", None, None, None) == "x\ny"
    assert main_text("<article>&lt;p&gt; 1 < 2 &amp;&am</article>", None, None, None) == "<p> 1 < 2 &&am"
    assert main_text("<article><script>x", None, None, None) == ""


def rows(spark, pages):
    data = [(k, u, h, "x", "y") for k, (u, h) in enumerate(pages)]
    return spark.createDataFrame(data, "page_id long, url string, html string, host string, frame string")


def test_frame_of_a_host(spark):
    host = [(f"https://A.example/{k}", page(f'<nav>{"<a>l</a>" * k}</nav><div class="lead story">{"<p>t</p>" * k}</div><div class="ads">x</div>')) for k in range(1, 6)]
    t = {r["host"]: r for r in host_templates(rows(spark, [*host, ("http://b.example", page("<article>z</article>"))])).collect()}
    assert t["a.example"]["frame"] == [">html", "html>head", "html>body", "body>nav", "body>div.lead.story", "body>div.ads"]
    assert sorted(t["a.example"]["outside"]) == ["body>div.ads", "body>nav", "html>head"] and t["a.example"]["main"] == []
    assert t["b.example"]["main"] == ["body>article"]


def test_every_row_comes_back(spark):
    pages = [
        ("https://a.example/1", page("<nav>n</nav><article><p>first  text</p></article>")), ("https://a.example/2", page("<nav>n</nav><article><p>second</p></article>")),
        ("https://a.example/3", page("<article><p>moved</p></article><nav>n</nav>")), ("https://a.example/4", page("<div><p>no article</p></div>")),
        (None, page("<article>none</article>")), ("odd", None), ("https://a.example/5", ""), ("https://a.example/2", page("<nav>n</nav><article><p>second</p></article>")),
        ("https://a.example/6", "<article><p>" + "w " * 50_000),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(rows(spark, pages)).collect()}
    want = ["first text", "second", "moved", "no article", "none", "", "", "second", ("w " * 50_000).strip()]
    assert got == {k: (t, len(t)) for k, t in enumerate(want)}
    assert extract_pages(rows(spark, pages).limit(0)).count() == 0


def test_attribute_names_are_whole():
    for attrs in ('style="overflow:hidden"', 'aria-hidden="false"', 'data-id="ad"', 'title="id=ad hidden"', "data-x='hidden' data-role=navigation"):
        assert main_text(f"<p>x</p><article {attrs}><p>text</p></article>", None, None, None) == "text", attrs
        assert main_text(f"<div {attrs}><p>text</p></div>", None, None, None) == "text", attrs
    for attrs in ("hidden", 'HIDDEN=""', 'x="1" hidden', "id = ad", 'data-id="1" id="ad"'):
        assert main_text(f"<article><p>text</p><div {attrs}>no</div></article>", None, None, None) == "text", attrs


def test_classes_decide_without_word_lists(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(30 + k)) for k in range(8)]
    body = lambda k: f'<div class="top">Welcome</div><div class="x1"><p>hi {k}</p></div><div class="x2"><h2>T{k}</h2>{"".join(f"<p>{t}</p>" for t in (texts[k], "said again")[: 1 + k % 2])}<div>Share this</div></div><div class="x3">{k}</div>'
    pages = [(f"https://a.example/{k}", page(body(k))) for k in range(8)]
    # Exact copies are one page, so they make no text the template's own.
    pages += [("https://b.example/1", page("<article><p>copied</p></article>"))] * 9
    got = {r["page_id"]: r["text"] for r in extract_pages(rows(spark, pages)).collect()}
    # "said again" is on half the pages and comes with no tag of its own.
    want = [f"T{k}\n{texts[k]}" + "\nsaid again" * (k % 2) for k in range(8)]
    assert got == {k: t for k, t in enumerate([*want, *["copied"] * 9])}
    t = {r["host"]: r for r in host_templates(rows(spark, pages)).collect()}
    assert t["a.example"]["content"] == "body>div.x2" and len(t["a.example"]["fixed"]) == 2 and t["b.example"]["content"] is None


STORY = ["The council met on Friday and heard the plans for the bridge.", "Work begins in spring, said the mayor, if the river stays low."]


def texts_of(spark, bodies):
    return [r["text"] for r in extract_pages(rows(spark, [("https://a.example/" + str(k), page(b)) for k, b in enumerate(bodies)])).orderBy("page_id").collect()]


@pytest.mark.parametrize("around", ["<article>{}</article>", '<div class="c1">{}</div>'])
def test_hosts_that_look_alike_keep_their_articles(spark, around):
    article = around.format("".join(f"<p>{t}</p>" for t in STORY))
    one = "\n".join(STORY)
    # One article on every page, only a date differs.
    for head in ("<header>day {}</header>", '<div class="d1">day {}</div>'):
        assert texts_of(spark, [head.format(k) + article + "<footer>f</footer>" for k in range(6)]) == [one] * 6
    # A paragraph that every article has, with few pages and with many.
    for n in (2, 4, 6):
        bodies = ["<nav>menu</nav>" + around.format(f"<p>{' '.join(f'own{k}x{i}' for i in range(20))}</p><p>{STORY[0]}</p>") for k in range(n)]
        assert all(t.endswith(STORY[0]) and t.startswith(f"own{k}x0 ") for k, t in enumerate(texts_of(spark, bodies))), n


def test_links_do_not_outweigh_an_article(spark):
    links = lambda k: '<div class="links">' + "".join(f'<p><a href="/{i}">Another long headline {k} of story {i}</a></p>' for i in range(9)) + "</div>"
    for around in ("<article><p>{}</p></article>", '<div class="c1"><p>{}</p></div>'):
        for n in (1, 3, 6):
            got = texts_of(spark, [links(k) + around.format(f"Short news {k} today.") for k in range(n)])
            if "article" in around or n >= 3:
                assert got == [f"Short news {k} today." for k in range(n)], (around, n)
    # A teaser inside a menu is no article, and a text of any length beside an article is none.
    body = lambda k: f'<aside><article>teaser {k}</article></aside><div class="c1"><p>{STORY[0]} {k}</p></div>'
    assert texts_of(spark, [body(k) for k in range(5)]) == [f"{STORY[0]} {k}" for k in range(5)]
    body = lambda k: f"<article>news {k}</article><div><p>{STORY[0] * 5} {k}</p></div>"
    assert texts_of(spark, [body(k) for k in range(5)]) == [f"news {k}" for k in range(5)]


def test_one_more_page_changes_no_other(spark):
    body = lambda k: f'<nav>menu</nav><article><h1>T{k}</h1><p>{STORY[0]}</p><div class="box">Follow us</div><p>{STORY[1]} {k}</p></article>'
    whole = texts_of(spark, [body(k) for k in range(7)])
    box = {t.replace("Follow us\n", "") for t in whole}
    for n in (1, 2, 4, 5, 6):
        assert {t.replace("Follow us\n", "") for t in texts_of(spark, [body(k) for k in range(n)])} <= box


@pytest.mark.parametrize("hostile", [
    '<div "' * 170_000, "<" * 1_000_000, "<a" * 500_000, "<!" * 500_000, "<div>" * 100_000 + "</p>" * 100_000, "<div '" * 160_000 + ">",
    "<a " * 330_000 + '">', "<p>x" * 150_000, "</script " * 110_000, "<b a=" + '"x" ' * 250_000,
])
def test_a_megabyte_of_hostile_markup(hostile):
    start = time.perf_counter()
    token_counts(hostile)
    main_text(hostile, None, None, None)
    assert time.perf_counter() - start < 20


def brute_templates(pages):
    """Per host by occurrence vectors held whole: class of each common token, frame, content and fixed texts."""
    hosts = {}
    for url, text in pages:
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "") or ["", ""])[1].lower()
        hosts.setdefault(host, {})[text or ""] = {k: rest for k, *rest in token_counts(text or "")}
    out = {}
    for host, tokens in hosts.items():
        n, keys = len(tokens), dict.fromkeys(k for t in tokens.values() for k in t)
        vector = {k: tuple(t[k][0] if k in t else 0 for t in tokens.values()) for k in keys}
        seen = {k: [t[k] for t in tokens.values() if k in t] for k in keys}
        text = {k for k in keys if seen[k][0][4] is not None}
        common = [k for k in keys if k != "#" and 2 * len(seen[k]) >= n and (k not in text or len(seen[k]) >= 3)]
        of = Counter(vector[k] for k in common)
        tags = Counter(vector[k] for k in common if k not in text)
        in_frame = lambda k: vector[k] == (1,) * n
        place = {k: sum(x[1] for x in seen[k]) / len(seen[k]) for k in keys}
        frame = sorted((k for k in common if in_frame(k) and k not in text), key=lambda k: (place[k], k))
        tag = lambda k: k.partition(">")[2]
        own = {k for k in common if k in text and (in_frame(k) or tags[vector[k]]) and n >= 3}
        slots = {tag(k) for k in text - own}
        fixed = {k for k in own if tag(k).rpartition(">")[2] not in PLAIN and tag(k) not in slots}
        mass = Counter()
        for k in text:
            for e in max(x[4] for x in seen[k]):
                mass[e] += max(x[3] for x in seen[k])
        kind = {k: max((x[2] for x in seen[k] if x[2] is not None), default=None) for k in keys}
        sole = [k for k in common if k not in text and n >= 3 and max(vector[k]) == 1]
        named = [k for k in sole if kind[k] and mass[k] > 0]
        classed = [k for k in sole if kind[k] is None and 2 * mass[k] > mass["#"] and (in_frame(k) or of[vector[k]] > 1)]
        content = min(named, key=place.get) if named else max(classed, key=place.get) if classed else None
        if common:
            out[host] = (frame, sorted(fixed), content)
    return out


def test_classes_against_whole_vectors(spark):
    pages = [(r["url"], r["html"]) for r in table(spark, SF, "pages").collect()]
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    pages += [(f"https://x.example/{k}", page(f'<div class="t">Hello</div><div class="u"><p>{words(k, 9)}</p><div class="v">Share</div></div><p>end</p>' + "<ul><li>a</ul>" * (k % 2))) for k in range(7)]
    pages += [("https://x.example/0", pages[-7][1]), (None, None), ("https://y.example", page("<p>one</p>"))]
    got = {r["host"]: (r["frame"], sorted(r["fixed"] or []), r["content"]) for r in host_templates(rows(spark, pages)).collect()}
    assert got == brute_templates(pages) and any(fixed and content for _, fixed, content in got.values())


def test_null_ids(spark):
    df = rows(spark, [("https://a.example", page("<article>x</article>"))] * 2).selectExpr("cast(null as long) page_id", "* except (page_id)")
    assert [(r["page_id"], r["text"]) for r in extract_pages(df).collect()] == [(None, "x")] * 2
