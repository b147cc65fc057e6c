"""Archives and page text."""

import hashlib

import numpy as np
import pytest

from casegrain.llm import html_text, warc


def trap(n):
    inner = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    return f"<pre>{inner}WARC/1.0\r\nbroken\r\n\r\n{inner}</pre>\r\n\r\n" + "é" * 200


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same text " * 200 + "</p>"
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<p>page {k} " + "w" * (k * 37 % 900) + "</p>") for k in range(40)]
    rows += [(50, "http://h.example/a b", big), (51, None, big), (52, "http://h.example/c", big), (53, "u", "short"), (54, "u", "short"), (55, "http://t.example/", trap(7)), (56, "x", None), (57, "x", ""), (58, "x", trap(8)), (58, "x", trap(8)), (60, "x", big[:-4])]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, size int").repartition(3)


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc_round_trip(spark, pages, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = str(tmp_path / "w")
        warc.write_warc(pages, path)
        got = sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_id or "") for r in warc.read_warc(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    owner = {}
    for i, b in rows:
        owner[b] = max(i, owner.get(b, i))
    name = lambda i: f"<urn:page:{i}>"
    want = sorted((name(i), len(b), hashlib.sha1(b).hexdigest(), *(("revisit", name(owner[b])) if len(b) >= 1000 and i < owner[b] else ("response", ""))) for i, b in rows)
    assert got == want
    assert {r[3] for r in got} == {"revisit", "response"}


def test_warc_files_are_bounded(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    table = pages.selectExpr("*", "1 as record", "2 as digest", "'o' as owner", "'f' as file")  # names that the operator uses
    path = tmp_path / "w"
    warc.write_warc(table.coalesce(1), str(path))
    assert max(f.stat().st_size for f in path.glob("part-*")) <= 5000 < sum(f.stat().st_size for f in path.glob("part-*"))
    assert warc.read_warc(spark, str(path)).count() == pages.count()


def test_warc_of_nothing(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages.where("1 = 0"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_reachable():
    offset, successor = np.array([0, 10, 15, 30, 45]), np.array([10, 30, 45, 45, 60])
    assert warc.reachable(offset, successor).tolist() == [True, True, False, True, True]
    assert warc.reachable(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)).tolist() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>More</ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>One <b>bold</b>\n text<p>Two&nbsp;&lt;3<br>lines</p><form>Name <input></form><div id="comments"><p>reader says</p></div><ul><li>a</li><li>b</li></ul></article></main><aside>Side</aside><footer>&copy; me</footer>"""


def inside(page):
    return "\n".join(t for t, held, kind in html_text.blocks(page) if held and not kind)


def test_blocks():
    assert inside(PAGE) == "Title & more\nOne bold text\nTwo <3 lines\na\nb"
    assert html_text.blocks(None) == [] and html_text.blocks("") == [] and html_text.blocks("a < b") == [("a < b", False, 0)]


@pytest.mark.parametrize("page, text", [
    ("<script>for(i=0;i<n;i++){}</script><article><p>Hello</p></article>", "Hello"),
    ("<script><!-- x </script><article><p>Hello</p></article><script>--></script>", "Hello"),
    ("<STYLE>a<b</Style ><textarea><article>no</article></textarea><article>Hello</article>", "Hello"),
    ("<script src=x><article><p>Hello", "Hello"),
    ("<!-- never closed <article><p>Hello", "Hello"),
    ('<div class="with-sidebar content"><article><header class="entry-header"><h1>Top</h1></header>Hello</article></div>', "Top\nHello"),
    ('<article><p>x<y then z</p><p>a <b and c</p><p>if 1 <two> 3</p></article>', "x<y then z\na <b and c\nif 1 <two> 3"),
    ("<article><p title='a>b'>One<ul><li>two<li>three</ul><p>four", "One\ntwo\nthree\nfour"),
    ('<div role="main">Hello <big>big</big> world<div class="comment-list">me too</div><div data-class="menu">stays</div></div>', "Hello big world\nstays"),
    ("<article>a<my-box>b</my-box>c<svg><text>d</text></svg><span class='ad'>buy</span>e</article>", "abc\ne"),
])
def test_blocks_of_odd_markup(page, text):
    assert inside(page) == text


def test_name_kinds():
    out = {"nav": "menu", "main-nav": "menu", "site-header": "header", "pageFooter": "footer", "cookie-notice": "notice", "sidebar_left": "sidebar", "comment-list": "never", "google-ads": "never"}
    assert {n: html_text.name_kind(n) for n in out} == out
    assert not any(map(html_text.name_kind, ("with-sidebar", "entry-header", "post-tags-off", "no-comments", "article", "content", "has-menu", "advertiser")))


def test_suffix_order():
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 3, size=n).tolist() for n in (1, 3, 8, 30, 60, 7, 60)]
    streams += [streams[4], streams[4][5:], [0] * 40]
    ends = np.cumsum([len(s) for s in streams])
    tails = [s[k:] for s in streams for k in range(len(s))]
    order, lcp = html_text.suffix_order(np.concatenate([np.array(s, dtype=np.int64) for s in streams]), ends)
    assert sorted(order.tolist()) == list(range(len(tails))) and [tails[k] for k in order] == sorted(tails)
    for k in range(1, len(tails)):
        a, b = tails[order[k - 1]], tails[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    content = np.array([0, 1, 2, 3, 4, 5, 6, 4, 4, 7])
    for run in (1, 5, 8):
        is_open = rng.random(len(tails)) < 0.7
        kind, many = html_text.repeated(np.concatenate([np.array(s, dtype=np.int64) for s in streams]), ends, content, is_open & np.concatenate([np.arange(len(s)) + run <= len(s) for s in streams]), run)
        owners, at = {}, 0
        for c, s in zip(content, streams):
            for k in range(len(s) - run + 1):
                owners.setdefault(tuple(s[k : k + run]), set()).update([c] * int(is_open[at + k]))
            at += len(s)
        at = 0
        for s in streams:
            assert many[at : at + len(s)].tolist() == [k + run <= len(s) and len(owners[tuple(s[k : k + run])]) > 1 for k in range(len(s))]
            at += len(s)
    assert html_text.suffix_order(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))[0].tolist() == []


def brute_extract(rows):
    """Texts by dictionaries of all windows of each host."""
    import re

    pages = []
    for _, url, page in rows:
        host = re.match(r"[a-z]+://([^/]*)", url or "")
        pages.append((host[1].lower() if host else "", html_text.blocks(page)))
    owners, contents = {}, {}
    for host, found in pages:
        content = " ".join(t for t, _, kind in found if not kind)
        content = content or " ".join(t for t, _, _ in found)
        contents.setdefault(host, set()).add(content if found else None)
        words = [w for t, _, _ in found for w in t.split(" ")]
        loose = [kind > 0 or not held for t, held, kind in found for _ in t.split(" ")]
        for k in range(len(words) - html_text.RUN + 1):
            owners.setdefault((host, *words[k : k + html_text.RUN]), set()).update([content] * any(loose[k : k + html_text.RUN]))
    covers, has, borne = [], dict.fromkeys(range(1, 6), 0), dict.fromkeys(range(1, 6), 0)
    streams = set()
    for host, found in pages:
        words = [w for t, _, _ in found for w in t.split(" ")]
        cover = {k + j for k in range(len(words) - html_text.RUN + 1) if len(owners[(host, *words[k : k + html_text.RUN])]) > 1 for j in range(html_text.RUN)}
        covers.append(cover)
        if (host, str(found)) in streams or len(contents[host] - {None}) < 2:
            continue
        streams.add((host, str(found)))
        for kind in range(1, 6):
            at, total, hit = 0, 0, 0
            for t, _, k in found:
                n = len(t.split(" "))
                if k == kind:
                    total, hit = total + n, hit + len(cover & set(range(at, at + n)))
                at += n
            has[kind] += total > 0
            borne[kind] += total > 0 and 2 * hit >= total
    gone = {k for k in has if html_text.PRIOR + borne[k] >= html_text.BORNE_OUT * (html_text.PRIOR + has[k])} | {html_text.NEVER}
    texts = []
    for (_, found), cover in zip(pages, covers):
        kept, at = [], 0
        for t, held, kind in found:
            words = t.split(" ")
            if kind not in gone:
                left = t if held else " ".join(w for k, w in enumerate(words, at) if k not in cover)
                kept += [left] if left else []
            at += len(words)
        texts.append("\n".join(kept))
    return texts


@pytest.mark.parametrize("group", [8 << 20, 60])
def test_extract_equals_brute_force(spark, monkeypatch, group):
    import random

    rng = random.Random(group)
    monkeypatch.setattr(html_text, "GROUP_BYTES", group)
    monkeypatch.setattr(html_text, "PRIOR", 1)
    monkeypatch.setattr(html_text, "BORNE_OUT", 0.4)
    word = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = [word(n) for n in (8, 9, 14, 30, 7, 12)]
    rows = []
    for k in range(60):
        part = lambda: rng.choice([rng.choice(shared), word(rng.randrange(12))])  # noqa: E731, B023
        rows.append((k, f"http://{rng.choice('aaaabc')}.example/{k}", f"<nav>{part()}</nav><div class='cookie-bar'>{word(9)}</div><div>{part()}<p>{part()}</p></div>{'<article>' * (k % 3 == 0)}<p>{part()}</p><h2>{part()}</h2></article><aside>{part()}</aside><footer>{shared[3]} {k}</footer>"))
    rows += [(100 + k, f"http://a.example/c{k}", rows[k][2]) for k in range(5)] + [rows[2], (200, None, None), (201, "u", "")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as key", "'y' as host").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(table).collect())
    assert got == sorted((r[0], t, len(t)) for r, t in zip(rows, brute_extract(rows)))
    assert len({t for _, t, _ in got}) > 30


def test_repeats_overturn_a_name(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PRIOR", 2)
    monkeypatch.setattr(html_text, "BORNE_OUT", 0.4)
    line = "the same eight words stand on every single page here"
    rows = [(k, f"http://a.example/{k}", f"<nav>{line} n{k}</nav><div class='notice'>the case number {k} of its own</div>") for k in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"the case number {k} of its own" for k in range(12)}


def test_extract(spark, monkeypatch):
    line = "all rights are kept by the owners of this very site"
    free = lambda k: f"<html><body><div>{line}</div><div>u{k} words {k}</div><p>{'own ' + str(k)}</p></body></html>"
    article = lambda k: f"<html><body><article><p>{line}</p><p>story {k}</p></article><footer>{line}</footer></body></html>"
    rows = [(k, f"http://a.example/{k}", free(k)) for k in range(8)] + [(20, "http://b.example/", free(20))] + [(30 + k, f"http://a.example/s{k}", article(k)) for k in range(3)] + [(40, None, None), (41, "http://c.example", ""), (0, "http://a.example/0", free(0))]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    for group in (8 << 20, 150):
        monkeypatch.setattr(html_text, "GROUP_BYTES", group)
        got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(table).collect())
        want = [(k, f"u{k} words {k}\nown {k}") for k in range(8)] + [(20, f"{line}\nu20 words 20\nown 20")] + [(30 + k, f"{line}\nstory {k}") for k in range(3)] + [(40, ""), (41, ""), (0, "u0 words 0\nown 0")]
        assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_text.extract(table.where("1 = 0")).count() == 0


def test_extract_of_copies(spark, monkeypatch):
    line = "all rights are kept by the owners of this very site"
    story = "a long tale of some eight words and then a few more of them"
    plain = f"<html><body><div>{line}</div><p>{story}</p></body></html>"
    marked = f"<html><head><title>x</title></head><body><div class='a'>{line}</div>\n<p><b>{story}</b></p></body></html>"
    other = lambda k: f"<html><body><div>{line}</div><p>o{k} words</p></body></html>"
    rows = [(k, f"http://a.example/{k}", plain if k % 2 else marked) for k in range(12)] + [(20 + k, f"http://a.example/o{k}", other(k)) for k in range(3)]
    rows += [(40 + k, f"http://b.example/{k}", plain) for k in range(2)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    want = {**{k: story for k in range(12)}, **{20 + k: f"o{k} words" for k in range(3)}, **{40 + k: f"{line}\n{story}" for k in range(2)}}
    for group in (8 << 20, 1):
        monkeypatch.setattr(html_text, "GROUP_BYTES", group)
        assert {r.page_id: r.text for r in html_text.extract(table).collect()} == want
