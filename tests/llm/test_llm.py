"""The training-data operators on hand-made cases and against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, html_text, language_id, licences, motion_jpeg, ngram_join, packing, pretoken, queries, repeats, top_k, url_filter
from tests.oracle import same

from . import brute

#: Null, empty, very long, tied and repeated texts, and characters of every length.
ODD = [None, "", " ", "a", "a", "\n\t ", "é", "日本語 テスト", "it's 'S we'll\n\n x", "A b C", "a B c", "\x00\x1c", "<|endoftext|> hi", "word " * 3000, "x" * 3000, "ab" * 700, "🙂" * 40]


def odd(spark):
    """ODD as documents with null columns and extra columns of clashing names."""
    rows = [(i, t, "en" if i % 3 else None, None, len(t or "")) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("bucket", "kind", "row", "rest", "ids", "n_bytes", "kept", "blob", "size", "digest", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLES[name])


# 1 licences


def test_licences_of_entire_texts_and_lines(spark):
    mit = licences.MIT_TERMS
    cases = {
        1: (mit, "MIT"), 2: ("MIT License\n\nCopyright (c) 2020 Some Body\n\n" + mit.replace("sublicense", "sub-licence").replace('"', "'").upper(), "MIT"), 3: (mit + " and more", None), 4: ("Redistribution\n" + licences.BSD_HEAD, None),
        5: ("Copyright 2001 X\nCopyright 2002 Y\n" + licences.BSD_HEAD + licences.BSD_END.replace("holders", "owners").replace("HOLDERS", "OWNERS"), "BSD-2-Clause"), 6: (None, None), 7: ("", None), 8: ("© 1999", None),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert {i: r.license for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    df = spark.createDataFrame([(1, "some text\nReleased under the MIT Licence!\nAll rights reserved.\nmore")], "doc_id long, text string")
    assert licences.scan(df).first().notices == "MIT,all-rights-reserved"
    assert licences.scan(odd(spark)).count() == len(ODD) and licences.scan(empty(spark)).count() == 0


def test_licences_of_copyright_lines_without_a_year(spark):
    heads = ["Copyright (c) Meta Platforms, Inc. and affiliates.", "Copyright (c) The Authors", "MIT License\n\nCopyright Some Body <a@b.org>", "© The Authors", "(c) Some Body", "SPDX-FileCopyrightText: Some Body", "Copyright: Some Body"]
    wrapped = licences.BSD_HEAD.replace("above copyright", "above\ncopyright") + licences.BSD_END.replace("THE COPYRIGHT", "THE\nCOPYRIGHT")
    cases = {i: (h + "\n\n" + licences.MIT_TERMS, "MIT") for i, h in enumerate(heads)}
    cases |= {50: ("Copyright The Authors\n" + wrapped, "BSD-2-Clause"), 51: ("Copyright (c) The Authors. " + " ".join(licences.MIT_TERMS.split()), None), 52: (licences.MIT_TERMS + "\n(c) you pay us;\n", None)}
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert {i: r.license for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    assert got[51].digest != hashlib.sha256(b"").hexdigest()


def test_licences_on_one_line_and_under_wrapped_notices(spark):
    flat = lambda t: " ".join(t.split())
    bsd = licences.BSD_HEAD + licences.BSD_END
    cases = [
        ("Copyright (c) 2020 X. " + flat(licences.MIT_TERMS), "MIT"), ("MIT License Copyright (c) 2020 John Doe " + flat(licences.MIT_TERMS), "MIT"), ("Copyright (c) 2020\nJohn Doe <a@b.org>\n\n" + licences.MIT_TERMS, "MIT"),
        ("Copyright (c) 2020 The very long name of X and\n   contributors\n\n" + licences.MIT_TERMS, "MIT"), ("Copyright © 1999, X and others " + flat(licences.ISC_TERMS), "ISC"), ("Copyright 2001 A\nCopyright 2002-2005 B,\n  C and D\n" + bsd, "BSD-2-Clause"), ("(c) 2003 Z\n" + licences.ZLIB_TERMS, "Zlib"),
        ("A story about copyright. " + flat(licences.MIT_TERMS), None), ("Copyright (c) 2020 X. " + "word " * 100 + flat(licences.MIT_TERMS), None), ("Copyright (c) 2020 X. " + "word " * 100, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(None, licences.MIT_TERMS), (0, licences.MIT_TERMS)], "doc_id long, text string")
    got = [(r.doc_id, r.license, r.digest) for r in licences.scan(df).collect()]
    assert {i: x for i, x, _ in got[: len(cases)] if i is not None} == {i: want for i, (_, want) in enumerate(cases)}
    assert sorted(x for i, x, _ in got if not i) == ["MIT"] * 3  # null and repeated ids are judged like others
    assert got[len(cases) - 1][2] != hashlib.sha256(b"").hexdigest()  # a long line isn't a copyright line
    import duckdb

    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[i, t] for i, (t, _) in enumerate(cases)])
    rel = con.sql(licences.ORACLE)
    assert {r[0]: r[rel.columns.index("license")] for r in rel.fetchall()} == {i: want for i, (_, want) in enumerate(cases)}


def test_licences_under_usual_heads(spark):
    bullets = lambda t: re.sub(r"(?m)^[0-9]\. ", "  * ", t)
    bsd2, bsd3 = licences.BSD_HEAD + licences.BSD_END, licences.BSD_HEAD + licences.BSD_THIRD + licences.BSD_END
    cases = [
        ("Copyright (c) 2010, X\nAll rights reserved.\n\n" + bsd2, "BSD-2-Clause"), ("Copyright (c) Some Body\n\n" + licences.MIT_TERMS, "MIT"), ("SPDX-FileCopyrightText: 2020 X\n" + licences.MIT_TERMS, "MIT"),
        ("Copyright 2011 X\n" + bullets(bsd3), "BSD-3-Clause"), ("BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + bullets(bsd3), "BSD-3-Clause"), ("All rights reserved.", "all-rights-reserved"), ("Copyright 2020 X\nAll rights reserved.", "all-rights-reserved"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].license for i in range(len(cases))] == [want for _, want in cases]
    assert got[0].notices == "all-rights-reserved"


def test_licences_of_longer_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (folder / f).read_text().upper().replace("\n", " \r\n")) for i, f in enumerate(files) if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts here")
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: list(files.values())[i] for i, _ in rows}
    own = spark.createDataFrame([(1, "Own terms")], "doc_id long, text string")
    digest = licences.scan(own).first().digest
    assert licences.scan(own, [("Own", digest)]).first().license == "Own"


# 2 HTML

PAGE = """<html><head><title>No</title><style>p {{}}</style></head><body><header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href=x>one</a><li><a href=y>two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to do many things that you should accept now, please do.</p></div><div class="page"><div class="sidebar"><p>Beside the text there is more text.</p></div>
<div class="content"><h2>A title</h2><p>First &eacute;&nbsp;&amp; <b>bold</b> text, long enough to count as one.<p>Second<br>line with a <a href=z>link</a> or so, and words.</p><form><p>Sign up</p><input value=1></form><ul><li>one item<li>two item</ul>
<table><tr><td>c1<td>c2</table><script>if (a < b) document.write("</p><p>no</p>")</script></div><div class="comments"><p>I liked this really a lot and even more than that, friend.</p></div></div><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE.replace("{{}}", "{}")) == "A title\nFirst é & bold text, long enough to count as one.\nSecond line with a link or so, and words.\none item\ntwo item\nc1\nc2"
    assert [html_text.main_text(x) for x in ("", "plain <b>text</b>", "<p>only", "<!-- a <p>b", "<div>a &lt; b</div><div>c</div>", "<nav><p>menu only</p></nav>", "<p" * 50)] == ["", "plain text", "only", "", "a < b\nc", "", ""]
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("tag", ['div class="layout has-sidebar"', 'div class="page no-sidebar"', 'div id="page-with-nav"', 'section class="related-work"', "form action=/x", 'form role="form"', 'div class="sidebar"', 'div id="main-nav-wrapper"', 'div class="page header"'])
def test_html_wrappers_keep_the_article(tag):
    end = f"</{tag.split()[0]}>"
    text = "<p>First paragraph of the article, which is long enough to count.</p><p>Second paragraph of it, as long as the first one or so.</p>"
    menu, side = "<nav><a href=a>one</a><a href=b>two</a></nav>", '<div class="sidebar-left"><p>Beside it.</p></div><form><p>Sign up</p></form>'
    want = "First paragraph of the article, which is long enough to count.\nSecond paragraph of it, as long as the first one or so."
    for article in (f"<article>{text}</article>", f"<main>{text}</main>", f"<div>{text}</div>"):
        assert html_text.main_text(f"<body>{menu}<{tag}>{article}{side}{end}<footer>me</footer></body>") == want
        assert html_text.main_text(f"<body><form><{tag}>{article}{end}{side}</form></body>") == want


def paragraphs(n):
    return [f"Paragraph number {i} of the article, which is long enough to be one of the real ones, and then a bit longer still." for i in range(n)]


def test_html_density_decides():
    text = "".join(f"<p>{x}</p>" for x in paragraphs(4))
    want = "\n".join(paragraphs(4))
    side, cookies = "<div><p>Beside it all stands a box.</p></div>", "<p>We use cookies here.</p>"
    links = "<ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>"
    assert html_text.main_text(f"<body>{side}<div>{text}</div>{cookies}</body>") == want  # without density all text counts
    assert html_text.main_text(f"<body><div>{side}<div>{text}</div></div>{cookies}{links}</body>") == want
    assert html_text.main_text(f"<body><h1>A title</h1><div>{text}{links}</div><h3>More</h3>{links}</body>") == "A title\n" + want
    assert html_text.main_text(f"<body>{side}<article><p>Short.</p></article>{cookies}</body>") == "Short."
    assert html_text.main_text(f"<body><p>{paragraphs(1)[0]}</p><div>{text}</div></body>") == paragraphs(1)[0] + "\n" + want  # as dense as the core
    # a doubtful element that holds the core stays, one that doesn't goes
    assert html_text.main_text(f'<body><p>Skip it</p><div class="sidebar">{text}</div></body>') == want
    assert html_text.main_text(f'<body><div class="sidebar"><p>{paragraphs(1)[0]}</p></div><div>{text}</div></body>') == want


def test_html_attributes_and_inline_elements():
    assert html_text.main_text("<p data-x=it's>two don't three</p><p a='b>'c=d\"e>four</p>") == "two don't three\nfour"
    assert html_text.main_text("<article><p title=\"class='nav'\">a <math><mi>x</mi></math> <svg><title>no</title><text>b</text></svg> <noscript>c</noscript></p></article>") == "a x b c"
    assert html_text.main_text("<p class=nav>no</p><p " + "a=b " * 50_000 + ">yes</p>") == "yes"
    assert html_text.main_text("<a x='" * 20_000) == html_text.main_text("<p a=b" * 20_000) == ""


def test_html_comments_and_teasers_stay_out():
    say = "<p>I liked this really a lot and even more than that, friend.</p>" * 5
    assert html_text.main_text(f'<article><p>Short but all there is.</p></article><div id="comments" class="comments-area"><article class="comment-body">{say}</article>{say}</div><div class="related"><article><p>Another one</p></article></div>') == "Short but all there is."


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\n", body.replace("<br>", " "))).split("\n")
        assert got[r.page_id] == "\n".join(html_text.unescape(" ".join(x.split())) for x in lines if x.strip())
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).orderBy("page_id").collect()] == [(None, "x", 1), (1, "", 0), (1, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_density_chooses_within_and_between_articles():
    words = lambda n, w="word": " ".join([w] * n)
    prose, other = words(60), words(55, "other")
    links = "".join(f'<a href="/{i}">link {i}</a>' for i in range(5))
    page = lambda body: f"<html><body><nav>{links}</nav>{body}<footer>foot</footer></body></html>"
    # prose with a telling class comes back, a short or linked one doesn't
    assert html_text.main_text(page(f'<article><p>{prose}</p><p class="related">{other}</p><p class="related">see also</p><p class="share">{links}</p></article>')) == prose + "\n" + other
    # a box of links in an article goes though nothing names it
    assert html_text.main_text(page(f"<article><p>{prose}</p><div>{links}</div><p>{other}</p></article>")) == prose + "\n" + other
    # two articles of a kind count both, a teaser doesn't
    assert html_text.main_text(page(f"<article><p>{prose}</p><p>{other}</p></article><article><p>{other}</p><p>{prose}</p></article><article><p>teaser</p></article>")) == "\n".join((prose, other, other, prose))
    assert html_text.main_text(page(f'<main><article><p>{prose}</p></article></main><article class="comment"><p>{other}</p></article>')) == prose
    # without density all of this would be different
    everything = lambda html: (root := html_text.parse(html), out := [], html_text.blocks(root, lambda n: True, out))[1]
    assert "link 0link 1" in "".join(everything(page(f"<article><p>{prose}</p><div>{links}</div></article>")))



# 3 motion JPEG


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in motion_jpeg.features(motion_jpeg.to_media(odd(spark))).collect()}
    for i, t in enumerate(ODD):
        b = (t or "").encode()
        payload = motion_jpeg.padded(b)
        assert len(payload) % 576 == 0 and len(payload) > 0
        r = rows[i]
        file = motion_jpeg.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
    assert motion_jpeg.features(motion_jpeg.to_media(empty(spark))).count() == 0


def test_media_is_plain_jpeg_in_avi():
    payload = bytes(range(256)) * 9
    file = motion_jpeg.write(payload)
    places, rate = motion_jpeg.index(file)
    assert rate == 25 and len(places) == 4
    lo, hi = places[2]
    picture = motion_jpeg.picture(file[lo:hi])  # bit by bit, with the whole inverse transform
    assert picture.shape == (192, 192) and picture[::8, ::8].tobytes() == payload[1152:1728] and (picture[:8, :8] == picture[0, 0]).all()
    assert motion_jpeg.index(file[: file.rindex(b"idx1")])[0] == places  # no index: the list is walked
    with pytest.raises(ValueError):
        motion_jpeg.index(b"RIFX")


def test_media_by_an_independent_decoder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.desc(F.length("text")), "doc_id").limit(3).unionByName(spark.createDataFrame([(-1, None), (None, "é" * 700)], "doc_id long, text string"), allowMissingColumns=True)
    media = {r.doc_id: bytes(r.media) for r in motion_jpeg.to_media(docs).collect()}
    rows = {r.doc_id: r for r in motion_jpeg.features(motion_jpeg.to_media(docs)).collect()}
    for r in docs.collect():
        frames = [brute.jpeg_dc(f) for f in brute.avi_frames(media[r.doc_id])]
        assert all((h, w) == (192, 192) for h, w, _ in frames)
        samples = [bytes(dc // 8 + 128 for dc in f) for _, _, f in frames]  # a flat block is its DC coefficient over 8
        payload, text = b"".join(samples), (r.text or "").encode()
        assert payload == text + b"\xff" * (-len(text) % 576 if text else 576)
        cuts = brute.shot_cuts(samples)
        mean = sum(payload) * 1000 // len(payload)
        assert rows[r.doc_id].feature == f"frames={len(samples)};shots={len(cuts) + 1};mean={mean};cuts={','.join(map(str, cuts))}"
        edges = [0, *cuts, len(samples)]
        assert [(c.clip, c.start_s, c.end_s, c.frames) for c in rows[r.doc_id].clips] == [(k, a / 25, b / 25, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert motion_jpeg.clip_rows(motion_jpeg.features(motion_jpeg.to_media(docs))).count() == sum(len(r.clips) for r in rows.values())


def test_shots():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(lo, lo + 40, (20, 576)) for lo in (0, 100, 200)]).astype(np.uint8)
    rows = motion_jpeg.clips(motion_jpeg.write(x.tobytes()))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(0, 0.0, 0.8, 20), (1, 0.8, 1.6, 20), (2, 1.6, 2.4, 20)]


# 4 urls


def test_url_rules_and_hosts(spark):
    cases = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net/de": ("example.net", "/de", "net/", "block"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"), "http://x.example.com/de/#a": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "http://x.org?a=/fr/": ("x.org", "", None, "allow"), "x.org/fr/": ("", "", None, "allow"), None: ("", "", None, "allow"), "a?b=http://y.net/z": ("y.net", "/z", "net/", "block"), "http://net": ("net", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge(df.limit(0)).count() == 0


LINKS = [(1, "http://seed.net/", ""), (2, "http://bad.com/x", '<a href="http://seed.net/a">x</a><A HREF = //seed.net/b>'), (3, "http://far.com/", "<a href='http://bad.com/'>"), (4, "http://mixed.com/", '<a href="http://seed.net/"></a><a href="http://good.com/"></a>'), (5, "http://x.org/fr/a", '<a href="http://good.com/">'), (6, "http://good.com/", "")]
LINKS += [(10 + i, f"http://many{i}.com/", '<a href="http://popular.net/">') for i in range(40)] + [(60, "http://popular.net/x", "")]


def test_trust_spreads(spark, tmp_path):
    df = spark.createDataFrame(LINKS, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(df).collect()}
    want = {"seed.net": "block", "popular.net": "block", "bad.com": "block", "far.com": "allow", "mixed.com": "allow", "x.org": "allow", "good.com": "allow"}
    assert {h: r.verdict for h, r in got.items() if not h.startswith("many")} == want
    # links count once: bad.com and mixed.com share the seed's distrust, far.com has all that bad.com passes on
    assert got["bad.com"].distrust == got["mixed.com"].distrust == round(0.85 / 2, 6) and got["far.com"].distrust == round(0.85 * 0.85 / 2, 6)
    assert got["bad.com"].mass == 1 and got["far.com"].mass == round(0.425 / 1.425, 6) and got["mixed.com"].mass == 0.5 / (0.5 + 0.5)
    # a blocked host with many referrers leaves each of them little distrust, and all of their mass
    assert all(got[f"many{i}.com"].verdict == "block" and got[f"many{i}.com"].distrust == round(0.85 / 40, 6) and got[f"many{i}.com"].mass == 1 for i in range(40))
    assert got["good.com"].trust == 0.85
    df.write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(url_filter.ORACLE)
    want = {r[rel.columns.index("page_id")]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()}
    assert {r.page_id: r.asDict() for r in url_filter.judge(df).collect()} == want


def test_one_verdict_whatever_the_number_of_referrers(spark):
    """A host that links to a blocked one only, with and without a trusted host's link, and many others that link there too."""
    for others in (0, 1, 50):
        pages = [(1, "http://bad.net/", ""), (2, "http://x.org/fr/a", '<a href="http://friend.com/">'), (3, "http://friend.com/", '<a href="http://bad.net/">'), (4, "http://foe.com/", '<a href="http://bad.net/">')]
        pages += [(10 + i, f"http://o{i}.com/", '<a href="http://bad.net/">') for i in range(others)]
        got = {r.host: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert {h: got[h].verdict for h in ("bad.net", "x.org", "friend.com", "foe.com")} == {"bad.net": "block", "x.org": "allow", "friend.com": "allow", "foe.com": "block"}
        assert got["friend.com"].mass == got["friend.com"].good_mass == got["foe.com"].mass == 1 and got["foe.com"].good_mass == 0


def test_rules_of_one_length_and_long_urls(spark):
    rules = (("allow", "b.com/x/"), ("block", "com/x/yy/"), ("allow", "a.com/x/"), ("block", "com/"))
    pages = [(1, "http://a.com/x/yy/z"), (2, "http://a.b.com/x/yy"), (3, "http://a.com/" + "y" * 100_000), (4, "http://" + "h" * 100_000 + ".com/"), (None, "http://a.com/x/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("com/x/yy/", "block"), 2: ("b.com/x/", "allow"), 3: ("com/", "block"), 4: ("com/", "block"), None: ("a.com/x/", "allow")}
    ties = (("allow", "b.a.com/"), ("block", "a.com/xy"))
    tied = spark.createDataFrame([(1, "http://b.a.com/xyz", None)], "page_id long, url string, html string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(tied, ties).collect()] == [("a.com/xy", "block")]


# 5 repeats


def made(seed, n):
    rng = random.Random(seed)
    docs = ["".join(rng.choice("ab é") for _ in range(rng.choice([0, 10, 49, 50, 51, 200, 1000]))) for _ in range(n)]
    base = [t for t in docs if len(t) > 90]
    for _ in range(2 * n):
        a, b = rng.choice(base), rng.choice(base)
        docs.append(a[rng.randint(0, 20) : rng.randint(40, len(a))] + rng.choice(["", "x", "yz" * 5]) + b[rng.randint(0, len(b)) :] + "a" * rng.choice([0, 80]))
    rng.shuffle(docs)
    return list(enumerate([*docs, None, docs[0], docs[0]]))


def test_repeats(spark, sf_dir):
    for docs in (made(5, 50), documents(spark, sf_dir), list(enumerate(ODD))):
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(3)
        want = brute.repeats(docs)
        got = {r.doc_id: r for r in repeats.remove_repeats(df, rest=["kept"]).collect()}
        assert len(got) == len(docs) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) == want[i] and r.rest.kept == "clash" for i, r in got.items())
    assert repeats.remove_repeats(odd(spark)).count() == len(ODD) and repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    t = "0123456789" * 5 + "tail of it that is no repeat of anything"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (9, t)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.n_removed) for r in repeats.remove_repeats(df).collect()) == [(0, 0), (7, 0), (7, 0), (9, len(t))]


def compare_repeats(df, docs):
    want = brute.repeats(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert got == {i: w[:4] for i, w in want.items()}


def test_repeats_around_a_frequent_line(spark):
    rng = random.Random(8)
    line, lines = "-- a line of forty bytes, in most texts --", []
    for _ in range(900):  # more runs of one anchor than MANY: they are dealt out window by window
        side = "".join(rng.choice("abc") for _ in range(40))
        lines.append(side + line + "".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 60]))))
        lines.append(rng.choice(lines)[rng.randint(0, 45) :] + rng.choice(["", "!", side]))
    docs = list(enumerate(lines))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    held = df.withColumn("bucket", F.lit(0))
    assert len(repeats.hot_anchors(repeats.first_pass(held, 5, 5, repeats.WINDOW, repeats.ANCHOR))) > 0
    compare_repeats(df, docs)


def test_repeats_in_texts_longer_than_a_chunk(spark):
    rng = random.Random(9)
    size = repeats.CHUNK_BYTES
    long = "".join(rng.choices("abcdefgh", k=2 * size + 300))
    other = "é" + long[size - 40 : size + 90] + "zzz" + long[-120:] + long[: size // 4] + "x" * 500
    docs = [(3, long), (1, other), (7, long[size - 10 : size + 400]), (5, "x" * 400), (9, "ab" * 40 + "".join(rng.choices("abcdefgh", k=200)) + "ab" * 40), (2, "ba" * 45)]
    compare_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), docs)


def test_repeats_by_bytes_not_by_digits(spark, monkeypatch):
    """Spans with equal fingerprints but other bytes stay apart."""
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    n = np.array([60, 60, 60])
    zero = np.zeros(3, np.uint64)
    s = repeats.Spans(zero, zero, np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64), n - 49, text, np.array([0, 60, 120]), n)
    kept, later, own, _ = s.settle()
    assert kept.doc.tolist() == [1, 2, 3] and not len(later.doc) and not len(own.doc)
    span, at = repeats.repeated_windows(kept, 50)
    assert set(zip(kept.doc[span].tolist(), at.tolist(), strict=True)) == {(3, k) for k in range(11)}


# 6 top-k


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(300)]  # ties in one place
    rows += [(1050, None), (1100, [1.0, None] * 4), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, rows[0][1]), (1250, [1.0, 2.0]), (1251, [3.0, 4.0]), (1300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash")).repartition(4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.nearest(df).collect()) == brute.top_k(rows)
    assert top_k.nearest(df.limit(0)).count() == 0


def test_top_k_of_repeated_ids_and_large_scores(spark):
    rng = random.Random(3)
    rows = [(50 * (i % 4), [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(40)] + [(1, [0.0] * 6)]
    big = [(50, [2.0**21, 0.0]), (1, [1.2e5, 1.0]), (2, [1.2e5 + 2**-8, 0.0]), (3, [1.2e5, 5.0]), (4, [-1.2e5, 0.0]), (100, [1.0, 2.0**21])]
    for some in (rows, [*big, (50, big[0][1])]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(3)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.nearest(df).collect()) == brute.top_k(some)
    assert max(abs(t[3]) for t in brute.top_k(big)) > 2**53
    huge = spark.createDataFrame([(50, [1e15]), (1, [1e14]), (2, [1e15]), (3, [-1e15]), (4, [0.0]), (5, [1e307])], "vec_id long, embedding array<double>")  # beyond 64 bits: their ends
    assert [(r.vec_id, r.score) for r in top_k.nearest(huge).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 0), (3, -(2**63) + 1)]


# 7 BPE, 10 packing


def test_bpe_equals_the_library(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    path = byte_bpe.ranks_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab'slvedmrt  \n\t1é.! 日") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    data, off = byte_bpe.raw(pa.array(texts))
    ids, ends = byte_bpe.pieces(path).ids(data, off)
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == [enc.encode_ordinary(t) for t in texts]
    assert byte_bpe.load(path).decode(ids.astype(np.int64)).tobytes() == data.tobytes()
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (100, 255, 256, 257, 258, 700, 5000) for letters in ("ab", "theraion", "aé日x", "lowerandhigher") for _ in range(8)] + ["a" * 50_001, "tion" * 3000]
    flat, sizes = byte_bpe.load(path).encode([t.encode() for t in long])
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [enc.encode_ordinary(t) for t in long]
    got = {r.doc_id: r for r in byte_bpe.encode_decode(odd(spark)).collect()}
    for i, t in enumerate(ODD):
        want = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.token_ids(odd(spark)).count() == len(ODD) and byte_bpe.encode_decode(empty(spark)).count() == 0


def test_bpe_of_the_table_and_of_null_ids(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.ranks_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, sf_dir).collect()}
    for i, t in documents(spark, sf_dir):
        want = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    rows = byte_bpe.encode_decode(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "None", "None"] and len({r.ids_sha256 for r in rows}) == 1


def test_pieces_of_one_fingerprint_stay_apart():
    path = byte_bpe.ranks_path()
    own = pretoken.Pieces(byte_bpe.load(path).encode)
    own.prints.of = lambda prefix, start, end: np.zeros(len(start), np.uint64)  # all pieces of a length collide
    data, off = byte_bpe.raw(pa.array(["one two six", "ten"]))
    got, want = own.ids(data, off), byte_bpe.pieces(path).ids(data, off)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(spark, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(odd(spark), length=length, keep_ids=True).collect()
    for i, text in enumerate(ODD):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == want and all(p.doc_tokens == len(want) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4")) for p in own)
    lengths: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == lengths.get(p.sequence_id, 0)
        lengths[p.sequence_id] = p.offset + p.length
    assert all(n == length for s, n in lengths.items() if s != max(lengths)) and sorted(lengths) == list(range(len(lengths)))
    assert packing.pack(empty(spark)).count() == 0


# 8 languages


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)
    model = language_id.learn(docs)
    junk = spark.createDataFrame([(1, "qxzjw vkqjx zzxqw kkvvq wxqzk jjqqx vvwwx zqxjk " * 5), (2, None), (3, "123 !?"), (4, "Étre de sur è.")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.row.doc_id: r for r in language_id.predict(junk, model).collect()}
    assert [got[i].rejected for i in (1, 2, 3, 4)] == [True, True, True, False] and got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "fr"


def test_languages_by_plain_centroids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs, per_language=10**6).collect()}  # all labelled rows
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = brute.languages(learned, [t for _, t, _ in rows], language_id.CENTROIDS, language_id.STEPS, language_id.DIMS)
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_languages_without_labels(spark):
    assert {r.lang_pred for r in language_id.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd(spark)).count() == len(ODD) and language_id.identify(empty(spark)).count() == 0


# 9 n-gram join


def near_groups(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    docs = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 40, 150]))]
        docs += [" ".join(edit(base, rng.choice([0, 0, 1, 2, 3, 5]))) for _ in range(rng.choice([2, 5, 40]))]
    line = [rng.choice(words) for _ in range(70)]
    docs += [" ".join(edit(line, rng.choice([0, 1])) + rng.choices(words, k=rng.choice([0, 3, 5, 50]))) for _ in range(150)]
    docs += ["", None, "  \n", "A b C", "a B c", "a", "a"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n,tenths", [(3, 90), (5, 80)])
def test_join(spark, n, tenths, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    docs = near_groups(n)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("clash")).repartition(3)
    want = brute.components(docs, n, tenths)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, tenths).collect()} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, tenths, salt_rows=8).collect()} == want  # signatures of over 8 are split


def test_join_of_odd_rows(spark):
    assert {r.doc_id: r.component_id for r in ngram_join.join(odd(spark)).collect()} == {i: c for i, (_, c) in brute.components(list(enumerate(ODD))).items()}
    assert ngram_join.join(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "A b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.join(df).collect()) == [(0, 0), (5, 5), (5, 5), (6, 5)]


def test_frequent_tokens_index_in_pairs():
    levels = np.zeros(ngram_join.COUNTERS, np.uint16)
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    levels[ngram_join.counter(x[:300])] = 200  # frequent
    y = np.unique(np.append(x[: len(x) - 20], rng.integers(0, 1 << 63, 20, dtype=np.uint64)))  # at the bound of e
    row, sig, _ = ngram_join.signatures(np.append(x, y), np.array([0, len(x), len(x) + len(y)]), levels, 100, 90)
    assert set(sig[row == 0]) & set(sig[row == 1])


@pytest.mark.parametrize("tenths", [50, 80, 90, 100])
def test_small_documents_of_frequent_tokens_share_a_signature(tenths):
    levels = np.full(ngram_join.COUNTERS, 200, np.uint16)  # all are frequent
    rng = np.random.default_rng(4)
    for size in [*range(1, 131), *range(250, 310, 6), *range(1000, 1400, 40), 5000]:
        for _ in range(4):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            lost = size - -(-size * tenths // 100)
            y = np.sort(rng.choice(x, size - lost, replace=False))  # the fewest that a partner can have
            row, sig, _ = ngram_join.signatures(np.append(x, y), np.array([0, len(x), len(x) + len(y)]), levels, 100, tenths)
            assert tenths < 80 or len(sig) < 8 * size + 64
            assert set(sig[row == 0]) & set(sig[row == 1]), size


@pytest.mark.parametrize("n,tenths", [(3, 90), (5, 80)])
def test_join_of_many_small_copies(spark, n, tenths):
    rng = random.Random(n)
    docs = []
    for size in (1, 2, 3, 4, 5, 8, 12, 18, 20, 40, 71, 80, 100):
        base = [f"{size}w{i}" for i in range(size + n - 1)]
        near = [base[:-1] if size > 1 else base, [*base, "more"]]
        docs += [" ".join(base)] * 110 + [" ".join(x) for x in near for _ in range(3)] + [" ".join([*base[: len(base) // 2], f"other{size}"])]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)  # several chunks in a task
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, tenths).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.components(docs, n, tenths)


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = p.languages(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() > 0.99 * docs.count()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = p.near_duplicates(spark, one, sf_dir)
    keep = {i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in two.collect()} == keep and two.schema == docs.schema
    three = p.repeated_passages(spark, two, sf_dir)
    want = brute.repeats([(i, t) for i, t in rows if i in keep])
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and {i: r.text for i, r in got.items()} == {i: w[4] for i, w in want.items()} and all(r.n_chars == len(r.text) for r in got.values())
    out = p.run(spark, sf_dir)
    assert sum(r.length for r in out.collect()) == sum(r.length for r in p.packed(spark, three, sf_dir).collect())
    for _, stage in p.STAGES[:-1]:
        stage(spark, empty(spark), sf_dir).count()
        stage(spark, odd(spark), sf_dir).count()
