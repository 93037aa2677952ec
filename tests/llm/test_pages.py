"""WARC bundles and main-text extraction."""

import base64
import collections
import hashlib
import html
import random
import re

from pyspark.sql import functions as F

from actiontrail.llm import html_extract, warc
from actiontrail.llm.dom import parse

PAGES = [(3, "http://a/x", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, "<p>same</p>"), (7, "u\r\nv", "É" * 10), (8, "w", None), (9, "w", ""),
         (None, "n", "<p>same</p>"), (None, "n", "alone"), (1, "http://b", "<p>same</p>"), (11, "big", "x" * 300_000), (12, "crlf", "a\r\n\r\nWARC/1.1\r\n")]


def table(spark, rows):
    return spark.createDataFrame([(p, u, h, "t", "d") for p, u, h in rows], "page_id long, url string, html string, text string, digest string").repartition(3)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_bundles_are_read_by_many_tasks(spark):
    """Paths are short rows, which Spark would put into one task."""
    rng = random.Random(2)
    pages = [(i, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3000))) for i in range(64)]
    index = warc.write(table(spark, pages), frame_bytes=2000, bundle_bytes=6000)
    bundles = index.select("path").distinct().count()
    tasks = warc.read(index).groupBy(F.spark_partition_id().alias("task")).count().count()
    assert bundles >= 8 and tasks >= 4


def test_archives(spark):
    index = warc.write(table(spark, PAGES), frame_bytes=2000, bundle_bytes=3000)
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, u, h in PAGES:
        refers = first.get(h or "")
        refers = None if refers is None or refers == p else refers
        want.append((p, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), len((h or "").encode()), b32(h),
                     "response" if refers is None else "revisit", refers, None if refers is not None else (h or "").encode()))
    got = [(*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in warc.read(index).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({(r.path, r.frame) for r in rows}) >= 3
    for r in rows:
        head, block = warc.fetch(r.path, r.frame, r.offset, r.length)
        assert head["WARC-Record-ID"] == r.record_id and block.startswith(b"HTTP/1.1 200 OK")
    assert warc.archive_report(table(spark, [])).count() == 0


def test_least_size_and_plain_readers(spark):
    import zstandard

    index = warc.write(table(spark, PAGES), least=12)
    assert warc.read(index).where("record_type = 'revisit'").count() == 0
    for path in {r.path for r in index.collect()}:
        data = warc.get(path)
        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
        assert whole.count(b"WARC-Type: response") >= 1


def test_reader_of_odd_html():
    texts = lambda page: [t for n in parse(page) for _, t in sorted(n.texts)]
    assert texts("") == [] and texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<b>b<p>c</p>d") == ["d", "ab", "c"]
    assert texts('<script>var t="</p>";</script>x<style>p{}') == ["x"]
    assert texts("<div>a<br>b  c\n</div><!-- <p>no --><ul><li>1<li>2</ul>") == ["a b c", "1", "2"]
    assert texts("<p title=\"a>b\">x</p><p class='open>y") == ["x", "y"]
    assert texts("a < b and <3") == ["a < b and <3"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]


def test_only_raw_text_is_skipped():
    texts = lambda page: [t for n in parse(page) for _, t in sorted(n.texts)]
    for tag in ("svg", "math", "select", "object", "template", "noscript"):
        assert texts(f"<{tag}><article><p>a</p></article><div>b</div>") == ["a", "b"], tag
        assert texts(f"<p>x <{tag}>in</{tag}> y</p>z") == ["z", "x", "y", "in"], tag
    assert texts("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds</p>") == ["so", "holds", "E=m"]
    assert texts("<svg><path d='M0'/><g><text>t</text></svg><p>a</p>") == ["t", "a"]
    assert texts("<p>a</p><script>x" + "\u0130" * 20 + "</script>b<p>" + "c" * 30) == ["b", "a", "c" * 30]
    assert texts("<script>1</scripture>2</SCRIPT >a") == ["a"]
    assert texts("<style>1</\u017ftyle>2</Style/>a") == ["a"]


def test_formulas_and_unclosed_parts_of_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(60)
    model = html_extract.train(pages)
    rows = [r.html for r in pages.collect()]
    plain = html_extract.texts_of(rows, model)
    for tag in ("svg", "math", "select", "object", "template", "noscript"):
        assert html_extract.texts_of([p.replace("<article>", f"<{tag}><article>", 1) for p in rows], model) == plain, tag
    formula = "<p>It is known that <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds in this and in many other cases.</p>"
    found = html_extract.texts_of([p.replace("<article>", "<article>" + formula, 1) for p in rows], model)
    assert sum("It is known that holds in this" in t or "E=m" not in t for t in found) == 0


def test_features_of_many_siblings():
    nodes = parse("".join(f"<p>{'x' * (k + 1)}</p>" for k in range(500)) + "<div>y</div>")
    rows = html_extract.features(nodes)[1:]
    assert [r[11] for r in rows] == [k / 501 for k in range(501)]
    assert [r[13] for r in rows] == [500 / 501] * 500 + [1 / 501]
    assert [r[14] for r in rows] == [(k + 1) / 500 for k in range(500)] + [1 / 500]


def gold(page):
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", found)).split())


def test_pages_and_held_out_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.train(pages)
    got = html_extract.extract(pages, model).collect()
    assert all(r.text == gold(r.html) and r.n_chars == len(r.text) for r in got)
    words = [w for r in got[:40] for w in r.text.split()][:4000]
    rng, right = random.Random(77), collections.Counter()
    for _ in range(150):
        page = html_extract.layout([r.text for r in got[40:80]], words, rng)
        nodes = parse(page)
        right[html_extract.texts_of([page], model)[0] == html_extract.main_text(nodes, [bool(v) for v in html_extract.labels_of(nodes)])] += 1
    assert right[True] >= 140


def test_decoding_is_consistent():
    import numpy as np

    nodes = parse("<div><nav><p>a</p></nav><article><p>b</p></article></div>")
    kept = html_extract.decoded(nodes, np.array([0, 2, -6, 3, 4, 5.0]))
    assert html_extract.main_text(nodes, kept) == "b"
    kept = html_extract.decoded(nodes, np.array([0, 2, -1, 3, 4, 5.0]))  # a strong child lifts a weak parent
    assert html_extract.main_text(nodes, kept) == "a b"


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (3, "u", "<nav>a</nav>")]
    got = html_extract.extract(table(spark, rows), html_extract.train(table(spark, rows))).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and "digest" in got[0].asDict()
    assert {r.page_id: r.text for r in got}[1] == ""
    assert html_extract.train(table(spark, [])) is None and html_extract.extraction_report(table(spark, [])).count() == 0
