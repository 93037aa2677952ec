"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block node of a page has features: subtree text and link density, tag density, words of its class, id and role,
depth, place among its siblings and how alike they are. The trees give each node the odds of belonging to (or holding)
the main text. Decoding picks the likeliest labelling of the whole tree under one rule: below a node that is dropped
nothing is kept. The text is the kept nodes' own texts in page order.

There are no labels for pages, so `train` makes them: it takes the texts of at most `TRAIN_PAGES` pages (those with the
smallest hashes of their page_id) and sets them into page layouts of many kinds, where the place of the main text is known; the
sampled pages that hold one <article> or <main> join them. Scores never rise with the words of class, id and role that stand for
other parts, nor with the link density (monotonic constraints).

Null and empty html give an empty text. Scripts, styles, titles, frames, text fields and comments are never text; formulas, drawings,
choices, templates and what stands for scripts and objects are nodes like others. Pages are cut nowhere;
repeated rows are treated alike; other columns are kept, and text and n_chars are replaced.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.dom import ASIDE_WORDS, MAIN_WORDS, Node, parse
from actiontrail.llm.shared import ship
from actiontrail.llm.trees import Forest, fit

TRAIN_PAGES = 120
LAYOUTS_PER_PAGE = 3
SEED = 11
KINDS = (("p", "blockquote", "pre"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("div", "section"),
         ("article", "main"), ("nav",), ("header",), ("footer", "address"), ("aside",), ("form", "fieldset"), ("figure", "figcaption", "table", "tr", "td"))
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
#: Features that may only lower the score.
MONOTONE = {3: -1, 5: -1, 6: -1}


def features(nodes: list[Node]) -> list[list[float]]:
    """One row for each node; subtree sums are gathered from the last node to the first."""
    n = len(nodes)
    place = {id(node): k for k, node in enumerate(nodes)}
    own = [sum(len(t) for _, t in node.texts) for node in nodes]
    chars, links, tags, ends, blocks = own[:], [node.links for node in nodes], [1 + node.inline for node in nodes], [0] * n, [0] * n
    paragraphs = [0] * n
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        ends[k] += sum(t.count(". ") + t.count(", ") + t.endswith(".") for _, t in node.texts)
        blocks[k] += len(node.texts)
        paragraphs[k] += node.tag == "p"
        if node.parent is not None:
            up = place[id(node.parent)]
            for sums in (chars, links, tags, ends, blocks, paragraphs):
                sums[up] += sums[k]
    total = max(chars[0], 1)
    # Of each node: its place among its parent's kids; of each parent: its kids' tags and their longest text.
    at, tally, longest = [0] * n, [Counter()] * n, [0] * n
    for k, node in enumerate(nodes):
        tally[k] = Counter(s.tag for s in node.kids)
        for i, s in enumerate(node.kids):
            at[place[id(s)]] = i
            longest[k] = max(longest[k], chars[place[id(s)]])
    aside_above, main_above = [0] * n, [0] * n
    out = []
    for k, node in enumerate(nodes):
        bad = len(node.words & ASIDE_WORDS)
        good = len(node.words & MAIN_WORDS)
        up = place[id(node.parent)] if node.parent is not None else -1
        plain_bad = bad > 0 or KIND.get(node.tag, -1) in (7, 8, 9, 10, 11)
        aside_above[k] = (aside_above[up] if up >= 0 else 0) + plain_bad
        main_above[k] = (main_above[up] if up >= 0 else 0) + (good > 0 or KIND.get(node.tag, -1) == 6)
        siblings = len(nodes[up].kids) if up >= 0 else 1
        same = tally[up][node.tag] if up >= 0 else 1
        most = longest[up] if up >= 0 else chars[k]
        row = [math.log1p(chars[k]), chars[k] / total, math.log1p(own[k]), links[k] / max(chars[k], 1), tags[k] / (1 + chars[k] / 100),
               bad, aside_above[k], good, main_above[k], node.depth, len(node.kids), at[k] / siblings, siblings, same / siblings,
               chars[k] / max(most, 1), ends[k] / (1 + chars[k] / 100), chars[k] / max(blocks[k], 1), math.log1p(paragraphs[k]),
               node.order / (1 + nodes[-1].order), chars[up] / total if up >= 0 else 1.0]
        kind = [0.0] * len(KINDS)
        if node.tag in KIND:
            kind[KIND[node.tag]] = 1.0
        out.append(row + kind)
    return out


def decoded(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels under the rule that nothing below a dropped node is kept; the root is kept."""
    n = len(nodes)
    place = {id(node): k for k, node in enumerate(nodes)}
    keep = (-np.logaddexp(0, -odds)).tolist()
    drop = (-np.logaddexp(0, odds)).tolist()
    for k in range(n - 1, 0, -1):
        up = place[id(nodes[k].parent)]
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    out = [True] * n
    for k in range(1, n):
        out[k] = out[place[id(nodes[k].parent)]] and keep[k] > drop[k]
    return out


def main_text(nodes: list[Node], kept: list[bool]) -> str:
    parts = sorted(t for node, ok in zip(nodes, kept) if ok for t in node.texts)
    return " ".join(t for _, t in parts)


def layout(texts: list[str], short: list[str], rng: random.Random) -> str:
    """A page of a random kind around some paragraphs; data-k says which parts are main text."""
    some = lambda least, most: " ".join(rng.choice(short) for _ in range(rng.randint(least, most)))
    part = lambda: rng.choice(texts)
    links = lambda k: "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(k))
    deep = lambda inner: inner if rng.random() < 0.6 else f"<div>{inner}</div>"
    beside = {
        "nav": lambda: f'<nav data-k="0"><ul>{links(rng.randint(2, 9))}</ul></nav>',
        "menu": lambda: f'<div class="{rng.choice(["menu", "navbar", "main-nav"])}" data-k="0"><ul>{links(rng.randint(2, 9))}</ul></div>',
        "header": lambda: f'<header data-k="0"><div>{some(1, 4)}</div><p>{some(2, 8)}</p></header>',
        "ad": lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "banner"])}" data-k="0">{some(4, 40)}</div>',
        "cookie": lambda: f'<div {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "cookie", "consent", "notice"])}" data-k="0"><p>{some(5, 30)}</p></div>',
        "aside": lambda: f'<aside data-k="0"><h3>{some(1, 3)}</h3><p>{part() if rng.random() < .4 else some(5, 40)}</p><ul>{links(rng.randint(0, 5))}</ul></aside>',
        "sidebar": lambda: f'<div class="{rng.choice(["sidebar", "widget", "related"])}" data-k="0"><h3>{some(1, 3)}</h3><p>{some(5, 60)}</p></div>',
        "comments": lambda: f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="comments" data-k="0">' + "".join(
            f'<div class="comment"><p>{part() if rng.random() < .5 else some(3, 40)}</p></div>' for _ in range(rng.randint(1, 6))) + f"</{t}>",
        "form": lambda: f'<form data-k="0"><p>{some(2, 10)}</p><input name="q"><button>{some(1, 2)}</button></form>',
        "share": lambda: f'<div class="share" data-k="0"><a href="#">{some(1, 1)}</a> <a href="#">{some(1, 1)}</a></div>',
        "footer": lambda: f'<footer data-k="0">&copy; {some(1, 4)} &middot; {some(2, 25)}</footer>',
        "foot": lambda: f'<div class="footer" data-k="0"><p>&copy; {some(2, 20)}</p></div>',
    }
    put = lambda *names: "".join(deep(beside[x]()) for x in names if rng.random() < 0.5)
    inner = []
    if rng.random() < 0.8:
        inner.append(f"<h1>{some(2, 9)}</h1>")
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8])):
        x, text = rng.random(), part() if rng.random() < .8 else some(1, 12)
        inner.append(f"<p>{text}</p>" if x < .5 else f"<p><b>{text}<br>" if x < .65 else f"<p>{text}" if x < .75 else f"<h2>{some(1, 6)}</h2><p>{text}</p>" if x < .85
                     else f"<blockquote>{text}</blockquote>" if x < .9 else f"<ul><li>{text}</li><li>{some(2, 12)}</li></ul>" if x < .95 else f"<div>{text}</div>")
        if rng.random() < .12:
            inner.append(beside[rng.choice(["ad", "share", "aside", "form"])]())
    open_, close = rng.choice([("<article data-k='1'>", "</article>")] * 3 + [("<main data-k='1'>", "</main>")] * 2 + [
        (f'<div class="{c}" data-k="1">', "</div>") for c in ("content", "post", "entry-content", "article-body", "story")] + [
        ("<section data-k='1'>", "</section>"), ("<div data-k='1'>", "</div>"), ("<div id='main' data-k='1'>", "</div>")])
    open_ = open_.replace("'", '"')
    body = open_ + "".join(inner) + put("comments") * (rng.random() < .3) + close
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f"<div>{put('sidebar') * (rng.random() < .4)}{body}{put('aside', 'sidebar') * (rng.random() < .4)}</div>"
    page = put("cookie", "header", "nav", "menu", "ad", "form") + body + put("share", "comments", "aside", "ad", "footer", "foot")
    return f"<html><head><title>{some(1, 5)}</title></head><body>{page}</body></html>"


def labels_of(nodes: list[Node]) -> list[int] | None:
    """1 for nodes of the main text or above it. Marked layouts say; else the one article or main does."""
    if any(n.mark for n in nodes):
        inside: dict[int, bool] = {}
        for n in nodes:
            inside[id(n)] = n.mark == "1" if n.mark else (inside[id(n.parent)] if n.parent is not None else False)
    else:
        tops = [n for n in nodes if n.tag in ("article", "main") and not (n.parent and n.parent.tag in ("article", "main"))]
        if len(tops) != 1:
            return None
        inside = {}
        for n in nodes:
            aside = KIND.get(n.tag, -1) in (7, 9, 10, 11) or bool(n.words & ASIDE_WORDS)
            inside[id(n)] = n is tops[0] or (n.parent is not None and inside[id(n.parent)] and not aside)
    holds = {id(n): inside[id(n)] for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and holds[id(n)]:
            holds[id(n.parent)] = True
    return [int(holds[id(n)]) for n in nodes]


def train(pages: DataFrame, rows: int = TRAIN_PAGES, seed: int = SEED) -> Forest | None:
    """Trees over the nodes of at most `rows` pages and of layouts made from their texts."""
    # First only hashes are ordered, so that no task sends pages that are not used.
    keyed = pages.where("html IS NOT NULL AND html != ''").select("html", F.xxhash64("page_id").alias("_page"), F.xxhash64("html").alias("_html"))
    picks = [tuple(r) for r in keyed.select("_page", "_html").orderBy("_page", "_html").limit(rows).collect()]
    chosen = F.col("_page").isin([p for p, _ in picks]) & F.col("_html").isin([h for _, h in picks])
    found = keyed.where(chosen).dropDuplicates(["_page", "_html"]).collect() if picks else []
    wanted = set(picks)
    some = [h for *_, h in sorted({(r["_page"], r["_html"], r["html"]) for r in found if (r["_page"], r["_html"]) in wanted})]
    if not some:
        return None
    rng = random.Random(seed)
    real = [parse(page) for page in some]
    texts = [t for nodes in real for node in nodes for _, t in node.texts if len(t) > 60] or [t for nodes in real for node in nodes for _, t in node.texts]
    if not texts:
        return None
    short = [w for t in texts for w in t.split()][:20_000]
    trees = real + [parse(layout(texts, short, rng)) for _ in range(LAYOUTS_PER_PAGE * max(len(some), 60))]
    x, y = [], []
    for nodes in trees:
        labels = labels_of(nodes)
        if labels is not None:
            x += features(nodes)[1:]
            y += labels[1:]
    if len(set(y)) < 2:
        return None
    return fit(np.asarray(x, float), np.asarray(y, float), trees=40, depth=5, rate=0.25, monotone=MONOTONE)


def texts_of(pages: list[str | None], model: Forest | None) -> list[str]:
    """The main texts of some pages; all their nodes are scored together."""
    trees = [parse(p) if p else [] for p in pages]
    rows = [row for nodes in trees if nodes for row in features(nodes)]
    odds = model.raw(np.asarray(rows, float)) if model is not None and rows else np.ones(len(rows))
    out, at = [], 0
    for nodes in trees:
        own, at = odds[at:at + len(nodes)], at + len(nodes)
        out.append(main_text(nodes, decoded(nodes, own)) if nodes else "")
    return out


def extract(pages: DataFrame, model: Forest | None) -> DataFrame:
    """Adds text and n_chars (code points)."""
    ship(pages.sparkSession)
    plain = pages.drop("text", "n_chars")
    place = plain.columns.index("html")
    schema = T.StructType(plain.schema.fields + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = texts_of(part.column(place).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                                 names=schema.fieldNames())

    return plain.mapInArrow(run, schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html"), train(pages)).select("page_id", "url", "text", "n_chars")
