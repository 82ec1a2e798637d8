"""Values beyond what caps once held: long secrets, ids of other types, components far apart, marks in names."""

import math
import time

import numpy as np
import pytest

from leafmill.llm import html_extract, secrets, topk, toxicity


def plain_urls(text):
    """(start, end, password) by trying every start, leftmost first, without overlaps."""
    out, at = [], 0
    blank = set(" \t\n\r\x0b\x0c/:@\x1c\x1d\x1e\x1f\x85\xa0")
    while at < len(text):
        k = at
        if text[k] in secrets.LETTERS:
            z = k + 1
            while z < len(text) and text[z] in secrets.SCHEME:
                z += 1
            if z - k >= 2 and text[z : z + 3] == "://":
                u = z + 3
                while u < len(text) and text[u] not in blank:
                    u += 1
                p = u + 1
                while p < len(text) and text[p] not in blank:
                    p += 1
                if u > z + 3 and text[u : u + 1] == ":" and p - u - 1 >= 6 and text[p : p + 1] == "@":
                    out.append((k, p + 1, text[u + 1 : p]))
                    at = p + 1
                    continue
        at += 1
    return out


def test_url_passwords_of_any_length():
    texts = ["see ftp://u:secret1@h and 9http://a:b23456@x", "a://u:123456@h", "ab://u:12345@h", f"x+y.z://{'u' * 500}:{'p' * 900}@h", f"{'s' * 300}://u:longer1@h", "ab://:123456@ ab://u:12 3456@", "ab://u:123456@cd://v:abcdef@e", "://u:123456@", "-.://u:123456@ 1a-b://u:123456@"]
    for t in texts:
        assert [(a, z, v) for _, a, z, v in secrets.url_passwords(t)] == plain_urls(t), t
    began = time.time()
    for hostile in ("a" * 400_000 + "://", "a://" * 100_000, "ab://" + "u:" * 200_000, "ab://u:" + "p" * 400_000):
        assert secrets.url_passwords(hostile) == []
    assert time.time() - began < 5


def test_toxicity_takes_ids_of_any_type(spark):
    good, bad = "the weather is mild and the road is long", "you are a vile filthy idiot"
    docs = spark.createDataFrame([(f"doc-{k}", bad if k % 3 == 0 else good) for k in range(90)] + [(None, bad)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"doc-{k}", int(k % 3 == 0)) for k in range(90)] + [("none", 1)], "doc_id string, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 91 and all((r["predicted"] == 1) == (r["doc_id"] is None or int(r["doc_id"][4:]) % 3 == 0) for r in got)
    assert toxicity.keep_clean(docs, labels).count() == 60
    numbers = spark.createDataFrame([(str(k), int(k % 3 == 0)) for k in range(90)] + [("no number", 1)], "doc_id string, toxic int")
    ids = docs.where("doc_id IS NOT NULL").selectExpr("CAST(substring(doc_id, 5) AS INT) AS doc_id", "text")
    assert sum(r["predicted"] for r in toxicity.toxicity(ids, numbers).collect()) == 30


@pytest.mark.parametrize("large", [1e5, 1e9, 1e17, 3e38])
def test_topk_with_large_components(spark, large):
    g = np.random.default_rng(4)
    rows = [(k, g.normal(size=8).round(3).tolist()) for k in range(120)]
    rows[7], rows[50], rows[90] = (7, [large] + [0.1] * 7), (50, [-large] + [0.3] * 7), (90, [0.0] * 7 + [large])
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {k: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v] for k, v in rows}
    want = []
    for q in range(0, 120, 50):
        held = lambda x: max(-(2**63), min(2**63 - 1, x))
        s = sorted((-held(sum(a * b for a, b in zip(whole[q], v, strict=True))), k) for k, v in whole.items() if k != q)[:5]
        want += [(q, r, k, -x) for r, (x, k) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in topk.top_k(d).select("query_id", "rank", "vec_id", "score").collect()) == want


@pytest.mark.parametrize(("source", "text"), [
    ('<div class="page no-sidebar"><article><p>one</p></article></div>', "one"),
    ('<article class="post has-comments"><p>two</p><div class="comments"><p>a reader</p></div></article>', "two"),
    ('<article><details class="cookie-recipe"><p>bake</p></details><math>x</math></article>', "bake\nx"),
    ('<div class="search-results-story"><p>story</p></div>', "story"),
    ('<div class="menu-wrap"><p>a menu</p><main><p>main</p></main></div>', "main"),
    ('<section id="comments"><article class="comment-body">a reader</article></section><p>three</p>', "three"),
    ('<div class="cookie-banner">we bake</div><div class="site-nav"><p>home</p></div><div class="sidebar-left">x</div><p>four</p>', "four"),
])
def test_marks_name_parts_and_nothing_else(source, text):
    assert html_extract.main_text(html_extract.parse(source), [], set()) == text
