"""Operators against brute force, and the cases their docstrings define."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, html_extract, license_scan, mixing, neardup, secrets, token_count, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
LONG = "alpha beta gamma delta " * 6000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated rows, and columns named like the operators' own."""
    body = " ".join(f"w{k}" for k in range(40))
    return docs(spark, [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, body, "b"), (4, body, "b"), (5, body + " end", "b"), (None, body, None), (6, "%%% &&&", "c"), (7, "one two", "c")])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_tokens_equal_library(spark, corpus, odd, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for d in (corpus, odd):
        text = {(r["doc_id"], len((r["text"] or "").encode())): r["text"] or "" for r in rows_of(d)}
        for r in rows_of(token_count.token_counts(d, MODEL)):
            t = text[r["doc_id"], r["n_bytes"]]
            assert r["n_tokens"] == len(lib.encode(t)) and r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_count.token_counts(none, MODEL).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\n\nb \n c", "<s>x</s>", "▁a▁b", " ①é　", "\x00\r\n\t", "unbelievable " * 3])
def test_prefix_table(text):
    lib, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_count.Vocabulary(MODEL)
    assert list(v.table(text)) == [len(lib.encode(text[:k])) for k in range(len(text) + 1)]


def test_budget_questions(spark):
    d = token_count.with_prefix_counts(docs(spark, [(1, "the cat sat on the mat", "a"), (2, None, "a")]), MODEL)
    got = d.select("doc_id", token_count.chars_within(F.col("prefix_tokens"), F.lit(3)).alias("c"), token_count.tokens_until(F.col("prefix_tokens"), F.lit(7)).alias("t")).orderBy("doc_id").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "the cat sat on the mat"
    assert got[0]["c"] == max(k for k in range(len(text) + 1) if len(lib.encode(text[:k])) <= 3)
    assert got[0]["t"] == len(lib.encode(text[:7])) and got[1]["c"] == 0 and got[1]["t"] == 0


def test_mixing_targets(spark, corpus, odd, none):
    for d in (corpus, odd):
        got = rows_of(mixing.mix(d))
        assert len(got) == d.count()
        size = {}
        for r in rows_of(d):
            size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        order = sorted(size, key=lambda s: (s is None, s))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        target, active, left = {}, set(order), 1.5 * sum(size.values())
        while over := [s for s in active if left * weight[s] / sum(weight[a] for a in active) > 2 * size[s]]:
            for s in over:
                target[s] = 2 * size[s]
                active.remove(s)
            left = 1.5 * sum(size.values()) - sum(target.values())
        target |= {s: left * weight[s] / sum(weight[a] for a in active) for s in active}
        for r in got:
            assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        if d is corpus:
            for s in order:
                assert sum(r["taken"] for r in got if r["source"] == s) == pytest.approx(target[s], rel=0.05)
    assert mixing.mix(none).count() == 0


def test_newton_equals_brute_force_solver(spark):
    """The coupled dual against a plain solver of the same equations, clipped rates and capped sources included."""
    rng = np.random.default_rng(2)
    rows, targets = [], []
    for k, (low, high, share) in enumerate(((5, 60, 1.3), (200, 900, 0.4), (20, 400, 1.97), (30, 90, 2.0))):
        size = rng.integers(low, high, 80)
        rows += [(f"s{k}", float(np.log2(x)), int(x)) for x in size]
        targets.append((f"s{k}", int(size.sum()), float(share * size.sum())))
    mean = sum(z * n for _, z, n in rows) / sum(n for *_, n in rows)
    rows = [(k, z - mean, n) for k, z, n in rows]
    dual, mu = mixing.entropy_balance(spark.createDataFrame(rows, "key string, z double, tokens long"), spark.createDataFrame(targets, "key string, source_size long, target double"))
    got = {r["key"]: r["lambda"] for r in dual.collect()}
    total = sum(n for *_, n in rows)

    def solve(m, key, target):
        low, high = -20.0, 20.0
        for _ in range(200):
            at = (low + high) / 2
            low, high = (at, high) if sum(n * min(2.0, math.exp(at + m * z)) for k, z, n in rows if k == key) < target else (low, at)
        return at

    def slope(m):
        at = {k: solve(m, k, t) for k, n, t in targets if t < 2 * n}
        return sum(n * z * (min(2.0, math.exp(at[k] + m * z)) if k in at else 2.0) for k, z, n in rows) + mixing.RIDGE * total * m

    low, high = -5.0, 5.0
    for _ in range(60):
        m = (low + high) / 2
        low, high = (m, high) if slope(m) < 0 else (low, m)
    assert abs(m) > 0.05 and mu == pytest.approx(m, abs=1e-3)
    for key, n, t in targets:
        assert got[key] == float("inf") if t == 2 * n else got[key] == pytest.approx(solve(m, key, t), abs=1e-3)


def test_copies_follow_rates_and_reruns_agree(spark, corpus):
    got = rows_of(mixing.mix(corpus))
    assert len({r["rate"] for r in got}) > len({r["source"] for r in got})
    assert all(math.floor(r["rate"]) - 1 <= r["copies"] <= math.ceil(r["rate"]) + 1 for r in got)
    assert sum(abs(r["copies"] - r["rate"]) >= 1 for r in got) <= 2 * mixing.REPAIRS * len({r["source"] for r in got})
    again = rows_of(mixing.mix(corpus.repartition(5)))
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_secrets_base_spans(spark, odd, none):
    key = "AKIA" + "ABCDEFGH" * 2
    texts = ["password: hunter22 and token='ab'", f"x {key} API_KEY=\"{'0' * 30}\"", "paſsword=hunter22", "ab" * 30, None, ""]
    d = docs(spark, [(i, t, f"repo{i}") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in rows_of(secrets.find_secrets(d))}
    for i, t in enumerate(texts):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(none).count() == 0


def test_secrets_ownership_and_redaction(spark):
    live, copied = "token = \"9f8a7b6c5d4e3f2a1b0c9d8e\"", "token = \"1a2b3c4d5e6f7a8b9c0d1e2f\""
    d = docs(spark, [(0, f"a {live} z", "o/r")] + [(k, f"see {copied} there", f"o{k}/r") for k in range(1, 7)])
    got = {r["doc_id"]: r for r in rows_of(secrets.find_secrets(d))}
    assert got[0]["n_live"] == 2 and got[0]["n_example"] == 0 and got[3]["n_live"] == 0 and got[3]["n_example"] == 2
    out = {r["doc_id"]: r for r in rows_of(secrets.redact(d))}
    assert out[0]["text"] == "a [SECRET]\" z" and out[0]["n_chars"] == len(out[0]["text"]) and copied in out[2]["text"]
    assert secrets.redact(d).columns == d.columns


def test_ownership_alone_decides(spark):
    d = docs(spark, [(1, "password: letter x", "o/r"), (2, "token=ab12ab", "p/r"), (3, "0" * 30, "q/r")])
    got = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in rows_of(secrets.find_secrets(d))}
    assert got == {1: (1, 0), 2: (1, 0), 3: (1, 0)}
    assert {r["doc_id"]: r["text"] for r in rows_of(secrets.redact(d))} == {1: "[SECRET] x", 2: "[SECRET]", 3: "0" * 30}


def test_topk_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = d.collect()
    v = np.floor(256 * np.array([r["embedding"] for r in rows], dtype=np.float32).astype(float)).astype(int)
    ids = [r["vec_id"] for r in rows]
    want = set()
    for i, q in zip(ids, v, strict=True):
        if i % 50 == 0:
            best = sorted((-int(s), j) for s, j in zip(v @ q, ids, strict=True) if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(d).collect()} == want


def test_topk_odd_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(d).orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 6, -65536)]
    assert topk.top_k(d.limit(0)).count() == 0


def test_topk_shared_ids_ragged_vectors_and_columns(spark):
    rows = [(0, [1.0, 0.0], 7, "a"), (0, [0.0, 1.0], 8, "b"), (0, [0.0, 1.0], 8, "b"), (1, [2.0], 1, "c"), (2, [0.5, 3.0, 9.0], 2, None), (3, [1.0, 1.0], 3, "d"), (3, [1.0, 1.0], 3, "d")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int, block string")
    got = sorted(tuple(r) for r in topk.top_k(d).collect())
    one, two = [256, 0], [0, 256]
    v = [(1, [512]), (2, [128, 768, 2304]), (3, [256, 256]), (3, [256, 256])]
    best = lambda q: sorted(((-sum(a * b for a, b in zip(q, x, strict=False)), i) for i, x in v))
    assert got == sorted((0, k + 1, i, -s) for q in (one, two) for k, (s, i) in enumerate(best(q)))


def brute_classes(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else {t or ""}
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, corpus, odd, none):
    want = brute_classes([(r["doc_id"], r["text"]) for r in corpus.collect()])
    got = rows_of(neardup.classes(corpus))
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == corpus.count()
    kept = neardup.keep_one(corpus)
    assert sorted(r["doc_id"] for r in rows_of(kept)) == sorted(set(want.values())) and kept.columns == corpus.columns
    got = {r["doc_id"]: r["class_id"] for r in rows_of(neardup.classes(odd))}
    assert got == {None: None, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert sorted(rows_of(neardup.keep_one(odd).select("doc_id")), key=str) == sorted([{"doc_id": i} for i in (1, 3, 4, 6, 7, None)], key=str)
    assert neardup.classes(none).count() == 0


def test_chain_of_links_is_one_class(spark):
    """Each text links to the next only; leaders alone would leave the chain apart."""
    w = [f"t{k}" for k in range(400)]
    d = docs(spark, [(k, " ".join(w[k * 8 : k * 8 + 140]), "a") for k in range(12)])
    assert {r["class_id"] for r in rows_of(neardup.classes(d))} == {0}


def test_repeated_passages_keep_links(spark):
    """Links are of shingle sets: a passage that repeats does not take a pair out of the bands."""
    rows = []
    for p in range(6):
        one = " ".join(f"a{p}x{k}" for k in range(404))
        rows += [(2 * p, one, "a"), (2 * p + 1, one + " " + " ".join([" ".join(f"b{p}x{k}" for k in range(92))] * 50), "a")]
    want = brute_classes([(i, t) for i, t, _ in rows])
    assert set(want.values()) == {0, 2, 4, 6, 8, 10}
    assert {r["doc_id"]: r["class_id"] for r in rows_of(neardup.classes(docs(spark, rows)))} == want


def test_prefix_index_loses_no_link(spark):
    """Of sets of different labels each pair at the threshold is a candidate, and pairs without a common rare shingle are none."""
    rng = np.random.default_rng(5)
    rows, base = [], rng.integers(0, 2**62, 300)
    for i in range(60):
        keep = base[rng.random(300) < rng.choice([0.5, 0.85, 0.95, 0.99])]
        rows.append((i, i if i % 3 else 0, np.unique(np.concatenate([keep, rng.integers(0, 2**62, rng.integers(0, 60))])).tolist()))
    got = {tuple(sorted(r)) for r in neardup.candidates_apart(spark.createDataFrame(rows, "id long, label long, set array<long>")).collect()}
    links, apart = set(), 0
    for i, li, a in rows:
        for j, lj, b in rows:
            if i < j and li != lj:
                both = len(set(a) & set(b))
                links |= {(i, j)} if both >= 0.8 * (len(a) + len(b) - both) else set()
                apart += 1
    assert links and links <= got and len(got) < apart / 2
    assert all(dict((r[0], r[1]) for r in rows)[i] != dict((r[0], r[1]) for r in rows)[j] for i, j in got)


def test_near_duplicates_other_ids_and_columns(spark):
    """String ids, a map column, columns named like the operator's own, repeated ids."""
    body = " ".join(f"w{k}" for k in range(60))
    rows = [("b", body, {"x": 1}, 1, "q"), ("a", body + " tail", {"x": 2}, 2, "q"), ("a", body + " tail", {"x": 3}, 2, "r"), ("a", "something else entirely", None, 3, "r"), ("c", None, {}, 4, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string, bucket map<string,int>, __k int, label string")
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(d).collect())
    assert got[-2:] == [("b", "a"), ("c", "c")] and {g[0] for g in got} == {"a", "b", "c"}
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == ["a", "c"]


def test_prob_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = x[:800], x[200:]
    one, two = (neardup.prob_min_hash(e, np.ones(len(e)), 4096) for e in (a, b))
    assert np.mean(one == two) == pytest.approx(0.6, abs=0.04)


def test_tiling_catches_reordered_passages(spark, none):
    item = [f"i{k}" for k in range(30)]
    moved = " ".join(["x"] * 20 + item[15:] + ["y", "z"] + item[:15] + ["x"] * 5)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    d = docs(spark, [(1, moved, "a"), (2, "nothing " * 30, "a"), (3, " ".join(item[:12]), "a"), (4, None, "a"), (5, "", "a"), (1, moved, "a")])
    for chars in (decontaminate.SLICE_CHARS, 100):
        got = rows_of(decontaminate.contamination(d, bench, chars=chars))
        assert [(r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in got] == [(1, 7, 2, 1.0)] * 2
    assert sorted(r["doc_id"] for r in rows_of(decontaminate.keep_uncontaminated(d, bench))) == [2, 3, 4, 5]
    assert decontaminate.contamination(none, bench).count() == 0


def test_tiles_do_not_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        doc, item = (rng.integers(0, 4, n).astype(np.uint64) for n in (80, 30))
        used_doc, used_item = set(), set()
        for i, j, n in decontaminate.tiles(doc, item):
            assert n >= 5 and (doc[i : i + n] == item[j : j + n]).all()
            assert not used_doc & set(range(i, i + n)) and not used_item & set(range(j, j + n))
            used_doc |= set(range(i, i + n))
            used_item |= set(range(j, j + n))


def test_toxicity_learns(spark, odd, none):
    rows = [(i, f"some quiet words number{i} here" + (" vile insult" if i % 4 == 0 else ""), "a") for i in range(400)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity(d, labels))
    held = [r for r in got if r["held_out"]]
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) and len(held) > 100
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in rows_of(toxicity.toxicity(odd, labels.limit(0)))} == {0.5}
    assert toxicity.keep_clean(d, labels).columns == d.columns


def test_url_filter(spark):
    log = spark.sql("SELECT * FROM VALUES ('bad.com', 'add', TIMESTAMP '2024-01-10', 'spam'), ('bad.com', 'remove', TIMESTAMP '2024-02-10', 'spam'), ('a.bad.com/x', 'add', TIMESTAMP '2024-01-20', 'ads'), (NULL, 'add', TIMESTAMP '2024-01-01', 'n') AS t(key, action, at, category)")
    rows = [(1, "http://u@A.bad.com:80/x/y", "2024-01-15"), (2, "http://a.bad.com/x/y", "2024-01-25"), (3, "https://bad.com", "2024-02-10"), (4, None, "2024-01-15"), (5, "http://bad.com/", None), (6, "no url", "2024-01-15"), (6, "no url", "2024-01-15")]
    c = spark.createDataFrame(rows, "page_id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    got = rows_of(url_filter.filter_urls(c, log))
    assert sorted((r["page_id"], r["matched_key"] or "") for r in got) == [(1, "bad.com"), (2, "a.bad.com/x"), (3, ""), (4, ""), (5, ""), (6, ""), (6, "")]
    assert url_filter.filter_urls(c.limit(0), log).count() == 0


def test_url_filter_deep_paths(spark):
    log = spark.sql("SELECT 'bad.com/a/b/c/d/e' AS key, 'add' AS action, TIMESTAMP '2024-01-10' AS at, 'spam' AS category")
    c = spark.createDataFrame([(1, "http://bad.com/a/b/c/d/e/f"), (2, "http://bad.com/a/b/c/d")], "page_id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-15")))
    got = {r["page_id"]: r["matched_key"] for r in rows_of(url_filter.filter_urls(c, log))}
    assert got == {1: "bad.com/a/b/c/d/e", 2: None}


def test_html_text(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; tail</h1><p>One<b> two<br>three<p>Four   five</p><script>var a='</p>';</script><div class=\"ad\">Buy</div><ul><li>Six<li>Seven</ul></article>"
        "<section id='comments'><p>First!</p></section><aside>Side</aside><form><input value=a>Send</form><footer>Foot</footer></body></html>"
    )
    plain = "<div id=top>Same top</div><div class=story><p>Body {k} text</p></div><div>Same end</div>"
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/2", "")] + [(10 + k, f"http://b.example/{k}", plain.format(k=k)) for k in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: r for r in rows_of(html_extract.extract(d))}
    assert got[1]["text"] == "Head & tail\nOne two three\nFour five\nSix\nSeven"
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert got[12]["text"] == "Body 2 text"
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_slots_choose_main_text(spark):
    """The template's slots decide where no mark does, and only they drop links or what is common."""
    page = (
        "<div class=top><p>Same top</p></div><div class=crumbs><p><a href=x>Way {k} to here</a></p></div><main><h1>Title {k}</h1><p>{lead}</p>"
        "<article><p>Told {k}</p></article><p>Rest {k}</p></main><div class=end><p>Same end</p></div>"
    )
    rows = [(k, f"http://a.example/{k}", page.format(k=k, lead=f"<a href=y>All links {k}</a>" if k == 3 else f"Lead {k}")) for k in range(12)]
    lone = "<div><p><a href=x>A list made of links</a></p></div><article><p>Teaser</p></article><div><p>Real text</p></div>"
    # The order of the template is broken: its text in another place is the page's own.
    moved = "<div class=end><p>Same end</p></div>" + page.format(k=20, lead="Lead 20").removesuffix("<div class=end><p>Same end</p></div>")
    rows += [(30, "http://b.example/", lone), (20, "http://a.example/20", moved)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows_of(html_extract.extract(d))}
    assert got[5] == "Title 5\nLead 5\nTold 5\nRest 5"
    assert got[3] == "Title 3\nAll links 3\nTold 3\nRest 3"
    assert got[30] == "A list made of links\nTeaser\nReal text"
    assert got[20] == "Same end\nTitle 20\nLead 20\nTold 20\nRest 20"
    host = html_extract.templates(d).first()
    assert host["host"] == "a.example" and html_extract.boilerplate_slots(d, html_extract.templates(d)).count() == 1


LICENSE_CASES = {
    "Released under the MIT License.": "MIT", "Lizenziert unter der MIT-Lizenz.": "MIT", "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the GNU Affero General Public License v3.": "AGPL",
    "Licensed under the Mozilla Public License 2.0.": "MPL-2.0", "All rights reserved.": "unknown", "Wir gehen mit dem Hund": None, "You need a driving license to rent a car.": None,
}


@pytest.fixture(scope="module")
def license_model(spark):
    prose = docs(spark, [(100 + k, f"ordinary prose number {k} of the corpus is here", "a") for k in range(200)])
    return license_scan.train(prose)


def test_license_families_of_unseen_wordings(spark, license_model):
    written = {b.lower().strip(".") for b, *_ in license_scan.written_rows()}
    assert not [t for t, f in LICENSE_CASES.items() if f not in ("MIT", None) and t.lower().strip(".") in written]
    texts = list(LICENSE_CASES)
    d = docs(spark, [(i, f"Some words\n{t}\nmore of it", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["license"] for r in rows_of(license_scan.scan(d, license_model)) if r["paragraph"] == 1}
    assert {t: got.get(i) for i, t in enumerate(texts)} == LICENSE_CASES


def test_license_prefilter_loses_nothing(spark, license_model):
    """Each paragraph of rows and corpus words whose likeliest class is not none has a trigger word."""
    rng = np.random.default_rng(4)
    pool = sorted({w for g in license_model.weights for w in g.split(" ")}) + ["zzz"] * 20
    bodies = [" ".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(1500)]
    d = docs(spark, [(i, b, "a") for i, b in enumerate(bodies)])
    p = license_model.probabilities(license_scan.grams(license_scan.tokens(F.col("text"))))
    seen = d.select(license_model.touches(F.col("text")).alias("t"), p.alias("p")).collect()
    other = [r for r in seen if max(r["p"][1:]) > r["p"][0]]
    assert len(other) > 50 and all(r["t"] for r in other)


def test_license_defined_cases(spark, odd, none, license_model):
    long = "filler words here " * 20_000 + "Released under the MIT License."
    d = docs(spark, [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (None, "Released under the MIT License.", None), (2, long, "a"), (3, "\n\n  \n", "a")])
    d = d.withColumns({"body": F.lit("x"), "paragraph": F.lit(9), "words": F.array(F.lit("y"))})
    got = [(r["doc_id"], r["license"]) for r in rows_of(license_scan.scan(d, license_model))]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (1, "MIT"), (None, "MIT")] + [g for g in got if g[0] == 2], key=str)
    assert license_scan.scan(odd, license_model).count() == 0 and license_scan.scan(none, license_model).count() == 0
    assert license_scan.train(none).weights


def brute_tiles(doc, item, shortest=5):
    """Greedy string tiling by its definition: again and again the longest match of unmarked words, the first of equals."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return out
        a[i : i + n] = b[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiling_is_greedy(spark):
    rng = np.random.default_rng(11)
    for k in range(60):
        doc, item = (rng.integers(0, 2 + k % 3, n).astype(np.uint64) for n in (40, 25))
        want = brute_tiles(doc.tolist(), item.tolist())
        for got in (decontaminate.tiles(doc, item), decontaminate._tiles_by_length(doc, item, 5)):
            assert sorted(n for *_, n in got) == sorted(n for *_, n in want)


def test_tiling_of_repetitive_texts_is_bounded():
    import resource

    doc, item = np.full(20_000, 7, np.uint64), np.full(2_000, 7, np.uint64)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontaminate.tiles(doc, item) == [(0, 0, 2_000)]
    cycle = np.tile(np.arange(3, dtype=np.uint64), 5_000)
    assert sum(n for *_, n in decontaminate.tiles(cycle, cycle[:900])) == 900
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_decontamination_defined_cases(spark, odd, none):
    body = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(3, body, 1)], "item_id short, text string, matched int")
    got = sorted(((r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.contamination(odd, bench))), key=str)
    assert got == [(4, 3), (4, 3), (5, 3), (None, 3)]
    kept = decontaminate.keep_uncontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in rows_of(kept)) == [1, 2, 3, 6, 7]
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0 and decontaminate.keep_uncontaminated(none, bench).count() == 0


def test_redaction_keeps_any_columns(spark):
    rows = [(1, "token=abcdef12 x", "o/r", 3, {"a": 1}), (1, "token=abcdef12 x", "o/r", 3, {"a": 1}), (None, "password: hunter22", "p/q", 4, None), (2, None, None, 5, {}), (3, "", "s", 6, {})]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, text_md5 int, cuts map<string,int>").withColumns({"b_doc": F.lit(1), "row": F.lit("r"), "new": F.lit(2)})
    out = rows_of(secrets.redact(d))
    assert secrets.redact(d).columns == d.columns and len(out) == 5
    assert sorted((r["text"] or "" for r in out)) == ["", "", "[SECRET]", "[SECRET] x", "[SECRET] x"] and {r["text_md5"] for r in out} == {3, 4, 5, 6}


def test_ownership_equals_brute_force(spark):
    """Repositories, owners and spans of each value, with a value that most sources hold."""
    rng = np.random.default_rng(6)
    rows = [(k, f"token={'sharedvalue1' if k % 3 else f'own{k:08d}'} and password: {'abcdef' * (1 + k % 2)}", f"o{rng.integers(6)}/r{rng.integers(9)}") for k in range(300)]
    want = {}
    for _, text, source in rows:
        for kind, *_, value in secrets.spans(text):
            w = want.setdefault(hashlib.sha256(value.encode()).hexdigest(), (set(), set(), []))
            w[0].add(source)
            w[1].add(source.split("/")[0])
            w[2].append(kind)
    got = {r["value_sha256"]: r for r in rows_of(secrets.ownership(secrets.scan(docs(spark, rows))))}
    assert {v: (r["n_repositories"], r["n_owners"], r["n_spans"]) for v, r in got.items()} == {v: (len(a), len(b), len(c)) for v, (a, b, c) in want.items()}
    assert sum(r["is_example"] for r in got.values()) == 3


def test_url_filter_defined_cases(spark):
    log = spark.sql("SELECT 'bad.com' AS key, 'add' AS action, TIMESTAMP '2024-01-10' AS at, 'spam' AS category")
    long = "http://bad.com/" + "a/" * 3000
    c = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (2, "http://ok.com/" + "x" * 100_000, "k")], "page_id long, url string, key string").withColumns({"fetched_at": F.to_timestamp(F.lit("2024-01-15")), "u": F.lit(1), "row": F.lit(2)})
    got = rows_of(url_filter.filter_urls(c, log, keep=("page_id", "url", "fetched_at", "key", "u", "row")))
    assert sorted((r["page_id"], r["blocked"], r["key"]) for r in got) == [(1, True, "k"), (1, True, "k"), (2, False, "k")]
    assert not any(r["blocked"] for r in rows_of(url_filter.filter_urls(c, log.limit(0))))


def test_token_cuts_equal_tables():
    v = token_count.Vocabulary(MODEL)
    for text in ("the cat sat on the mat " * 4, "unbelievable\n\n  internationalisation ①é　x", "a", "   ", "x" * 50):
        table = v.table(text)
        for limit in range(int(table.max()) + 2):
            assert v.count_and_cut(text, limit) == (table[-1], max(k for k in range(len(text) + 1) if table[k] <= limit)), (text, limit)


def test_token_cut(spark):
    text = "the cat sat on the mat " * 4
    r = token_count.token_counts(docs(spark, [(1, text, "a"), (2, None, "a")]), MODEL, limit=5).orderBy("doc_id").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert r[0]["cut_chars"] == max(k for k in range(len(text) + 1) if len(lib.encode(text[:k])) <= 5) and r[0]["over_limit"] and r[1]["cut_chars"] == 0


def test_html_deep_markup_is_linear():
    import time

    began = time.time()
    page = html_extract.parse("<article>" + "<b>" * 100_000 + "deep text" + "</i>" * 100_000 + "</b>" * 50_000 + "<p>next" * 1000 + "</article>")
    assert time.time() - began < 20 and page.blocks[0].text == "deep text" and len(page.blocks) == 1001


def test_html_article_marks():
    page = html_extract.parse("<article><p>One</p><div class='related-work'><p>Two</p></div><div class='ad'>Buy</div><section class='comments'><p>First!</p></section><p class='share'>Three</p></article>")
    assert html_extract.main_text(page, [], set()) == "One\nTwo\nThree"


def test_html_template_equals_brute_force(spark):
    """Classes of tokens by their occurrence vectors, counted page by page; the text changes without the template."""
    page = "<div class=top><p>Same top</p></div><div class=mid><p>Own {k}</p></div><div class=end><p>Same end</p></div>"
    rows = [(k, f"http://a.example/{k}", page.format(k=k) + ("<div class=odd>rare</div>" if k == 7 else "")) for k in range(10)]
    rows += [(20, "http://b.example/", page.format(k=1))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    vectors = {}
    for k, _, h in rows[:10]:
        for t in html_extract.tokens_of(html_extract.parse(h)):
            if t is not None:
                vectors.setdefault(t, [0] * 10)[k] += 1
    by_vector = {}
    for t, v in vectors.items():
        by_vector.setdefault(tuple(v), set()).add(t)
    want = set().union(*(ts for v, ts in by_vector.items() if len(ts) >= html_extract.MIN_CLASS and sum(x > 0 for x in v) >= html_extract.MIN_SHARE * 10))
    got = {r["host"]: r["template"] for r in html_extract.templates(d).collect()}
    assert set(got) == {"a.example"} and set(got["a.example"]) == want and want
    parsed = html_extract.parse(rows[3][2])
    assert html_extract.main_text(parsed, got["a.example"], set()) == "Own 3"
    assert html_extract.main_text(parsed, [], set()) == "Same top\nOwn 3\nSame end"


def test_html_defined_cases(spark):
    d = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "h"), (1, "http://a.example/", "<p>x</p>", "h"), (None, None, "<p>" + "word " * 200_000 + "</p>", "h")], "page_id long, url string, html string, template string").withColumn("text", F.lit(1))
    got = rows_of(html_extract.extract(d))
    assert sorted((r["n_chars"] for r in got)) == [1, 1, 999_999]


def test_ftrl_equals_plain_loop():
    """Per-coordinate rates and L1 sparsity against the update rule written out one coordinate at a time."""
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    labels = [int(3 in r or 7 in r) for r in rows]
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.5, 0.1, 4
    m = toxicity.fit(rows, labels, bits=6, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    z, n, w = ([0.0] * 64 for _ in range(3))
    bz = bn = bias = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            p = 1 / (1 + math.exp(-(bias + sum(w[k] for k in rows[i]))))
            g = p - labels[i]
            for k in rows[i]:
                step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - step * w[k]
                n[k] += g * g
                w[k] = 0.0 if abs(z[k]) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
    assert m.index.tolist() == [k for k in range(64) if w[k]] and m.weight == pytest.approx([x for x in w if x]) and m.bias == pytest.approx(bias)
    assert 0 < len(m.index) < 40


def test_toxicity_defined_cases(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    d = odd.withColumns({"toxic": F.lit(7), "held_out": F.lit("x"), "predicted": F.lit(None).cast("int")})
    got = rows_of(toxicity.toxicity(d, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert toxicity.keep_clean(d, labels).columns == d.columns
