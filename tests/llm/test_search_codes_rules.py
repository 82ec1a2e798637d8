"""Quality rules, ranked search and vector codes against plain loops, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from leafmill.llm import codes, lexical, quality_rules, queries
from leafmill.llm.common import table

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.mark.parametrize("name", ["op7_topk", "op12_lexical_search", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name]).df()
    ours = queries.QUERIES[name](spark, SF).toPandas()
    order = sorted(ours.columns)
    assert sorted(theirs.columns) == order and len(ours)
    assert sorted(map(tuple, ours[order].itertuples(index=False))) == sorted(map(tuple, theirs[order].itertuples(index=False)))


# Ranked search ----------------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, n = sum(sum(b.values()) for _, b in bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        want, scores = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in want.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(x, t, 1) for x, t in docs], "doc_id long, text string, score int")
    i = spark.createDataFrame([(x, t, 2) for x, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(d, i, **options).collect()), key=str)


DOCS = [(k, f"alpha{k % 7} beta Ünder {'gamma ' * (k % 5)}x{k}") for k in range(60)]
DOCS += [(3, "beta twice"), (3, "beta twice"), (None, "beta gamma"), (None, None), (70, ""), (71, "... --- !"), (72, "KK ÄÖ _a_b` {c}~d\x7fe"), (73, "beta " * 5000 + "rare"), (80, "same text here"), (81, "same text here")]
ITEMS = [(1, "BETA gamma gamma, alpha3"), (1, "BETA gamma gamma, alpha3"), (1, "same text"), (2, None), (3, ""), (4, "unknown words"), (None, "rare same"), (5, "ÄÖ a b c d e K"), (6, "Ünder")]


@pytest.mark.parametrize("k", [1, 4, 20, 500])
def test_search_equals_plain_loops(spark, k):
    assert searched(spark, DOCS, ITEMS, k=k) == plain_search(DOCS, ITEMS, k)


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    for name, value in (("SHARD_DOCS", 3), ("SHARD_TERMS", 9), ("BLOCK_ITEMS", 1), ("BLOCK_TERMS", 2), ("MOST_SHELVES", 2), ("BROADCAST", 9)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(spark, DOCS, ITEMS) == plain_search(DOCS, ITEMS)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], ITEMS) == searched(spark, DOCS, []) == searched(spark, [(1, None)], ITEMS) == []


def test_best_keeps_ties_by_id():
    scores, ids = np.array([5, 7, 5, 0, 5, 5]), np.array([9, 1, 4, 0, 2, 2])
    last = np.array([False, False, False, False, False, True])
    assert lexical.best(scores, ids, last, 3).tolist() == [1, 4, 2]
    assert lexical.best(scores, ids, last, 9).tolist() == [1, 4, 2, 0, 5]


# Vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, entries, rounds):
    fit = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for _, _, v in fit) // 4) * 4
    most = codes.bound(dims)
    fit = [(i, lab, [max(-most, min(most, x)) for x in v] + [0] * (dims - len(v))) for i, lab, v in fit]
    w, out = dims // 4, [["", 0] for _ in fit]
    first = sorted(range(len(fit)), key=lambda k: (fit[k][0] is None, fit[k][0] or 0, fit[k][2]))[:entries]
    text = []
    for p in range(4):
        parts = [v[p * w : (p + 1) * w] for _, _, v in fit]
        book = [parts[k] for k in first]

        def nearest(x, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            at = [nearest(x)[1] for x in parts]
            for e in set(at):
                own = [x for x, k in zip(parts, at, strict=True) if k == e]
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for k, x in enumerate(parts):
            d, e = nearest(x)
            out[k][0] += f"{e:02x}"
            out[k][1] += d
        text += [str(c) for e in book for c in e]
    totals = Counter()
    for (_, lab, _), (_, d) in zip(fit, out, strict=True):
        totals[lab] += d
    digest = hashlib.sha256(",".join(text).encode()).hexdigest()
    return sorted(((i, c, d, totals[lab], digest) for (i, lab, _), (c, d) in zip(fit, out, strict=True)), key=str)


def coded(spark, rows, entries, rounds, monkeypatch, shard=40):
    monkeypatch.setattr(codes, "SHARD_ROWS", shard)
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    monkeypatch.setattr(codes.train, "__kwdefaults__", {"entries": entries, "rounds": rounds})
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in codes.vector_codes(d).collect()), key=str)


def _rows(n, dims, seed):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    return [(k, None if k % 11 == 0 else k % 3, (centres[k % 6] + g.normal(scale=0.2, size=dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("entries", "rounds"), [(1, 2), (5, 4), (40, 6)])
def test_codes_equal_plain_rounds(spark, monkeypatch, entries, rounds):
    rows = _rows(150, 8, entries)
    rows += [(7, 1, rows[7][2]), (7, 2, rows[8][2]), (None, 1, rows[3][2])] + [(500 + k, 9, [0.5] * 8) for k in range(70)]
    rows += [(901, 1, None), (902, 1, [None] * 8), (903, 1, [math.nan] * 8), (904, 1, [math.inf] + [0.0] * 7), (905, 1, [0.25] * 3), (906, 1, []), (907, 1, [1e30, -1e30, 1e6, 0.0])]
    assert coded(spark, rows, entries, rounds, monkeypatch) == plain_codes(rows, entries, rounds)


def test_odd_dimensions_and_fewer_rows_than_entries(spark, monkeypatch):
    rows = _rows(9, 6, 3)
    assert coded(spark, rows, 256, 4, monkeypatch, shard=2) == plain_codes(rows, 256, 4)


def test_no_vectors(spark, monkeypatch):
    assert coded(spark, [(1, 1, None)], 256, 4, monkeypatch) == coded(spark, [], 256, 4, monkeypatch) == []
    assert coded(spark, [(1, 1, [])], 256, 4, monkeypatch) == [(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]


def test_heaps_pop_only_what_drift_has_reached():
    """Entries that stay are not scanned again, and what is not popped would not have changed."""
    g = np.random.default_rng(1)
    parts = (g.normal(size=(2000, 4)) * 40 + 1000 * g.integers(0, 8, size=(2000, 1))).astype(np.int64)
    state = codes.Books(parts[None, :32].copy())
    entry, _, slack = codes.scan(parts, state.books[0])
    heaps = codes.Heaps.empty(np.full(len(parts), -1), 32)
    heaps.push(np.arange(len(parts)), entry, slack)
    before, popped = np.full(len(parts), -1), []
    rows = np.arange(len(parts))
    for _ in range(12):
        state.updated([(0, e, n, s) for e, n, s in codes.changed_sums(parts, rows, before, heaps.entry[rows].astype(np.int64), 32)])
        rows = heaps.violated(state.drift[0])
        popped.append(len(rows))
        before = heaps.entry[rows].astype(np.int64)
        entry, _, slack = codes.scan(parts[rows], state.books[0])
        heaps.push(rows, entry, slack + state.drift[0][entry])
        assert np.array_equal(heaps.entry, codes.scan(parts, state.books[0])[0])
    assert popped[-1] < len(parts) / 2
    again = codes.Heaps(*(np.frombuffer(b, t).copy() for b, t in zip(heaps.arrays(), (np.int32, float, np.int32, np.int64), strict=True)))
    assert np.array_equal(again.violated(state.drift[0] + 9), heaps.violated(state.drift[0] + 9))


# Quality rules ----------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(three)
    inside = {k + j for k, t in enumerate(three) if n[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)


HARD = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b c a b c", "x y\nx y\n\nx y\r\n \n \n", "   \x85", "a b\x00c |#*$%&<> é𝄞 " * 9, "p q r " * 5000]


def test_counts_equal_plain_loops(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "doc_id long, text string").union(table(spark, SF, "documents").select("doc_id", "text"))
    texts = d.collect()
    got = quality_rules.statistics(d).select("doc_id", *quality_rules.COUNTS[:5]).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *plain_counts(r["text"])) for r in texts)


def test_held_out_documents_are_judged_right(spark):
    sf = SF.replace("0.001", "0.1")
    out = quality_rules.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = out.join(table(spark, sf, "labels"), "doc_id").where(quality_rules.held_out(out["doc_id"])).where("not base_failed").selectExpr("quality = 1 AS good", "kept").collect()
    assert len(rows) > 1000 and sum(r["good"] != r["kept"] for r in rows) <= len(rows) // 200


def test_rules_are_found_in_order_and_pruned():
    g = np.random.default_rng(5)
    x = g.uniform(size=(6000, 3))
    low = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.9)
    noisy = low ^ (g.uniform(size=len(low)) < 0.01)
    rules = quality_rules.learn(x, noisy, ["a", "b", "c"])
    assert 2 <= len(rules) <= 6 and all(len(r) <= 3 for r in rules)
    said = np.logical_or.reduce([quality_rules.covered(r, x, ["a", "b", "c"]) for r in rules])
    assert (said != low).mean() < 0.02
    assert quality_rules.learn(x, g.uniform(size=len(x)) < 0.1, ["a", "b", "c"]) == []
    assert quality_rules.learn(x, np.zeros(len(x), bool), ["a", "b", "c"]) == quality_rules.learn(x[:0], low[:0], ["a", "b", "c"]) == []


def test_best_condition_equals_all_thresholds():
    g = np.random.default_rng(2)
    x = np.round(g.uniform(size=(80, 2)), 1)
    low = g.uniform(size=80) < x[:, 1]

    def gain(c):
        on = c.holds(x, ["a", "b"])
        p = low[on].sum()
        return p * (math.log2(p / on.sum()) - math.log2(low.mean())) if p else 0.0

    every = [quality_rules.Condition(n, above, v) for j, n in enumerate("ab") for v in np.unique(x[:, j])[:-1] for above in (False, True)]
    assert abs(gain(quality_rules.best_condition(x, low, ["a", "b"])) - max(map(gain, every))) < 1e-9


def test_expression_equals_rules_on_arrays(spark):
    stats = quality_rules.statistics(table(spark, SF, "documents"))
    c = quality_rules.Condition
    rules = [(c("mean_word_chars", True, 6.0), c("ended_lines", False, 0.9)), (c("symbols_a_word", True, 0.1),), (c("longest_word", True, 14.0),)]
    names = list(quality_rules.FEATURES)
    got = quality_rules.judged(stats, rules).selectExpr("base_failed", "rule", "kept", *(f"{x} AS f_{n}" for n, x in quality_rules.FEATURES.items())).collect()
    x = np.array([[r[f"f_{n}"] for n in names] for r in got])
    on = [quality_rules.covered(r, x, names) for r in rules]
    for k, r in enumerate(got):
        first = next((i + 1 for i, m in enumerate(on) if m[k]), None)
        assert (r["rule"], r["kept"]) == ((None, False) if r["base_failed"] else (first, first is None))


def test_quality_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("a", text, 1), ("a", text, 2), (None, text, 3), ("b", None, 4), ("c", "", 5), ("d", "p q r " * 40, 6)], "doc_id string, text string, kept int")
    labels = spark.createDataFrame([("a", 1), ("a", 0), (None, 0), ("zz", 0), ("b", None)], "doc_id string, quality int")
    got = sorted(map(tuple, quality_rules.quality(docs, labels).select("doc_id", "n_words", "base_failed", "kept", "rule").collect()), key=str)
    assert got == sorted([("a", 60, False, True, None), ("a", 60, False, True, None), (None, 60, False, True, None), ("b", 0, True, False, None), ("c", 0, True, False, None), ("d", 120, True, False, None)], key=str)
    assert quality_rules.quality(docs.limit(0), labels.limit(0)).collect() == []
