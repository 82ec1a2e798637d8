"""Registered queries of the page model on the star-schema tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import numerals
from leafmill.operators import boxes, folio, learn, profile, robust, sequence, store
from leafmill.plans.bindings import SQL, b_decision, b_folio, b_gray, b_page, b_region, b_scope, read

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {SQL} {sql}"
        return f

    return keep


_CAND = "cand AS (SELECT *, v - page_index AS off FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS pages FROM b_folio) WHERE v > 0 AND v <= pages + 50)"
_VOTES = "votes AS (SELECT book_id, kind, off, count(*) AS votes, min(page_index) AS first_page, max(page_index) AS last_page FROM cand GROUP BY ALL)"
_PRIM = "prim AS (SELECT * EXCLUDE m FROM (SELECT *, max(votes) OVER (PARTITION BY book_id, kind) AS m FROM votes) WHERE votes >= 3 AND votes >= 0.3 * m)"
_ASG = "asg AS (SELECT * EXCLUDE r FROM (SELECT c.book_id, c.kind, c.page_index, c.v, c.off, p.votes, row_number() OVER (PARTITION BY c.book_id, c.kind, c.page_index ORDER BY p.votes DESC, c.off) AS r FROM cand c JOIN prim p USING (book_id, kind, off)) WHERE r = 1)"


@registered(f", {_CAND}, {_VOTES}, {_PRIM}, {_ASG}, l AS (SELECT *, lag(v) OVER w AS pv, lag(page_index) OVER w AS pi FROM asg WINDOW w AS (PARTITION BY book_id, kind ORDER BY page_index, v)) SELECT book_id, kind, page_index, pv AS prev_value, v, (v - pv) - (page_index - pi) AS missing FROM l WHERE v > pv AND (v - pv) - (page_index - pi) >= 1")
def folio_gap_report(spark: SparkSession, d: str) -> DataFrame:
    return folio.gap_report(b_folio(spark, d))


@registered(f", {_CAND}, {_VOTES} SELECT * FROM votes")
def folio_votes(spark, d):
    return folio.votes(b_folio(spark, d))


@registered(f", {_CAND}, {_VOTES}, {_PRIM} SELECT * FROM prim")
def folio_primary_clusters(spark, d):
    return folio.primary_clusters(b_folio(spark, d))


@registered(f", {_CAND}, {_VOTES}, {_PRIM}, {_ASG} SELECT * FROM asg")
def folio_assigned(spark, d):
    return folio.assigned(b_folio(spark, d))


@registered(" SELECT book_id, page_index % 2 AS side, count(*) AS n, median(x) AS x, median(y) AS y FROM (SELECT *, CAST(100 + (book_id * 7 + page_index) % 13 + (page_index % 2) * 800 AS DOUBLE) AS x, CAST(950 + (book_id + page_index * 3) % 7 AS DOUBLE) AS y FROM b_folio) GROUP BY ALL HAVING count(*) >= 3")
def folio_position_model(spark, d):
    x = (100 + (F.col("book_id") * 7 + F.col("page_index")) % 13 + (F.col("page_index") % 2) * 800).cast("double")
    y = (950 + (F.col("book_id") + F.col("page_index") * 3) % 7).cast("double")
    return folio.position_model(b_folio(spark, d).withColumn("x", x).withColumn("y", y))


@registered(", s AS (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, median(l_extendedprice) AS med, 1.4826 * mad(l_extendedprice) AS mad, quantile_cont(l_extendedprice, 0.975) AS p975 FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, n, round(med, 4) AS med, round(mad, 4) AS mad, round(p975, 4) AS p975 FROM s")
def robust_stat_by_group(spark, d):
    s = robust.large_stats(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("med", "mad", "p975")))


@registered(", s AS (SELECT book_id, count(*) AS n, median(angle) AS med, 1.4826 * mad(angle) AS mad FROM b_page GROUP BY ALL) SELECT p.book_id, p.page_index, round(p.angle, 6) AS angle, round(s.med, 6) AS med, round(s.mad, 6) AS mad FROM b_page p JOIN s USING (book_id) WHERE n >= 8 AND mad > 0 AND abs(angle - med) > 3.5 * mad")
def skew_outliers(spark, d):
    out = robust.robust_outliers(b_page(spark, d), ["book_id"], "angle")
    return out.select("book_id", "page_index", *(F.round(c, 6).alias(c) for c in ("angle", "med", "mad")))


@registered(", p AS (SELECT *, CAST(k AS DOUBLE) / 10 AS confidence FROM b_page), s AS (SELECT book_id, count(angle) AS n, median(angle) AS med, 1.4826 * mad(angle) AS mad FROM p GROUP BY ALL) SELECT p.book_id, p.page_index, round(p.angle, 6) AS angle, n, round(s.med, 6) AS med, round(s.mad, 6) AS mad FROM p JOIN s USING (book_id) WHERE CASE WHEN n >= 8 THEN abs(angle - med) > 2 * greatest(mad, 0.10) AND abs(angle) >= 0.5 ELSE abs(angle) >= 0.2 AND coalesce(confidence, 0) < 1.5 END")
def skew_flags(spark, d):
    # The tables have no deskew confidence; the query takes a tenth of k.
    out = robust.skew_flags(b_page(spark, d).withColumn("confidence", F.col("k").cast("double") / 10), ["book_id"], "angle", "confidence")
    return out.select("book_id", "page_index", *(F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in ("angle", "n", "med", "mad")))


@registered(", c AS (SELECT book_id, k, count(*) AS votes, min(page_index) AS f FROM b_page WHERE k IS NOT NULL GROUP BY ALL) SELECT book_id, k, votes FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY votes DESC, f) AS r FROM c) WHERE r = 1")
def mode_first_seen(spark, d):
    return robust.first_seen_mode(b_page(spark, d), ["book_id"], "k", F.col("page_index"))


@registered(", h AS (SELECT l_returnflag, gray, count(*) AS n FROM b_gray GROUP BY ALL), a AS (SELECT l_returnflag, gray, CAST(sum(n) OVER w AS BIGINT) AS w0, CAST(sum(n * gray) OVER w AS BIGINT) AS s0, CAST(sum(n) OVER p - sum(n) OVER w AS BIGINT) AS w1, CAST(sum(n * gray) OVER p - sum(n * gray) OVER w AS BIGINT) AS s1 FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY gray ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY l_returnflag)), s AS (SELECT *, round(CAST(w0 AS DOUBLE) * w1 * (s0 / w0 - s1 / w1) * (s0 / w0 - s1 / w1), 3) AS score FROM a WHERE w1 > 0) SELECT l_returnflag, gray AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, gray) AS r FROM s) WHERE r = 1")
def otsu_threshold(spark, d):
    return robust.otsu(b_gray(spark, d), ["l_returnflag"], "gray")


def _runs(bridge: int) -> str:
    return f", o AS (SELECT book_id, page_index, CASE WHEN page_index - lag(page_index) OVER w <= {bridge + 1} THEN 0 ELSE 1 END AS fresh FROM b_page WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY book_id ORDER BY page_index)), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY book_id ORDER BY page_index) AS BIGINT) AS run FROM o) SELECT book_id, run, min(page_index) AS first, max(page_index) AS last, count(*) AS length FROM r GROUP BY book_id, run"


@registered(_runs(0))
def runs(spark, d):
    return sequence.runs(b_page(spark, d).withColumn("flag", F.col("event_type").isin("view", "click")), ["book_id"], "page_index", "flag")


@registered(_runs(2))
def bridged_runs(spark, d):
    return sequence.runs(b_page(spark, d).withColumn("flag", F.col("event_type").isin("view", "click")), ["book_id"], "page_index", "flag", bridge=2)


@registered(", m AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b_region), i AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR y0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m) SELECT page, island, min(y0) AS y0, max(y1) AS y1, count(*) AS parts FROM i GROUP BY page, island")
def merge_intervals(spark, d):
    return sequence.merge_intervals(b_region(spark, d), ["page"], "y0", "y1")


@registered(", p AS (SELECT a.page, a.rid AS rid_a, b.rid AS rid_b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b_region a JOIN b_region b ON a.page = b.page AND a.rid < b.rid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT page, rid_a, rid_b, round(i / (s - i), 6) AS iou FROM p WHERE round(i / (s - i), 6) >= 0.1")
def box_iou_pairs(spark, d):
    return boxes.overlapping_pairs(b_region(spark, d))


@registered(" SELECT page, kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS regions FROM b_region GROUP BY page, kind")
def region_hull(spark, d):
    return boxes.hull(b_region(spark, d), ["page", "kind"])


@registered(" SELECT page, rid, round(least(0.5 * x0 - 0.25 * y0, 0.5 * x0 - 0.25 * y1, 0.5 * x1 - 0.25 * y0, 0.5 * x1 - 0.25 * y1) + 3, 6) AS x0, round(0.25 * x0 + 0.5 * y0 - 7, 6) AS y0, round(greatest(0.5 * x0 - 0.25 * y0, 0.5 * x0 - 0.25 * y1, 0.5 * x1 - 0.25 * y0, 0.5 * x1 - 0.25 * y1) + 3, 6) AS x1, round(0.25 * x1 + 0.5 * y1 - 7, 6) AS y1 FROM b_region")
def affine_map_boxes(spark, d):
    return boxes.affine(b_region(spark, d).select("page", "rid", "x0", "y0", "x1", "y1"), (0.5, -0.25, 3.0, 0.25, 0.5, -7.0))


@registered(" SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY created_at DESC, id DESC) AS r FROM b_decision) WHERE r = 1")
def upsert_latest(spark, d):
    return store.latest(b_decision(spark, d), ["doc", "field"], [F.desc("created_at"), F.desc("id")])


@registered(", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page_index ORDER BY created_at DESC, id DESC) AS r FROM b_decision) WHERE r = 1) SELECT field, count(*) AS n, count(DISTINCT doc) AS docs FROM u GROUP BY field")
def status_counts(spark, d):
    last = store.latest(b_decision(spark, d), ["doc", "page_index"], [F.desc("created_at"), F.desc("id")])
    return last.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"))


@registered(", f AS (SELECT doc, page_index, count(*) AS flags, max(id) AS last_id FROM b_decision WHERE field = 'error' GROUP BY doc, page_index) SELECT doc, page_index, flags, last_id FROM f WHERE NOT EXISTS (SELECT 1 FROM b_decision b WHERE b.doc = f.doc AND b.page_index = f.page_index AND b.field = 'purchase' AND b.id > f.last_id)")
def review_queue(spark, d):
    log = b_decision(spark, d)
    flagged = log.where("field = 'error'").groupBy("doc", "page_index").agg(F.count("*").alias("flags"), F.max("id").alias("last_id"))
    done = log.where("field = 'purchase'").groupBy("doc", "page_index").agg(F.max("id").alias("done_id"))
    return flagged.join(done, ["doc", "page_index"], "left").where("done_id is null or done_id <= last_id").drop("done_id")


_LATTICE = ", lat AS (SELECT scanner, CASE WHEN grouping(fmt) = 1 THEN '*' ELSE fmt END AS fmt, CASE WHEN grouping(genre) = 1 THEN '*' ELSE genre END AS genre, CASE WHEN grouping(writing) = 1 THEN '*' ELSE writing END AS writing, count(*) AS n, round(avg(metric), 4) AS mean FROM b_scope GROUP BY scanner, CUBE (fmt, genre, writing))"


@registered(f"{_LATTICE} SELECT * FROM lat")
def scope_lattice(spark, d):
    return profile.scope_lattice(b_scope(spark, d), "scanner", ["fmt", "genre", "writing"], "metric")


@registered(f"{_LATTICE}, q AS (SELECT DISTINCT scanner, fmt, genre, writing FROM b_scope) SELECT q.scanner, q.fmt, q.genre, q.writing, CAST(CASE WHEN a.n IS NOT NULL THEN 3 WHEN b.n IS NOT NULL THEN 2 WHEN c.n IS NOT NULL THEN 1 WHEN e.n IS NOT NULL THEN 0 END AS BIGINT) AS depth, coalesce(a.n, b.n, c.n, e.n) AS n, coalesce(a.mean, b.mean, c.mean, e.mean) AS mean FROM q LEFT JOIN lat a ON a.scanner = q.scanner AND a.fmt = q.fmt AND a.genre = q.genre AND a.writing = q.writing AND a.n >= 20 LEFT JOIN lat b ON b.scanner = q.scanner AND b.fmt = q.fmt AND b.genre = q.genre AND b.writing = '*' AND b.n >= 20 LEFT JOIN lat c ON c.scanner = q.scanner AND c.fmt = q.fmt AND c.genre = '*' AND c.writing = '*' AND c.n >= 20 LEFT JOIN lat e ON e.scanner = q.scanner AND e.fmt = '*' AND e.genre = '*' AND e.writing = '*' AND e.n >= 20")
def scope_backoff(spark, d):
    rows = b_scope(spark, d)
    soft = ["fmt", "genre", "writing"]
    return profile.back_off(rows.select("scanner", *soft).distinct(), profile.scope_lattice(rows, "scanner", soft, "metric"), "scanner", soft, least=20)


_REGIME = ", lat AS (SELECT CASE WHEN grouping(scanner) = 1 THEN '*' ELSE scanner END AS scanner, CASE WHEN grouping(fmt) = 1 THEN '*' ELSE fmt END AS fmt, CASE WHEN grouping(genre) = 1 THEN '*' ELSE genre END AS genre, writing, count(*) AS n, round(avg(metric), 4) AS mean FROM b_scope GROUP BY writing, CUBE (scanner, fmt, genre)), q AS (SELECT DISTINCT scanner, fmt, genre, writing FROM b_scope), l AS (SELECT *, CASE WHEN scanner <> '*' AND fmt <> '*' AND genre <> '*' THEN 0 WHEN scanner <> '*' AND fmt <> '*' THEN 1 WHEN scanner <> '*' AND genre <> '*' THEN 2 WHEN fmt <> '*' AND genre <> '*' THEN 3 WHEN scanner <> '*' THEN 4 WHEN fmt <> '*' THEN 5 WHEN genre <> '*' THEN 6 ELSE 7 END AS level FROM lat)"


@registered(f"{_REGIME} SELECT writing, scanner, fmt, genre, CAST(level AS BIGINT) AS level, n, mean FROM (SELECT q.*, l.level, l.n, l.mean, row_number() OVER (PARTITION BY q.writing, q.scanner, q.fmt, q.genre ORDER BY l.level) AS r FROM q JOIN l ON l.writing = q.writing AND l.scanner IN (q.scanner, '*') AND l.fmt IN (q.fmt, '*') AND l.genre IN (q.genre, '*') WHERE l.n >= 20 OR l.level = 7) WHERE r = 1")
def scope_resolve(spark, d):
    rows = b_scope(spark, d)
    soft = ["scanner", "fmt", "genre"]
    return profile.resolve(rows.select("writing", *soft).distinct(), profile.scope_lattice(rows, "writing", soft, "metric"), "writing", soft, least=20)


_VEC = ", v AS (SELECT vec_id, label, unnest(range(0, 8)) AS dim, unnest(embedding[1:8]) AS x FROM embeddings), vd AS (SELECT vec_id, label, CAST(dim AS INTEGER) AS dim, CAST(x AS DOUBLE) AS x FROM v), sc AS (SELECT dim, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-9 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM vd GROUP BY dim), mo AS (SELECT label, vd.dim, (avg(x) - any_value(mu)) / any_value(sd) AS centre, any_value(mu) AS mu, any_value(sd) AS sd FROM vd JOIN sc ON vd.dim = sc.dim GROUP BY label, vd.dim)"


@registered(f"{_VEC} SELECT label, dim, round(centre, 6) AS centre, round(mu, 6) AS mu, round(sd, 6) AS sd FROM mo")
def centroid_train(spark, d):
    m = learn.train(learn.long_form(read(spark, d, "embeddings"), "vec_id", "label", "embedding", 8), "label")
    return m.select("label", "dim", *(F.round(c, 6).alias(c) for c in ("centre", "mu", "sd")))


@registered(f"{_VEC}, f AS (SELECT vec_id, mo.label AS predicted, round(sum(((x - mu) / sd - centre) * ((x - mu) / sd - centre)), 6) AS distance FROM vd JOIN mo ON vd.dim = mo.dim GROUP BY ALL) SELECT vec_id, predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) AS r FROM f) WHERE r = 1")
def centroid_predict(spark, d):
    rows = learn.long_form(read(spark, d, "embeddings"), "vec_id", "label", "embedding", 8)
    return learn.predict(rows, learn.train(rows, "label"), "vec_id", "label").select("vec_id", "predicted")


_ALL = _VEC.replace("range(0, 8)", "range(0, len(embedding))").replace("embedding[1:8]", "embedding")


@registered(f"{_ALL} SELECT label, dim, round(centre, 6) AS centre, round(mu, 6) AS mu, round(sd, 6) AS sd FROM mo")
def centroid_train_all(spark, d):
    m = learn.train(learn.long_form(read(spark, d, "embeddings"), "vec_id", "label", "embedding"), "label")
    return m.select("label", "dim", *(F.round(c, 6).alias(c) for c in ("centre", "mu", "sd")))


@registered(f"{_ALL}, f AS (SELECT vec_id, mo.label AS predicted, round(sum(((x - mu) / sd - centre) * ((x - mu) / sd - centre)), 6) AS distance FROM vd JOIN mo ON vd.dim = mo.dim GROUP BY ALL) SELECT vec_id, predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) AS r FROM f) WHERE r = 1")
def centroid_predict_all(spark, d):
    rows = learn.long_form(read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return learn.predict(rows, learn.train(rows, "label"), "vec_id", "label").select("vec_id", "predicted")


@registered(", t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9A-Za-z]+')) AS tok FROM documents), u AS (SELECT doc_id, upper(tok) AS tok FROM t WHERE regexp_full_match(upper(tok), '" + numerals.ROMAN.strip("^$") + "') AND tok <> '') SELECT doc_id, tok, count(*) AS n, CAST(1000 * (len(tok) - len(replace(tok, 'M', ''))) + 500 * (len(tok) - len(replace(tok, 'D', ''))) + 100 * (len(tok) - len(replace(tok, 'C', ''))) + 50 * (len(tok) - len(replace(tok, 'L', ''))) + 10 * (len(tok) - len(replace(tok, 'X', ''))) + 5 * (len(tok) - len(replace(tok, 'V', ''))) + len(tok) - len(replace(tok, 'I', '')) - CASE WHEN contains(tok, 'CM') OR contains(tok, 'CD') THEN 200 ELSE 0 END - CASE WHEN contains(tok, 'XC') OR contains(tok, 'XL') THEN 20 ELSE 0 END - CASE WHEN contains(tok, 'IX') OR contains(tok, 'IV') THEN 2 ELSE 0 END AS BIGINT) AS value FROM u GROUP BY doc_id, tok")
def parse_roman(spark, d):
    tok = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[^0-9A-Za-z]+")).alias("tok"))
    up = tok.select("doc_id", F.upper("tok").alias("tok")).where((F.col("tok") != "") & F.col("tok").rlike(numerals.ROMAN))
    return up.groupBy("doc_id", "tok").agg(F.count("*").alias("n")).withColumn("value", numerals.roman(F.col("tok")))


@registered(" SELECT conv_id, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def reading_text(spark, d):
    turns = read(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", "turns", F.array_join("t.text", "\n").alias("text"))


@registered(" SELECT page, kind, source, count(*) AS copies FROM b_region GROUP BY ALL HAVING count(*) > 1")
def dedupe_lines(spark, d):
    return b_region(spark, d).groupBy("page", "kind", "source").agg(F.count("*").alias("copies")).where("copies > 1")


@registered(" SELECT book_id, page_index, v, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY v DESC, page_index) AS r FROM b_folio WHERE v IS NOT NULL) WHERE r <= 5")
def topk_candidates(spark, d):
    w = Window.partitionBy("book_id").orderBy(F.desc("v"), "page_index")
    return b_folio(spark, d).where("v is not null").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("book_id", "page_index", "v", "rank")
