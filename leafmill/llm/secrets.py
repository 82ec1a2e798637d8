"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credential patterns. A candidate is known by a hash of its value only; the
hashes are summed over the corpus: how many distinct repositories (sources) and owners hold a value,
and how many documents. A value that many repositories and owners carry is an example that was copied
around; one that stays with an owner is a live one. Ownership alone decides; the entropy of a value is reported beside it.

Repository is the ``source`` column and owner its part before the first ``/``; both are parameters.

Distinct counts are taken in two levels (value and repository first, then value), so a value that a
third of all rows hold is summed map-side and its rows never meet in a task.

Defined cases: null or empty text has no spans; rows with null source belong to one repository named
by the empty string; repeated rows are scanned each and count as one repository; ids may be null; a text
of any length is scanned whole; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Added kinds, after the base ones.
MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vcs": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "pay": re.compile(r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
}
#: A password in a URL, from its ``://``; the scheme is the run of letters before it.
USER = re.compile(r"://[^\s/:@]++:([^\s/:@]{6,}+)@")
SCHEME, LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-"), frozenset("abcdefghijklmnopqrstuvwxyz")
KINDS = ("assign", "access", "hex", *MORE, "url")
BASE = KINDS[:3]
#: What must be in a text for an added kind to be in it.
CUES = {"pem": "PRIVATE KEY", "jwt": "eyJ", "vcs": "", "chat": "xox", "pay": "k_"}
#: An example if at least so many repositories and owners hold the value.
EXAMPLE_REPOSITORIES, EXAMPLE_OWNERS = 5, 3


def url_passwords(text: str) -> list[tuple[str, int, int, str]]:
    """Spans of ``scheme://user:password@``, parts of any length, in time in proportion to the text."""
    out = []
    for m in USER.finditer(text):
        start = m.start()
        while start and text[start - 1] in SCHEME:
            start -= 1
        while start < m.start() and text[start] not in LETTERS:
            start += 1
        if m.start() - start >= 2:
            out.append(("url", start, m.end(), m[1]))
    return out


def spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in MORE.items():
        if CUES[kind] in text:
            found += [(kind, m.start(), m.end(), m[pattern.groups]) for m in pattern.finditer(text)]
    if "://" in text:
        found += url_passwords(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]]))


def joined(found: list[tuple[str, int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def bits(value: str) -> float:
    """Shannon entropy a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


FOUND = "array<struct<kind:string,start:int,end:int,value_sha256:string,bits:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_md5, n_assign, n_access, n_hex, base_sha256, spans and ``found``, the
    candidates of each row. Values themselves are not returned."""
    held = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "text"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, text_md5 string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {FOUND}"
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_sha256", pa.string()), ("bits", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans = [spans(t) for t in b.column("text").to_pylist()]
            counts = [Counter(k for k, *_ in got) for got in all_spans]
            out = {c: b.column(c) for c in ("doc_id", "source", "text_md5")}
            out |= {f"n_{k}": pa.array([n[k] for n in counts], pa.int64()) for k in BASE}
            out["base_sha256"] = pa.array([_sha256(joined([x for x in got if x[0] in BASE])) for got in all_spans], pa.string())
            out["spans"] = pa.array([joined(got) for got in all_spans], pa.string())
            out["found"] = pa.array([[(k, a, z, _sha256(v), bits(v)) for k, a, z, v in got] for got in all_spans], found_type)
            yield pa.RecordBatch.from_pydict(out)

    return held.mapInArrow(scanned, schema)


def _sha256(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def ownership(scanned: DataFrame) -> DataFrame:
    """value_sha256, n_repositories, n_owners, n_spans, bits, is_example: over all rows of ``scan``."""
    each = scanned.where(F.size("found") > 0).select("source", F.explode("found").alias("f")).select("source", "f.value_sha256", "f.bits")
    by_repository = each.groupBy("value_sha256", "source").agg(F.count("*").alias("n"), F.max("bits").alias("bits"))
    owned = by_repository.withColumn("owner", F.substring_index("source", "/", 1))
    by_owner = owned.groupBy("value_sha256", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"), F.max("bits").alias("bits"))
    total = by_owner.groupBy("value_sha256").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_spans"), F.max("bits").alias("bits"))
    copied = (F.col("n_repositories") >= EXAMPLE_REPOSITORIES) & (F.col("n_owners") >= EXAMPLE_OWNERS)
    return total.withColumn("is_example", copied)


def _same_text(a: DataFrame, b: DataFrame):
    """Rows of one id and text; ids may be null."""
    return a["doc_id"].eqNullSafe(b["b_doc"]) & (a["text_md5"] == b["b_md5"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """The op10 digest with n_live and n_example, the document's spans by the ownership of their values."""
    scanned = materialise(scan(docs), "secrets")
    examples = ownership(scanned).where("is_example").select("value_sha256")
    held = scanned.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_md5"])
    each = held.select("doc_id", "text_md5", F.explode("found.value_sha256").alias("value_sha256"))
    shown = each.join(examples, "value_sha256", "left_semi").groupBy(F.col("doc_id").alias("b_doc"), F.col("text_md5").alias("b_md5")).agg(F.count("*").alias("n_example"))
    out = scanned.join(shown, _same_text(scanned, shown), "left")
    n_example = F.coalesce("n_example", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        (F.size("found") - n_example).cast("long").alias("n_live"), n_example.alias("n_example"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document stays; each live-looking span becomes ``[SECRET]``, copied examples stay.

    Overlapping spans are cut as one; n_chars follows the text. Columns as they came.
    """
    hits = materialise(scan(docs).where(F.size("found") > 0).select("doc_id", "source", "text_md5", "found"), "hits")
    examples = ownership(hits).where("is_example").select("value_sha256")
    each = hits.dropDuplicates(["doc_id", "text_md5"]).select("doc_id", "text_md5", F.explode("found").alias("f")).select("doc_id", "text_md5", "f.*")
    live = each.join(examples, "value_sha256", "left_anti")
    cuts = live.groupBy(F.col("doc_id").alias("b_doc"), F.col("text_md5").alias("b_md5")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    # Rows travel as one struct, so their columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    text = F.col("row.text")
    joined_ = rows.join(cuts, rows["row.doc_id"].eqNullSafe(cuts["b_doc"]) & (rows["md5"] == cuts["b_md5"]), "left")
    keep = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, c: F.when(
            c["end"] > s["at"],
            F.struct(
                F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0))), F.when((c["start"] >= s["at"]), F.lit("[SECRET]")).otherwise("")).alias("out"),
                c["end"].alias("at"),
            ),
        ).otherwise(s),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    out = joined_.withColumn("new", F.when(F.col("cuts").isNull(), text).otherwise(keep))
    of = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(docs.schema["n_chars"].dataType))
    return out.select(*(of.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
