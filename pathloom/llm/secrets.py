"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds the (blob, rule version) pairs
that were scanned before, with their spans; only blobs that are not in it are scanned, each once, and findings are
joined back to all paths that hold the blob. A first test in the JVM (a superset of every rule) keeps blobs without any
trace of a secret out of the shuffle and of Python; they enter the ledger with no spans.

Rules: the base kinds `assign`, `access` and `hex`, and more kinds that only add spans. A change of the rules changes
RULE_VERSION, which makes every blob unseen again.

Defined results: null text is empty text and has no spans; equal texts share one blob and one scan; offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, gives_back, small_batches, whole_rows

#: Kind, pattern, and the least length of (group 2 or the whole match), in the order that breaks ties.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
#: Kinds beyond the base, matched as a whole.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{3,80}@", 1),
)
#: Strings of which a text with a span of any kind but access and hex has one, in lower case.
_TRACES = ("password", "passwd", "secret", "token", "apikey", "api_key", "private key-----", "eyj", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "://")
RULE_VERSION = hashlib.sha256(repr((BASE_RULES, MORE_RULES)).encode()).hexdigest()[:16]
FOUND = "n_assign long, n_access long, n_hex long, base_spans string, spans string"
LEDGER = f"blob binary, {FOUND}, rule_version string"

#: Findings (hash and spans) are broadcast up to this many bytes, summed before; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

#: A run of hex digits shorter than the least length can never match, so runs are only tried where they begin.
_COMPILED = [(kind, re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}" if kind == "hex" else pattern, re.A), least, k) for k, (kind, pattern, least) in enumerate(BASE_RULES + MORE_RULES)]


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, kind) of every span, sorted."""
    found = []
    for kind, pattern, least, order in _COMPILED:
        for m in pattern.finditer(text):
            a, b = m.span(2) if kind == "assign" else m.span()
            if b - a >= least:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def _trace(text):
    """A test without false negatives for every rule, in JVM expressions."""
    lower = F.lower(text)
    test = text.rlike("[0-9a-f]{24}") | text.contains("AKIA")
    for trace in _TRACES:
        test = test | lower.contains(trace)
    return test


@gives_back
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = len(BASE_RULES)
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            spans = find(text.as_py())
            written = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
            own = [order for _, order, _, _ in spans]
            rows.append((own.count(0), own.count(1), own.count(2), ",".join(w for w, o in zip(written, own) if o < base), ",".join(written)))
        columns = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), *arrays], ["blob", "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def content(versions: DataFrame, path: str = "doc_id") -> DataFrame:
    """path, blob and text of every version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return small_batches(versions).select(F.col(path).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def unseen_findings(held: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Spans of each blob with any trace that the ledger does not hold for this rule version; one row per blob."""
    if ledger is not None:
        held = held.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # copies meet here: each task keeps one row per blob before the shuffle
    once = held.filter(_trace(F.col("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    return once.mapInArrow(_scan, f"blob binary, {FOUND}")


def ledger_update(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """The rows to append to the ledger: every unseen blob once, with its spans (none: zeros and empty strings)."""
    held = content(versions, path)
    blobs = held.select("blob").distinct()
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return _filled(blobs.join(unseen_findings(held, ledger, rule_version), "blob", "left")).withColumn("rule_version", F.lit(rule_version))


def _filled(df: DataFrame) -> DataFrame:
    return df.fillna(0, ["n_assign", "n_access", "n_hex"]).fillna("", ["base_spans", "spans"])


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """path, blob and FOUND for every version: findings of the ledger and of the unseen blobs, joined to all paths."""
    held = content(versions, path)
    found = unseen_findings(held, ledger, rule_version)
    if ledger is not None:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        old = ledger.filter((F.col("rule_version") == rule_version) & (F.col("spans") != "")).select("blob", *columns)
        found = found.unionByName(old)
    return _filled(held.select("path", "blob").join(found, "blob", "left"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored ledger, or None where none is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))
    return spark.read.schema(LEDGER).parquet(folder) if held is not None and len(held) else None


def scan_incrementally(versions: DataFrame, folder: str, rule_version: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """scan_versions through the ledger stored in folder: what it lacks is scanned and appended, findings are read from it.

    One run at a time may append to a folder; a pair that two runs appended all the same counts once."""
    spark = versions.sparkSession
    ledger_update(versions, read_ledger(spark, folder), rule_version, path).write.mode("append").parquet(folder)
    known = spark.read.schema(LEDGER).parquet(folder).filter((F.col("rule_version") == rule_version) & (F.col("spans") != ""))
    columns = [c.split()[0] for c in FOUND.split(", ")]
    once = known.groupBy("blob").agg(*(F.first(c).alias(c) for c in columns))
    return _filled(content(versions, path).select("path", "blob").join(once, "blob", "left"))


def masked(text: str, spans: str) -> str:
    out, at = [], 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",")):
        if b > at:
            out += [text[at : max(a, at)], "[SECRET]" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


@gives_back
def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [masked(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "masked"])


def redact(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """docs with every found span replaced by [SECRET] in text, through the blob of each row; all rows stay.

    Only rows with spans go through Python. Findings of blobs that the ledger holds are taken from it."""
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = unseen_findings(content(docs), ledger, rule_version).select("blob", "spans")
    if ledger is not None:
        found = found.unionByName(ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans"))
    found = cut(found.filter("spans != ''"))
    held = docs.select(blob.alias("own"), F.col("text").alias("text"), whole_rows(docs.drop("text")).alias("rest"))
    size = found.agg(F.sum(F.octet_length("spans") + 100)).first()[0] or 0
    joined = held.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("own") == F.col("blob"), "left").select("rest", "text", "spans")
    kind = joined.select("rest", F.col("text").alias("masked")).schema
    # two scans of docs, as rows without spans need no Python
    out = joined.filter("spans is null").select("rest", F.col("text").alias("masked")).union(joined.filter("spans is not null").mapInArrow(_redacted, kind))
    return out.select(*(F.col("masked").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
