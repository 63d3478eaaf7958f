"""Secret scans by an incremental ledger of content-addressed blobs.

A version of a document is a blob, known by the SHA-256 of its text. The ledger holds a row for each blob and rule
version that was ever scanned. A run scans only the pairs that the ledger lacks, each once however many paths or
versions hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, sift, unused

Span = tuple[str, int, int]
#: Words without which a text cannot hold an assignment; a search for them is far cheaper than the pattern.
_HINTS = ("passw", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MORE = (
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----")),
    ("forge", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)


def base_rules(text: str) -> Iterable[Span]:
    """Assignments, access keys and hex runs, leftmost and without overlap inside each kind; short ones are dropped.

    A run of hex digits or of an access key's characters is matched to its end, so a least length in the pattern drops
    exactly the matches that are too short; an assignment that is too short still hides what it overlaps.
    """
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 18:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def more_rules(text: str) -> Iterable[Span]:
    """Private keys and well-known token shapes."""
    for kind, hint, pattern in _MORE:
        if hint in text:
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "forge", "chat", "jwt")


@dataclass(frozen=True)
class RuleVersion:
    """A set of rules under a name that changes whenever they do."""

    version: str
    find: Callable[[str], Iterable[Span]]


BASE, MORE = RuleVersion("base-1", base_rules), RuleVersion("more-1", more_rules)
_SPANS = "array<struct<kind: string, start: int, stop: int>>"
LEDGER = f"blob binary, rules string, spans {_SPANS}"


def blob_id(text: str = "text") -> Column:
    """The content address of a text; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[RuleVersion, ...]) -> DataFrame:
    """Ledger rows of blobs (blob, todo, text): a row for each version named in todo, also where nothing is found.

    A blob that a task has met before is not scanned again; a null text is an empty one.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanned: set[bytes] = set()
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for blob, todo, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if (blob := blob.as_py()) in scanned:
                    continue
                scanned.add(blob)
                names, text = set(todo.as_py()), text.as_py() or ""
                for rule in rules:
                    if rule.version in names:
                        spans = [{"kind": k, "start": a, "stop": b} for k, a, b in rule.find(text)]
                        for column, value in zip(out, (blob, rule.version, spans), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], kind)], names=["blob", "rules", "spans"])

    return blobs.select("blob", "todo", "text").mapInArrow(run, LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[RuleVersion, ...] = (BASE, MORE)) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks of versions (path, text).

    Returns the new ledger rows (to be appended to the ledger) and findings (path, blob, found): for each row of
    versions the spans by rule version, empty where nothing was found. A null path is a path; a null text is an empty
    one; a blob is scanned once, whatever number of paths, versions or repeated rows hold it. A ledger may repeat rows, as
    two runs at once or a retried append leave it: a pair of blob and rules counts once.
    """
    versions = versions.select("path", "text")
    held = durable(versions.select("path", blob_id().alias("blob")), "blobs")
    # one path stands for each blob that is not wholly in the ledger, so that its text is scanned once
    blobs = held.groupBy("blob").agg(F.min("path").alias("path")).withColumn("todo", F.array(*(F.lit(r.version) for r in rules)))
    if ledger is not None:
        known = ledger.join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("rules").alias("known"))
        left = F.array_except("todo", F.coalesce("known", F.array().cast("array<string>")))
        blobs = blobs.join(known, "blob", "left").withColumn("todo", left).drop("known")
    blobs = durable(blobs, "todo")
    whole = F.size("todo") == len(rules)
    texts = versions.withColumn("blob", blob_id())
    # rows that are neither a copy nor known are scanned where they are; the others meet the list of what is to be scanned
    rest = durable(held.join(blobs.where(whole).select("blob", "path"), ["blob", "path"], "left_anti").distinct(), "rest")
    maybe, plain = sift(texts, F.xxhash64("path", "blob"), rest, F.xxhash64("path", "blob"))
    todo = blobs.where(F.size("todo") > 0).select(F.col("blob").alias("want"), F.col("path").alias("at"), "todo")
    asked, _ = sift(maybe, F.xxhash64("path", "blob"), todo, F.xxhash64("at", "want"))
    asked = asked.join(todo, (F.col("blob") == F.col("want")) & F.col("path").eqNullSafe(F.col("at")))
    plain = plain.withColumn("todo", F.array(*(F.lit(r.version) for r in rules)))
    texts = plain.select("blob", "todo", "text").unionByName(asked.select("blob", "todo", "text"))
    fresh = durable(scan_blobs(texts, rules).dropDuplicates(["blob", "rules"]), "ledger")
    current = fresh
    if ledger is not None:
        # of the ledger only this run's blobs, and a pair once: runs side by side or a retried append repeat rows
        own = ledger.where(F.col("rules").isin([r.version for r in rules])).join(held.select("blob").distinct(), "blob", "left_semi")
        current = fresh.unionByName(own).dropDuplicates(["blob", "rules"])
    found = current.groupBy("blob").agg(F.collect_list(F.struct("rules", "spans")).alias("found"))
    return fresh, held.join(found, "blob").select("path", "blob", "found")


def joined(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(F.col(spans), lambda s: F.struct(s["start"], F.array_position(order, s["kind"]), s["stop"], s["kind"].alias("kind")))
    parts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or nothing where no run has written one yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def document_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, blob, spans and base_spans (arrays of kind, start, stop) of every document. Repeated rows each come back.

    `ledger` is a path that runs share: what stands there is not scanned again, and what is scanned is appended. Without
    one, the run's ledger goes when it ends. Documents may have no id or no text; a document without findings has empty
    arrays; an empty table gives an empty table; other columns are not read.
    """
    held = read_ledger(docs.sparkSession, ledger) if ledger else None
    fresh, findings = scan(docs.select(F.col("doc_id").alias("path"), "text"), held)
    if ledger:
        fresh.write.mode("append").parquet(ledger)
    spans = lambda found: F.flatten(F.transform(found, lambda x: x["spans"]))
    base = F.filter("found", lambda x: x["rules"] == BASE.version)
    return findings.select(F.col("path").alias("doc_id"), "blob", spans(F.col("found")).alias("spans"), spans(base).alias("base_spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars (if there) counted anew where the text changed.

    Spans that overlap are replaced as one. No row is dropped: null and empty texts and repeated rows stay as they are,
    an empty table gives an empty table. All columns are returned, whatever their names. For `ledger` see
    document_secrets.
    """
    found = document_secrets(docs, ledger).where(F.size("spans") > 0)
    of, blob, spans, new_text = (unused(docs, n) for n in ("of", "blob", "spans", "new_text"))
    found = found.groupBy("doc_id", "blob").agg(F.first("spans").alias(spans)).withColumnsRenamed({"doc_id": of, "blob": blob})
    found = durable(found, "found")
    # documents without findings stay where they are
    maybe, others = sift(docs, F.xxhash64("doc_id", blob_id()), found, F.xxhash64(of, blob))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (blob_id() == F.col(blob))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        between = F.concat(done["out"], F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(mark))
        out = F.when(span["start"] >= done["at"], between).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["stop"]).alias("at"), out.alias("out"))

    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    hit = F.col(spans).isNotNull()
    out = maybe.join(found, same, "left").withColumn(new_text, F.when(hit, F.aggregate(ordered, start, step, rest)).otherwise(text))
    new = {"text": F.col(new_text), "n_chars": F.when(hit, F.length(new_text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    out = out.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))
    return others.unionByName(out)
