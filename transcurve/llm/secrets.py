"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text: assigned secrets, access keys, long hex runs
(the base kinds) and, beyond them, provider tokens, private-key headers and mixed
high-entropy strings. Every candidate value is hashed and counted over the corpus by
distinct documents (the repositories) and distinct sources (the owners). A value that
many owners carry is a copied example; one that few hold looks live. Base spans are
always reported; a span of the further kinds is reported only while its value is
owner-specific.

Null text counts as empty: no spans. A null source counts as one owner, a null doc_id
as one repository. Repeated rows are reported each, and count once. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

# Fixed values of the base kinds: pattern, group whose length counts, least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "private", "provider", "mixed")
#: Distinct owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: A value with more than one in this many of all spans is frequent; there are fewer such values than this.
FREQUENT = 1000
#: Bits a character from which on a mixed string counts as random, and its least length.
MIXED_BITS, MIXED_CHARS = 3.5, 24
CHUNK_BYTES = 2 << 20

_FURTHER = {
    "private": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "provider": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "mixed": rf"[A-Za-z0-9+/_=-]{{{MIXED_CHARS},}}",
}


def entropy(value: str) -> float:
    """Bits a character of the value's own letters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


class Scanner:
    """Spans (kind, start, end, value) of one text; offsets count code points."""

    def __init__(self) -> None:
        self.assign = re.compile(ASSIGN, re.I | re.A)
        # a run that is too short fails whole, so the bound can stand in the pattern: runs are maximal
        self.access = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}")
        self.hex = re.compile(rf"[0-9a-f]{{{HEX_CHARS},}}")
        self.further = [(k, re.compile(p)) for k, p in _FURTHER.items()]

    def base(self, text: str) -> list[tuple[str, int, int, str]]:
        found = [("assign", m.start(), m.end(), m[2]) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        found += [("access", m.start(), m.end(), m[0]) for m in self.access.finditer(text)]
        return found + [("hex", m.start(), m.end(), m[0]) for m in self.hex.finditer(text)]

    def more(self, text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """Spans of the further kinds outside the base ones and each other."""
        out = []
        taken: list[list[int]] = []  # disjoint covered stretches, in order
        for _, s, e, _ in sorted(base, key=lambda x: x[1:3]):
            if taken and s < taken[-1][1]:
                taken[-1][1] = max(e, taken[-1][1])
            else:
                taken.append([s, e])
        for kind, pattern in self.further:
            for m in pattern.finditer(text):
                if kind == "mixed" and not (re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and entropy(m[0]) >= MIXED_BITS):
                    continue
                at = bisect_left(taken, [m.end()])  # the first stretch that begins at or after the span's end
                if not at or taken[at - 1][1] <= m.start():
                    taken.insert(at, [m.start(), m.end()])
                    out.append((kind, m.start(), m.end(), m[0]))
        return out


_SPANS = "doc_id long, source string, spans array<struct<kind:string,start:long,end:long,value:string,base:boolean>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source and the candidate spans of every document, by start, then kind.

    ``value`` is the hash of the candidate: texts of secrets don't leave the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, order = Scanner(), {k: i for i, k in enumerate(KINDS)}
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())])))])
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                rows = []
                for text in part.column("text").to_pylist():
                    base = scan.base(text or "")
                    spans = [(*s, True) for s in base] + [(*s, False) for s in scan.more(text or "", base)]
                    spans.sort(key=lambda s: (s[1], order[s[0]]))
                    rows.append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "base": own} for k, a, b, v, own in spans])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(rows, schema.field("spans").type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(common.tidy(run), _SPANS)


def ownership(found: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """value, n_spans, n_repos, n_owners, example: how widely each candidate value is carried.

    Counted in two steps that combine before they shuffle, so a value in a third of all
    documents meets nowhere whole: first per (value, owner, repository), then per value.
    """
    flat = found.select("doc_id", "source", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), F.struct("source").alias("owner"), F.struct("doc_id").alias("repo"))
    per_repo = flat.groupBy("value", "owner", "repo").agg(F.count("*").alias("k"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    return per_owner.groupBy("value").agg(F.sum("k").alias("n_spans"), F.sum("n").alias("n_repos"), F.count("*").alias("n_owners")).withColumn("example", F.col("n_owners") >= owners)


def scan(docs: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id, source, spans (kind, start, end, value, base, n_repos, n_owners, example) of every document.

    Only documents with candidates meet the counts; base spans stay whatever the counts say.
    Spans of the frequent values, of which there are fewer than ``FREQUENT``, meet their counts
    by a broadcast, so that no task gets all spans of a value; the others meet them in a shuffle.
    """
    found = common.cut(candidates(docs).withColumn("row", F.monotonically_increasing_id()))
    counts = common.cut(ownership(found, owners))
    flat = common.cut(found.select("row", F.explode("spans").alias("s")).select("row", F.col("s.value").alias("value"), "s"))
    spans = counts.agg(F.sum("n_spans")).first()[0] or 0
    frequent = F.broadcast(counts.where(F.col("n_spans") * FREQUENT > spans))
    others = counts.where(F.col("n_spans") * FREQUENT <= spans)
    judged = (
        flat.join(frequent, "value")
        .unionByName(flat.join(frequent.select("value"), "value", "left_anti").join(others, "value"))
        .where("s.base or not example")
        .groupBy("row")
        .agg(F.collect_list(F.struct(F.col("s.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "value", F.col("s.base").alias("base"), "n_repos", "n_owners", "example")).alias("js"))
        .select(F.col("row").alias("jrow"), F.array_sort("js").alias("js"))
    )
    return found.join(judged, F.col("row") == F.col("jrow"), "left").select("doc_id", "source", F.coalesce("js", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,value:string,base:boolean,n_repos:bigint,n_owners:bigint,example:boolean>>")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(common.documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return spans.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.example)).cast("long").alias("n_examples"),
        F.size(F.filter("spans", lambda s: ~s.example)).cast("long").alias("n_live"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_secret_scan": query}
ORACLES: dict[str, str] = {}
