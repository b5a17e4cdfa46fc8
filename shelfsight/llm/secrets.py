"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a table below the shared folder,
holds (blob, rule set) pairs that were scanned and what was found; only unseen pairs are scanned, and findings
join back to every path that has the blob. Copies are reduced to one blob map-side, before the shuffle.

Defined results: null text is the empty blob; a null path keeps its findings; repeated rows stay rows; an empty
table gives an empty result and an empty ledger; further columns of the versions are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, new_path


class Rule(NamedTuple):
    kind: str
    pattern: str  # without groups but the one of the value, if any
    value: bool  # whether the pattern's first group, not the whole match, has the least length
    least: int


#: The base kinds as they are asked for, in the order listed.
BASE = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 24),  # runs are maximal, so shorter ones never hide a longer one
)
#: Public formats of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", False, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", False, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", False, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", False, 39),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,place:int,kind:string,stop:int>>"


def spans_of(text: str, place: int, rule: Rule) -> F.Column:
    """All matches of one rule, leftmost and apart, as (start, place of the rule, kind, stop) in code points.

    A match anchored at the end of the one before also takes the text between; lengths then add up to offsets.
    """
    between = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)(?:{rule.pattern})"), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({rule.pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({rule.pattern})"), F.lit(2)) if rule.value else whole
    steps = F.arrays_zip(between.alias("between"), whole.alias("whole"), value.alias("value"))

    def step(acc, m):
        start = acc["at"] + F.length(m["between"])
        stop = start + F.length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        found = F.when(F.length(m["value"]) >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    found = F.aggregate(steps, begin, step, lambda acc: acc["found"])
    return F.when(F.col(text).rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame, text: str = "text", spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` with the spans of all rules, by start and then by the order of the rules."""
    found = F.concat(*(spans_of(text, i, r) for i, r in enumerate(rules)))
    return blobs.withColumn(spans, F.array_sort(found))


def rule_version(rules: tuple[Rule, ...]) -> F.Column:
    return F.sha2(F.lit(repr([tuple(r) for r in rules])), 256)


def scan_versions(versions: DataFrame, ledger: str | None = None, text: str = "text", spans: str = "spans",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with the spans found in their content, in place of a column called so; scans what the ledger at that path hasn't seen.

    Without a path, a new ledger below the shared folder is used.
    """
    spark = versions.sparkSession
    path = ledger or new_path(spark, "secret-ledger")
    body = F.coalesce(F.col(text), F.lit(""))
    address = F.unhex(F.sha2(body, 256))
    schema = f"blob binary, version string, spans {SPANS}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    book = spark.read.schema(schema).parquet(path)
    seen = book.where(F.col("version") == rule_version(rules))
    blobs = versions.select(address.alias("blob"), body.alias("text"))
    if ledger:
        blobs = blobs.join(seen.select("blob").distinct(), "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    scan(once, rules=rules).select("blob", rule_version(rules).alias("version"), "spans").write.mode("append").parquet(path)
    blob, found, own = (fresh(versions, n) for n in ("known_blob", "known_spans", "own_blob"))
    known = spark.read.schema(schema).parquet(path).where(F.col("version") == rule_version(rules)) \
        .select(F.col("blob").alias(blob), F.col("spans").alias(found))
    if ledger:  # two runs at once may both have scanned a blob
        known = known.groupBy(blob).agg(F.first(found).alias(found))
    kept = [F.col(f"`{c}`") for c in versions.columns if c.lower() != spans.lower()]
    return versions.withColumn(own, address).join(known, F.col(own) == F.col(blob), "left").select(
        *kept, F.col(found).alias(spans))


def written_out(spans: F.Column) -> F.Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of base spans, all spans."""
    found = scan_versions(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    counts = [F.size(F.filter("spans", is_kind(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(written_out(base), 256).alias("base_sha256"),
                        written_out(F.col("spans")).alias("spans"))
