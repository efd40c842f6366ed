"""Secret scans over an incremental ledger of content-addressed blobs, in Spark SQL functions only.

Every version of a text is named by its SHA-256.  The ledger has a row for each (blob, kind, version) that was ever scanned,
with the spans found; only pairs of blob and rule version without a row are scanned, each blob once however many paths hold
it.  Whether there is such a row is asked by digests, so the texts of known blobs do not travel.  Findings are joined back to all
paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The rules, in the order of kinds.  The lengths of access and hex are in their patterns, which match maximal runs.
BASE_RULES = (
    SecretRule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("url_password", 1, r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES
#: Digests that are broadcast at most, some 20 MB.
FEW_BLOBS = 200_000
LEDGER = "blob binary, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def spans_of(text: Column, rule: SecretRule) -> Column:
    """Spans (code points, end exclusive) of a rule's matches: lengths of the gaps and matches before give the places."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    steps = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(kept, F.length).alias("length"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        found = F.when(x["length"] >= max(rule.least, 1), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda s: s["spans"])).otherwise(none)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, blob (SHA-256), spans (array of kind, start, end by start, then order of ``rules``).

    A null text is an empty one.  Repeated texts share one scan; repeated rows and rows without doc_id each get theirs; an
    empty table gives none; other columns are not read.  ``ledger`` names a Parquet table that later runs add to; without it
    the ledger begins empty in the shared folder.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "secrets")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    names = F.array(*(F.lit(r.name) for r in rules))
    past = _read_ledger(spark, ledger)
    digests = rows.select("blob").distinct()
    if past is None:
        pending = rows.select("blob", "text").dropDuplicates(["blob"]).withColumn("pending", names)
    else:
        # The ledger is asked by digests.  A bounded number of those that it lacks go to the texts, so no other text travels; where
        # there are more, copies are put aside within tasks before texts meet them.
        digests = space.keep(digests)
        seen = past.join(digests, "blob", "left_semi").groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
        lacking = digests.join(seen, "blob", "left").withColumn("pending", F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, "seen")))
        lacking = space.keep(lacking.where(F.size("pending") > 0).select("blob", "pending"))
        n_lacking = lacking.count()
        if n_lacking > FEW_BLOBS:
            pending = rows.select("blob", "text").dropDuplicates(["blob"]).join(lacking, "blob")
        else:
            pending = rows.select("blob", "text").join(F.broadcast(lacking), "blob").dropDuplicates(["blob"]) if n_lacking else None
    scans = [
        F.when(F.array_contains("pending", r.name), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules
    ]
    new = pending.select("blob", F.inline(F.filter(F.array(*scans), lambda x: x.isNotNull()))) if pending is not None else None
    if ledger:
        if new is not None:
            new.write.mode("append").parquet(ledger)
        known = _read_ledger(spark, ledger)
        known = known.join(digests, "blob", "left_semi") if past is not None else known
    else:
        known = space.keep(new)
    order = {r.kind: k for k, r in enumerate(rules)}
    current = known.join(F.broadcast(spark.createDataFrame([(r.kind, r.version, order[r.kind]) for r in rules], "kind string, version int, rank int")), ["kind", "version"])
    found = current.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"), "rank", "kind").select("blob", F.struct("s.start", "rank", "kind", "s.end").alias("span"))
    found = found.distinct().groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    joined = rows.select("doc_id", "blob").join(found, "blob", "left")
    shaped = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "blob", F.coalesce(shaped, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def _read_ledger(spark, path: str | None) -> DataFrame | None:
    if not path:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def secret_digests(scanned: DataFrame, base: tuple[SecretRule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, the last two over ``kind:start:end`` joined by commas."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = [r.kind for r in base]
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base_spans = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select("doc_id", *counts, F.sha2(joined(base_spans), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
