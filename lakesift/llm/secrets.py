"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import fresh, text_of, work_dir

# The rules, in the order in which equal starts are listed. Group 1 is what precedes
# the value, group 2 the value; the least number of characters holds for the named part.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "value", 6),
    "access": (r"()(AKIA[A-Z0-9]{16,})", "match", 20),
    "hex": (r"()([0-9a-f]{24,})", "match", 24),
}
#: What findings and ledger are kept under: it changes with every rule.
RULE_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]
#: Private-use characters that mark matches; where a text holds them they are replaced first, one for one.
OPEN, MIDDLE, CLOSE, STAND_IN = "", "", "", "�"
MASK = "[SECRET]"

FINDINGS = "blob binary, rule_version string, kind string, start long, end long"
LEDGER = "blob binary, rule_version string"


def blob_of(text: str = "text"):
    """Content address of a text."""
    return F.unhex(F.sha2(text_of(text), 256))


def _marked(kind: str, column):
    pattern, _, _ = RULES[kind]
    return F.regexp_replace(column, pattern, f"{OPEN}$1{MIDDLE}$2{CLOSE}")


def find(blobs: DataFrame) -> DataFrame:
    """blob, kind, start, end (code points, end exclusive) of each match in ``blobs`` (blob, content).

    Each rule's matches are marked in a copy of the text; the pieces between the marks are
    numbered and the places are running sums of their lengths, so work follows the text's length.
    """
    clean = F.translate("content", OPEN + MIDDLE + CLOSE, STAND_IN * 3)
    # each text is read once; a rule without a match needs no copy of it
    copies = [F.when(F.col("content").rlike(p), F.struct(F.lit(kind).alias("kind"), F.split(_marked(kind, clean), OPEN).alias("pieces"))) for kind, (p, _, _) in RULES.items()]
    marked = blobs.select("blob", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("copy")).select("blob", "copy.kind", "copy.pieces").where(F.size("pieces") > 1)
    each = marked.select("blob", "kind", F.posexplode("pieces").alias("k", "piece"))
    # a piece after the first: what precedes the value, MIDDLE, the value, CLOSE, the text up to the next match
    marks = F.when(F.col("k") > 0, 2).otherwise(0)
    sized = each.select(
        "blob", "kind", "k", (F.length("piece") - marks).cast("long").alias("n"),
        F.length(F.substring_index("piece", MIDDLE, 1)).alias("head"), F.length(F.substring_index("piece", CLOSE, 1)).alias("closed"),
    )
    before = F.sum("n").over(Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("start", before).where("k > 0")
    value, match = F.col("closed") - F.col("head") - 1, F.col("closed") - 1
    long_enough = reduce(lambda x, y: x | y, [(F.col("kind") == kind) & ((value if part == "value" else match) >= least) for kind, (_, part, least) in RULES.items()])
    return placed.where(long_enough).select("blob", "kind", "start", (F.col("start") + F.col("closed") - 1).alias("end"))


def rank_of(kind: str = "kind"):
    return F.array_position(F.array(*map(F.lit, RULES)), F.col(kind))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan(docs: DataFrame, ledger: str | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, scanned): all findings in the blobs of ``docs``, and the ledger's blobs, both for this rule version.

    ``docs`` holds one row for each version of each path. Blobs whose (blob, rule version) is in the
    ledger are not scanned again; the others are scanned once, however many rows hold them. The ledger holds digests, kinds
    and places, never a text or a secret.
    Findings are appended first and the ledger after them, so a job that was lost in between is
    done again; repeated rows are dropped on reading. A new folder stands in for no ledger.
    """
    spark = docs.sparkSession
    ledger = ledger or work_dir(spark, "blob-ledger")
    found_at, seen_at = f"{ledger}/findings", f"{ledger}/scanned"
    unseen = docs.select(blob_of(text).alias("blob"), text_of(text).alias("content"))
    if _exists(spark, seen_at):
        seen = spark.read.schema(LEDGER).parquet(seen_at).where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        unseen = unseen.join(seen, "blob", "left_anti")
    # the rules read one shuffle of the different texts
    blobs = unseen.groupBy("blob").agg(F.first("content").alias("content"))
    find(blobs).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "kind", "start", "end").write.mode("append").parquet(found_at)
    unseen.select("blob").distinct().select("blob", F.lit(RULE_VERSION).alias("rule_version")).write.mode("append").parquet(seen_at)
    findings = spark.read.schema(FINDINGS).parquet(found_at).where(F.col("rule_version") == RULE_VERSION).drop("rule_version").distinct()
    return findings, spark.read.schema(LEDGER).parquet(seen_at).where(F.col("rule_version") == RULE_VERSION)


def by_blob(findings: DataFrame) -> DataFrame:
    """One row for each blob with findings: counts by kind, the spans in order, and the merged ranges to mask."""
    order = F.sort_array(F.collect_list(F.struct("start", rank_of().alias("rank"), "end", "kind")))
    per = findings.groupBy("blob").agg(order.alias("own"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in RULES])
    named = F.transform("own", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return per.select("blob", *[f"n_{k}" for k in RULES], F.array_join(named, ",").alias("spans"), F.transform("own", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("ranges"))


def scan_rows(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, spans and ranges: findings joined back to every row that holds the blob.

    Null text: the empty text. Repeated texts: scanned once, reported for every row. Empty table:
    empty result. Columns of ``docs`` with the new names are replaced.
    """
    findings, _ = scan(docs, ledger)
    new = [*(f"n_{k}" for k in RULES), "spans", "ranges"]
    inner = {c: fresh(f"__{c}", docs.columns) for c in ("key", "blob", *new)}
    own = by_blob(findings).select(F.col("blob").alias(inner["blob"]), *[F.col(c).alias(inner[c]) for c in new])
    kept = [c for c in docs.columns if c not in new]
    joined = docs.select(*kept, blob_of().alias(inner["key"])).join(own, F.col(inner["key"]) == F.col(inner["blob"]), "left")
    empty = {"spans": F.lit(""), "ranges": F.array().cast("array<struct<start:bigint,end:bigint>>")} | {f"n_{k}": F.lit(0).cast("long") for k in RULES}
    return joined.select(*kept, *[F.coalesce(F.col(inner[c]), empty[c]).alias(c) for c in new])


def mask_rows(docs: DataFrame, ledger: str | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret in text replaced by ``mask``; every row and every other column stays as it is, whatever its name.

    A null text stays null; equal texts are masked alike; an empty table stays empty.
    """
    found = by_blob(scan(docs, ledger)[0]).select(F.col("blob").alias("__blob"), F.col("ranges").alias("__ranges"))
    own = docs.select(*[F.col(c).alias(f"__own_{k}") for k, c in enumerate(docs.columns)], blob_of().alias("__key"))
    at = docs.columns.index("text")
    text = F.when(F.col("__ranges").isNull(), F.col(f"__own_{at}")).otherwise(masked(F.col(f"__own_{at}"), F.col("__ranges"), mask))
    joined = own.join(found, F.col("__key") == F.col("__blob"), "left")
    return joined.select(*[(text if k == at else F.col(f"__own_{k}")).alias(c) for k, c in enumerate(docs.columns)])


def masked(text, ranges, mask: str = MASK):
    """``text`` with each range of ``ranges`` (sorted by start; they may overlap) replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        reaches = x["end"] > acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        piece = F.when(x["start"] >= acc["at"], F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(reaches, x["end"]).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    folded = F.aggregate(ranges, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(ranges) == 0, text).otherwise(folded)
