"""Secret scanning with an incremental blob ledger (operator 5, DataFrame functions only).

Every version of a text is addressed by its SHA-256. The ledger is a table kept at a path, with a row
for each (blob, rule@version) that was ever scanned and the spans found, also if there are none. A run
reduces its input to distinct addresses, scans only the pairs that the ledger lacks, appends them, and
joins the findings back to all rows (paths, versions) by address. A row that is appended twice, by a
retried job or two runs at once, counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import exists
from .common import stage, text_of


@dataclass(frozen=True)
class Rule:
    """kind:version names it; a match counts if its part ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in their order, then what this method adds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")
LEDGER_SCHEMA = "blob binary, rule string, spans array<struct<start:long,stop:long>>"
#: Blobs to scan, up to which their addresses are broadcast so that no other text leaves its task.
FEW = 20_000


def blob_address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pieces(rule: Rule) -> Column:
    """Per match: code points before it since the last match, its own, and whether it counts.
    split() and regexp_extract_all() walk the same leftmost matches of the same engine."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    found = F.transform(F.arrays_zip(whole.alias("n"), part.alias("counts")), lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m["n"].alias("n"), m["counts"].alias("counts")))
    return F.when(text.rlike(rule.pattern), found)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; an empty one is begun where there is none."""
    if not exists(spark, path):
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(blob, due): the addresses of docs with the rules that the ledger does not hold for them. Only
    addresses are shuffled, combined before. An empty table gives an empty table."""
    addresses = docs.select(blob_address(text_of(text_col)).alias("blob")).distinct()
    keys = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return addresses.withColumn("due", keys)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    due = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return addresses.join(seen, "blob", "left").select("blob", due.alias("due")).where(F.size("due") > 0)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, spans) for the blobs of docs and those rules not yet in ledger. A text
    is scanned whole, however long; equal ones are combined before they meet. A null text counts as
    empty. An empty table gives an empty table."""
    text = text_of(text_col)
    due = stage(unseen(docs, ledger, rules, text_col), "due-blobs")
    rows = docs.select(text.alias("text")).withColumn("blob", blob_address(F.col("text")))
    if due.limit(FEW + 1).count() <= FEW:  # a late run: few texts are new, the others stay where they are
        rows = rows.join(F.broadcast(due.select("blob")), "blob", "left_semi")
    blobs = rows.dropDuplicates(["blob"]).join(due, "blob")
    tried = F.array(
        *(F.when(F.array_contains("due", r.key), F.struct(F.lit(r.key).alias("rule"), _pieces(r).alias("pieces"))) for r in rules)
    )
    scanned = blobs.select("blob", F.explode(F.filter(tried, lambda t: t.isNotNull())).alias("t")).select("blob", "t.rule", "t.pieces")
    rows = scanned.select("blob", "rule", F.posexplode_outer("pieces").alias("at", "m"))
    order = Window.partitionBy("blob", "rule").orderBy("at")
    stop = F.sum(F.col("m.gap") + F.col("m.n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("stop", stop).withColumn(
        "span", F.when(F.col("m.counts"), F.struct((F.col("stop") - F.col("m.n")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))
    )
    return spans.groupBy("blob", "rule").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at path lacks of docs, append it, and return the ledger. A run over the same
    docs and rules appends nothing more."""
    fresh = stage(scan_unseen(docs, read_ledger(docs.sparkSession, path), rules, text_col), "secret-rows")
    fresh.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(LEDGER_SCHEMA).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``carry`` (a version, say) and spans, an array of
    (start, rank, kind, stop) by start, then kind in the order of rules; start and stop in code
    points, stop exclusive. Ledger rows that repeat count once. An empty table gives an empty table."""
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))))
    hits = (
        ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
        .withColumn("of", ranks[F.col("rule")])
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("of.rank").alias("rank"), F.col("of.kind").alias("kind"), s["stop"].alias("stop"))).alias("spans"))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))
    )
    # A written table, so that the join shuffles both sides and can split a blob with very many copies.
    hits = stage(hits, "secret-findings")
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, blob_address(text_of(text_col)).alias("_blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")
    joined_back = rows.join(hits.select(F.col("blob").alias("_of"), F.col("spans").alias("_spans")), F.col("_blob") == F.col("_of"), "left")
    return joined_back.select("doc_id", *carry, F.coalesce("_spans", none).alias("spans"))


def secret_scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Bring the ledger at a path up to date with docs, and the findings of all rows of docs from it.

    A null text counts as empty and has no findings. Repeated rows and equal texts are scanned once
    and each get the findings. Ids may be null or repeat. Very long texts are scanned whole. An empty
    table gives an empty table. Other columns of docs are ignored but for those to carry.
    """
    return findings(docs, update_ledger(docs, ledger_path, rules, text_col), rules, id_col, text_col, carry)


def joined(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
