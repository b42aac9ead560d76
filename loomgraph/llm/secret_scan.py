"""Secret scans with an incremental blob ledger (operator 8): DataFrame and SQL functions only.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger holds one row for each pair
of a blob and a rule version that has been scanned, with the spans found. A scan looks only at pairs the ledger
does not have, and joins findings back to all paths (rows) that hold the blob. The ledger is a table in a folder that
every scan appends to, so the next version of a corpus, or of the rules, is scanned only where it is new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.hashing import unused


@dataclass(frozen=True)
class Rule:
    """One kind of secret. Matches are leftmost and do not overlap; those under `least` characters in `group` drop out.

    `hint` is a cheap condition on the text under which alone the pattern can match enough characters.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    base: bool = True


# The base kinds in their order, then those this operator adds.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:password|passwd|secret|token|api_?key)", group=2, least=6),
    Rule("access", 1, "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", 1, "[0-9a-f]{24,}", "[0-9a-f]{24}", least=24),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ", base=False),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}", base=False),
)

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of a rule in a text, as an array of (start, rank, kind, end) in code points, end exclusive.

    The text splits into gaps at the matches; gap and match lengths add up to the places.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m))
    found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), judged.alias("judged"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done, m):
        at = done["at"] + m["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + m["size"]).alias("end"))
        return F.struct((at + m["size"]).alias("at"), F.when(m["judged"] >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    none = F.array().cast(SPAN)
    return F.when(text.rlike(rule.hint), F.aggregate(found, start, step, lambda done: done["spans"])).otherwise(none)


LEDGER = "blob string, kind string, version int, spans " + SPAN


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blobs(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with `blob`, the SHA-256 of the text (null counts as empty)."""
    return rows.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each blob of texts(blob, text, due): the spans of the rules that are due, a ledger row a rule."""
    found = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("due", r.kind), spans_of(F.coalesce("text", F.lit("")), r, k)).alias("spans")) for k, r in enumerate(rules)]
    rows = texts.select("blob", F.explode(F.filter(F.array(*found), lambda x: x["spans"].isNotNull())).alias("x"))
    return rows.select("blob", "x.kind", "x.version", "x.spans")


def update(rows: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that rows(text, ...) add: each unseen pair of blob and rule version, scanned once.

    Null and empty texts are one blob without spans; a blob that many rows hold is scanned once; a rule whose
    version has changed is scanned again, others are not. Append the result to the ledger's table.
    """
    # Only texts that some rule may match travel to where the copies of a blob meet, one of each task.
    suspect = F.when(F.col("text").rlike("|".join(f"(?:{r.hint})" for r in rules)), F.col("text"))
    texts = blobs(rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).groupBy("blob").agg(F.max(suspect).alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        texts = texts.join(known, "blob", "left")
        wanted = F.array_except(wanted, F.coalesce("known", F.array().cast("array<struct<kind:string,version:int>>")))
    return _scanned(texts.withColumn("due", F.transform(wanted, lambda w: w["kind"])).where(F.size("due") > 0), rules)


def findings(rows: DataFrame, ledger: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns `keys` of rows(text, ...) with `spans`, all spans of current rule versions by start, then kind.

    Every row is returned, repeated ones as often as they occur; columns beside keys and text are not read.
    """
    current = ledger.where(F.concat_ws(":", "kind", F.col("version").cast("string")).isin([f"{r.kind}:{r.version}" for r in rules]))
    spans = current.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    named = blobs(rows.select(*keys, "text")).select(*keys, "blob")
    return named.join(spans, "blob", "left").select(*keys, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept in a folder; empty where nothing has been scanned yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(path)


def scan(rows: DataFrame, keys: list[str], path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger in the folder `path` up to date with rows and give the findings of all rows.

    See update() and findings(). The new ledger rows become visible together when the scan's job commits, so a scan
    that fails or loses executors leaves the ledger as it was, and scanning again scans what is still unseen.
    """
    spark = rows.sparkSession
    update(rows, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return findings(rows, read_ledger(spark, path), keys, rules)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, counts of the base kinds, base_sha256 and all spans as text.

    A row for each input row; null texts are empty; other columns are not read. `path` is the ledger's folder, a new
    one in the shared folder if it is not given.
    """
    path = path or runtime.fresh_path(docs.sparkSession, "secret_ledger")
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"], path, rules)
    bases = [r.kind for r in RULES if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(bases))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in bases]
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(text, ...) with every secret in text replaced by [SECRET]; all columns and rows are kept, whatever their names.

    Overlapping spans go as one. Null texts stay null. The blob findings are joined back to all rows by content.
    `path` is the ledger's folder, as in report().
    """
    spark, path = docs.sparkSession, path or runtime.fresh_path(docs.sparkSession, "secret_ledger")
    update(docs, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    blob, spans = unused(docs.columns, "blob"), unused(docs.columns, "spans")
    current = read_ledger(spark, path).where(F.concat_ws(":", "kind", F.col("version").cast("string")).isin([f"{r.kind}:{r.version}" for r in rules]))
    found = current.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(spans))
    out = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).join(found, blob, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done, s):
        # Text up to the span, then one mark; a span that starts inside the last one only moves its end.
        apart = s["start"] > done["at"]
        first = (done["at"] == 0) & (s["start"] == 0)
        gap = F.col("text").substr(done["at"] + 1, s["start"] - done["at"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(apart, F.concat(done["text"], gap, F.lit("[SECRET]"))).when(first, F.lit("[SECRET]")).otherwise(done["text"]).alias("text"))

    cleaned = F.aggregate(F.col(spans), start, step, lambda done: F.concat(done["text"], F.col("text").substr(done["at"] + 1, F.length("text"))))
    return out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cleaned)).select(*docs.columns)
