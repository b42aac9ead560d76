"""Benchmark decontamination by template canonicalisation (operator 1): DataFrame and SQL functions only.

Texts become tokens; numbers, names and units become typed placeholders, so a question and the same question with
other figures or names have one template. Windows of template tokens are hash-joined between documents and
benchmark items; windows of one pair that lie on neighbouring diagonals are counted together, so a few words put in
or left out don't hide an item. Where enough of an item's windows are met, the slots are compared: each value of the
item must stand for one value of the document, as in a re-parameterised question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.hashing import unused

NUMBER, NAME = "§n", "§a"
# Units that count as such after a number.
UNITS = "mm cm m km mg g kg t ml l s ms min h hz khz mhz ghz w kw v kb mb gb tb in ft yd mi oz lb lbs mph kmh percent % usd eur dollars euros cents seconds minutes hours days weeks months years miles metres meters kilometres kilometers kilograms grams litres liters pounds inches feet degrees".split()
#: A capital after a word that does not end its sentence starts a name.
NAME_PATTERN = r"([\p{L}\p{N},;]\s)(\p{Lu})"
NUMBER_PATTERN = r"\p{N}+(?:[.,:/]\p{N}+)*"
TOKEN_PATTERN = rf"{NUMBER}{NUMBER_PATTERN}|[\p{{L}}\p{{N}}§%]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; numbers and names carry a mark in front of their value."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_PATTERN, f"$1{NAME}$2")
    marked = F.regexp_replace(marked, NUMBER_PATTERN, f"{NUMBER}$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN_PATTERN), F.lit(0))


def slot(tokens: Column, token: Column, k: Column) -> Column:
    """The placeholder of the k-th token, null where it is a literal."""
    after_number = (k > 0) & F.get(tokens, k - 1).startswith(NUMBER)
    return F.when(token.startswith(NAME), F.lit(NAME)).when(token.startswith(NUMBER), F.lit(NUMBER)).when(after_number & token.isin(UNITS), F.lit("§u"))


def template_hashes(tokens: Column) -> Column:
    """Hashes of the template tokens. `tokens` should be a column of its own: it is looked up for each token."""
    return F.transform(tokens, lambda t, k: F.xxhash64(F.coalesce(slot(tokens, t, k), t)))


def window_hashes(hashes: Column, width: int) -> Column:
    """Hashes of all windows of `width` hashes, in order."""
    starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.xxhash64(*[F.get(hashes, k + j) for j in range(width)]))


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with tokens; the first word is left out where it has a capital, which says nothing at a text's start."""
    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates()
    found = found.select("item_id", F.xxhash64("item_id", "text").alias("ik"), F.trim("text").rlike(r"^\p{Lu}").alias("capital"), tokens(F.trim("text")).alias("t"))
    return found.select("item_id", "ik", F.expr("if(capital, slice(t, 2, greatest(size(t) - 1, 0)), t)").alias("item_tokens"))


def _item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    """(window, item, place) of the windows with enough literal tokens to be evidence, with their number."""
    t = F.col("item_tokens")
    plain = F.transform(t, lambda x, k: slot(t, x, k).isNull().cast("int"))
    rows = items.select("item_id", "ik", plain.alias("plain"), template_hashes(t).alias("h"))
    rows = rows.select("item_id", "ik", "plain", F.posexplode(window_hashes(F.col("h"), width)).alias("place", "window"))
    rows = rows.where(F.aggregate(F.slice("plain", F.col("place") + 1, F.lit(width)), F.lit(0), lambda a, b: a + b) >= literals)
    return rows.select("window", "item_id", "ik", "place")


def _matches(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float, literals: int, small: int, drift: int) -> DataFrame:
    """(doc_id, dk, item_id, n_matched, n_windows, same) of matched pairs; `dk`, two hashes, names the row by content."""
    items = _items(benchmark)
    windows = _item_windows(items, width, literals)
    n_windows = windows.groupBy("ik").agg(F.count("*").alias("n_windows"))
    few = windows.count() <= small
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("dk", row_key())
    seen = named.select("doc_id", "dk", tokens(F.col("text")).alias("t")).select("doc_id", "dk", template_hashes(F.col("t")).alias("h"))
    seen = seen.select("doc_id", "dk", F.posexplode(window_hashes(F.col("h"), width)).alias("at", "window"))
    hits = seen.join(F.broadcast(windows) if few else windows, "window")
    lines = hits.groupBy("doc_id", "dk", "item_id", "ik", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    # Two dealings into bands of 2 * drift diagonals: any two within `drift` of each other share a band.
    bands = F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("shift") + k * drift) / (2 * drift)).alias("band")) for k in (0, 1)])
    lines = lines.withColumn("in", F.explode(bands)).groupBy("doc_id", "dk", "item_id", "ik", "in")
    lines = lines.agg(F.array_sort(F.collect_list(F.struct((-F.size("places")).alias("rank"), "shift", "places"))).alias("lines"))
    lines = lines.withColumn("n_matched", F.size(F.array_distinct(F.flatten("lines.places")))).join(F.broadcast(n_windows) if few else n_windows, "ik").where(F.col("n_matched") >= coverage * F.col("n_windows"))
    # Written, so that the planner knows how large it is and takes the text to it, or it to the text.
    lines = runtime.materialise(lines.select("doc_id", "dk", "item_id", "ik", "lines", "n_matched", "n_windows"), "template_matches")

    texts = named.select("dk", "text").join(lines.select("dk").distinct(), "dk", "left_semi").dropDuplicates(["dk"])
    pairs = texts.select("dk", tokens(F.col("text")).alias("doc_tokens")).join(lines, "dk").join(items.select("ik", "item_tokens"), "ik")
    it, dt = F.col("item_tokens"), F.col("doc_tokens")

    def shift_of(k):
        """Each token of the item stands with the diagonal whose windows are nearest to it, the longest of equals."""
        far = lambda line: F.array_min(F.transform(line["places"], lambda p: F.greatest(p - k, k - p - (width - 1), F.lit(0))))
        return F.array_min(F.transform("lines", lambda line: F.struct(far(line).alias("far"), line["rank"].alias("rank"), line["shift"].alias("shift"))))["shift"]

    def values(k, shift):
        a, b = F.get(it, k), F.get(dt, k + shift)
        return F.when((k + shift >= 0) & (slot(it, a, k) == slot(dt, b, k + shift)), F.struct(a.alias("a"), b.alias("b")))

    shifts = F.transform(F.sequence(F.lit(0), F.size(it) - 1), lambda k: F.struct(k.alias("k"), shift_of(k).alias("shift")))
    pairs = pairs.withColumn("shifts", shifts).withColumn("slots", F.array_distinct(F.filter(F.transform("shifts", lambda x: values(x["k"], x["shift"])), lambda s: s.isNotNull())))
    consistent = F.size(F.array_distinct("slots.a")) == F.size("slots")
    return pairs.where(consistent).select("doc_id", "dk", "item_id", "n_matched", "n_windows", F.forall("slots", lambda s: s["a"] == s["b"]).alias("same"))


def row_key() -> Column:
    """A row of doc_id and text by its content, in 128 bits."""
    return F.struct(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("a"), F.xxhash64(F.lit(1), F.col("text").cast("string"), F.col("doc_id").cast("long")).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, literals: int = 3, small: int = 1_000_000, drift: int = 4) -> DataFrame:
    """Pairs (doc_id, item_id) of docs(doc_id, text) that hold an item of benchmark(item_id, text) or its template.

    Returns doc_id, item_id, n_matched and n_windows (of the item), coverage, kind ('verbatim' where all slots
    agree, else 'reparameterised'); rows with equal (doc_id, item_id) appear once, with the best match. Null and
    empty texts, and items without a window of `literals` literal tokens, match nothing. Whole texts are read;
    other columns are not. An empty table gives an empty result. Windows count together where up to `drift` words
    have been put in or left out between them.

    The item windows are broadcast only where there are at most `small` of them (16 bytes each and a few for the
    table); beyond that the join shuffles both sides by window.
    """
    share = F.col("n_matched") / F.col("n_windows")
    best = F.max(F.struct(share, "same", "n_matched", "n_windows")).alias("best")
    found = _matches(docs, benchmark, width, coverage, literals, small, drift).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.n_matched", "best.n_windows", (F.col("best.n_matched") / F.col("best.n_windows")).alias("coverage"), F.when(F.col("best.same"), "verbatim").otherwise("reparameterised").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, literals: int = 3, small: int = 1_000_000, drift: int = 4) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all columns.

    Rows go by their own content: a clean row stays though another with its doc_id (or with none) goes. Null and
    empty texts stay; repeated rows stay or go together; see contaminated().
    """
    name = unused(docs.columns, "bad")
    bad = _matches(docs, benchmark, width, coverage, literals, small, drift).select(F.col("dk").alias(name)).distinct()
    return docs.join(bad, row_key() == F.col(name), "left_anti")
