"""Benchmark contamination as a prefix-filtered set join, with DataFrame functions only.

Windows of benchmark words must occur whole, so a document has to hold each of a window's shingles;
one word is the unit here. Ordered by rarity in the documents, the necessary prefix is the first word
alone: only its occurrences are joined. The place of that word in the window bounds the start, the
number of words bounds the end, and the words in between are compared exactly. A document travels as
stretches of STRETCH words with the window's reach on either side, so no row carries a whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleloom.llm.common import row_key
from saleloom.session import stored

WINDOW = 10
STRETCH = 64
#: Distinct windows up to which the benchmark side is broadcast (about 200 bytes each); beyond it is shuffled.
BROADCAST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased A-Z, then runs of digits, letters and everything beyond ASCII; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def _shared(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_WINDOWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and words of each distinct window; an item of fewer words is one window, one of none has none."""
    items = (benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words(F.col(f"`{text}`")).alias("w"))
             .filter("size(w) > 0"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (items.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.slice("w", F.col("i") + 1, window).alias("words")).distinct())


def _stretches(docs: DataFrame, reach: int) -> DataFrame:
    """doc_id, key, n_words, at (place of the first own word), lead (words before it), part (words)."""
    starts = F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(STRETCH))
    lead = F.least(F.col("at"), F.lit(reach))
    return (docs.filter("n_words > 0").select("doc_id", "key", "n_words", "w", F.explode(starts).alias("at"))
            .select("doc_id", "key", "n_words", "at", lead.alias("lead"),
                    F.slice("w", F.col("at") - lead + 1, lead + STRETCH + reach).alias("part")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id") -> DataFrame:
    """Every occurrence of every window: doc_id, key, start, n (words), window (id).

    ``docs`` has doc_id, key, n_words and w (words). Also returns the window table: window, item_ids.
    """
    windows = stored(item_windows(benchmark, window, item_id).groupBy("words")
                     .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
                     .withColumn("window", F.xxhash64("words")), "windows")
    count = windows.count()
    own = F.slice("part", F.col("lead") + 1, STRETCH)
    # how rare is each benchmark word in the documents
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = (_stretches(docs, 0).select(F.explode("part").alias("word"))
              .join(_shared(vocabulary, count), "word").groupBy("word").agg(F.count("*").alias("n")))
    rank = stored(vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "rarity")
    placed = windows.select("window", "words", F.posexplode("words").alias("offset", "word"))
    first = (placed.join(rank, "word").groupBy("window", "words")
             .agg(F.min(F.struct("n", "word", "offset")).alias("p")).filter("p.n > 0")
             .select("window", "words", F.col("p.word").alias("word"), F.col("p.offset").alias("offset")))
    first = stored(first, "prefixes")
    if count <= BROADCAST_WINDOWS:
        seen = (_stretches(docs, window - 1)
                .select("doc_id", "key", "n_words", "at", "lead", "part", F.posexplode(own).alias("i", "word"))
                .join(F.broadcast(first), "word")
                .withColumn("start", F.col("at") + F.col("i") - F.col("offset"))
                .filter("start >= 0 AND start + size(words) <= n_words")
                .filter(F.slice("part", F.col("lead") + F.col("i") - F.col("offset") + 1, F.size("words")) == F.col("words")))
    else:  # words travel alone, candidates meet their stretch afterwards
        parts = _stretches(docs, 0)
        bare = parts.select("doc_id", "key", "n_words", F.col("at"), F.posexplode("part").alias("i", "word"))
        found = (bare.join(first, "word").withColumn("start", F.col("at") + F.col("i") - F.col("offset"))
                 .filter("start >= 0 AND start + size(words) <= n_words")
                 .withColumn("at", (F.floor(F.col("start") / STRETCH) * STRETCH).cast("int")))
        whole = _stretches(docs, window - 1).select("doc_id", "key", "at", "lead", "part")
        seen = (found.join(whole, ["doc_id", "key", "at"])
                .filter(F.slice("part", F.col("lead") + F.col("start") - F.col("at") + 1, F.size("words")) == F.col("words")))
    return seen.select("doc_id", "key", "start", F.size("words").alias("n"), "window").distinct(), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, item_ids (sorted as strings) of every document row.

    Rows of one doc_id are told apart by their text; equal rows get equal results. Null and empty
    texts have no words, an empty benchmark hits nothing, items without id carry no name but hit.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{text}`")).alias("key"),
                       words(F.col(f"`{text}`")).alias("w")).withColumn("n_words", F.size("w"))
    # a row without doc_id is looked up under its key alone
    found, windows = hits(base.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))),
                          benchmark, window, item_id)
    found = stored(found, "hits")
    covered = (found.select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p"))
               .distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_hit")))
    named = (found.select("doc_id", "key", "window").distinct().join(windows.select("window", "item_ids"), "window")
             .select("doc_id", "key", F.explode("item_ids").alias("item"))
             .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    per_doc = covered.join(named, ["doc_id", "key"], "left").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    rows = base.select("doc_id", "key", "n_words")
    same = (F.coalesce(rows["doc_id"].cast("string"), F.lit("none")) == per_doc["_doc"]) & (rows["key"] == per_doc["_key"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(per_doc, same, "left").select(
        "doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    found = contamination(docs, benchmark, window).filter("n_hit > 0").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_doc"), F.col("key").alias("_key")).distinct()
    found = stored(found, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), row_key(F.col("text")).alias("_row_key"))
    same = (F.coalesce(F.col("row.doc_id").cast("string"), F.lit("none")) == found["_doc"]) & (F.col("_row_key") == found["_key"])
    return rows.join(found, same, "left_anti").select("row.*")
