"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the size of their shingle sets (powers of two). Each item keeps a bottom-k MinHash
sketch, its k smallest shingle hashes, and k is set per partition: an item of n shingles that lies in a document
with containment 0.8 lacks at most 0.2 n of them, so one more than that many sketch entries cannot all be
missing. Documents look up their shingle hashes in the sketches; a hit in a document that has too few
shingles for the item is left out. No containing document is missed, however long it is. The pairs
found are verified on the shingles themselves.

Only DataFrame functions are used. Neither side is broadcast by a hint; Spark does so where the sketches are small.

Shingles are five lower-case words (runs of letters, marks and digits); an item of fewer words is one shingle
of its own length. Nulls: null texts have no shingles; rows without item_id or doc_id cannot be named and are left
out (``drop_contaminated`` keeps such documents). Rows that share an item_id or doc_id count as one, with all their
shingles. Empty items match nothing, empty tables give no pairs, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.distributed import pinned
from corpusloom.session import store

WORDS = 5
CONTAINMENT = 0.8
_BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text as an array."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN_WORDS), "")


def _windows(tokens: Column, width: Column | int, make) -> Column:
    """``make`` of every run of ``width`` tokens; empty where there are fewer."""
    runs = F.size(tokens) - F.lit(width) + 1
    return F.when(
        (runs > 0) & (F.lit(width) > 0), F.transform(F.sequence(F.lit(1), runs), lambda i: make(F.slice(tokens, i, width)))
    )


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, width, shingle, hash and the item's number of distinct shingles."""
    tokens = pinned(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), "tokens", words(F.col("text")))
    width = F.least(F.lit(WORDS), F.size("tokens"))
    cut = tokens.withColumn("width", width).select(
        "item_id", "width", F.explode(_windows(F.col("tokens"), F.col("width"), lambda s: F.array_join(s, " "))).alias("shingle")
    )
    cut = cut.distinct().withColumn("hash", F.xxhash64(F.split("shingle", " ")))
    sizes = cut.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return cut.join(sizes, "item_id")


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The k smallest hashes of each item; k by the size partition of the item.

    Windows are over one item's shingles, which its own text bounds.
    """
    partition = F.floor(F.log2("n_shingles"))
    largest = F.pow(F.lit(2.0), partition + 1) - 1
    lacking = F.floor(largest * (1 - containment) + 1e-9)
    ranked = shingles.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("hash", "shingle")))
    return ranked.where(F.col("rank") <= lacking + 1).select(
        "item_id", "hash", F.ceil(F.col("n_shingles") * containment - 1e-9).alias("least")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and containment of every item found in a document."""
    items = store(item_shingles(benchmark), "items")
    sketch = store(sketches(items, containment), "sketches")
    # At most WORDS values: five unless an item is shorter.
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()] or [WORDS]

    tokens = pinned(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "tokens", words(F.col("text")))
    hashes = [F.coalesce(_windows(F.col("tokens"), w, F.xxhash64), F.array().cast("array<bigint>")) for w in widths]
    hashed = pinned(tokens.select("doc_id", "tokens"), "hashes", F.flatten(F.array(*hashes)) if len(hashes) > 1 else hashes[0])
    hits = hashed.select("doc_id", F.size("hashes").alias("size"), F.explode("hashes").alias("hash")).join(sketch, "hash")
    pairs = store(hits.where("size >= least").select("doc_id", "item_id").distinct(), "pairs")

    # Exact: the shingles of the documents found, against all shingles of the items found in them.
    found = docs.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    tokens = pinned(found, "tokens", words(F.col("text")))
    cuts = [
        F.coalesce(_windows(F.col("tokens"), w, lambda s: F.array_join(s, " ")), F.array().cast("array<string>")) for w in widths
    ]
    cut = tokens.select("doc_id", F.explode(F.flatten(F.array(*cuts)) if len(cuts) > 1 else cuts[0]).alias("shingle"))
    shared = cut.join(items.select("item_id", "shingle", "n_shingles"), "shingle")
    counted = shared.distinct().groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
    return (
        counted.join(pairs, ["doc_id", "item_id"], "left_semi")
        .where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
        .select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that contain no benchmark item; all columns stay, as do rows without doc_id."""
    found = store(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
