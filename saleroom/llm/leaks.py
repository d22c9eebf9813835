"""Benchmark decontamination by size-partitioned MinHash containment.

Items are put into size classes by their number of distinct word shingles. An item's sketch
holds its k smallest shingle hashes, with k = the shingles that may be missing in its size
class plus one. The smallest hashes are a uniform choice among an item's shingles, so each is
in a document with the probability of the containment; and as at most k - 1 shingles may be
missing, a document that reaches the threshold always holds one of the k. Long documents cost
nothing extra: no sketch of a document is needed, only a look-up of its shingles. Candidates
are then verified by counting the item's distinct shingles in the document.

Words are split at white space after lower-casing. Null and empty texts, and texts of fewer
than `shingle` words, have no shingles: such an item matches nothing, such a document is
clean. Repeated documents with one id count as one text; repeated items give the same answer
each. Rows with a null id are compared like any other id. Empty tables give an empty result.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.llm.tokens import words

SHINGLE = 5
CONTAINMENT = 0.8
# A table is broadcast below this many (hash, item) rows: about 50 MB in memory.
BROADCAST_ROWS = 1_000_000


def shingles(rows: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(key, shingle): the 64-bit hash of each n words in a row, repeats included."""
    places = rows.select(key, words(F.lower(F.col(text))).alias("_w")).select(
        key, "_w", F.posexplode("_w").alias("_at", "_first")
    )
    rest = [F.get(F.col("_w"), F.col("_at") + k) for k in range(1, n)]
    return places.where(F.col("_at") <= F.size("_w") - n).select(
        key, F.xxhash64("_first", *rest).alias("shingle")
    )


def may_miss(size: Column, least: float) -> Column:
    """Shingles that an item of this size may lack and still reach the threshold."""
    return size - F.ceil(size * F.lit(least) - F.lit(1e-9))


def sketches(item_shingles: DataFrame, least: float) -> DataFrame:
    """(shingle, item_id) of each item's MinHash sketch; classes are powers of two of the size.

    The class's upper end decides k, so all items of a class have sketches of one length.
    """
    ordered = item_shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("shingle")).alias("_all"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_all"))))
    k = (may_miss(upper, least) + 1).cast("int")
    return ordered.select("item_id", F.explode(F.slice("_all", 1, k)).alias("shingle"))


def _maybe_broadcast(rows: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(rows) if n <= most else rows


def leaks(
    docs: DataFrame,
    items: DataFrame,
    least: float = CONTAINMENT,
    shingle: int = SHINGLE,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles (long), containment of each pair at or above the threshold.

    The item side is broadcast when it is small enough (its rows are counted first); beyond
    that, documents' distinct shingles are shuffled to it by hash.
    """
    # an unknown id compares equal to an unknown id: ids travel as a struct that is never null
    d = docs.select(F.struct(F.col(doc_id).alias("v")).alias("doc_id"), F.col(doc_text).alias("_text"))
    i = items.select(F.struct(F.col(item_id).alias("v")).alias("item_id"), F.col(item_text).alias("_text"))
    item_shingles = shingles(i, "item_id", "_text", shingle).distinct()
    sketch = sketches(item_shingles, least)
    n = item_shingles.count()
    found = shingles(d, "doc_id", "_text", shingle)
    if n > broadcast_rows:
        found = found.distinct()
    candidates = (
        found.join(_maybe_broadcast(sketch, n, broadcast_rows), "shingle").select("doc_id", "item_id").distinct()
    )
    # only candidates' texts are read again, and only their items' shingles are counted
    again = d.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (
        shingles(again, "doc_id", "_text", shingle)
        .join(_maybe_broadcast(item_shingles, n, broadcast_rows), "shingle")
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n_shared"))
        .join(candidates, ["doc_id", "item_id"], "left_semi")
    )
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return (
        shared.join(_maybe_broadcast(sizes, n, broadcast_rows), "item_id")
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        .where(F.col("n_shared") >= F.col("n_shingles") - may_miss(F.col("n_shingles"), least))
        .select(F.col("doc_id.v").alias("doc_id"), F.col("item_id.v").alias("item_id"), "n_shared", "n_shingles", "containment")
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how: object) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    leaky = leaks(docs, items, doc_id=doc_id, **how).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(leaky, docs[doc_id].eqNullSafe(leaky["_leaky"]), "left_anti")
