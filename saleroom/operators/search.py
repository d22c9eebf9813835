"""Search for a table of terms through an inverted index of 3-grams.

A term is found where `ILIKE '%term%'` holds for the title, category or description; `%` and
`_` in it are wildcards. Its literal runs are cut into 3-grams (a shorter run is a gram of
its own; a term of wildcards only has the empty gram, which every listing has). All those
grams must occur in one column, so looking up the rarest of them is enough, and the few
listings found are then compared by `ilike`. The index holds only grams that some term has,
so what is shuffled grows with the texts' share of such grams; the plan is the same for any
number of terms and has no nested loop.

Listings are dealt by id once, and their index and the listings found stay where they were
dealt. They are never broadcast, however small their files are: a few megabytes of repeated
texts are hundreds as rows, and the driver would hold them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.operators.listings import SEARCHED, matches, shown

N = 3


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, each once."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))))


def term_grams(terms: DataFrame) -> DataFrame:
    """(term, gram) of the different terms; nulls are no terms."""
    found = terms.select(F.col("term").cast("string").alias("term")).where(F.col("term").isNotNull()).distinct()
    # an escape sign ends a run as wildcards do: what is left must occur all the same
    runs = F.filter(F.split(F.lower("term"), r"[%_\\]"), lambda r: r != "")
    of_run = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < N, F.array(r)).otherwise(_grams(r, N))))
    grams = F.when(F.size(runs) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(of_run))
    return found.select("term", F.explode(grams).alias("gram"))


def gram_index(listings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, id) of the wanted grams, each once per listing."""
    texts = F.array_compact(F.array(*(F.lower(F.col(c)) for c in SEARCHED)))
    each = F.flatten(F.transform(texts, lambda t: F.concat(*(_grams(t, n) for n in range(1, N + 1)), F.array(F.lit("")))))
    every = listings.select("id", F.explode(F.array_distinct(each)).alias("gram"))
    return every.join(wanted, "gram", "left_semi")


def search_table(listings: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per (term, matching visible listing): the term and all columns of the listing.

    `terms` has a column `term`; repeated terms count once. `id` names a listing.
    """
    visible = listings.where(shown()).repartition("id")
    grams = term_grams(terms)
    index = gram_index(visible, grams.select("gram").distinct())
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no listing has leaves its term without listings
    rarest = grams.join(frequency, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    ).where("best.n > 0").select("term", F.col("best.gram").alias("gram"))
    candidates = rarest.join(index, "gram").select("term", "id")
    return candidates.join(visible.hint("merge"), "id").where(matches(F.col("term"))).select("term", *listings.columns)
