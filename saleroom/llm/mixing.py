"""Mixing sources to target weights by entropy balancing.

Each document has a base mass (its size in words) and gets the mass closest to it in relative
entropy such that every source meets its token target, no document exceeds `most` times its
size, and the words of each length stratum (sizes of equally many binary digits) keep their
share of the corpus, so that a source is not filled with its short or long documents alone.
Two families of constraints cross, so the multipliers have no closed form. The rate of a
document is exponentially tilted: min(most, exp(source multiplier + stratum multiplier)).

The dual is solved by Newton steps on the strata's multipliers (at most 63). Every step is a
Spark job over the table of sources: given the strata's multipliers, a source's own one follows
from its words per stratum, and value, gradient and curvature are added up over all sources, in
whole units, so that the order of adding does not matter. The strata are soft (`SLACK`): with
caps and source targets their shares can be out of reach, and the sources' targets come first.
Steps end at `TOLERANCE` or after `NEWTON_STEPS`.

Rates are rounded into whole copies: the whole part of the rate for every document, and one
more for documents in order of u / rest until the rest of the source's target is used up, with
u even in [0, 1) from the MD5 of the id and rest the fraction of the rate (sequential Poisson
sampling: documents get one more with the odds of their fraction).

A null text has size 0; null is a source of its own, last in order. Repeated rows are rows.
An empty table gives an empty result; a source whose documents are all empty gets the target
0. Ties in the order (repeated ids) are broken by size; equal rows are interchangeable. Other
columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from saleroom.functions.ids import numbered, pinned
from saleroom.llm.tokens import WORD_BREAK

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # all sources together take 3/2 of all words
MOST = 2
NEWTON_STEPS = 40
TOLERANCE = 1e-9  # of all words, by which a stratum may miss its balance
# A stratum's relative distance from its share, for a multiplier of one.
SLACK = 0.01
STRATA = 63  # a size is a long: 1 to 63 binary digits
UNIT = 2.0**40  # gradients are added up in these parts of all words
# Documents of one source in one sorted run, on average.
RUN_ROWS = 2_000
BROADCAST_SOURCES = 20_000  # of about 600 bytes each


def n_words(text: Column) -> Column:
    """Number of words of a text, without building them: breaks inside the trimmed text, plus one."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_BREAK}|{WORD_BREAK}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, WORD_BREAK))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> the same with target.

    Water filling: with level m, a source gets min(most * size, weight * m), and m makes the
    targets add up to the share of all words. Sources fill up in order of size / weight. The
    sums are whole numbers and the target is one division, so every engine gives it alike.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_n")
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = ranked.withColumn("_weight", F.get(cycle, (F.col("_n") - 1) % len(weights)))
    # One row per distinct ratio size/weight would be needed to fill up in order; numbering by
    # that order and running sums over the numbered rows stay distributed through `numbered`.
    total, weight = (ranked.agg(F.sum(c)).scalar() for c in ("source_size", "_weight"))
    filled = _running(ranked, F.col("source_size") / F.col("_weight"), ["source_size", "_weight"])
    # full sources before this one leave (share * total - most * before) to the weights from here on
    left = F.lit(SHARE[0]) * total - F.lit(SHARE[1] * most) * F.col("_before_source_size")
    per = F.lit(SHARE[1]) * (weight - F.col("_before__weight"))
    full = F.col("_weight") * left >= F.lit(most) * F.col("source_size") * per
    marked = pinned(filled.withColumn("_full", full & (per > 0)))
    # the first source that isn't full has the level of all after it
    level = marked.where(~F.col("_full")).select(
        F.struct(F.col("_order"), (left).alias("left"), (per).alias("per")).alias("_s")
    ).agg(F.min("_s").alias("_s"))
    open_left, open_per = (level.select(F.col(f"_s.{c}")).scalar() for c in ("left", "per"))
    return marked.select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("_full"), (F.lit(most) * F.col("source_size")).cast("double"))
        .otherwise((F.col("_weight") * open_left).cast("double") / open_per.cast("double"))
        .alias("target"),
        *(c for c in ("masses",) if c in sizes.columns),
    )


def _running(rows: DataFrame, order: Column, sums: list[str]) -> DataFrame:
    """Adds _order (1, 2, … by `order`, then _n) and _before_<c>, the sum over the rows before, without one task for all rows."""
    fixed = numbered(rows.withColumn("_key", order), ["_key", "_n"], "_order").withColumn(
        "_block", F.floor((F.col("_order") - 1) / F.lit(RUN_ROWS))
    )
    blocks = fixed.groupBy("_block").agg(*(F.sum(c).alias(f"_b_{c}") for c in sums))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per 2,000 sources
    offsets = blocks.select("_block", *(F.coalesce(F.sum(f"_b_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums))
    inside = Window.partitionBy("_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return fixed.join(offsets, "_block").select(
        *(c for c in fixed.columns if c not in ("_key", "_block")),
        *((F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"_before_{c}") for c in sums),
    )


def stratum(size: Column) -> Column:
    """0 for sizes up to 1, 1 for 2 and 3, 2 for 4 to 7, …"""
    return F.length(F.bin(size)) - 1


def tilted(masses: np.ndarray, target: np.ndarray, beta: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(multiplier of each source, rate of each source and stratum) at the strata's multipliers.

    Strata reach the cap in order of beta; with the first j of them capped, the multiplier
    that meets the target is one logarithm. The right j is the first that leaves the next
    stratum below the cap. A source that can only just be filled has the multiplier infinity.
    """
    order = np.argsort(-beta, kind="stable")
    own, high = masses[:, order], beta[order]
    below = np.cumsum((own * np.exp(high))[:, ::-1], axis=1)[:, ::-1]
    capped = np.cumsum(own, axis=1) - own
    with np.errstate(divide="ignore", invalid="ignore"):
        levels = np.log((target[:, None] - most * capped) / below)
    fits = (levels + high <= np.log(most)) & (below > 0)
    level = np.where(fits.any(axis=1), levels[np.arange(len(own)), fits.argmax(axis=1)], np.inf)
    return level, np.minimum(most, np.exp(np.minimum(level[:, None] + beta, 700.0)))


def dual_parts(masses: np.ndarray, target: np.ndarray, beta: np.ndarray, most: float) -> np.ndarray:
    """Per source: value of the dual, words taken per stratum, curvature (strata by strata), in one row."""
    level, rate = tilted(masses, target, beta, most)
    taken = masses * rate
    m = np.clip(level, -700, np.log(most) - beta.min())[:, None] + beta  # beyond it every stratum is capped: the value stays
    over = m > np.log(most)
    value = (m - beta)[:, 0] * target - np.where(over, masses * most * (1 + m - np.log(most)), masses * np.exp(np.minimum(m, np.log(most)))).sum(axis=1)
    free = np.where(rate < most, taken, 0.0)
    total = free.sum(axis=1)
    share = free / np.where(total > 0, total, 1.0)[:, None]
    bend = free[:, :, None] * (np.eye(len(beta)) - share[:, None, :])
    return np.concatenate([value[:, None], taken, bend.reshape(len(masses), -1)], axis=1)


def _arrays(batch: pa.RecordBatch, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index("masses"))
    masses = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, used]
    return masses.astype(np.float64), batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False)


def balanced(
    targets: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS, share: float = SHARE[0] / SHARE[1], slack: float = SLACK
) -> DataFrame:
    """Adds rates (one per stratum, an array as long as masses) and rate (the source's mean).

    `targets`: source, source_size, target and masses (the source's words per stratum; without
    it a source is one stratum). It is read once per step: hand it over pinned.
    """
    if "masses" not in targets.columns:
        targets = targets.withColumn("masses", F.array(F.col("source_size")))
    sums = targets.select(F.posexplode("masses").alias("k", "w")).groupBy("k").agg(F.sum("w").alias("w")).collect()  # a row per stratum
    words = np.zeros(max((r["k"] for r in sums), default=0) + 1)
    for r in sums:
        words[r["k"]] = r["w"]
    used, total = np.flatnonzero(words), words.sum()
    wanted = share * words[used] / max(total, 1.0)

    def dual(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(1 + len(beta) + len(beta) ** 2, np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    masses, target = _arrays(batch.slice(a, 256), used)
                    own += np.rint(dual_parts(masses / total, target / total, beta, most) * UNIT).astype(np.int64).sum(axis=0)
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["at", "part"])

        found = np.zeros(1 + len(beta) + len(beta) ** 2)
        parts = targets.select("masses", "target").mapInArrow(run, "at int, part bigint")
        for r in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():  # at most 1 + 63 + 63 * 63 rows
            found[r["at"]] = r["part"] / UNIT
        pull = wanted * beta
        gradient = wanted - slack * pull - found[1 : 1 + len(beta)]
        bend = found[1 + len(beta) :].reshape(len(beta), -1) + np.diag(slack * wanted)
        return float(found[0] + pull.sum() - slack / 2 * (pull * beta).sum()), gradient, bend

    beta = np.zeros(len(used))
    if len(used) > 1:
        value, gradient, bend = dual(beta)
        for _ in range(steps):
            if np.abs(gradient).max() <= TOLERANCE:
                break
            step = np.clip(np.linalg.solve(bend, gradient), -4.0, 4.0)
            for _ in range(10):
                further = dual(beta + step)
                if further[0] >= value - 1e-11:
                    break
                step = step / 2
            beta, (value, gradient, bend) = beta + step, further
    beta = np.round(beta, 9)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masses, target = _arrays(batch, used)
            every = np.zeros((batch.num_rows, len(words)))
            if len(used):
                every[:, used] = tilted(masses, target, beta, most)[1] * (masses.sum(axis=1) > 0)[:, None]
            lists = pa.ListArray.from_arrays(np.arange(0, every.size + 1, len(words), dtype=np.int32), pa.array(every.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "rates"])

    kinds = StructType([*targets.schema.fields, StructField("rates", ArrayType(DoubleType()))])
    taken = F.aggregate(F.zip_with("masses", "rates", lambda w, r: w * r), F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.col("source_size") > 0, taken / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.mapInArrow(rates, kinds).withColumn("rate", mean)


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size); `keep`: other columns to carry.

    Each source's taken words differ from its target by at most half of one document.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        *(F.struct(F.col(c)).alias(f"_keep_{i}") for i, c in enumerate(keep)),
    )
    small = pinned(rows.select("doc_id", "source", "size"))
    cells = small.groupBy("source", stratum(F.col("size")).alias("_k")).agg(F.sum("size").alias("_w"), F.count("*").alias("_n_docs"))
    by_stratum = F.map_from_entries(F.collect_list(F.struct("_k", "_w")))  # at most 63 entries a source
    sizes = cells.groupBy("source").agg(F.sum("_w").alias("source_size"), F.sum("_n_docs").alias("n_docs"), by_stratum.alias("_by"))
    every = F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), lambda k: F.coalesce(F.try_element_at("_by", k), F.lit(0).cast("long")))
    targets = pinned(source_targets(pinned(sizes.withColumn("masses", every).drop("_by")), weights, most))
    # whole copies of all documents of a source
    whole = F.aggregate(
        F.zip_with("masses", "rates", lambda w, r: w * F.floor(r + 1e-9)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    rates = pinned(
        balanced(targets, most)
        .withColumn("_extra", F.col("target") - whole)
        .withColumn("_runs", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(RUN_ROWS))))
        .drop("masses", "rate", "n_docs")
    )
    few = (F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates).withColumnRenamed("source", "_source")
    by = rates.columns[1:]

    def in_runs(part: DataFrame) -> DataFrame:
        # runs follow the order of u / rest, with u from the first 8 hex digits of the digest
        digest = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
        head = F.coalesce(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double"), F.lit(0.0)) / F.lit(2.0**32)
        rate = F.get("rates", stratum(F.col("size")))
        return (
            part.join(few, F.col("source").eqNullSafe(F.col("_source")))
            .select(*part.columns, *by, rate.alias("rate"), digest.alias("_digest"))
            .drop("rates")
            .withColumn("_whole", F.floor(F.col("rate") + 1e-9))
            .withColumn("_open", F.when(F.col("_whole") < most, F.col("size")).otherwise(F.lit(0).cast("long")))
            .withColumn("_turn", head / F.greatest(F.col("rate") - F.col("_whole"), F.lit(1e-9)))
            .withColumn("_run", F.floor(F.col("_runs") * F.col("_turn") / (F.col("_turn") + 1)))
        )

    runs = in_runs(small).groupBy("source", "_run").agg(F.sum("_open").alias("_run_size"))
    earlier = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("source").alias("_s"), F.col("_run").alias("_r"), F.coalesce(F.sum("_run_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("source", "_run").orderBy("_turn", "_digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_open").over(inside), F.lit(0))
    one_more = (2 * before + F.col("size") <= 2 * F.col("_extra")) & (F.col("_whole") < most)
    held = in_runs(rows if keep else small)
    placed = held.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")))
    return placed.withColumn("copies", (F.col("_whole") + one_more.cast("long")).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"_keep_{i}.{c}").alias(c) for i, c in enumerate(keep)),
    )
