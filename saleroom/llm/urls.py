"""URL filters: written rules first, and for the rest the reputation of the host by empirical Bayes.

A rule names a host and a path prefix. It fits that host and its subdomains where the path
starts with the prefix; of several rules the longest (host and path together) wins, ties by
text. A short list of rules becomes one expression; a table of rules of any size is joined.

Reputation: labelled pages are counted per host (bad of all). A host's share of bad pages has
a beta prior around the share of its registered domain, a domain's one around its suffix, a
suffix's one around all pages. The strength of each level's prior is fitted to the counts: with
the parent's share m, a child with n pages has E (k - nm)^2 = m(1-m) (n + n(n-1) rho), which
gives rho from two sums over all children, and 1/rho - 1 pages of strength. So a host with few
labels is judged by its domain, one with many by itself, and levels whose children are alike
shrink more. A page is blocked where the lower bound of its host's share, on the log-odds of
the posterior, lies above the limit.

Host and path come from the whole url: the host follows the first `://`, up to `/`, `?`, `#` or
the end, A-Z lower-cased; the path then goes up to `?`, `#` or the end. A null url, or one
without `://`, has an empty host and path; such pages share one reputation. Only the
reputation strips user names and ports. A label counts once per page id and host, and is bad if
any of the id's labels is; pages with a null id and null labels are never labelled. Repeated
pages are repeated in the result. With no labels at all a host's share is 1/2 with the
strength of two pages. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned

# A list of rules above this length is refused: give a table.
MOST_LISTED = 200
# A host goes when its share of bad pages is above LIMIT with a one-sided certainty of Z deviations.
LIMIT = 0.3
Z = 1.645
# Strength of a prior, in pages: never weaker than one page, never stronger than a thousand.
WEAKEST, STRONGEST = 1.0, 1000.0
# Names that registries use in second place, below a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "nom", "or", "org")

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user name, port and the root's dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", ""), r"\.$", "")


def suffix_of(bare: Column) -> Column:
    """The part under which names are registered: the last label, or two below a country's own second level."""
    labels = F.split(bare, r"\.")
    country = F.length(F.element_at(labels, -1)) == 2
    second = F.when(F.size(labels) > 2, F.element_at(labels, -2)).isin(*SECOND_LEVEL)
    address = bare.rlike(r"^[0-9.]+$|^\[")  # an address is its own suffix
    last = F.when(country & F.coalesce(second, F.lit(False)), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).otherwise(last)


def domain_of(bare: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    n = F.size(F.split(suffix, r"\."))
    return F.when(bare == suffix, bare).when(n == 2, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def listed_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null: one expression, longest first."""
    if len(rules) > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} rules: give them as a table")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        this = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits(host, path, r), this).otherwise(found)
    return found


def tabled_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) of the different (host, path) that some rule of the table (verdict, host, path) fits.

    A place is joined by each of its host's names, and by those prefixes of its path whose
    length some rule of that name has: both joins are on equal keys, and their rows grow with
    labels and lengths, not with the number of rules of a name.
    """
    rules = rules.select("verdict", F.col("host").alias("_name"), F.coalesce("path", F.lit("")).alias("_prefix"))
    lengths = rules.groupBy("_name").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = places.select("host", "path").distinct().select("host", "path", F.explode(tails).alias("_name"))
    tried = named.join(lengths, "_name").select("host", "path", "_name", F.explode("_lengths").alias("_n"))
    tried = tried.where(F.length("path") >= F.col("_n")).withColumn("_prefix", F.substring("path", F.lit(1), F.col("_n")))
    rule = F.concat("_name", "_prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    return tried.join(rules, ["_name", "_prefix"]).groupBy("host", "path").agg(best.alias("_best")).select(
        "host", "path", F.struct("_best.rule", "_best.verdict").alias("found")
    )


def _shrunk(children: DataFrame, parent: str) -> DataFrame:
    """Adds strength to counts (…, n, k, m): m is the parent's share. All children of a level share one strength."""
    spread = F.col("m") * (1 - F.col("m"))
    miss = F.col("k") - F.col("n") * F.col("m")
    sums = children.agg(
        F.sum(miss * miss).alias("seen"), F.sum(F.col("n") * spread).alias("alone"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("paired"),
    )
    rho = F.when(F.col("paired") > 0, (F.col("seen") - F.col("alone")) / F.col("paired"))
    rho = F.greatest(F.lit(1 / (1 + STRONGEST)), F.least(F.lit(1 / (1 + WEAKEST)), F.coalesce(rho, F.lit(1 / (1 + WEAKEST)))))
    # one row, met by every child: as a scalar subquery it is computed once and needs no join
    return children.withColumn("strength", 1 / sums.select(rho).scalar() - 1)


def _share() -> Column:
    return (F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host counts (host, n labelled, k bad) -> host, n_labelled, n_bad, share, bound.

    Each level is summed from the one below before it is joined, so a domain with a third of
    all hosts, or a host with a third of all pages, costs one row per task.
    """
    hosts = outcomes.select("host", "n", "k", bare_host(F.col("host")).alias("_bare"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("_bare"))).withColumn("domain", domain_of(F.col("_bare"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    all_pages = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    suffixes = _shrunk(suffixes.withColumn("m", all_pages.scalar()), "m").select("suffix", _share().alias("m"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix").select("domain", _share().alias("m"))
    judged = _shrunk(hosts.join(domains, "domain"), "domain")
    good = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("m"))
    bad = F.col("k") + F.col("strength") * F.col("m")
    # log-odds of a beta variable: about log(a/b), with a variance of about 1/a + 1/b
    odds = F.log(bad / good) - F.lit(Z) * F.sqrt(1 / bad + 1 / good)
    return judged.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), _share().alias("share"), (1 / (1 + F.exp(-odds))).alias("bound"))


def outcomes_of(places: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k) of every host of places (page_id, host), from labels (page_id, bad), bad boolean."""
    known = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("_bad"))
    # hosts are summed before they meet: labelled pages are a small table beside all pages
    told = places.select("page_id", "host").where(F.col("page_id").isNotNull()).join(known, "page_id").distinct()
    counted = told.groupBy("host").agg(F.count("*").alias("n"), F.sum("_bad").alias("k"))
    everywhere = places.select("host").distinct()
    return everywhere.join(counted, "host", "left").na.fill(0, ["n", "k"])


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    limit: float = LIMIT,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), n_labelled, n_bad, share and bound of every page.

    labels: page_id, bad (boolean). rules: a short list, or a table (verdict, host, path).
    The join of pages with hosts is on equal hosts; a hot host is split by adaptive execution.
    """
    places = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        by_rule = tabled_rules(places, rules)
        ruled = places.join(by_rule, ["host", "path"], "left")
    else:
        ruled = places.withColumn("found", listed_rule(F.col("host"), F.col("path"), rules))
    # a row per host, read once by each level: pinned, so that pages are read no further time
    known = reputation(pinned(outcomes_of(places, labels)))
    by_host = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(known, "host").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_host).alias("verdict"), "n_labelled", "n_bad", "share", "bound",
    )


def allowed(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", **how: object) -> DataFrame:
    """The rows of pages, all columns, whose url is not blocked."""
    verdicts = judged(pages, labels, rules, url=url, **how)
    gone = verdicts.where(F.col("verdict") == "block").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    same = (host_of(pages[url]) == gone["_host"]) & (path_of(pages[url]) == gone["_path"])
    return pages.join(gone, same, "left_anti")
