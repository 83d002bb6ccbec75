"""Which pages an address lets in: listed rules first, then the reputation of its host.

A host's share of bad outcomes is estimated from its own labelled pages and, the fewer there are, from those of its registered domain,
its suffix and all pages: the posterior mean of each level is the prior mean of the next one down, and how much the groups of a level
differ from what is above them says how many labelled pages the prior is worth (beta-binomial, by moments). A host is blocked when the
lower posterior bound of its share is too high.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Rules are part of the plan, so there are so many at most.
MOST_RULES = 1_000
#: Standard deviations between the posterior mean and its bound, and the share of bad pages that the bound may not pass.
Z, MOST_BAD = 1.645, 0.2
#: Share of bad pages that is supposed before any is labelled; it counts as one page.
START = 0.1
#: Likeness of a group's pages: bounds of the estimate, and its value where no group has two labelled pages.
LEAST_LIKE, MOST_LIKE, NO_LIKE = 0.001, 0.5, 0.1
# Labels under which a country registers domains at the third level.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://, or for null."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What stands behind the host up to ? or #; empty without ://, or for null."""
    shown = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(shown, "/")
    return F.when(at > 0, F.substring(shown, at, F.length(shown))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def suffix(name: Column) -> Column:
    """The last label of a host, or the last two where the country registers under a second one."""
    two = F.substring_index(name, ".", -2)
    second = F.substring_index(two, ".", 1)
    return F.when((F.instr(name, ".") > 0) & (F.length(F.substring_index(name, ".", -1)) == 2) & second.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column) -> Column:
    """The suffix and the label before it; a host that is a suffix is its own domain."""
    three, two = F.substring_index(name, ".", -3), F.substring_index(name, ".", -2)
    return F.when(suffix(name) == two, three).otherwise(two)


def _rule(rules: Sequence[tuple[str, str]], name: Column, place: Column, what: int) -> Column:
    """Rule or verdict of the longest rule that fits; of equally long ones the first by code point."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for rule, verdict in sorted(dict(rules).items(), key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, slash, p = rule.partition("/")
        fits = ((name == h) | name.endswith("." + h)) & place.startswith(slash + p)
        out = F.when(fits, (rule, verdict)[what]).otherwise(out)
    return out


def _strength(groups: DataFrame, mean: Column) -> float:
    """Labelled pages that the prior of a level is worth: 1 / likeness - 1, the likeness of pages of one group by moments."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    wide = F.sum((k - n * mean) * (k - n * mean) - n * mean * (1 - mean))
    got = groups.agg(wide.alias("a"), F.sum(n * (n - 1) * mean * (1 - mean)).alias("b")).first()
    like = got.a / got.b if got.b else NO_LIKE
    return 1 / min(max(like, LEAST_LIKE), MOST_LIKE) - 1


def _posterior(groups: DataFrame, strength: float) -> DataFrame:
    """mean of each group from its own n and k and the prior mean up."""
    return groups.withColumn("mean", (F.col("up") * strength + F.col("k")) / (strength + F.col("n")))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Per host its mean and its lower bound, from rows (host, n, k): labelled pages, and how many of them are bad (both may be 0).

    A domain or suffix may hold a third of all hosts: counts are summed before they are shuffled, and the means of a level
    are written before they are joined, so that a common key can be split. A few numbers a level come to the driver.
    """
    hosts = stored(hosts.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    up = ((total.k or 0) + START) / ((total.n or 0) + 1)
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("up", F.lit(up))
    suffixes = stored(_posterior(suffixes, _strength(suffixes, F.col("up"))).select("suffix", F.col("mean").alias("up")), "suffixes")
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")
    domains = stored(_posterior(domains, _strength(domains, F.col("up"))).select("domain", F.col("mean").alias("up")), "domains")
    hosts = hosts.select("host", "n", "k", "domain").join(domains, "domain")
    strength = _strength(hosts, F.col("up"))
    m = F.col("mean")
    return _posterior(hosts, strength).select("host", "n", "k", "mean", (m - z * F.sqrt(m * (1 - m) / (strength + F.col("n") + 1))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), *, key: str = "page_id", url: str = "url", z: float = Z, most_bad: float = MOST_BAD) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block), n_labelled and bad_bound of every page.

    rules are pairs such as ("example.org/es/", "block"): a rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins. outcomes has rows (page_id, bad) with bad true or false, several for a page if need be; null ones
    and those of no page count nowhere. Pages without a rule are blocked if the lower bound of their host's share of bad outcomes
    is above most_bad; a host without outcomes has that of its domain, its suffix or all pages, and without
    any outcomes none is blocked. A null address, or one without
    ://, has an empty host and path; the empty host is a host like others. Repeated pages each get a row and count each; empty
    tables give an empty result. Only the two columns of pages are read. Rows of one host may be a third of all: they are counted
    before they are shuffled, and the join with the verdicts of hosts, a written table, can be split.
    """
    seen = pages.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    seen = seen.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    told = outcomes.select(F.col(key).alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    hosts = seen.select("page_id", "host").join(told, "page_id", "left").groupBy("host").agg(zero("n"), zero("k"))
    known = stored(reputations(hosts, z).select("host", F.col("n").alias("n_labelled"), "bound"), "reputations")
    out = seen.join(known, "host")
    by_host = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    rule, verdict = (_rule(rules, F.col("host"), F.col("path"), i) for i in (0, 1))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "n_labelled", F.round("bound", 6).alias("bad_bound"))
