"""URL filters: explicit rules first, then empirical-Bayes host reputation.

A host's labelled page outcomes are shrunk through beta-binomial priors: from
the whole table to the public suffix, from there to the registered domain, and
from there to the host. How strongly each level is drawn to the one above is
estimated from the labelled counts by moments. All steps are DataFrame
operations; one row of sums per level goes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Public suffixes of two labels under which anyone registers names; a parameter, as the public list is longer and grows.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.id", "co.il", "co.in", "ac.jp", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.sg", "com.tr",
    "com.tw", "com.ua", "co.za",
)
ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


class Prior(NamedTuple):
    """Pseudo-counts of the whole table: bad and good pages."""

    bad: float = 1.0
    good: float = 9.0


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; '' where there is no ://."""
    return F.translate(_after(url, "^([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return _after(url, "^[^/?#]*([^?#]*)")


def _after(url: Column, pattern: str) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, pattern, 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's;
    of equally long rules the first listed wins. The list is a parameter: it is
    planned as one expression, which suits up to a few thousand rules.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # later ones are asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """Pseudo-count of the prior over ``groups`` (n, bad, up_n, up_bad): by
    moments, from how far the groups' rates lie from those of the level above,
    beyond what binomial chance explains."""
    n, p, part = F.col("n"), F.try_divide("up_bad", "up_n"), F.try_divide("n", "up_n")
    got = (
        groups.where("n > 0 and up_bad > 0 and up_bad < up_n")
        .agg(
            F.sum(n * F.pow(F.try_divide("bad", "n") - p, 2)).alias("spread"),
            F.sum(p * (1 - p) * (1 - part)).alias("chance"),
            F.sum(p * (1 - p) * n * (1 - part)).alias("scale"),
        )
        .first()
    )
    if not got or got.spread is None or got.scale - got.chance <= 0:
        return most
    rho = (got.spread - got.chance) / (got.scale - got.chance)
    return most if rho <= 0 else min(most, max(least, 1 / rho - 1))


def registered(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, which may have a user
    before it and a port after it. The suffix is the last label, or the last
    two if these are in ``suffixes``; the domain has one label more. An
    address of four numbers is a domain under the suffix ''."""
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(site, "\\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two, address = last(2).isin(*suffixes), site.rlike(ADDRESS)
    return F.when(address, "").when(two, last(2)).otherwise(last(1)), F.when(address, site).when(two, last(3)).otherwise(last(2))


def host_reputation(
    outcomes: DataFrame, prior: Prior = Prior(), z: float = 1.645, least: float = 1.0, most: float = 1000.0, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """A row per host of ``outcomes`` (host, n labelled pages, bad ones).

    Returns host, n, bad, posterior ``mean`` and its bounds ``low`` and
    ``high``: mean minus and plus z standard deviations of the beta posterior,
    cut to 0..1 (the normal bounds of a beta posterior). A host without labels has its domain's posterior mean; a
    domain or suffix without labels that of the level above.
    """
    suffix, domain = registered(F.col("host"), suffixes)
    # A row per host, read by the sums of each level: written once.
    hosts = written(outcomes.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    base = (whole.bad + prior.bad) / (whole.n + prior.bad + prior.good)

    up_suffix = suffixes.withColumns({"up_n": F.lit(float(whole.n)), "up_bad": F.lit(float(whole.bad))})
    k_suffix = _strength(up_suffix, least, most)
    above = suffixes.select("suffix", F.col("n").alias("up_n"), F.col("bad").alias("up_bad"))
    up_domain = domains.join(above, "suffix")
    k_domain = _strength(up_domain, least, most)
    above = domains.select("domain", F.col("n").alias("up_n"), F.col("bad").alias("up_bad"))
    k_host = _strength(hosts.join(above, "domain"), least, most)

    at_suffix = suffixes.select("suffix", ((F.col("bad") + k_suffix * base) / (F.col("n") + k_suffix)).alias("up"))
    at_domain = domains.join(at_suffix, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("up")) / (F.col("n") + k_domain)).alias("up"))
    a, b = F.col("bad") + k_host * F.col("up"), F.col("n") - F.col("bad") + k_host * (1 - F.col("up"))
    posterior = hosts.join(at_domain, "domain").withColumns({"a": a, "b": b})
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return posterior.select(
        "host", "n", "bad", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("low"), F.least(F.lit(1.0), mean + z * sd).alias("high")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    bad: Column | None = None,
    bad_rate: float = 0.25,
    prior: Prior = Prior(),
    z: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule, verdict and the
    host's posterior mean and lower bound.

    ``bad`` is a condition over ``labels`` (quality = 0 by default) that says
    whether the page with that id turned out bad; null outcomes do not count.
    The verdict is the rule's if one fits, else block if the lower posterior
    bound of the host's bad rate is above ``bad_rate``, else allow.

    A null url, or one without ://, has host and path '' and shares the
    reputation of that empty host; repeated pages and labels count as often as
    they occur; empty tables give no rows, or priors alone. Other columns of
    either table are not read.
    """
    outcome = (F.col("quality") == 0) if bad is None else bad
    marks = labels.select(F.col(label_id).alias("_id"), outcome.cast("int").alias("_bad")).where("_bad is not null")
    marks = marks.groupBy("_id").agg(F.count("*").alias("_n"), F.sum("_bad").alias("_bad"))
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    outcomes = (
        own.join(marks, F.col("page_id") == F.col("_id"), "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).cast("double").alias("bad"))
    )
    seen = host_reputation(outcomes, prior, z, suffixes=suffixes).select("host", "mean", "low")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > bad_rate, "block").otherwise("allow")
    # A host may hold a third of all pages: a join that adaptive execution can split, or broadcast once it has seen the size.
    return own.join(seen, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("mean", 6).alias("bad_mean"), F.round("low", 6).alias("bad_low")
    )


def oracle_sql(rules: Sequence[Rule], bad_rate: float = 0.25, prior: Prior = Prior(), z: float = 1.645, least: float = 1.0, most: float = 1000.0, suffixes: Sequence[str] = SUFFIXES) -> str:
    """``judge_urls`` with its defaults in DuckDB SQL."""

    def strength(name: str, groups: str) -> str:
        return f"""
{name} AS (
  SELECT CASE WHEN spread IS NULL OR scale - chance <= 0 OR spread <= chance THEN {most}
              ELSE least({most}, greatest({least}, (scale - chance) / (spread - chance) - 1)) END AS k
  FROM (SELECT sum(n * pow(bad / n - p, 2)) AS spread, sum(p * (1 - p) * (1 - n / up_n)) AS chance, sum(p * (1 - p) * n * (1 - n / up_n)) AS scale
        FROM (SELECT *, up_bad / up_n AS p FROM ({groups})) WHERE n > 0 AND up_bad > 0 AND up_bad < up_n)
)"""

    ordered = sorted(rules, key=lambda r: -len(r.name))
    two = ", ".join(f"'{x}'" for x in suffixes)
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in ordered]
    case = lambda attr: "CASE " + " ".join(f"WHEN {f} THEN '{getattr(r, attr)}'" for f, r in zip(fits, ordered)) + " END" if rules else "NULL"
    return f"""
WITH own AS (
  SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(instr(url, '://'), 0) AS pos, substr(url, instr(url, '://') + 3) AS rest FROM pages)
), marks AS (
  SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(quality = 0 AS INT)) AS DOUBLE) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), sites AS (
  SELECT host, coalesce(sum(n), 0.0::DOUBLE) AS n, coalesce(sum(bad), 0.0::DOUBLE) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site, string_split(site, '.') AS parts,
         regexp_matches(site, '{ADDRESS}') AS address, array_to_string(parts[-2:], '.') IN ({two}) AS two
  FROM own LEFT JOIN marks ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
         CASE WHEN address THEN site WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM sites
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
whole AS (SELECT sum(n) AS n, sum(bad) AS bad FROM suffixes),
{strength("k_suffix", "SELECT s.n, s.bad, w.n AS up_n, w.bad AS up_bad FROM suffixes s, whole w")},
{strength("k_domain", "SELECT d.n, d.bad, s.n AS up_n, s.bad AS up_bad FROM domains d JOIN suffixes s USING (suffix)")},
{strength("k_host", "SELECT h.n, h.bad, d.n AS up_n, d.bad AS up_bad FROM hosts h JOIN domains d USING (domain)")},
at_suffix AS (
  SELECT suffix, (s.bad + k * (w.bad + {prior.bad}) / (w.n + {prior.bad + prior.good})) / (s.n + k) AS up FROM suffixes s, k_suffix, whole w
), at_domain AS (SELECT domain, (d.bad + k * up) / (d.n + k) AS up FROM domains d JOIN at_suffix USING (suffix), k_domain),
posterior AS (SELECT host, h.bad + k * up AS a, h.n - h.bad + k * (1 - up) AS b FROM hosts h JOIN at_domain USING (domain), k_host),
seen AS (SELECT host, a / (a + b) AS mean, greatest(0.0, a / (a + b) - {z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) AS low FROM posterior)
SELECT page_id, host, path, {case("name")} AS rule,
       coalesce({case("verdict")}, CASE WHEN low > {bad_rate} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_mean, round(low, 6) AS bad_low
FROM own LEFT JOIN seen USING (host)
"""
