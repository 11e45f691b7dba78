"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Rules come first: a rule fits its host and all subdomains where the url's path
starts with the rule's, and the longest rule wins.

Other pages get the verdict of their host. Labelled pages (bad or not) are
counted by host, registered domain and suffix, once. From the top down each
level's rate is a beta-binomial posterior whose prior has the mean of the level
above and a strength fitted by moments over all groups of that level. A host is
blocked if its share of bad pages is above `limit` with a posterior probability
of more than 1 - `doubt`, which is to say if the posterior's `doubt` quantile is
above `limit`; a host without labels gets its domain's posterior, and so on up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import written

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Second-level public suffixes, the default of a parameter: with these the registered domain has three labels.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    rest = F.expr("substring(u_, locate('://', u_) + 3)")
    return F.when(F.col("u_").contains("://"), F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), LETTERS, LETTERS.lower())).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    rest = F.expr("substring(u_, locate('://', u_) + 3)")
    return F.when(F.col("u_").contains("://"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest fitting rule, else nulls. Length counts host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user and port. An address of numbers is its own domain, without a suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*):[0-9]*$", "$1")
    address = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    two = F.substring_index(bare, ".", -2)
    second = two.isin(*second_level) if second_level else F.lit(False)
    suffix = F.when(second, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(second, F.substring_index(bare, ".", -3)).otherwise(two)
    return F.when(address, bare).otherwise(domain), F.when(address, "").otherwise(suffix)


# --- beta posteriors -----------------------------------------------------------------------------------------


def log_gamma(z: Column) -> Column:
    """Of positive numbers: Stirling's series eight places up, less the logarithms of the factors passed over."""
    w = z + 8
    passed = z
    for i in range(1, 8):
        passed = passed * (z + i)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - F.log(passed)


def beta_cdf(x: float, a: Column, b: Column) -> Column:
    """P(B <= x) of a beta distribution, 0 < x < 1, from the series of the incomplete beta function on that side of
    the mean where its terms fall. The terms that count grow with the root of a + b, so a group of 1e10 labels takes
    a million of them; there are few such groups."""

    def low(x: float, a: Column, b: Column) -> Column:
        step = lambda s, k: F.struct((s["t"] * x * (a + b + k) / (a + 1 + k)).alias("t"), (s["sum"] + s["t"]).alias("sum"))
        terms = F.sequence(F.lit(0), (F.ceil(12 * F.sqrt((a + b) / (1 - x))) + 80).cast("int"))
        total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
        return F.exp(a * math.log(x) + b * math.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a * total

    return F.when(a / (a + b) >= x, low(x, a, b)).otherwise(1 - low(1 - x, b, a))


def _strength(groups: DataFrame) -> float:
    """Strength of a level's prior, by moments over (n, bad, mean): how much less the groups' rates vary
    around their priors than separate rates would. One row comes to the driver."""
    p, m, n = F.col("bad") / F.col("n"), F.col("mean"), F.col("n")
    r = groups.agg(
        F.sum(n * (p - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("noise"),
        F.sum(n * m * (1 - m)).alias("weight"),
    ).first()
    if not r["weight"]:
        return 100.0
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho), strength = 1 / rho - 1
    rho = (r["spread"] - r["noise"]) / max(r["weight"] - r["noise"], 1e-9)
    rho = min(max(rho, 1e-3), 0.5)
    return 1 / rho - 1


def reputation(hosts: DataFrame, doubt: float = 0.05, limit: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From counts (host, domain, suffix, n labelled, bad): tables of host, domain and suffix with n, bad, rate (the
    posterior mean) and block. Groups without labels have no rows."""
    hosts = hosts.where("n > 0")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domain-counts")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffix-counts")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    def shrunk(groups: DataFrame, name: str) -> DataFrame:
        s = _strength(groups)
        rows = groups.withColumns({"a": F.col("mean") * s + F.col("bad"), "b": (1 - F.col("mean")) * s + F.col("n") - F.col("bad")})
        return written(rows.withColumns({"rate": F.col("a") / (F.col("a") + F.col("b")), "block": beta_cdf(limit, F.col("a"), F.col("b")) < doubt}), name)

    suffixes = shrunk(suffixes.withColumn("mean", F.lit(overall)), "suffixes")
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("mean")), "suffix"), "domains")
    hosts = shrunk(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("mean")), ["domain", "suffix"]), "hosts")
    return tuple(t.select(k, "n", "bad", "rate", "block") for t, k in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix")))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, doubt: float = 0.05, limit: float = 0.5, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none), verdict (block or allow).

    outcomes: (page_id, bad boolean), at most one row per page_id counts (bad if
    any is; null is no outcome). A null url, and one without ://, has an empty
    host: the group of such pages is judged like any host. Repeated page_ids stay
    separate rows, each with the outcome; null ones have none. No outcomes at
    all block nothing beyond the rules. Other columns are not read.
    """
    df = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("u_"))
    df = df.select("page_id", host_of(F.col("u_")).alias("host"), path_of(F.col("u_")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad = outcomes.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    # Every host of the table once, with its labels: all that follows is made of this.
    counted = df.select("page_id", "host").join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    domain, suffix = levels(F.col("host"), second_level)
    known = written(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "host-counts")
    hosts, domains, suffixes = reputation(known, doubt, limit)
    judged = (
        known.join(hosts.select("host", F.col("block").alias("h")), "host", "left")
        .join(domains.select("domain", F.col("block").alias("d")), "domain", "left")
        .join(suffixes.select("suffix", F.col("block").alias("s")), "suffix", "left")
        .select("host", F.coalesce("h", "d", "s", F.lit(False)).alias("block"))
    )
    # Where a host holds a third of the pages, this join is broadcast or split by Spark.
    out = df.select("*", rule.alias("rule"), verdict.alias("verdict_")).join(written(judged, "host-verdicts"), "host", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict_", F.when(F.col("block"), "block").otherwise("allow")).alias("verdict"),
    )


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """The outcomes are `labels`, whose ids are taken as page ids: a page is bad if its quality is 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")))


def _rules_sql() -> str:
    return ", ".join(f"('{what}', '{h}', '{p}')" for what, h, p in RULES)


# The posterior probability by midpoints of the density.
OP8_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{LETTERS}', '{LETTERS.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(what, h, p) AS (VALUES {_rules_sql()}),
fit AS (SELECT DISTINCT p.host, p.path, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.what, length(rules.h || rules.p)) AS verdict
        FROM (SELECT DISTINCT host, path FROM p) p JOIN rules ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p) GROUP BY p.host, p.path),
o AS (SELECT doc_id AS page_id, max((quality = 0)::INTEGER) AS bad FROM labels GROUP BY doc_id),
b AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '^(\[[^\]]*\]|[^:]*):[0-9]*$', '') AS bare FROM p),
l AS (SELECT host, bare, regexp_matches(bare, '^[0-9.]+$') OR starts_with(bare, '[') AS address,
        regexp_extract(bare, '(?:[^.]*\.)?[^.]*$') AS two, regexp_extract(bare, '(?:[^.]*\.){{0,2}}[^.]*$') AS three, regexp_extract(bare, '[^.]*$') AS one FROM b),
d AS (SELECT host, CASE WHEN address THEN bare WHEN two IN {SECOND_LEVEL} THEN three ELSE two END AS domain, CASE WHEN address THEN '' WHEN two IN {SECOND_LEVEL} THEN two ELSE one END AS suffix FROM l),
hosts AS (SELECT d.host, d.domain, d.suffix, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p JOIN d ON d.host = p.host LEFT JOIN o ON o.page_id = p.page_id GROUP BY ALL),
h0 AS (SELECT * FROM hosts WHERE n > 0),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
s1 AS (SELECT s0.*, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM s0) AS mean FROM s0),
s2 AS (SELECT *, mean * k + bad AS a, (1 - mean) * k + n - bad AS b FROM s1, (SELECT 1 / least(greatest((sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) / greatest(sum(n * mean * (1 - mean)) - sum(mean * (1 - mean)), 1e-9), 1e-3), 0.5) - 1 AS k FROM s1)),
d1 AS (SELECT d0.*, s2.a / (s2.a + s2.b) AS mean FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT *, mean * k + bad AS a, (1 - mean) * k + n - bad AS b FROM d1, (SELECT 1 / least(greatest((sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) / greatest(sum(n * mean * (1 - mean)) - sum(mean * (1 - mean)), 1e-9), 1e-3), 0.5) - 1 AS k FROM d1)),
h1 AS (SELECT h0.*, d2.a / (d2.a + d2.b) AS mean FROM h0 JOIN d2 USING (domain, suffix)),
h2 AS (SELECT *, mean * k + bad AS a, (1 - mean) * k + n - bad AS b FROM h1, (SELECT 1 / least(greatest((sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean))) / greatest(sum(n * mean * (1 - mean)) - sum(mean * (1 - mean)), 1e-9), 1e-3), 0.5) - 1 AS k FROM h1)),
posts AS (SELECT 'h' AS level, host AS name, a, b FROM h2 UNION ALL SELECT 'd', domain, a, b FROM d2 UNION ALL SELECT 's', suffix, a, b FROM s2),
points AS (SELECT (unnest(range(0, 4000)) + 0.5) / 8000 AS t),
blocks AS (SELECT level, name, sum(exp((a - 1) * ln(t) + (b - 1) * ln(1 - t) + lgamma(a + b) - lgamma(a) - lgamma(b))) / 8000 < 0.05 AS block FROM posts, points GROUP BY level, name),
v AS (SELECT hosts.host, coalesce(bh.block, bd.block, bs.block, false) AS block FROM hosts LEFT JOIN blocks bh ON bh.level = 'h' AND bh.name = hosts.host
      LEFT JOIN blocks bd ON bd.level = 'd' AND bd.name = hosts.domain LEFT JOIN blocks bs ON bs.level = 's' AND bs.name = hosts.suffix)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN v.block THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path LEFT JOIN v ON v.host = p.host
"""
