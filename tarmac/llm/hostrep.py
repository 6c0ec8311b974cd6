"""URL filter: rules first, else an empirical-Bayes host reputation.

Labelled pages have an outcome (bad: low quality or toxic). A host's bad rate
is a beta posterior whose prior has its registered domain's posterior mean,
the domain's that of its suffix, the suffix's that of all pages. The strength
of the prior at each level comes from the data: with mu the parent's mean, the
excess of sum n (y/n - mu)^2 over what binomial noise explains gives the
correlation rho inside a group (method of moments), and 1/rho - 1 is the
prior's weight in pages. A page is blocked when the lower posterior bound of
its host's bad rate is above ``LIMIT``: few or no labels never block by
themselves.

Registered domain: the last two labels of the host without port; suffix: the
last. One row per host is joined back to the pages; a hot host has one row
there, and AQE splits the page side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut

# (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
LIMIT = 0.5                      # bad rate that the lower bound must exceed
Z = 1.645                        # one-sided 95 %
RHO = (0.001, 0.5)               # prior strength between 999 pages and 1 page
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, n, y, mean, low`` from one row per page ``host, bad`` (1, 0, or
    null without a label). Hosts without labels have their prior."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("y"))
                .withColumn("domain", F.substring_index(name, ".", -2)).withColumn("suffix", F.substring_index(name, ".", -1)))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    parent = hosts.withColumn("mu", F.lit(((whole["y"] or 0) + 1.0) / ((whole["n"] or 0) + 2.0)))
    for level, below in zip(_LEVELS, (*_LEVELS[1:], None)):
        groups = parent.groupBy(level, "mu").agg(F.sum("n").alias("gn"), F.sum("y").alias("gy"))
        noise, n, y = F.col("mu") * (1 - F.col("mu")), F.col("gn"), F.col("gy")
        s = groups.where("gn > 0").agg(F.sum(n * F.pow(y / n - F.col("mu"), 2)).alias("spread"), F.sum(noise).alias("noise"),
                                       F.sum(noise * (n - 1)).alias("room")).first()
        rho = min(max((s["spread"] - s["noise"]) / s["room"], RHO[0]), RHO[1]) if s["room"] else RHO[0]
        weight = 1.0 / rho - 1.0
        alpha, beta = F.col("mu") * weight + y, (1 - F.col("mu")) * weight + n - y
        if below:
            means = groups.select(F.col(level).alias("of"), (alpha / (alpha + beta)).alias("mean"))
            parent = parent.join(means, F.col(level) == F.col("of")).drop("of", "mu").withColumnRenamed("mean", "mu")
    mean, total = alpha / (alpha + beta), alpha + beta
    return groups.select("host", F.col("gn").alias("n"), F.col("gy").alias("y"), mean.alias("mean"),
                         (mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", label_col: str = "doc_id",
          rules=RULES, limit: float = LIMIT) -> DataFrame:
    """One row per page: ``page_col, host, path, rule, verdict, n_labelled``
    (labelled pages of the host).

    A null url, or one without ``://``, has an empty host and path; the empty
    host is a host like others. An id labelled more than once is bad if any
    of its labels is; labels with a null in them don't count. Repeated pages
    count as often as they occur. No labels: nothing is blocked without a
    rule, as the posterior is the uniform prior's.
    """
    seen = pages.select(F.col(page_col).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcome = (labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
               .groupBy(F.col(label_col).alias("labelled")).agg(F.max(bad).alias("bad")))
    known = reputation(seen.join(outcome, F.col("page") == F.col("labelled"), "left").select("host", "bad"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return (seen.join(known, "host").withColumn("rule", rule)
            .select(F.col("page").alias(page_col), "host", "path", "rule",
                    F.coalesce(verdict, F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"),
                    F.col("n").alias("n_labelled")))


def _oracle() -> str:
    def level(name: str, column: str, up: str) -> str:
        return f"""
{name} AS (SELECT h.{column}, any_value({up}.mean) AS mu, sum(h.n) AS n, sum(h.y) AS y
  FROM h JOIN {up} ON {"true" if up == "w" else f"h.{up[:-1]} = {up}.{up[:-1]}"} GROUP BY h.{column}),
{name}w AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(y / n - mu, 2)) - sum(mu * (1 - mu))) / nullif(sum(mu * (1 - mu) * (n - 1)), 0),
  {RHO[0]}), {RHO[0]}), {RHO[1]}) - 1 AS weight FROM {name} WHERE n > 0),
{column}s AS (SELECT {column}, n, mu * coalesce(weight, {1 / RHO[0] - 1}) + y AS a, (1 - mu) * coalesce(weight, {1 / RHO[0] - 1}) + n - y AS b, a / (a + b) AS mean
  FROM {name} JOIN {name}w ON true)"""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in ordered]
    rule = " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, ordered))
    verdict = " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, ordered))
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS y,
      regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*(\.[^.]*)?$') AS domain,
      regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*$') AS suffix
      FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host),
w AS (SELECT (sum(y) + 1.0) / (sum(n) + 2.0) AS mean FROM h),
{level("ls", "suffix", "w")},
{level("ld", "domain", "suffixs")},
{level("lh", "host", "domains")}
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict}
            WHEN mean - {Z} * sqrt(mean * (1 - mean) / (a + b + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS BIGINT) AS n_labelled
FROM p JOIN hosts USING (host)
"""


ORACLE = _oracle()
