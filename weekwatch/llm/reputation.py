"""URL filter: fixed rules first, then the reputation of the host by empirical Bayes.

A rule is (host, path prefix, verdict). It fits its host and all subdomains of it where the path starts with the prefix;
of all rules that fit, the longest (host and prefix together) decides.

Where none fits, the host's share of bad pages decides. Labelled pages are Bernoulli outcomes, 1 for a bad page.
Suffixes are shrunk towards the mean of all labelled pages, registered domains towards their suffix, hosts towards their
domain: at each level a child with x bad ones of n has the posterior Beta(x + k m, n - x + k (1 - m)), m the posterior
mean of its parent. The strength k of a level comes from the data: under a beta-binomial E[x (x - 1)] = n (n - 1) (m^2 + m (1 - m) r)
with r = 1 / (k + 1), so r is the sum of x (x - 1) - n (n - 1) m^2 over that of n (n - 1) m (1 - m), held within bounds. A
host is blocked if even the lower bound of its posterior is above `limit`. The bound is Cantelli's, mean - sd sqrt((1 - e) / e): a share below it has
at most the probability e, whatever the form of the posterior. A host without labels has the prior of its domain, a domain
without labels that of its suffix.

Hosts, domains and suffixes are summed before anything is joined. What goes back to the pages goes in two parts: keys that hold
a thousandth of all rows or more, at most a thousand by that, are broadcast; all others are joined by their key.

Defined cases: a null url, or one without ://, has an empty host and path and is judged as the host "". Registered domain: the last
two labels of a host, three where the last two are in `double_suffixes`; a host of one label is its own domain and
suffix; a host that ends in a number (an IP address) is its own domain below the suffix "". Ports and user names stay part of the host. Repeated rows are judged one
by one and each counts as a page; a page with several label rows is bad if any of them is; null page ids have no label. Without labels every host
has the mean 1/2 and a wide posterior, so none is blocked. An empty table gives no row. Only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.session import cut_lineage

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
MOST_RULES = 1000  # the rules become one expression
LIMIT, ERROR = 0.5, 0.1
LEAST_R, MOST_R = 1 / 1001, 1 / 3  # strengths of 1000 to 2 pages
HOT_SHARE = 1000
DOUBLE_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "ne.jp", "org.au", "org.uk")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MOST_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, double_suffixes=DOUBLE_SUFFIXES) -> Column:
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    return F.when(last.rlike(r"^[0-9]+(:[0-9]+)?$"), "").when(two.isin(*double_suffixes) & (two != host), two).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", host).otherwise(F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)))


def outcomes(labels: DataFrame) -> DataFrame:
    """(labelled_id, bad): 1 for documents of low quality or toxic ones, from (doc_id, quality, toxic)."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("labelled_id"), bad.alias("bad")).where("labelled_id is not null and bad is not null").groupBy("labelled_id").agg(F.max("bad").alias("bad"))


def join_back(rows: DataFrame, groups: DataFrame, key: str, rows_of: str) -> DataFrame:
    """Inner join of rows with one row per key; `rows_of` counts a key's rows. No task gets a key with a thousandth of all rows."""
    total = groups.agg(F.sum(rows_of)).first()[0] or 0
    hot = F.col(rows_of) * HOT_SHARE >= total
    # at most HOT_SHARE keys can have that many rows
    often = rows.join(F.broadcast(groups.where(hot).withColumn("__hot", F.lit(True)).drop(rows_of)), key, "left")
    seldom = often.where("__hot is null").select(*rows.columns).join(groups.where(~hot).drop(rows_of), key)
    return often.where("__hot").drop("__hot").unionByName(seldom)


def _shrunk(level: DataFrame, mean: str) -> tuple[DataFrame, float]:
    """Rows with n, x and the parent's mean -> the same with `mean`, and the strength of the level."""
    pairs = (F.col("n") * (F.col("n") - 1)).cast("double")
    m = F.col("parent")
    row = level.agg(
        F.sum((F.col("x") * (F.col("x") - 1)).cast("double") - pairs * m * m).alias("more"), F.sum(pairs * m * (1 - m)).alias("most")
    ).first()
    r = row["more"] / row["most"] if row["most"] else LEAST_R
    k = 1 / min(max(r, LEAST_R), MOST_R) - 1
    return level.withColumn(mean, (F.col("x") + k * m) / (F.col("n") + k)), k


def reputations(pages: DataFrame, labelled: DataFrame, limit: float = LIMIT, error: float = ERROR, double_suffixes=DOUBLE_SUFFIXES) -> DataFrame:
    """(host, n_pages, n_labelled, n_bad, posterior_mean, posterior_bound, blocked): one row per host of (page_id, host)."""
    known = pages.where("page_id is not null").join(labelled, F.col("page_id") == F.col("labelled_id")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("x"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages")).join(known, "host", "left").na.fill(0, ["n", "x"])
    suffix = suffix_of(F.col("host"), double_suffixes)
    hosts = cut_lineage(sizes.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("children"))

    domains = cut_lineage(sums(hosts, "domain", "suffix").withColumnRenamed("children", "hosts"))
    suffixes = cut_lineage(sums(domains, "suffix"))
    all_of = suffixes.agg(F.sum("n"), F.sum("x")).first()
    mean = ((all_of[1] or 0) + 0.5) / ((all_of[0] or 0) + 1)
    suffixes, _ = _shrunk(suffixes.withColumn("parent", F.lit(mean)), "m")
    parents = suffixes.select("suffix", F.col("m").alias("parent"), "children")
    domains, _ = _shrunk(cut_lineage(join_back(domains, parents, "suffix", "children")), "m")
    parents = domains.select("domain", F.col("m").alias("parent"), "hosts")
    hosts = cut_lineage(join_back(hosts, parents, "domain", "hosts"))
    hosts, k = _shrunk(hosts, "posterior_mean")
    mu = F.col("posterior_mean")
    spread = F.sqrt(mu * (1 - mu) / (F.col("n") + k + 1) * ((1 - error) / error))
    return hosts.select(
        "host", "n_pages", F.col("n").alias("n_labelled"), F.col("x").alias("n_bad"), "posterior_mean",
        (mu - spread).alias("posterior_bound"), (mu - spread > limit).alias("blocked"),
    )


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, limit: float = LIMIT, error: float = ERROR, double_suffixes=DOUBLE_SUFFIXES) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict and the host's reputation; `labelled` has (labelled_id, bad)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    hosts = cut_lineage(reputations(rows, labelled, limit, error, double_suffixes))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = join_back(rows.withColumn("ruled", ruled), hosts.withColumn("rows", F.col("n_pages")), "host", "rows")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad",
    )


def _sql() -> str:
    lower = f"translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}')"
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

    def cases(what) -> str:
        return " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{what(h, p, v)}'" for h, p, v in by_length)

    doubles = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)
    strength = "1 / least(greatest(coalesce(sum(x * (x - 1) - n * (n - 1) * parent * parent) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0), {0}), {0}), {1}) - 1".format("1 / 1001.0", "1 / 3.0")
    return rf"""
with p as (select page_id, {lower} as host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') as path from pages),
ruled as (select *, case {cases(lambda h, p, v: h + p)} end as rule, case {cases(lambda h, p, v: v)} end as fixed from p),
lab as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
        where quality is not null or toxic is not null group by doc_id),
parts as (select host, count(bad) as n, coalesce(sum(bad), 0) as x, string_split(host, '.') as w from p left join lab on doc_id = page_id group by host),
hosts0 as (select host, n, x, w, case when regexp_matches(w[-1], '^[0-9]+(:[0-9]+)?$') then ''
             when len(w) > 2 and w[-2] || '.' || w[-1] in ({doubles}) then w[-2] || '.' || w[-1] else w[-1] end as suffix from parts),
hosts as (select host, n, x, suffix, case when suffix = '' then host when suffix like '%.%' then array_to_string(w[-3:], '.')
             else array_to_string(w[-2:], '.') end as domain from hosts0),
s0 as (select suffix, sum(n) as n, sum(x) as x, (select (sum(x) + 0.5) / (sum(n) + 1) from hosts) as parent from hosts group by suffix),
s as (select suffix, (x + k * parent) / (n + k) as m from s0, (select {strength} as k from s0)),
d0 as (select domain, h.suffix, sum(n) as n, sum(x) as x, any_value(m) as parent from hosts h join s on s.suffix = h.suffix group by domain, h.suffix),
d as (select domain, (x + k * parent) / (n + k) as m from d0, (select {strength} as k from d0)),
h0 as (select host, n, x, m as parent from hosts join d using (domain)),
h1 as (select host, n, x, k, (x + k * parent) / (n + k) as m from h0, (select {strength} as k from h0)),
h as (select host, n, x, m - sqrt(m * (1 - m) / (n + k + 1) * {(1 - ERROR) / ERROR!r}) > {LIMIT} as blocked from h1)
select page_id, host, path, rule, coalesce(fixed, case when blocked then 'block' else 'allow' end) as verdict, n as n_labelled, cast(x as bigint) as n_bad
from ruled join h using (host)"""


@query("op12_url_reputation", _sql())
def op12(spark, sf_dir):
    """The url of every page; a page's label is that of the document of its number."""
    return judge(table(spark, sf_dir, "pages"), outcomes(table(spark, sf_dir, "labels")))
