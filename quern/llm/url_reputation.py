"""URL filters: fixed rules, and an empirical-Bayes reputation of hosts.

A page whose label says low quality or toxic is a bad outcome of its host. A
host's bad outcomes are beta-binomial. Its prior is centred on its registered
domain's shrunk rate, which is shrunk towards its suffix's, and that towards the
rate of all. How strongly each level shrinks is estimated from the data: the
variance between a level's groups, beyond what binomial chance explains, gives
the correlation within groups, 1 / (strength + 1). A host's rate then has a beta
posterior, and the bound is its quantile at 1 - `confidence`: with that probability
the host is worse. A host is blocked if the bound is above `tolerance` times the
rate of all, that is, if it is worse than the corpus with that confidence; hosts
with few labels stay near their prior, and are not. Without differences between
hosts beyond chance the posteriors stay close to the rate of all, and few hosts or
none are blocked.

The quantile is found on a grid: log(rate / (1 - rate)) has a smooth density with
one peak, and a deviation of at most sqrt(1/a + 1/a^2 + 1/b + 1/b^2), so 257 points
over 8 deviations on both sides hold the posterior, and its mass is summed up to
the quantile.

Registered domains are told by a rule: a country's second-level label of general
use (co, com, net, ...) belongs to the suffix, as do the `private` suffixes under
which hosts belong to different people; an address is a domain of its own.

A rule fits its host and all subdomains if the url's path begins with the rule's
path; the longest that fits decides before the reputation does.

DataFrame functions only; no Python runs on the executors. Outcomes are counted
by host before anything else, then by domain and suffix from those counts.

Defined results: the host of a null url, or one without ://, is empty, and so is
its path; an empty host is a host; ports and user names are part of the host as
shown, not of its domain; of several labels of one page the worst holds; pages
without a label judge nothing; repeated pages are judged each; without labels
nothing is blocked by reputation; an empty table gives an empty result; other
columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._store import written

CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch", "web")
#: Suffixes of two labels under which hosts belong to different people.
PRIVATE_SUFFIXES = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com", "workers.dev")
_DOUBLE = rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
#: Grid points on each side of the posterior's middle, and how many of them are a deviation.
GRID, PER_DEVIATION = 128, 16


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    fits = [
        F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def domain_and_suffix(host: Column, private: tuple[str, ...] = PRIVATE_SUFFIXES) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last_two, address = F.substring_index(bare, ".", -2), bare.rlike(_ADDRESS)
    double = last_two.rlike(_DOUBLE) | last_two.isin(*private)
    suffix = F.when(address, F.lit("address")).when(double, last_two).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).when(double, F.substring_index(bare, ".", -3)).otherwise(last_two), suffix


def beta_quantile(posterior: DataFrame, q: float) -> DataFrame:
    """`posterior` (a, b and other columns) with `bound`, the quantile of Beta(a, b) at q."""
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    step = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) / PER_DEVIATION
    placed = posterior.withColumns({"__step": step, "__middle": F.log(a / b)})

    def log(t: Column) -> Column:
        """a * log(rate) + b * log(1 - rate)"""
        rest = F.log(1 + F.exp(-F.abs(t)))
        return -a * (rest + F.greatest(-t, zero)) - b * (rest + F.greatest(t, zero))

    def mass(i: Column) -> Column:
        return F.exp(log(F.col("__middle") + i * F.col("__step")) - log(F.col("__middle")))

    weighed = placed.withColumn("__mass", F.transform(F.sequence(F.lit(-GRID), F.lit(GRID)), mass))
    summed = weighed.withColumn("__goal", q * F.aggregate("__mass", zero, lambda acc, x: acc + x))

    def walk(acc: Column, i: Column) -> Column:
        own = F.get("__mass", i)
        after = acc["sum"] + own
        edge = F.col("__middle") + (i - GRID + 0.5) * F.col("__step") - F.col("__step") * (after - F.col("__goal")) / own
        return F.struct(after.alias("sum"), F.when((acc["sum"] < F.col("__goal")) & (after >= F.col("__goal")), edge).otherwise(acc["at"]).alias("at"))

    at = F.aggregate(F.sequence(F.lit(0), F.lit(2 * GRID)), F.struct(zero.alias("sum"), zero.alias("at")), walk, lambda acc: acc["at"])
    return summed.withColumn("bound", 1 / (1 + F.exp(-at))).drop("__step", "__middle", "__mass", "__goal")


def _strength(groups: DataFrame, rate: float) -> float:
    """The prior's strength at a level, from one aggregation over its groups (n, bad)."""
    n, share = F.col("n").cast("double"), F.col("bad") / F.col("n")
    spread, groups_less_one, total, squares = (groups.where("n > 0").agg(F.sum(n * (share - rate) * (share - rate)), F.count(F.lit(1)) - 1, F.sum(n), F.sum(n * n))).first()
    if not total:
        return 1000.0
    size = total - squares / total - groups_less_one
    rho = (spread / (rate * (1 - rate)) - groups_less_one) / size if size > 0 else 0.0
    return 1 / max(1 / 1001, min(0.5, rho)) - 1


def reputations(outcomes: DataFrame, confidence: float = CONFIDENCE, tolerance: float = 1.0, private: tuple[str, ...] = PRIVATE_SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, bound, blocked) for `outcomes` (host, n, bad); n may be 0."""
    domain, suffix = domain_and_suffix(F.col("host"), private)
    hosts = written(outcomes.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes")
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    rate = ((bad or 0) + 1) / ((n or 0) + 2)

    def shrunk(groups: DataFrame, towards: Column) -> Column:
        k = F.lit(_strength(groups, rate))
        return (F.col("bad") + k * towards) / (F.col("n") + k)

    by_suffix = suffixes.select("suffix", shrunk(suffixes, F.lit(rate)).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(domains, F.col("suffix_mean")).alias("domain_mean"))
    k = F.lit(_strength(hosts, rate))
    known = hosts.join(by_domain, ["domain", "suffix"])
    posterior = known.select("host", "n", "bad", (F.col("bad") + k * F.col("domain_mean")).alias("a"), (F.col("n") - F.col("bad") + k * (1 - F.col("domain_mean"))).alias("b"))
    bounded = beta_quantile(posterior, 1 - confidence)
    return bounded.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), "bound", (F.col("bound") > tolerance * rate).alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES, confidence: float = CONFIDENCE, tolerance: float = 1.0, private: tuple[str, ...] = PRIVATE_SUFFIXES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and the reputation's bound."""
    host, path = split_url(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = written(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    bad = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    labelled = rows.join(bad.withColumnRenamed("doc_id", "id"), "id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    outcomes = rows.select("host").distinct().join(labelled, "host", "left").select("host", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    known = written(reputations(outcomes, confidence, tolerance, private), "reputations").select("host", "bound", "blocked")
    found = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(known, "host").withColumn("found", found)
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "bound")


def op8_url_reputation(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


def _sql_groups(name: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY {keys})"


def _sql_strength(name: str, source: str) -> str:
    rho = "CASE WHEN size > 0 THEN (spread / v - g) / size ELSE 0.0 END"
    return (
        f"{name} AS (SELECT coalesce(1 / greatest(1 / 1001.0::DOUBLE, least(0.5, {rho})) - 1, 1000.0) AS k FROM (SELECT sum(n * (bad / n - rate) * (bad / n - rate)) AS spread, count(*) - 1 AS g, "
        f"sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS size, max(rate * (1 - rate)) AS v FROM (SELECT n::DOUBLE AS n, bad::DOUBLE AS bad FROM {source} WHERE n > 0), overall))"
    )


_SQL_LOG = "-a * (ln(1 + exp(-abs({0}))) + greatest(-{0}, 0)) - b * (ln(1 + exp(-abs({0}))) + greatest({0}, 0))"
_PRIVATE = ", ".join(f"'{x}'" for x in PRIVATE_SUFFIXES)
_CASES = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)))
_ORDERED = sorted(RULES, key=lambda r: (-len(r.name), r.name))

SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcome AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM urls LEFT JOIN outcome ON page_id = doc_id GROUP BY host),
bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM counts),
two AS (SELECT *, array_to_string(parts[-2:], '.') AS last_two FROM bare),
kinds AS (SELECT *, regexp_matches(array_to_string(parts, '.'), '{_ADDRESS}') AS address, regexp_matches(last_two, '{_DOUBLE}') OR last_two IN ({_PRIVATE}) AS double FROM two),
hosts AS (SELECT host, n, bad, CASE WHEN address THEN array_to_string(parts, '.') WHEN double THEN array_to_string(parts[-3:], '.') ELSE last_two END AS domain, CASE WHEN address THEN 'address' WHEN double THEN last_two ELSE parts[-1] END AS suffix FROM kinds),
{_sql_groups("domains", "domain, suffix")},
{_sql_groups("suffixes", "suffix")},
overall AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM hosts),
{_sql_strength("ks", "suffixes")}, {_sql_strength("kd", "domains")}, {_sql_strength("kh", "hosts")},
sm AS (SELECT suffix, (bad + ks.k * rate) / (n + ks.k) AS suffix_mean FROM suffixes, overall, ks),
dm AS (SELECT domain, suffix, (bad + kd.k * suffix_mean) / (n + kd.k) AS domain_mean FROM domains JOIN sm USING (suffix), kd),
post AS (SELECT host, bad + kh.k * domain_mean AS a, n - bad + kh.k * (1 - domain_mean) AS b FROM hosts JOIN dm USING (domain, suffix), kh),
placed AS (SELECT host, a, b, ln(a / b) AS middle, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) / {PER_DEVIATION} AS step FROM post),
points AS (SELECT *, middle + i * step AS t FROM placed, range(-{GRID}, {GRID + 1}) r(i)),
masses AS (SELECT *, exp({_SQL_LOG.format("t")} - ({_SQL_LOG.format("middle")})) AS mass FROM points),
sums AS (SELECT host, i, middle, step, mass, sum(mass) OVER (PARTITION BY host ORDER BY i) AS after, {1 - CONFIDENCE!r}::DOUBLE * sum(mass) OVER (PARTITION BY host) AS goal FROM masses),
bounds AS (SELECT host, 1 / (1 + exp(-(middle + (i + 0.5::DOUBLE) * step - step * (after - goal) / mass))) AS bound FROM sums QUALIFY row_number() OVER (PARTITION BY host, after >= goal ORDER BY i) = 1 AND after >= goal)
SELECT page_id, host, path, CASE {_CASES.format(*(r.name for r in _ORDERED))} END AS rule,
coalesce(CASE {_CASES.format(*(r.verdict for r in _ORDERED))} END, CASE WHEN bound > rate THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound
FROM urls JOIN bounds USING (host), overall
"""
