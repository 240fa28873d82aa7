"""URL filter: allow and block rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad 0 or 1) are counted per host, registered domain and suffix. The rate of
each level is shrunk towards the posterior mean of the level above by a beta-binomial prior, whose
strength comes from the spread between the level's units (method of moments): all pages -> suffix ->
registered domain -> host. A host is blocked if the lower bound of its posterior bad rate, a quantile of its beta
distribution, is over the threshold: if a rate under the threshold has a chance of less than `risk`. A host without labelled
pages has the posterior of its domain, suffix or all pages.

Outcomes come from `labelled`, or else from what is known of a page by itself: a rule's verdict, otherwise whether its url
holds one of `bad_terms` as a word. Suffixes of two labels are a parameter; pass those of a public suffix list.

Edge cases: a null url, or one without ://, has an empty host and path; it fits no rule and is judged
by the reputation of the empty host. No labels at all: prior rate 0, so all is allowed. Repeated rows
count and are judged each on their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import let, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a url that speak against its page.
BAD_TERMS = ("ads", "adult", "bet", "bets", "betting", "casino", "cheap", "escort", "jackpot", "phishing", "pills", "poker", "porn", "scam", "slots", "spam", "viagra", "warez", "xxx")
#: Places at which a posterior is summed up.
POINTS = 512
#: Suffixes of more than one label.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def has_bad_term(url: Column, bad_terms: Sequence[str]) -> Column:
    pattern = "(^|[^a-z])(" + "|".join(bad_terms) + ")([^a-z]|$)"
    return F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER).rlike(pattern) if bad_terms else F.lit(False)


def levels_of(host: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    labels = F.split(host, r"\.", -1)
    last_two = F.concat_ws(".", F.slice(labels, -2, 2))
    long = last_two.isin(*suffixes)
    suffix = F.when(F.size(labels) < 2, host).when(long, last_two).otherwise(F.element_at(labels, -1))
    domain = F.when(F.size(labels) < 2, host).when(long & (F.size(labels) > 2), F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(last_two)
    return domain, suffix


def strength(n: int, bad: int, spread: float, units: int) -> float:
    """Prior strength of a level, from the weighted spread of its units' rates: the share of it that chance doesn't explain.

    n, bad: labelled pages and bad ones; spread: sum of n_u * (rate_u - rate)**2; units: those with labelled pages.
    """
    rate = bad / max(n, 1)
    noise, k = rate * (1 - rate), units / max(n, 1)
    rho = (spread / max(n, 1) / noise - k) / (1 - k) if noise > 0 and k < 1 else 1.0
    return 1 / min(max(rho, 0.001), 0.999) - 1


def chance_under(a: Column, b: Column, rate: float) -> Column:
    """Chance that a rate of Beta(a, b) is at most `rate`: sums over the log-odds, on which the density has no poles."""
    width = 8 * (1 / a + 1 / b + F.sqrt(1 / a + 1 / b))
    step, cut = 2 * width / POINTS, math.log(rate / (1 - rate))
    top = a * F.ln(a / (a + b)) + b * F.ln(b / (a + b))

    def soft(x: Column) -> Column:  # ln(1 + exp(x))
        return F.greatest(x, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(x)))

    def summed(v: Column) -> Column:
        def part(i: Column) -> Column:
            x = v["low"] + (i + 0.5) * v["step"]
            w = F.exp(-v["a"] * soft(-x) - v["b"] * soft(x) - v["top"])
            return F.struct(w.alias("w"), (w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cut - x) / v["step"] + 0.5))).alias("under"))

        parts = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), part)
        total = F.aggregate(parts, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("under")), lambda acc, x: F.struct((acc["w"] + x["w"]).alias("w"), (acc["under"] + x["under"]).alias("under")))
        return let(total, lambda t: t["under"] / t["w"])

    given = F.struct((F.ln(a / b) - width).alias("low"), step.alias("step"), a.alias("a"), b.alias("b"), top.alias("top"))
    return F.when(a <= 0, 1.0).when(b <= 0, 0.0).otherwise(let(given, summed))


def host_reputation(labelled: DataFrame, hosts: DataFrame, threshold: float = 0.5, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """labelled: (host, bad 0/1); hosts: (host). Per host: host, n, n_bad, mean, under (chance of a rate of at most `threshold`)."""
    seen = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("n_bad"))
    every = hosts.select("host").distinct().join(seen, "host", "left").na.fill(0, ["n", "n_bad"])
    domain, suffix = levels_of(F.col("host"), suffixes)
    every = stored(every.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    by_domain = every.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("n_bad").alias("bad_d"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("bad_d").alias("bad_s"))
    n, bad = every.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    rate = bad / max(n, 1)

    def strength_of(units: DataFrame, n_u: str, bad_u: str) -> float:
        part = F.when(F.col(n_u) > 0, F.col(n_u) * F.pow(F.col(bad_u) / F.col(n_u) - rate, F.lit(2.0))).otherwise(0.0)
        spread, k = units.agg(F.coalesce(F.sum(part), F.lit(0.0)), F.count(F.when(F.col(n_u) > 0, 1))).first()
        return strength(n, bad, spread, k)

    m_s, m_d, m_h = strength_of(by_suffix, "n_s", "bad_s"), strength_of(by_domain, "n_d", "bad_d"), strength_of(every, "n", "n_bad")
    out = every.join(by_domain, ["domain", "suffix"]).join(by_suffix, "suffix")
    out = out.withColumn("mean_s", (m_s * rate + F.col("bad_s")) / (m_s + F.col("n_s")))
    out = out.withColumn("mean_d", (m_d * F.col("mean_s") + F.col("bad_d")) / (m_d + F.col("n_d")))
    out = out.withColumns({"a": m_h * F.col("mean_d") + F.col("n_bad"), "b": m_h * (1 - F.col("mean_d")) + F.col("n") - F.col("n_bad")})
    out = out.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    return out.select("host", "n", "n_bad", "mean", chance_under(F.col("a"), F.col("b"), threshold).alias("under"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, threshold: float = 0.5, risk: float = 0.05, bad_terms: Sequence[str] = BAD_TERMS, suffixes: Sequence[str] = LONG_SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. labelled: (url, bad); None: outcomes by rule or term."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), has_bad_term(F.col(url_col), bad_terms).alias("term"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "says": says})
    if labelled is None:
        outcomes = own.select("host", F.coalesce(F.col("says") == "block", F.col("term")).cast("int").alias("bad"))
    else:
        outcomes = labelled.where("bad is not null").select(host_and_path(F.col("url"))[0].alias("host"), F.col("bad").cast("int").alias("bad"))
    # written, so that the join below sees its true size: broadcast if that is small, else dealt out with hot hosts split
    blocked = stored(host_reputation(outcomes, own, threshold, suffixes).select("host", (F.col("under") < risk).alias("bad_host")), "reputation")
    verdict = F.coalesce(F.col("says"), F.when(F.col("bad_host"), "block").otherwise("allow"))
    return own.join(blocked, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def sql(rules: Sequence[tuple[str, str]], threshold: float = 0.5, risk: float = 0.05) -> str:
    """The same for DuckDB over the view pages, with outcomes by rule or term."""
    cases = []
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        name, _, tail = text.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}')", text, says))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases) + " END"
    says = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END"
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)

    def m(units: str, n: str, bad: str, name: str) -> str:
        k = f"(count(*) FILTER ({n} > 0))::DOUBLE / greatest(any_value(t.n), 1)"
        spread = f"coalesce(sum({n} * pow({bad} / {n} - t.p, 2)) FILTER ({n} > 0), 0) / greatest(any_value(t.n), 1)"
        noise = "any_value(t.p) * (1 - any_value(t.p))"
        rho = f"CASE WHEN {noise} > 0 AND {k} < 1 THEN ({spread} / ({noise}) - {k}) / (1 - {k}) ELSE 1.0 END"
        return f"{name} AS (SELECT 1 / least(greatest({rho}, 0.001), 0.999) - 1 AS {name} FROM {units}, t)"

    return f"""
WITH u AS (SELECT page_id, regexp_matches(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '(^|[^a-z])({"|".join(BAD_TERMS)})([^a-z]|$)') AS term, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, term, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, term, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
r AS (SELECT *, {rule} AS rule, {says} AS says FROM p),
h0 AS (SELECT host, count(*) AS n, (count(*) FILTER (coalesce(says = 'block', term)))::DOUBLE AS bad, string_split(host, '.') AS l FROM r GROUP BY host),
h1 AS (SELECT *, len(l) < 2 AS bare, array_to_string(list_slice(l, -2, -1), '.') AS two FROM h0),
h AS (SELECT host, n, bad, CASE WHEN bare THEN host WHEN two IN ({long}) THEN two ELSE l[-1] END AS suffix,
      CASE WHEN bare THEN host WHEN two IN ({long}) AND len(l) > 2 THEN array_to_string(list_slice(l, -3, -1), '.') ELSE two END AS domain FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(bad) / greatest(sum(n), 1) AS p FROM h),
{m('x', 'x.n', 'x.bad', 'ms')}, {m('d', 'd.n', 'd.bad', 'md')}, {m('h', 'h.n', 'h.bad', 'mh')},
post AS (SELECT h.host, h.n, h.bad, mh, (md * (ms * t.p + x.bad) / (ms + x.n) + d.bad) / (md + d.n) AS mean_d FROM h JOIN d USING (domain, suffix) JOIN x USING (suffix), t, ms, md, mh),
ab AS (SELECT host, mh * mean_d + bad AS a, mh * (1 - mean_d) + n - bad AS b FROM post),
w AS (SELECT host, a, b, 8 * (1 / a + 1 / b + sqrt(1 / a + 1 / b)) AS width FROM ab WHERE a > 0 AND b > 0),
g AS (SELECT host, a, b, 2 * width / {POINTS} AS step, ln(a / b) - width + (i + 0.5) * 2 * width / {POINTS} AS x FROM w, range({POINTS}) t(i)),
e AS (SELECT host, step, x, exp(-a * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) - b * (greatest(x, 0) + ln(1 + exp(-abs(x)))) - a * ln(a / (a + b)) - b * ln(b / (a + b))) AS d FROM g),
c AS (SELECT host, sum(d * greatest(0, least(1, ({math.log(threshold / (1 - threshold))} - x) / step + 0.5))) / sum(d) AS under FROM e GROUP BY host),
v AS (SELECT ab.host, coalesce(under, CASE WHEN a <= 0 THEN 1 ELSE 0 END) < {risk} AS blocked FROM ab LEFT JOIN c USING (host))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN v USING (host)
"""
