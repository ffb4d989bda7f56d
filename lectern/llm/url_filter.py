"""URL filters: host rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and public
suffix. Beta-binomial priors shrink suffix towards all, domain towards suffix and host towards
domain; their strengths come from the spread of each level's units round their own parent's
mean (method of moments, over parents with several units). A host without a rule is allowed
where the lower bound of its posterior, mean less ``z`` deviations, reaches ``least``.

A public suffix is the last label of a host, or the last two where the last is a country's two
letters and the one before a kind of registrant (``KINDS``) or both are listed by the caller.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as
the host ``""``; several labels of one page count as their least; null outcomes are ignored;
repeated page rows each count; pages without an id have no outcome; of rules that fit, the
longest counts, of equally long ones the later; without any labels all hosts share the prior
mean one half; empty tables give an empty result; long urls are judged whole; all columns are
kept whatever their names, but for those that the result adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, ascii_lower, materialize, same_ids, shielded

#: (verdict, rule): a host, then the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Kinds of registrant below a country's suffix.
KINDS = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc")
#: Posterior deviations below the mean, the bound a host must reach, and limits of a prior's strength.
Z, LEAST, STRENGTH = 1.645, 0.5, (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, two: int, one: int, suffixes: tuple) -> Column:
    """The last labels of a host: two where its suffix has two labels, else one."""
    name = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    last2 = F.substring_index(name, ".", -2)
    wide = last2.rlike(rf"^({'|'.join(KINDS)})\.[a-z]{{2}}$")
    return F.when(wide | last2.isin(*suffixes) if suffixes else wide, F.substring_index(name, ".", -two)).otherwise(F.substring_index(name, ".", -one))


def suffix_of(host: Column, suffixes: tuple = ()) -> Column:
    return _labels(host, 2, 1, suffixes)


def domain_of(host: Column, suffixes: tuple = ()) -> Column:
    return _labels(host, 3, 2, suffixes)


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame) -> float:
    """How much a level's units (n, good, m: their parent's mean, peers) keep to their parent: the beta-binomial's a + b by moments."""
    noise = F.col("m") * (1 - F.col("m"))
    over = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)) - F.sum(noise)
    found, room = units.where("n > 0 and peers > 1").agg(over, F.sum(noise * (F.col("n") - 1))).first()
    rho = found / room if room else 0
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: tuple = ()) -> DataFrame:
    """(host, n_labelled, posterior_mean, posterior_bound) of every host in pages (page_id, url).

    outcomes: (page_id, good). Pages and outcomes are read once, for the counts by host; the
    levels above are counted from these. The overall mean and three strengths are all that
    reaches the driver.
    """
    least = outcomes.where("good is not null and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(least, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("units")]
    level = {"domain": hosts.groupBy("domain", "suffix").agg(*sums)}
    level["suffix"] = level["domain"].groupBy("suffix").agg(*sums)
    n, good, peers = level["suffix"].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0.0)), F.count("*")).first()
    shrunk = lambda k: (F.col("good") + k * F.col("m")) / (F.col("n") + k)
    units = level["suffix"].withColumns({"m": F.lit((good + 1) / (n + 2)), "peers": F.lit(peers)})
    for above, below in (("suffix", level["domain"]), ("domain", hosts)):
        parents = units.select(above, shrunk(_strength(units)).alias("m"), F.col("units").alias("peers"))
        units = below.join(parents, above)
    k = _strength(units)
    a, b = F.col("good") + k * F.col("m"), F.col("n") - F.col("good") + k * (1 - F.col("m"))
    known = units.select("host", F.col("n").alias("n_labelled"), a.alias("a"), b.alias("b"))
    post = F.col("a") / (F.col("a") + F.col("b"))
    bound = post - Z * F.sqrt(post * (1 - post) / (F.col("a") + F.col("b") + 1))
    return known.select("host", "n_labelled", post.alias("posterior_mean"), bound.alias("posterior_bound"))


ADDED = ["host", "path", "rule", "verdict", "n_labelled", "posterior_mean", "posterior_bound"]


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, least: float = LEAST, suffixes: tuple = ()) -> DataFrame:
    """Each page row with host, path, rule, verdict and its host's reputation."""
    plain, called = shielded(pages)
    url = as_text(called["url"])
    said, of = shielded(outcomes)
    own, theirs = same_ids(plain, called["page_id"], said, of["page_id"])
    known = reputations(plain.select(own.alias("page_id"), url.alias("url")), said.select(theirs.alias("page_id"), F.col(of["good"]).alias("good")), suffixes)
    rows = plain.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(known, "host").withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("posterior_bound") >= least, "allow").otherwise("block"))})
    kept = [k for k, c in enumerate(pages.columns) if c not in ADDED]
    return out.select(*[f"c{k}" for k in kept], *ADDED).toDF(*[pages.columns[k] for k in kept], *ADDED)


def _oracle() -> str:
    fits = lambda t: "(host = '{0}' or host like '%.{0}') and path like '/{1}%'".format(*t.split("/", 1))
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "case " + " ".join(f"when {fits(t)} then '{t}'" for _, t in ordered) + " end"
    said = "case " + " ".join(f"when {fits(t)} then '{v}'" for v, t in ordered) + f" when posterior_bound >= {LEAST} then 'allow' else 'block' end"
    name = "regexp_replace(host, '^.*@|:[0-9]*$', '', 'g')"
    last = lambda k: f"array_to_string(list_slice(string_split({name}, '.'), -{k}, -1), '.')"
    two = f"regexp_matches({last(2)}, '^({'|'.join(KINDS)})[.][a-z]{{2}}$')"
    k = lambda t: f"""(select case when rho > 0 then least(greatest(1 / rho - 1, {STRENGTH[0]}), {STRENGTH[1]}) else {STRENGTH[1]} end from (
        select case when sum(v * (n - 1)) > 0 then (sum(n * pow(good / n - m, 2)) - sum(v)) / sum(v * (n - 1)) else 0 end rho from (select *, m * (1 - m) v from {t} where n > 0 and peers > 1)))"""  # noqa: E731
    return f"""
    with outcome as (select doc_id page_id, min(quality) good from labels where quality is not null group by 1),
    p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
    h0 as (select host, count(good) n, coalesce(sum(good), 0)::double good from p left join outcome using (page_id) group by 1),
    hosts as (select *, case when {two} then {last(3)} else {last(2)} end as dom, case when {two} then {last(2)} else {last(1)} end as suffix from h0),
    domains as (select dom, suffix, sum(n) n, sum(good) good, count(*) units from hosts group by all),
    suffixes as (select suffix, sum(n) n, sum(good) good, count(*) units from domains group by all),
    u1 as (select *, (select (sum(good) + 1) / (sum(n) + 2) from suffixes) m, (select count(*) from suffixes) peers from suffixes),
    u2 as (select domains.*, p.m, p.peers from domains join (select suffix, (good + k * m) / (n + k) m, units peers from u1, (select {k('u1')} k)) p using (suffix)),
    u3 as (select hosts.*, p.m, p.peers from hosts join (select dom, (good + k * m) / (n + k) m, units peers from u2, (select {k('u2')} k)) p using (dom)),
    ab as (select host, n n_labelled, good + k * m a, n - good + k * (1 - m) b from u3, (select {k('u3')} k)),
    post as (select host, n_labelled, a / (a + b) posterior_mean, a / (a + b) - {Z} * sqrt(a * b / pow(a + b, 2) / (a + b + 1)) posterior_bound from ab)
    select page_id, host, path, {rule} as rule, {said} as verdict, n_labelled, round(posterior_mean, 6) posterior_mean, round(posterior_bound, 6) posterior_bound
    from p join post using (host)"""


ORACLE_SQL = _oracle()
