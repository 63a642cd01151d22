"""URL filter in DataFrame functions: rules are found through their rarest literal token, and only candidates run regular expressions.

A rule is (rule, action, pattern, rank): a regular expression over host and path, an action, and a rank; of the rules that fit a URL the
one of the highest rank wins. Each rule is indexed by one literal token that every URL it fits must hold, the one that is rarest among
the tokens of all distinct URLs. The tokens of a URL (parts of host and path between other characters than letters and digits) fetch the
rules indexed by them; only for those the pattern runs. URLs are judged once each, however often they occur.

Null URLs and such without "://" have an empty host and path and meet no rule. Without a rule the verdict is allow. Repeated rows give
repeated results. Only page_id and url are read. The rule list is a parameter that the driver holds anyway; the index is broadcast.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """tokens: literal tokens, in lower case, that are in every URL the pattern fits; listed: its name is reported."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`; longer rules win."""
    whole = [t for t in re.split("[^A-Za-z0-9]+", host) if t]
    inner = re.split("[^A-Za-z0-9]+", path)[:-1]  # the last piece may go on in the URL
    pattern = rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}"
    tokens = tuple(dict.fromkeys(t.lower() for t in [*whole, *inner] if t))
    return Rule(host + path, action, pattern, tokens, 1_000 + len(host + path))


# The listed sites.
SITES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Further patterns, below the sites: (name, pattern, tokens).
PATTERNS = (
    ("spam hosts", r"^([^/]*[.-])?spam([.-][^/]*)?(/|$)", ("spam",)),
    ("casino hosts", r"^([^/]*[.-])?casino([.-][^/]*)?(/|$)", ("casino",)),
    ("adult hosts", r"^([^/]*[.-])?(xxx|porn)([.-][^/]*)?(/|$)", ("xxx", "porn")),
    ("login pages", r"/(login|signin)(/|\.[a-z]+|$)", ("login", "signin")),
    ("click trackers", r"^(ads|track|click)\.[^/]*/", ("ads", "track", "click")),
)


def default_rules() -> list[Rule]:
    rules = [site_rule(*site) for site in SITES]
    for name, pattern, tokens in PATTERNS:
        choices = re.search(r"\((\w+(?:\|\w+)+)\)", pattern)
        # of alternatives only one is in a URL: a rule for each
        for token in tokens:
            own = pattern.replace(choices[0], f"({token})", 1) if choices and token in choices[1].split("|") else pattern
            rules.append(Rule(f"{name}: {token}", "block", own, (token,), len(token), listed=False))
    return rules


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first :// up to / ? # or the end, A-Z in lower case, and from there up to ? or # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens_of(site: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(site, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rule, action, pattern, rank, listed): every rule under its token that is rarest among the URLs (site)."""
    listed = [{"n": n, "rule": r.name} | {k: getattr(r, k) for k in ("action", "pattern", "rank", "listed", "tokens")} for n, r in enumerate(rules)]
    schema = "array<struct<n:int,rule:string,action:string,pattern:string,rank:int,listed:boolean,tokens:array<string>>>"
    table = urls.sparkSession.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), schema)))
    literal = table.select(F.explode(F.array_distinct("tokens")).alias("token"), "n")
    whole = table.drop("tokens")
    known = literal.select("token").distinct()
    found = urls.select(F.explode(tokens_of(F.col("site"))).alias("token")).join(_small(known, rules), "token", "left_semi")
    counts = found.groupBy("token").agg(F.count("*").alias("uses"))
    ranked = literal.join(counts, "token", "left").select("n", F.struct(F.coalesce("uses", F.lit(0)), "token").alias("choice"))
    rarest = ranked.groupBy("n").agg(F.min("choice")["token"].alias("token"))
    return rarest.join(whole, "n").drop("n")


def _small(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Broadcast what has a few rows a rule, unless the list is long."""
    return F.broadcast(df) if len(rules) <= MOST_BROADCAST_RULES else df


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule (null if none of the listed fits) and verdict (allow or block) of every page."""
    rules = default_rules() if rules is None else rules
    if any(not rule.tokens for rule in rules):
        raise ValueError("every rule needs a literal token")
    host, path = host_and_path(F.col("url"))
    sites = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = sites.select("host", "path").where("host != '' OR path != ''").distinct()
    distinct = distinct.withColumn("site", F.concat("host", "path"))
    index = _small(rule_index(distinct, rules), rules)
    candidates = distinct.withColumn("token", F.explode(tokens_of(F.col("site")))).join(index, "token")
    fitting = candidates.where(F.expr("site RLIKE pattern"))
    best = F.max(F.struct("rank", "rule", "action", "listed")).alias("best")
    verdicts = fitting.groupBy("host", "path").agg(best)
    judged = sites.join(verdicts, ["host", "path"], "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"),
    )


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(spark.read.parquet(f"{folder}/pages.parquet"))


def _sql() -> str:
    listed = [(host + path, host, path, action) for action, host, path in SITES]
    values = ", ".join(f"('{name}', '{host}', '{path}', '{action}', {1_000 + len(name)})" for name, host, path, action in listed)
    others = [r for r in default_rules() if not r.listed]
    patterns = ", ".join(f"('{r.name}', '{r.pattern}', '{r.action}', {r.rank})" for r in others)
    return f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
            FROM cut
        ), site_rules(rule, rule_host, rule_path, action, rank) AS (VALUES {values}
        ), pattern_rules(name, pattern, action, rank) AS (VALUES {patterns}
        ), urls AS (SELECT DISTINCT host, path FROM parts
        ), fits AS (
            SELECT host, path, rule, action, rank FROM urls JOIN site_rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            UNION ALL
            SELECT host, path, NULL, action, rank FROM urls JOIN pattern_rules ON regexp_matches(host || path, pattern)
        ), best AS (
            SELECT host, path, arg_max(rule, rank) FILTER (rank > 1000) AS rule, arg_max(action, rank) AS action FROM fits GROUP BY ALL
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
    """


OP5_SQL = _sql()
