"""URL filters by pattern rules, in DataFrame operations only.

Every rule has literal tokens, of which the one that the fewest URLs hold is its
index key.  The tokens of a URL fetch candidate rules through that index, and
only the candidates' regular expressions run.  Of the rules that fit, the one
with the longest pattern text wins; ties go to the smaller pattern.

The rule table is broadcast while it has at most ``BROADCAST_RULES`` rows (each a
few hundred bytes); a larger one is joined by token in an exchange, where a
token's rows are spread over ``SALTS`` copies of its rules.

Defined results: a null URL or one without ``://`` has an empty host and path and
fits no rule, so it has the default verdict.  Rows that repeat are judged each by
itself.  Other columns pass through one exchange; leave out large ones that
aren't needed.  Columns named host, path, rule, verdict or matched are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BROADCAST_RULES = 20_000
SALTS = 16
TOKEN = "[a-z0-9]+"
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is what a result names; ``regex`` runs on ``host + path``, lower-cased host first."""

    pattern: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    base: bool = False


def host_rule(pattern: str, verdict: str) -> Rule:
    """``host/path-prefix``: the host, its subdomains, and paths that start so."""
    host, _, path = pattern.partition("/")
    return Rule(pattern, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tuple(re.findall(TOKEN, host)), True)


def word_rule(word: str, verdict: str) -> Rule:
    """A word of the host, bounded by dots, hyphens or the host's ends."""
    return Rule(f"*{word}*", verdict, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", tuple(re.findall(TOKEN, word)))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(raw), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit(f"({TOKEN})"), F.lit(1)))


def indexed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, pattern, verdict, regex, base): each rule under its rarest token.

    ``pages`` has the column ``_tokens``.  A token's count over all URLs is found in one
    aggregate that holds a row per rule token; tokens of no URL count 0.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame(
        [(i, t, r.pattern, r.verdict, r.regex, r.base) for i, r in enumerate(rules) for t in r.tokens],
        "rule_id long, token string, pattern string, verdict string, regex string, base boolean",
    )
    wanted = listed.select("token").distinct()
    if len(rules) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    seen = pages.select(F.explode("_tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    ranked = listed.join(seen, "token", "left").groupBy("rule_id").agg(
        F.min_by(F.struct("token", "pattern", "verdict", "regex", "base"), F.struct(F.coalesce("count", F.lit(0)), "token")).alias("r")
    )
    return ranked.select("r.*")


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict and matched added.

    ``rule`` is the pattern of the base rule that won, else null; ``matched`` the
    pattern of the rule that gave the verdict, base or not.  Base rules come first.
    """
    passing = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "matched")]
    judged = pages.select(*passing).withColumn("_host", host_of(F.col(url_col))).withColumn("_path", path_of(F.col(url_col)))
    judged = judged.withColumn("_tokens", F.when(F.col("_host") != "", _tokens(F.col("_host"), F.col("_path"))).otherwise(F.array().cast("array<string>")))
    index = indexed(judged, rules)
    one = judged.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode_outer("_tokens").alias("token"))
    if len(rules) <= BROADCAST_RULES:
        found = one.join(F.broadcast(index), "token", "left")
    else:
        one = one.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = one.join(index, ["token", "_salt"], "left").drop("_salt")
    fits = F.expr("if(concat(_host, _path) rlike regex, true, null)")
    best = F.struct(F.col("base"), F.length("pattern"), F.col("pattern"))
    out = found.groupBy("_row", "_host", "_path").agg(
        *[F.first(c).alias(f"_c{i}") for i, c in enumerate(passing)],
        F.max_by(F.when(fits, F.struct("pattern", "verdict", "base")), F.when(fits, best)).alias("_won"),
    )
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(passing)],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_won.base"), F.col("_won.pattern")).alias("rule"),
        F.coalesce("_won.verdict", F.lit(default)).alias("verdict"),
        F.col("_won.pattern").alias("matched"),
    )
