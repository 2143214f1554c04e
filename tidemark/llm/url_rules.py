"""URL filters: pattern rules indexed by their rarest literal token.

A rule is either host and path (``example.net/en/``: that host and its subdomains, paths that start so) or a pattern over
the lower-cased url in which ``*`` stands for any characters and ``^`` for a separator or an end. Words of letters and
digits that a rule needs whole are its literal tokens. Each rule is filed under the one that the fewest urls hold; a url's
tokens fetch the rules filed under them, and only those run their regular expressions. A rule without a literal token is
filed under the empty token, which every url has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WorkTables

# Rule set of the production query, fixed values: host and path rules, then patterns.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PATTERN_RULES = [
    ("block", "*.casino-*"),
    ("block", "*/casino-*"),
    ("block", "*^poker^*"),
    ("block", "*^viagra^*"),
    ("block", "*^xxx^*"),
    ("block", "*^porn^*"),
    ("block", "*/cart/*"),
    ("block", "*/login^*"),
    ("block", "*/wp-admin/*"),
    ("block", "*^sessionid=*"),
    ("allow", "*.casino-history.*"),
]


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    regex: str
    tokens: list[str]
    by_host: bool


def host_rule(action: str, text: str) -> Rule:
    """Rule on host + path; its regular expression runs on the lower-cased host followed by the path."""
    host, slash, path = text.partition("/")
    regex = "^(?:[^/]*\\.)?" + re.escape(host.lower()) + re.escape(slash + path)
    words = re.findall("[a-z0-9]+", text.lower())
    # A rule that ends inside a word does not need that word whole.
    return Rule(text, action, regex, words[:-1] if text[-1:].isalnum() else words, True)


def pattern_rule(action: str, text: str) -> Rule:
    """Rule on the whole lower-cased url; the pattern must cover it from start to end."""
    parts = {"*": "[\\s\\S]*", "^": "(?:[^a-z0-9]|^|$)"}
    regex = "^" + "".join(parts.get(c) or re.escape(c) for c in text.lower()) + "$"
    tokens = [m[0] for m in re.finditer("[a-z0-9]+", text.lower()) if text[m.start() - 1 : m.start()] != "*" and text[m.end() : m.end() + 1] != "*"]
    return Rule(text, action, regex, tokens, False)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.text, r.action, r.regex, r.tokens, r.by_host) for r in rules], "rule string, action string, regex string, tokens array<string>, by_host boolean"
    )


def parts(url) -> tuple:
    """(host, path): host after the first ``://`` up to / ? # or end, A-Z lower-cased; path up to ? # or end."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    ``rules`` is a table as of ``rules_table``. Of the host rules that fit, the longest wins (ties: the smaller text)
    and is named in ``rule``. Without one the patterns decide: an allowing one before a blocking one, else
    ``default``. A null url, or one without ``://``, has empty host and path; patterns still see it unless null. Repeated
    rows come out as often as they came in; other columns are not read; no pages: no rows; no rules: ``default``.
    """
    tables = WorkTables(pages.sparkSession, "urls")
    host, path = parts(F.col("u"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", "u", host.alias("host"), path.alias("path"))
    plain = F.lower("u")
    urls = own.where("u is not null").select("u").distinct()
    tokens = F.array_union(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))), F.array(F.lit("")))
    posted = tables.write("tokens", urls.select("u", F.explode(tokens).alias("token")))
    wanted = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token")).drop("tokens")
    counts = posted.join(wanted.select("token").distinct(), "token").groupBy("token").count()
    filed = (
        wanted.join(counts, "token", "left")
        .groupBy("rule", "action", "regex", "by_host")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
        .select("rule", "action", "regex", "by_host", "least.token")
    )
    filed = tables.write("filed", filed)
    candidates = posted.join(filed, "token").select("u", "rule", "action", "regex", "by_host", *[x.alias(n) for x, n in zip(parts(F.col("u")), ("h", "p"))])
    seen = F.when(F.col("by_host"), F.concat("h", "p")).otherwise(plain)
    fits = candidates.withColumn("seen", seen).where(F.expr("seen rlike regex"))
    rank = F.struct(F.col("by_host").alias("a"), F.when(F.col("by_host"), F.length("rule")).otherwise((F.col("action") == "allow").cast("int")).alias("b"))
    ranked = fits.select("u", "rule", "action", "by_host", rank.alias("rank"))
    best = ranked.groupBy("u").agg(F.max("rank").alias("rank"))
    won = ranked.join(best, ["u", "rank"]).groupBy("u").agg(F.min(F.struct("rule", "action", "by_host")).alias("w"))
    won = tables.write("won", won.select("u", "w.rule", "w.action", "w.by_host"))
    joined = own.join(won, "u", "left")
    return joined.select("page_id", "host", "path", F.when(F.col("by_host"), F.col("rule")).alias("rule"), F.coalesce("action", F.lit(default)).alias("verdict"))
