"""URL filters: pattern rules behind an index on their rarest literal token.

A rule is written as

* ``host/path``: fits the host and all its subdomains where the URL's path
  starts with ``/path`` (``net/``, ``example.net/en/``);
* ``~text``: fits where ``text`` occurs in ``.host/path``; ``*`` in it stands for
  any characters (``~.spam-farm.``, ``~/wp-*/login``).

A rule's literal tokens are the runs of letters and digits that must be whole
tokens of every URL it fits. Each rule is filed under the one of them that is
rarest among the URLs; a URL's tokens fetch the rules filed under them and only
those are run as regular expressions. A rule without such a token is filed under
the empty token, which every URL has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# An index of at most so many rules is broadcast (a rule is a short line of text);
# a larger one is joined by Spark without a hint.
BROADCAST_RULES = 10_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(text, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for NULL and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def compile_rule(rule: str) -> tuple[str, list[str]]:
    """The regular expression of a rule (over ``.host/path``) and its whole literal tokens."""
    if rule.startswith("~"):
        parts = rule[1:].split("*")
        pattern = ".*".join(re.escape(p) for p in parts)
        # A run at the edge of a literal may continue beyond it in a URL.
        tokens = [t for p in parts for t in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", p)]
    else:
        host, slash, path = rule.partition("/")
        literal = "." + host.lower() + slash + path
        pattern = r"^[^/]*" + re.escape(literal)
        tokens = re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", literal)
    return f"(?s){pattern}", sorted({t.lower() for t in tokens})


def _tokens(subject: Column) -> Column:
    """Distinct tokens of a URL, the empty one included."""
    found = F.regexp_extract_all(F.lower(subject), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, int]], url: str = "url") -> DataFrame:
    """One row per distinct (host, path) that a rule fits, with the deciding rule.

    ``rules`` are (rule, action, tier). The lowest tier decides, in it the longest
    rule, among equally long ones the smallest text. Result: host, path, rule,
    action, tier. URLs that no rule fits have no row; an empty table gives an
    empty result.
    """
    spark = urls.sparkSession
    listed = [(rule, action, tier, *compile_rule(rule)) for rule, action, tier in rules]
    schema = "rule string, action string, tier int, pattern string, tokens array<string>"
    rules_df = spark.createDataFrame(listed, schema)
    host, path = host_and_path(F.col(url))
    distinct = urls.select(host.alias("host"), path.alias("path")).distinct()
    subjects = distinct.withColumn("subject", F.concat(F.lit("."), "host", "path"))
    tokens = subjects.select("host", "path", "subject", F.explode(_tokens(F.col("subject"))).alias("token"))
    rule_tokens = rules_df.select("rule", F.explode("tokens").alias("token"))
    hint = F.broadcast if len(listed) <= BROADCAST_RULES else (lambda df: df)
    wanted = rule_tokens.select("token").distinct()
    seen = tokens.select("token").join(hint(wanted), "token", "left_semi").groupBy("token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)), "token")
    filed = rule_tokens.join(seen, "token", "left").groupBy("rule").agg(F.min_by("token", rarity).alias("token"))
    index = rules_df.join(filed, "rule", "left").select(
        "rule", "action", "tier", "pattern", F.coalesce("token", F.lit("")).alias("token")
    )
    # Case is folded for the lookup alone; the expression decides on the URL itself.
    fits = tokens.join(hint(index), "token").filter(F.expr("subject rlike pattern"))
    best = F.min_by(F.struct("rule", "action", "tier"), F.struct("tier", -F.length("rule"), "rule"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def verdicts(
    urls: DataFrame, rules: Iterable[tuple[str, str]], patterns: Iterable[tuple[str, str]], default: str = "allow"
) -> DataFrame:
    """Every URL row with host, path, rule, pattern and verdict.

    The longest fitting rule of ``rules`` decides; else the longest fitting one of
    ``patterns``; else ``default``. Columns of those names, in any case, that the input has are
    replaced. NULL URLs and such without ``://`` have an empty host and path;
    repeated rows stay repeated.
    """
    added = ("host", "path", "rule", "pattern", "verdict")
    both = [(r, a, 0) for r, a in dict(rules).items()] + [(r, a, 1) for r, a in dict(patterns).items()]
    found = judge(urls, both)
    host, path = host_and_path(F.col("url"))
    kept = [c for c in urls.columns if c.lower() not in added]
    rows = urls.select(*kept, host.alias("host"), path.alias("path"))
    decided = found.select(
        "host",
        "path",
        F.when(F.col("tier") == 0, F.col("rule")).alias("rule"),
        F.when(F.col("tier") == 1, F.col("rule")).alias("pattern"),
        F.col("action").alias("verdict"),
    )
    joined = rows.join(decided, ["host", "path"], "left")
    return joined.select(*kept, "host", "path", "rule", "pattern", F.coalesce("verdict", F.lit(default)).alias("verdict"))
