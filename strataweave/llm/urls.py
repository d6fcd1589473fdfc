"""URL filter with DataFrame functions only (operator 10).

Every rule is a regular expression with the literal tokens that any URL it fits must have. The rule is filed
under its rarest token, rarity being counted over all URLs. A URL's tokens fetch the rules filed under
them, and only those run their expressions. All of it is one projection; the rules are a literal in the plan, as
large as the list the caller passes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for the URLs whose ``host + path`` the Java expression ``pattern`` finds; ``tokens`` are runs of letters and digits that each of them has whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    #: Listed rules go before the method's patterns; of those that fit, the longest name wins.
    listed: bool = True


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains, and the paths that start with ``path``."""
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)  # the last run may go on in the URL
    tokens = tuple(dict.fromkeys([*re.findall(r"[a-z0-9]+", host), *whole]))
    return Rule(host + path, verdict, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tokens)


def word_rule(word: str) -> Rule:
    """Blocks hosts and paths that have ``word`` between other characters than letters and digits."""
    return Rule(f"*{word}*", BLOCK, rf"(?i)(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", (word,), listed=False)


#: The listed rules.
SITES = [site_rule(ALLOW, "org", "/"), site_rule(BLOCK, "example.org", "/es/"), site_rule(BLOCK, "example.org", "/en/1"), site_rule(ALLOW, "com", "/fr/"), site_rule(BLOCK, "com", "/de/")]
#: The method's own patterns: words that name gambling, adult and spam sites.
WORDS = [word_rule(w) for w in ("casino", "casinos", "poker", "betting", "jackpot", "slots", "porn", "xxx", "adult", "sex", "escort", "viagra", "cialis", "pills", "warez", "torrent", "payday", "lottery")]
RULES = SITES + WORDS


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(rest, F.length(host) + 1, F.length(rest))


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct runs of ASCII letters and digits, as written and in lower case."""
    found = F.split(F.concat(host, path), "[^A-Za-z0-9]+")
    return F.array_remove(F.array_distinct(F.concat(found, F.transform(found, F.lower))), "")


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs have each token of the rules. One row for each such token at most comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = host_and_path(F.col(url_col))
    tokens = F.array_intersect(url_tokens(host, path), F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(tokens).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in rows}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules, by place, under their rarest token; "" holds those without one, which every URL fetches."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return out


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, default: str = ALLOW, url_col: str = "url") -> DataFrame:
    """``pages`` with a struct column ``url_verdict``: host, path, rule and verdict; one row for each row.

    ``rule`` is the name of the longest listed rule that fits, null if none does (of two as long, the one first in the
    list); ``verdict`` is its verdict, else that of the method's patterns, else ``default``. Null URLs and those without
    ``://`` have an empty host and path, and so no rule. A column named url_verdict is replaced; repeated rows, ties
    and empty tables need nothing special.
    """
    host, path = host_and_path(F.col(url_col))
    filed = index(rules, token_counts(pages, rules, url_col) if any(r.tokens for r in rules) else {})
    listed = F.array(*[F.struct(F.lit(r.listed).alias("listed"), F.lit(len(r.name)).alias("size"), F.lit(-i).alias("order"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules)])
    always = F.array(*map(F.lit, filed.pop("", []))).cast("array<int>")
    by_token = F.create_map(*[x for t, places in sorted(filed.items()) for x in (F.lit(t), F.array(*map(F.lit, places)))]) if filed else None
    # the page's own columns stay inside a struct, so no name can clash
    parts = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    fetched = F.flatten(F.filter(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.element_at(by_token, t)), lambda x: x.isNotNull())) if filed else F.array().cast("array<int>")
    candidates = F.transform(F.concat(always, fetched), lambda i: F.get(listed, i))
    fits = F.filter(candidates, lambda c: F.rlike(F.concat("host", "path"), c["pattern"])) if rules else F.lit(None).cast("array<struct<listed: boolean, size: int, order: int, name: string, verdict: string, pattern: string>>")
    best = F.array_max(F.col("fits"))
    rule = F.when(best["listed"], best["name"])
    verdict = F.struct("host", "path", rule.alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")).alias("url_verdict")
    return parts.withColumn("fits", fits).select(*[F.col(f"page.`{c}`").alias(c) for c in pages.columns if c != "url_verdict"], verdict)
