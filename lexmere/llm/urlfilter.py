"""URL filters: rules indexed by their rarest literal token; only rules that a URL's tokens fetch run their expression.

Two kinds of rules. A site rule is a host and the start of a path
(`example.com/en/`): it fits the host and its subdomains where the path starts
so, and the longest fitting one decides. A pattern is text over host and path
in which `*` is any run of characters and `^` one character that is no letter
or digit (or either end); where no site rule fits, any fitting pattern blocks.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are sent to every task; more than this many are refused.
MOST_RULES = 100_000

#: Patterns that block where no site rule fits: advertising, betting, pill, spam and adult hosts.
PATTERNS = ("^casino^", "^free^bets^", "^cheap^pills^", "^spam^farm^", "^ads^track^", "^adult^x^")

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_TOKEN = re.compile(r"[a-z0-9]+")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty if it is null or has no `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def site_tokens(rule: str) -> set[str]:
    """Tokens that any URL fitting a site rule has: runs of letters and digits that the rule itself closes."""
    low = rule.translate(_LOWER)
    return {m[0] for m in _TOKEN.finditer(low) if m.end() < len(low) or "/" not in low}


def pattern_tokens(pattern: str) -> set[str]:
    """The same for a pattern: runs closed by another literal character or `^` on both sides."""
    low = pattern.translate(_LOWER)
    return {m[0] for m in _TOKEN.finditer(low) if 0 < m.start() and m.end() < len(low) and "*" not in (low[m.start() - 1], low[m.end()])}


def site_expression(rule: str) -> re.Pattern:
    host, slash, path = rule.partition("/")
    return re.compile(rf"(?:[^/]*\.)?{re.escape(host.translate(_LOWER))}(?![^/]){re.escape(slash + path)}", re.S)


def pattern_expression(pattern: str) -> re.Pattern:
    said = {"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}
    return re.compile("".join(said.get(c, re.escape(c)) for c in pattern), re.S | re.I)


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each of the given tokens, counted over all rows; no more rows come back than rules have tokens."""
    lowered = F.translate(F.col(url_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)")))).alias("t"))
    return {r.t: r.n for r in seen.where(F.col("t").isin(sorted(tokens))).groupBy("t").agg(F.count("*").alias("n")).collect()} if tokens else {}


def judge(urls: DataFrame, sites: dict[str, str], patterns: Iterable[str] = PATTERNS, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict and pattern added, in one pass without a shuffle.

    sites: rule -> `allow` or `block`; the longest fitting rule decides, ties
    by the rule's text. Else the first fitting pattern (by its text) blocks and is named in
    `pattern`; else `allow`. Null URLs and those without `://` have empty host
    and path, which no rule fits: `allow`. Repeated rows stay; an empty table
    gives an empty result; columns of urls that have one of the added names
    are replaced.
    """
    patterns = sorted(set(patterns))
    if len(sites) + len(patterns) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    tokens = {**{("site", r): site_tokens(r) for r in sites}, **{("pattern", p): pattern_tokens(p) for p in patterns}}
    counts = token_counts(urls, url_col, set().union(*tokens.values()))
    index, always = defaultdict(list), []
    for rule, own in tokens.items():
        if own:
            index[min(own, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            always.append(rule)
    index = dict(index)
    schema = "host string, path string, rule string, verdict string, pattern string"

    @F.pandas_udf(schema)
    def judged(s):  # noqa: ANN001, ANN202
        import pandas as pd

        made: dict[tuple[str, str], re.Pattern] = {}
        rows = []
        for url in s:
            host, path = parts(url)
            rule, pattern, whole = None, None, host + path
            if host:
                fetched = [r for t in set(_TOKEN.findall(whole.translate(_LOWER))) for r in index.get(t, ())] + always
                fits = []
                for r in fetched:
                    if r not in made:
                        made[r] = site_expression(r[1]) if r[0] == "site" else pattern_expression(r[1])
                    if (made[r].match if r[0] == "site" else made[r].search)(whole):
                        fits.append(r)
                rule = max((r for k, r in fits if k == "site"), key=lambda r: (len(r), r), default=None)
                pattern = min((p for k, p in fits if k == "pattern"), default=None) if rule is None else None
            rows.append((host, path, rule, sites[rule] if rule is not None else "block" if pattern else "allow", pattern))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

    return urls.withColumn("_judged", judged(F.col(url_col).cast("string"))).withColumns({c: F.col(f"_judged.{c}") for c in ("host", "path", "rule", "verdict", "pattern")}).drop("_judged")
