"""URL filters: rules indexed by their rarest literal token, so that a URL runs only the few expressions its tokens fetch.

Two kinds of rule. Site rules are ``host/path`` with a verdict; one fits its host and all subdomains where the path of the
URL starts with the rule's, and of those that fit the longest wins (equal lengths: the longer host, then the smaller
text). Patterns judge the URLs that no site rule fits: ``||`` stands for the start of a host label, ``|`` for an end of
the URL, ``^`` for a separator or the end, ``*`` for anything; a URL is blocked where a blocking pattern and no
allowing one is found in it, and allowed otherwise.

Every rule is a regular expression with the literal tokens (runs of ``a-z0-9``) that each text it fits must hold whole.
The rarest of them, counted over all URLs, is its place in the index; rules without a token are candidates of every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lokalith.llm.shared import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")
#: Patterns of the default filter, each with its verdict.
PATTERNS = [
    ("||adult-", "block"), ("||xxx.", "block"), ("||free-bets.", "block"), ("||casino.", "block"), ("||spam-farm.", "block"),
    ("/wp-login.php|", "block"), ("^phpsessid=*", "block"), (".exe|", "block"), ("/cgi-bin/*?*=", "block"), ("|ftp://", "block"),
    ("/wp-login.php?action=help^", "allow"), ("||casino.*/history/", "allow"),
]
#: A compiled index of at most so many bytes is broadcast; a larger one meets the URLs' tokens in a shuffled join.
BROADCAST_BYTES = 32 << 20
_END = r"(?![\s\S])"
_RULE = "kind string, rule string, verdict string, regex string, tokens array<string>, bytes int"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    return F.translate(_part(url, r"\A([^/?#]*)"), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _part(url, r"\A[^/?#]*([^?#]*)")


def _part(url: Column, regex: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), regex, 1)).otherwise("")


def site_regex(rule: str) -> str:
    """Of ``host/path``, over ``host + path`` of a URL."""
    host, slash, path = rule.partition("/")
    if not host or not slash:
        raise ValueError(f"site rule without host or path: {rule!r}")
    return r"\A(?:[^/]*\.)?" + re.escape(host.translate(str.maketrans(_UPPER, _LOWER))) + re.escape(slash + path)


def pattern_regex(pattern: str) -> str:
    """Of a pattern, over the URL with A-Z lower-cased."""
    start, body, end = _anchors(pattern)
    inner = "".join({"*": r"[\s\S]*", "^": rf"(?:[^a-z0-9_.%-]|{_END})"}.get(x) or re.escape(x) for x in re.split(r"([*^])", body) if x)
    return {"||": r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", "|": r"\A", "": ""}[start] + inner + (_END if end else "")


def _anchors(pattern: str) -> tuple[str, str, bool]:
    start = "||" if pattern.startswith("||") else "|" if pattern.startswith("|") else ""
    body = pattern[len(start) :].translate(str.maketrans(_UPPER, _LOWER))
    return start, body.removesuffix("|"), body.endswith("|")


def literal_tokens(pattern: str, site: bool = False) -> list[str]:
    """Tokens that every text which the rule fits holds whole: both their ends are separators, anchors or other literals."""
    start, body, end = ("||", pattern.translate(str.maketrans(_UPPER, _LOWER)), False) if site else _anchors(pattern)
    pieces = [body] if site else re.split(r"([*^])", body)
    out = set()
    for k, piece in enumerate(pieces):
        if not site and piece in ("*", "^"):
            continue
        closed_left = bool(start) if k == 0 else pieces[k - 1] == "^"
        closed_right = end if k == len(pieces) - 1 else pieces[k + 1] == "^"
        out |= {m.group() for m in _TOKEN.finditer(piece) if (m.start() > 0 or closed_left) and (m.end() < len(piece) or closed_right)}
    return sorted(out)


def compiled(rules: DataFrame) -> DataFrame:
    """``rules(kind, rule, verdict)`` with their expressions and tokens; ``kind`` is ``site`` or ``pattern``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                site = kind == "site"
                regex, tokens = site_regex(rule) if site else pattern_regex(rule), literal_tokens(rule, site)
                rows.append((kind, rule, verdict, regex, tokens, len(rule.encode()) + len(regex.encode()) + 100))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in _RULE.split(", ")])

    return rules.select("kind", "rule", "verdict").distinct().mapInArrow(run, _RULE)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; A-Z count as lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(url, _UPPER, _LOWER), F.lit(r"[a-z0-9]+"), F.lit(0)))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules with ``token``, the one of theirs that the fewest of ``urls(url)`` hold (ties: the smallest), '' without one."""
    wanted = rules.select("kind", "rule", "verdict", F.explode_outer("tokens").alias("token"))
    known = wanted.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # added up before any join
    counts = seen.join(known, "token", "left_semi")
    rarest = wanted.join(counts, "token", "left").groupBy("kind", "rule", "verdict").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    return rules.drop("tokens").join(rarest.select("kind", "rule", "verdict", F.coalesce("r.token", F.lit("")).alias("token")), ["kind", "rule", "verdict"])


def _order(rule: str) -> tuple:
    return -len(rule), -rule.find("/"), rule


def _looked_up(index: Iterable) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for r in index:
        out.setdefault(r["token"], []).append((r["kind"], r["rule"], r["verdict"], r["regex"]))
    return out


_FOUND = StructType().add("rule", StringType()).add("rule_verdict", StringType()).add("pattern", StringType()).add("pattern_verdict", StringType())


def _by_broadcast(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` by one pass without a shuffle; the index is small, as the caller has checked."""
    held = urls.sparkSession.sparkContext.broadcast(_looked_up(index.collect()))

    @F.arrow_udf(_FOUND)
    def found(url: pa.Array, address: pa.Array) -> pa.Array:
        rules, out = held.value, []
        for u, a in zip(url.to_pylist(), address.to_pylist(), strict=True):
            low = (u or "").translate(_TABLE)
            fits = [r for token in {"", *_TOKEN.findall(low)} for r in rules.get(token, ()) if re.search(r[3], a if r[0] == "site" else low)]
            sites, patterns = [r for r in fits if r[0] == "site"], [r for r in fits if r[0] == "pattern"]
            site = min(sites, key=lambda r: (*_order(r[1]), r[2]), default=(None,) * 4)
            pattern = min(patterns, key=lambda r: (r[2], r[1]), default=(None,) * 4)
            out.append({"rule": site[1], "rule_verdict": site[2], "pattern": pattern[1], "pattern_verdict": pattern[2]})
        return pa.array(out, pa.struct([(f.name, pa.string()) for f in _FOUND]))

    return urls.withColumn("found", found("url", "address"))


_TABLE = str.maketrans(_UPPER, _LOWER)


def _by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` for an index of any size: tokens of distinct URLs meet the index in a shuffled join that adaptive
    execution splits, the expressions run on what meets, and the best rules are picked by partial aggregation."""
    distinct = urls.groupBy("url", "address").agg(F.count(F.lit(1)).alias("n"))
    tokens = distinct.select("url", "address", F.explode(F.array_append(url_tokens(F.coalesce("url", F.lit(""))), F.lit(""))).alias("token"))
    subject = F.when(F.col("kind") == "site", F.col("address")).otherwise(F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER))
    fits = tokens.join(index.hint("merge"), "token").where(F.regexp_like(subject, F.col("regex")))
    site, slash = F.col("kind") == "site", F.instr("rule", "/")
    best = fits.groupBy("url").agg(
        F.min(F.when(site, F.struct(-F.length("rule"), -slash, F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))).alias("s"),
        F.min(F.when(~site, F.struct(F.col("verdict").alias("verdict"), F.col("rule").alias("rule")))).alias("p"),
    )
    told = best.select(F.col("url").alias("_url"), F.struct(F.col("s.rule").alias("rule"), F.col("s.verdict").alias("rule_verdict"), F.col("p.rule").alias("pattern"), F.col("p.verdict").alias("pattern_verdict")).alias("found"))
    return urls.join(told, F.col("url").eqNullSafe(F.col("_url")), "left").drop("_url")


def rules_of(spark, sites: Iterable[tuple[str, str]], patterns: Iterable[tuple[str, str]] = PATTERNS) -> DataFrame:
    """A rule table from pairs of text and verdict."""
    return spark.createDataFrame([("site", *r) for r in sites] + [("pattern", *r) for r in patterns], "kind string, rule string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, pattern``.

    ``rules(kind, rule, verdict)`` may be of any size; verdicts are ``block`` or ``allow``. ``rule`` is the site rule that
    wins, ``pattern`` the pattern that decides where none fits (the smallest that allows, else the smallest that
    blocks), both null where there is none. An empty or null URL has an empty host and path and is allowed unless an unanchored
    pattern fits the empty text. Columns of ``pages`` with the names of the results are replaced. Without rules
    everything is allowed. Repeated rows are judged alike, none is dropped.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    index = materialise(indexed(compiled(rules), pages.select(F.col(url).cast("string").alias("url"))), "urlrules")
    size = index.agg(F.sum(F.col("bytes") + F.octet_length("token"))).head()[0] or 0
    asked = pages.select(F.struct(*[F.col(c) for c in kept]).alias("own"), F.col(url).cast("string").alias("url"))
    asked = asked.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).fillna("", ["host", "path"])
    asked = asked.withColumn("address", F.concat("host", "path"))
    told = _by_broadcast(asked, index) if size <= broadcast_bytes else _by_join(asked, index)
    verdict = F.coalesce("found.rule_verdict", "found.pattern_verdict", F.lit("allow"))
    pattern = F.when(F.col("found.rule").isNull(), F.col("found.pattern"))
    return told.select("own.*", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))
