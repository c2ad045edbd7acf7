"""URL filters by pattern rules, indexed by their rarest literal token.

A rule is a regular expression over the url's canonical form (host, a zero character, path) with the tokens that any match must
hold.  The index lists each rule under its token that the fewest urls have (counted over all urls, rule tokens only).  The
tokens of a url fetch the candidates, and only their expressions run.  Of the placed rules (host and path) that fit, the
longest gives the verdict; else a pattern that fits blocks; else the url is allowed.

Rules are parameters, not data.  They are sent to all executors in blocks of at most ``MOST``, each block a pass that improves on
what the ones before found, without a shuffle; any number of rules works.  Defined cases: a null url, or one without ``://``,
has an empty host and path and is judged by these; repeated rows are judged one by one; urls of any length work; a rule without
any token is a candidate for every url; of placed rules of one length the greater name wins; without rules all is allowed; an
empty table gives an empty result; ids may be of any type, null or repeated; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 200_000
TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``name``: what is reported, with the length that decides; None for a pattern of the method itself."""

    name: str | None
    verdict: str
    expression: str
    tokens: tuple[str, ...]

    @staticmethod
    def placed(host: str, path: str, verdict: str) -> Rule:
        """For a host, all its subdomains, and paths that start with ``path``.  A path's last token counts only if something ends it."""
        whole = TOKEN.findall(host) + TOKEN.findall(path[: len(path) - len(re.search(r"[a-z0-9]*$", path)[0])].translate(LOWER))
        return Rule(host + path, verdict, rf"(?:^|^[^\x00]*\.){re.escape(host)}\x00{re.escape(path)}", tuple(whole))

    @staticmethod
    def blocked(expression: str, *tokens: str) -> Rule:
        return Rule(None, "block", expression, tokens)


#: The rules of the query.
PLACED = [
    Rule.placed("com", "/", "allow"),
    Rule.placed("example.com", "/en/", "block"),
    Rule.placed("www.example.com", "/en/", "allow"),
    Rule.placed("net", "/es/", "block"),
    Rule.placed("net", "/fr/", "block"),
]
#: Host labels of spam, adverts, gambling and adult sites.
PATTERNS = [
    Rule.blocked(r"(?:^|\.)cheap-pills\.[^\x00]*\x00", "cheap", "pills"),
    Rule.blocked(r"(?:^|\.)spam-farm\.[^\x00]*\x00", "spam", "farm"),
    Rule.blocked(r"(?:^|\.)free-bets\.[^\x00]*\x00", "free", "bets"),
    Rule.blocked(r"(?:^|\.)casino(?:-[a-z]+)?\.[^\x00]*\x00", "casino"),
    Rule.blocked(r"(?:^|\.)adult(?:-[a-z]+)?\.[^\x00]*\x00", "adult"),
    Rule.blocked(r"(?:^|\.)ads(?:-[a-z]+)?\.[^\x00]*\x00", "ads"),
]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


#: The best placed rule so far and its verdict, and whether a pattern blocks.
Found = tuple[str | None, str | None, bool]


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.rules, self.compiled = rules, {}
        for k, rule in enumerate(rules):
            token = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)) if rule.tokens else ""
            self.by_token.setdefault(token, []).append(k)

    def fits(self, host: str, path: str) -> list[Rule]:
        canonical = f"{host}\x00{path}"
        out = []
        for token in {"", *TOKEN.findall(canonical.translate(LOWER))}:
            for k in self.by_token.get(token, ()):
                if k not in self.compiled:
                    self.compiled[k] = re.compile(self.rules[k].expression)
                if self.compiled[k].search(canonical):
                    out.append(self.rules[k])
        return out

    def best(self, host: str, path: str, known: Found = (None, None, False)) -> Found:
        """The longest placed rule that fits and its verdict, and whether a pattern blocks; better than or as ``known``."""
        found = self.fits(host, path)
        named = max(((len(r.name), r.name, r.verdict) for r in found if r.name is not None), default=None)
        rule, verdict, blocked = known
        if named and (rule is None or named[:2] > (len(rule), rule)):
            rule, verdict = named[1:]
        return rule, verdict, blocked or any(r.name is None and r.verdict == "block" for r in found)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        return decided(self.best(host, path))


def decided(found: Found) -> tuple[str | None, str]:
    rule, verdict, blocked = found
    return (rule, verdict) if rule is not None else (None, "block" if blocked else "allow")


def token_counts(urls: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """In how many urls each of ``tokens`` stands; only the rules' own tokens reach the driver."""
    known = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    split = urls.select(F.explode(F.array_distinct(F.split(F.lower(url_col), "[^a-z0-9]+"))).alias("token"))
    return {r["token"]: r["n"] for r in split.join(F.broadcast(known), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    send = pages.sparkSession.sparkContext.broadcast
    counts = token_counts(pages, {t for r in rules for t in r.tokens}, url_col)
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "host", "path", "rule", "verdict", "blocked"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = zip(*map(parts, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((hosts, paths, none, none, [False] * batch.num_rows), kinds, strict=True))], names=names)

    def one_pass(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                hosts, paths, *known = (batch.column(x).to_pylist() for x in names[1:])
                found = [own.best(h, p, k) for h, p, k in zip(hosts, paths, zip(*known, strict=True), strict=True)]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, t) for x, t in zip(columns, kinds[2:], strict=True))], names=names)

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [decided(x) for x in zip(*(batch.column(n).to_pylist() for n in names[3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([e[k] for e in ends], pa.string()) for k in (0, 1))], names=[id_col, "host", "path", "rule", "verdict"])

    schema = f"id {kind}, host string, path string, rule string, verdict string, blocked boolean"
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(split, schema)
    for at in range(0, len(rules), MOST):
        rows = rows.mapInArrow(one_pass(send(Index(rules[at : at + MOST], counts))), schema)
    return rows.mapInArrow(finish, f"{id_col} {kind}, host string, path string, rule string, verdict string")
