r"""Operator 11, URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression over host and path, and has literal tokens: runs of letters and digits that any
URL it fits must hold whole.  Spark counts in how many URLs each of these occurs, and the rule is listed under the
rarest.  A URL's tokens fetch the rules listed under them; only those run their regular expressions, the best rule first.
Rules without a whole token are fetched by every URL.

There are two kinds of rules:

* ``site``: a host and the beginning of a path.  It fits the host and all its subdomains, if the URL's path starts with the rule's;
* ``pattern``: looked for anywhere in host and path, whatever the case of A-Z.  ``*`` stands for any characters, ``^`` for a separator
  (no letter or digit of ASCII, or an end), everything else for itself.  All patterns match in time linear in the URL.

The longest site rule that fits decides; without one, the longest pattern; without one, ``default``.  Rules of equal length
go by the longer host, then by text, then block before allow.

Rules are broadcast in waves of at most ``wave_bytes`` of text, each a pass over the URLs that carries the best rule found so far, so their
number has no bound.  URLs are never shuffled.

Defined results: the host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path goes on
up to ``?``, ``#`` or the end.  Null URLs and those without ``://`` have empty hosts and paths.  Every row of the input gives a row, repeated ones
too; an empty table gives none.  Columns that are kept come first; a result column whose name is taken gets underscores at its end.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import unused
from .store import materialize

_TOKEN = re.compile("[A-Za-z0-9]+")
_WORD = "[A-Za-z0-9]"
_FOUND = T.StructType([T.StructField("rank", T.LongType()), T.StructField("site", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("verdict", T.StringType())])


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    #: The length of the host at the text's beginning; None for a pattern.
    host: int | None = None

    @cached_property
    def regex(self) -> re.Pattern:
        """Matches (from the start) the host and path of URLs that the rule fits."""
        if self.host is None:
            parts = [_segment(s) for s in self.text.split("*") if s]
            return re.compile("".join(rf"(?>[\s\S]*?{p})" for p in parts), re.IGNORECASE | re.ASCII)
        host, path = re.escape(self.text[: self.host]), re.escape(self.text[self.host :]) or r"(?=/|\Z)"
        return re.compile((rf"(?:[^/]*\.)?{host}" if host else "[^/]*") + path)

    @cached_property
    def tokens(self) -> list[str]:
        """Tokens, in lower case, that every URL of the rule holds whole."""
        out = []
        for m in _TOKEN.finditer(self.text):
            before, after = self.text[m.start() - 1 : m.start()], self.text[m.end() : m.end() + 1]
            if self.host is None:  # the ends of a pattern, and stars, may stand for letters
                whole = before not in ("", "*") and after not in ("", "*")
            else:
                whole = (m.start() == 0 or bool(before)) and (bool(after) or m.end() == self.host)
            if whole:
                out.append(m.group().lower())
        return out

    @cached_property
    def order(self) -> tuple:
        return self.host is None, -len(self.text), -(self.host or 0), self.text, self.verdict != "block"


def _segment(text: str) -> str:
    """What stands between two stars: separators at its ends look around, those within take a character."""
    out = []
    for i, c in enumerate(text):
        if c != "^":
            out.append(re.escape(c))
        elif i == 0:
            out.append(f"(?<!{_WORD})")
        elif i == len(text) - 1:
            out.append(f"(?!{_WORD})")
        else:
            out.append("[^A-Za-z0-9]")
    return "".join(out)


def site_rule(verdict: str, site: str) -> Rule:
    """A rule such as ``example.com/en/``; the host, in lower case, ends where the path begins."""
    host, slash, path = site.partition("/")
    return Rule(verdict, host.lower() + slash + path, len(host))


def pattern_rule(verdict: str, text: str) -> Rule:
    return Rule(verdict, text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, in lower case, and the path of a URL; see the module's text."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def token_counts(addresses: DataFrame, column: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many rows each of ``tokens`` occurs; the others' rows stop at the join, and counts are summed before they are shuffled."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    listed = addresses.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    lowered = F.translate(F.col(column), string.ascii_uppercase, string.ascii_lowercase)
    each = addresses.select(F.explode(F.array_distinct(F.split(lowered, "[^a-z0-9]+"))).alias("token"))
    counted = each.join(F.broadcast(listed), "token").groupBy("token").count()  # no larger than the rules of a wave
    return {r["token"]: r["count"] for r in counted.collect()}


def index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """The numbers of the rules by rarest token (ties: the longest, then the least), and of those without one."""
    by_token: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return by_token, always


def candidates(address: str, by_token: dict[str, list[int]], always: list[int]) -> list[int]:
    """The rules that a URL's tokens fetch, the best first."""
    out = set(always)
    for t in _TOKEN.findall(address):
        out.update(by_token.get(t.lower(), ()))
    return sorted(out)


def _finder(shared):
    @F.arrow_udf(_FOUND)
    def find(addresses: pa.Array) -> pa.Array:
        first, rules, by_token, always = shared.value
        found = []
        for address in addresses.to_pylist():
            hit = next((i for i in candidates(address, by_token, always) if rules[i].regex.match(address)), None)
            found.append(None if hit is None else {"rank": first + hit, "site": rules[hit].host is not None, "text": rules[hit].text, "verdict": rules[hit].verdict})
        return pa.array(found, pa.struct([("rank", pa.int64()), ("site", pa.bool_()), ("text", pa.string()), ("verdict", pa.string())]))

    return find


def _waves(rules: Sequence[Rule], wave_bytes: int) -> list[list[Rule]]:
    out: list[list[Rule]] = []
    room = 0
    for rule in rules:
        size = 64 + 4 * len(rule.text)
        if size > room:
            out.append([])
            room = max(wave_bytes, size)
        out[-1].append(rule)
        room -= size
    return out


def judge(urls: DataFrame, rules: Iterable[Rule], *, url_column: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow", wave_bytes: int = 16 << 20) -> DataFrame:
    """``keep``, then host, path, rule (of the site rule that fits, or null), pattern (of the pattern that decides, or null) and verdict."""
    spark = urls.sparkSession
    host, path = host_and_path(F.col(f"`{url_column}`"))
    address, best, at, to = (unused(n, urls) for n in ("address", "best", "at_host", "at_path"))
    kept = [F.col(f"`{c}`") for c in keep]
    rows = urls.select(*kept, host.alias(at), path.alias(to))
    rows = rows.withColumn(address, F.concat(F.coalesce(at, F.lit("")), F.coalesce(to, F.lit(""))))
    rows = rows.withColumn(best, F.lit(None).cast(_FOUND))
    first = 0
    waves = _waves(sorted(set(rules), key=lambda r: r.order), wave_bytes)
    for wave in waves:
        by_token, always = index(wave, token_counts(rows, address, (t for r in wave for t in r.tokens)))
        find = _finder(spark.sparkContext.broadcast((first, wave, by_token, always)))
        # waves go from the best rule to the last, so what an earlier one found stays
        rows = rows.withColumn(best, F.coalesce(best, find(F.col(address))))
        if len(waves) > 1:
            rows = materialize(rows, "url-wave")
        first += len(wave)
    names = [unused(n, urls.select(*kept)) for n in ("host", "path", "rule", "pattern", "verdict")]
    site = F.col(f"{best}.site")
    values = (
        F.coalesce(at, F.lit("")),
        F.coalesce(to, F.lit("")),
        F.when(site, F.col(f"{best}.text")),
        F.when(~site, F.col(f"{best}.text")),
        F.coalesce(F.col(f"{best}.verdict"), F.lit(default)),
    )
    return rows.select(*kept, *(v.alias(n) for v, n in zip(values, names, strict=True)))
