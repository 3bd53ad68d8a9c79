"""Text functions over source text and names, as Column functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_counts(text: Column) -> Column:
    """Physical, filled and comment lines; a line feed at the end begins one more, empty line."""
    lines = F.split(text, "\n")
    filled = F.filter(lines, lambda x: F.trim(x) != "")
    comments = F.filter(lines, lambda x: F.startswith(F.trim(x), F.lit("#")))
    return F.struct(F.size(lines).cast("long").alias("physical"), F.size(filled).cast("long").alias("filled"), F.size(comments).cast("long").alias("comments"))


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole text: ``*`` any text, ``?`` any character, ``[seq]`` and ``[!seq]`` one of a set or none of it.

    A bracket that is never closed stands for itself; line ends are characters like any other.
    """
    out, at = [], 0
    while at < len(pattern):
        ch = pattern[at]
        close = pattern.find("]", at + 2 + pattern.startswith("!", at + 1)) if ch == "[" else -1
        if close > 0:
            body = pattern[at + 1 : close]
            negated = body.startswith("!")
            members = "".join("\\" + x if x in "\\[]^&" else x for x in body[negated:])
            out.append(f"[{'^' * negated}{members}]")
            at = close + 1
            continue
        out.append(".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "_/ " or ord(ch) > 127 else "\\" + ch)
        at += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_pattern(pattern))


def version_key(version: Column) -> Column:
    """Parts between dots, each as its leading number (-1 without one) and the rest; a part without a rest comes after those with one, as a release after its candidates."""
    number = lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]{1,18}", 0).try_cast("long"), F.lit(-1))
    rest = lambda x: F.regexp_replace(x, "^[0-9]{1,18}", "")
    return F.transform(F.split(version, r"\."), lambda x: F.struct(number(x).alias("number"), (rest(x) == "").alias("final"), rest(x).alias("rest")))


def at_least_version(version: Column, least: str) -> Column:
    return version_key(version) >= version_key(F.lit(least))


def path_mutations(path: Column) -> Column:
    """Eight ways to write one path."""
    return F.array(
        path,
        F.lower(path),
        F.upper(path),
        F.concat(F.lit("./"), path),
        F.concat(F.lit("/"), path),
        F.replace(path, F.lit("/"), F.lit("\\")),
        F.concat(path, F.lit("/")),
        F.element_at(F.split(path, "/"), -1),
    )


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC-SHA256 as lower-case hex, out of two digests."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    block = raw.ljust(64, b"\0")
    inner, outer = bytearray(x ^ 0x36 for x in block), bytearray(x ^ 0x5C for x in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), text.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def scramble(name: Column, salt: str, kind: str) -> Column:
    return F.concat(F.lit(f"${kind}_"), F.substring(hmac_sha256(name, salt), 1, 8))


def scramble_words(text: Column, secret: Callable[[Column], Column], salt: str, kind: str = "SYM") -> Column:
    """``text`` with a token in place of every whole word that ``secret`` holds of; a longer word is never replaced in part."""
    pieces = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(secret(x), scramble(x, salt, kind)).otherwise(x)), "")


def masked(text: Column, hidden: str, plain: str) -> Column:
    """``text`` with all that the pattern ``hidden`` matches as blanks, of the same length and with the same line feeds.

    ``plain`` matches runs in which nothing hidden begins, so that most text is one piece.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{hidden})|(?:{plain})|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^(?:{hidden})$"), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def script_complexity(text: Column) -> Column:
    """1, and one for each branching keyword and question mark outside string literals and comments."""
    masked = F.regexp_replace(F.regexp_replace(text, '"[^"\\n]*"', '""'), "<!--[^>]*-->", "")
    return (1 + F.regexp_count(masked, F.lit(r"\b(if|for|while|case|catch)\b")) + F.regexp_count(masked, F.lit(r"\?"))).cast("long")
