"""Column builders and plain helpers for text."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: shortest token that the trigram index can find
TRIGRAM = 3
TOKEN = r"[\p{L}\p{N}_]+"


def fold_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_ascii_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def tokenize(query: str) -> list[str]:
    return re.findall(r"\w+", query)


def tokens(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0))


def match_expr(query: Column) -> Column:
    """Quoted tokens of three characters and more joined by OR; null if there is none."""
    long = F.filter(tokens(query), lambda t: F.length(t) >= TRIGRAM)
    return F.when(F.size(long) > 0, F.array_join(F.transform(long, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def contains_folded(c: Column, token: str) -> Column:
    """Substring test that folds ASCII letters only."""
    return F.coalesce(F.instr(fold_ascii(c), fold_ascii_text(token)) > 0, F.lit(False))


def occurrences(c: Column, token: str) -> Column:
    """How often token (in lower case) starts in c, overlaps included."""
    overlaps = any(token[i:] == token[: len(token) - i] for i in range(1, len(token)))
    if not overlaps:
        return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("long")
    last = F.length(c) - len(token) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.substring(c, i, F.lit(len(token))) == token)).cast("long")


def norm_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names without one or with a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def normalize_path(path: str) -> str:
    """Fold . and .. in a relative POSIX path."""
    out = posixpath.normpath(path)
    return "" if out == "." else out


def identifier(c: Column) -> Column:
    """Quotes and brackets off, the last dotted part."""
    return F.element_at(F.split(F.regexp_replace(F.trim(c), r"[\"'`\[\]]", ""), r"\."), -1)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
