"""Source trees: which files are read, and as what."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import extension

#: Endings of each language
LANGUAGES = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi"),
    "go": (".go",),
    "java": (".java",),
}


def glob_regex(glob: str) -> str:
    """A glob over POSIX paths as a regular expression: ** crosses folders, * and ? don't, {a,b} is a choice."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(glob_regex, glob[i + 1 : end].split(","))) + ")", end + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def ignore_regexes(text: str) -> list[tuple[bool, str]]:
    """.gitignore rules as (negated, regular expression), in order; .git is always out."""
    out = [(False, r"(?:.*/)?\.git(?:/.*)?")]
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        body = glob_regex(rule.strip("/"))
        out.append((negated, ("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?")))
    return out


def ignored(path, rules: list[tuple[bool, str]]):
    """Column: the last rule that matches decides."""
    out = F.lit(False)
    for negated, rule in rules:
        out = F.when(path.rlike(f"^{rule}$"), F.lit(not negated)).otherwise(out)
    return out


def language(path):
    e = extension(path)
    out = F.lit(None).cast("string")
    for name, endings in LANGUAGES.items():
        out = F.when(e.isin(*endings), name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = (), gitignore: str = "", only_paths: DataFrame | None = None) -> DataFrame:
    """(file_path, language, source_code, hash) of the text files of known languages below root.

    Filters on paths come before contents are read; dotfiles, ignored files and files with a NUL byte are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/")) if "://" not in root.removeprefix("file://") else re.escape(root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^.*?{prefix}/", "")
    files = files.withColumn("file_path", path)
    any_of = lambda globs: "^(?:" + "|".join(map(glob_regex, globs)) + ")$"
    keep = F.col("file_path").rlike(any_of(include)) & ~F.col("file_path").rlike(r"(^|/)\.")
    if exclude:
        keep = keep & ~F.col("file_path").rlike(any_of(exclude))
    files = files.filter(keep & ~ignored(F.col("file_path"), ignore_regexes(gitignore))).withColumn("language", language(F.col("file_path"))).filter("language IS NOT NULL")
    if only_paths is not None:
        files = files.join(only_paths.select("file_path").distinct(), "file_path", "left_semi")
    text = files.select("file_path", "language", F.decode("content", "UTF-8").alias("source_code"))
    return text.filter(F.instr("source_code", "\0") == 0).withColumn("hash", F.sha2("source_code", 256))
