"""Parsing as a dataflow: files (file_path, language, source_code) to DataFrames of facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.parse.facts import CALLS, IMPORTS, REFS, SYMBOLS, Facts, adapter

KINDS = {"symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS, "refs": REFS}


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in _fields(ddl)) + ">"


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def rows(path: str, f: Facts) -> dict[str, list[tuple]]:
    return {
        "symbols": [(path, s.name, s.kind, s.signature, s.start, s.end, s.exported, s.default, s.source, s.extends, s.implements, i) for i, s in enumerate(sorted(f.symbols, key=lambda s: not s.exported))],
        "imports": [(path, i.module, i.kind, [{"imported": a, "local": b} for a, b in i.bindings], i.line) for i in f.imports],
        "calls": [(path, *c) for c in f.calls],
        "refs": [(path, *r) for r in f.refs],
    }


PARSED = "file_path string, " + ", ".join(f"{k} array<{_struct(v)}>" for k, v in KINDS.items())


def parse(files: DataFrame) -> DataFrame:
    """One row a file of a known language: file_path and its arrays of symbols, imports, calls and refs; empty ones if it can't be parsed."""
    names = {k: [p.split(" ", 1)[0] for p in _fields(v)] for k, v in KINDS.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for path, language, source in zip(pdf["file_path"], pdf["language"], pdf["source_code"]):
                reader = adapter(language)
                try:
                    found = rows(path, reader.parse(path, source)) if reader else None
                except (SyntaxError, IndexError, StopIteration, ValueError, RecursionError):
                    found = {k: [] for k in KINDS}
                if found is not None:
                    out.append((path, *([dict(zip(names[k], r)) for r in found[k]] for k in KINDS)))
            yield pd.DataFrame(out, columns=["file_path", *KINDS])

    return files.select("file_path", "language", "source_code").mapInPandas(run, PARSED)


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.select(F.explode(kind).alias("f")).select("f.*")
