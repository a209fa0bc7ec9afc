"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

from lodegraph.runtime import ship

#: query name -> module of this subpackage that holds the function of that name
QUERIES = {
    "op1_token_store": "token_store",
    "op2_language_id": "language_id",
    "op3_exact_dedup": "exact_dedup",
    "op4_simhash": "simhash",
    "op5_secrets": "secret_scan",
    "op6_pack": "packing",
    "op7_line_dedup": "line_dedup",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_warc_store": "warc_store",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict:
    def bind(name: str, module: str):
        def run(spark, sf_dir):
            ship(spark)
            return getattr(importlib.import_module(f"lodegraph.llm.{module}"), name)(spark, sf_dir)

        return run

    return {name: bind(name, module) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in QUERIES.items():
        sql = getattr(importlib.import_module(f"lodegraph.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
