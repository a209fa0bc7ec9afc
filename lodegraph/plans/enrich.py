"""Summaries by a language model, as a status machine over files and their nodes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.summarize import parse_answer, prompt
from lodegraph.operators.summary import pending_files
from lodegraph.plans.embed import HttpError
from lodegraph.runtime import checkpoint

ANSWER = "file_id long, file_summary string, names array<string>, texts array<string>, status string"


def answers(files: DataFrame, nodes: DataFrame, ask: Callable[[str], str], concurrency: int = 5) -> DataFrame:
    """One row a pending file: its summary and its nodes', or status error. At most `concurrency` files are asked about at once."""
    symbols = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "node_id", "name", "signature", "source_code"))).alias("symbols"))
    work = pending_files(files).select("file_id", "file_path").join(symbols, "file_id", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for file_id, path, found in zip(pdf["file_id"], pdf["file_path"], pdf["symbols"]):
                try:
                    text, named = parse_answer(ask(prompt(path, [(s["name"], s["signature"] or "", s["source_code"] or "") for s in (found if found is not None else [])])))
                    rows.append((file_id, text, list(named), list(named.values()), "done"))
                except (ValueError, HttpError):
                    rows.append((file_id, None, [], [], "error"))
            yield pd.DataFrame(rows, columns=["file_id", "file_summary", "names", "texts", "status"])

    return work.repartition(concurrency).mapInPandas(run, ANSWER)


def summarize(files: DataFrame, nodes: DataFrame, ask: Callable[[str], str], model: str, concurrency: int = 5) -> tuple[DataFrame, DataFrame]:
    """(files, nodes) with the answers for pending files. All nodes of an answered file are done; those without a text in the answer have a null summary, so they are never embedded."""
    got = checkpoint(answers(files, nodes, ask, concurrency))  # each question is asked once
    f = files.join(got.select("file_id", F.col("file_summary").alias("_t"), F.col("status").alias("_s")), "file_id", "left")
    asked = F.col("_s").isNotNull()
    values = {"file_summary": F.when(F.col("_s") == "done", F.col("_t")).otherwise(F.col("file_summary")), "summary_status": F.coalesce("_s", "summary_status"), "summary_model": F.when(asked, model).otherwise(F.col("summary_model"))}
    f = f.select(*[values.get(c, F.col(c)).alias(c) for c in files.columns])
    each = got.filter("status = 'done'").select("file_id", F.explode(F.arrays_zip("names", "texts")).alias("x")).select("file_id", F.col("x.names").alias("name"), F.col("x.texts").alias("_t"))
    n = nodes.join(got.select("file_id", F.col("status").alias("_s")), "file_id", "left").join(each, ["file_id", "name"], "left")
    values = {"summary": F.when(F.col("_s") == "done", F.col("_t")).otherwise(F.col("summary")), "summary_status": F.coalesce("_s", "summary_status"), "summary_model": F.when(asked, model).otherwise(F.col("summary_model"))}
    return f, n.select(*[values.get(c, F.col(c)).alias(c) for c in nodes.columns])
