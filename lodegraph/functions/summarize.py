"""Summaries: heuristic ones, prompts for a language model, and its answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import basename

# Fixed values
SOURCE_CHARS = 1200
CUT = "\n/* …（源码已截断）*/"
NOTHING = "无导出符号"


def file_summaries(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_id, file_summary): the file's name and its exported names, else all names, by start line, then node_id."""
    named = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "node_id", "name", "is_exported"))).alias("l"))
    exported = F.filter("l", lambda x: x["is_exported"])
    names = F.transform(F.when(F.size(exported) > 0, exported).otherwise(F.col("l")), lambda x: x["name"])
    out = files.join(named, "file_id", "left")
    return out.select("file_id", F.concat(basename(F.col("file_path")), F.lit(": "), F.coalesce(F.array_join(names, ", "), F.lit(NOTHING))).alias("file_summary"))


def node_summary(name: Column, signature: Column) -> Column:
    s = F.trim(F.coalesce(signature, F.lit("")))
    return F.when(s == "", name).otherwise(F.concat(name, F.when(s.startswith("("), "").otherwise(" "), s))


def embedding_text(name: Column, summary: Column) -> Column:
    return F.trim(F.concat_ws("\n", name, summary))


def file_embedding_text(path: Column, summary: Column) -> Column:
    s = F.trim(F.coalesce(summary, F.lit("")))
    return F.when(s == "", path).otherwise(s)

#: Fixed value: what stands around code
FENCE = "```"


def prompt(path: str, symbols: list[tuple[str, str, str]]) -> str:
    """symbols: (name, signature, source)."""
    blocks = [f"### {n}\n{s or '-'}\n" + (code if len(code) <= SOURCE_CHARS else code[:SOURCE_CHARS] + CUT) for n, s, code in symbols]
    wanted = json.dumps({"file_summary": "...", "nodes": [{"name": "...", "summary": "..."}]})
    return f"Summarise this file and each of its symbols in a sentence. Answer with JSON alone, in the form {wanted}, with every name below.\n\nFile: {path}\n\n" + "\n\n".join(blocks)


def parse_answer(raw: str) -> tuple[str, dict[str, str]]:
    """(file summary, name -> summary); ValueError for anything but the wanted object. A code fence around it is cut off."""
    begin = raw.find(FENCE)
    end = raw.find(FENCE, begin + len(FENCE)) if begin >= 0 else -1
    body = raw
    if end >= 0:
        body = raw[begin + len(FENCE) : end]
        body = body[4:] if body[:4].lower() == "json" else body  # the language after the fence
    try:
        data = json.loads(body.strip())
    except json.JSONDecodeError as e:
        raise ValueError(f"the answer is not JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("file_summary"), str):
        raise ValueError("the answer has no file_summary")
    nodes = data.get("nodes") if isinstance(data.get("nodes"), list) else []
    pairs = ((x.get("name"), x.get("summary")) for x in nodes if isinstance(x, dict))
    return data["file_summary"], {n: s for n, s in pairs if isinstance(n, str) and isinstance(s, str)}
