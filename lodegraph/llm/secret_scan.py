"""Secret scans: broad candidate search, and a random forest that removes false positives.

Candidates are runs of token characters with letters and digits and at least `MIN_RUN` characters, and values assigned to
a word like password or token. The forest (forest.py) sees a candidate's length, its characters and the transitions
between their kinds, how much of it a dictionary covers, its path (the source) and the words beside it. It is trained
from labelled findings: (before, value, after, path, label) tuples, the caller's or the generated ones of `labelled`.
The dictionary has the `DICTIONARY_WORDS` most frequent words of all documents.

Places are UTF-8 bytes. Null text has no findings, a null path is an empty one. Every row is scanned, repeated rows,
too. Overlapping candidates are one, the longer. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import table
from lodegraph.llm.forest import Forest

MIN_RUN, CONTEXT = 14, 60
DICTIONARY_WORDS = 3000
#: How well-known credentials begin, words beside secrets, words beside look-alikes, paths of examples
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"xoxb-", b"xoxp-", b"sk-", b"sk_live_", b"AIza", b"eyJ", b"glpat-", b"npm_")
BESIDE = re.compile(rb"(?i)password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth")
DECOY = re.compile(rb"(?i)example|sample|dummy|placeholder|changeme|your[_-]|sha-?\d|checksum|digest|commit|md5|uuid|version|mail|http|www|page|isbn|phone|order|invoice|x{4,}|0{6,}")
EXAMPLE_PATH = re.compile(r"(?i)test|example|sample|doc|fixture|readme")
ASSIGNED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}$")
SIGN = re.compile(rb"[=:]")
VALUE = re.compile(rb"\s{0,3}[\"']?([^\s\"'<>;,]{6,})")

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 other token character
for _k, _chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b"_+/=-.")):
    _KIND[list(_chars)] = _k


def candidates(text: bytes) -> list[tuple[int, int]]:
    a = _KIND[np.frombuffer(text, np.uint8)]
    inside = np.concatenate([[False], a > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    found = set()
    if len(starts):
        digits = np.concatenate([[0], np.cumsum(a == 3)])
        letters = np.concatenate([[0], np.cumsum((a == 1) | (a == 2))])
        ok = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
        for s, e in zip(starts[ok].tolist(), ends[ok].tolist()):
            cut = max(text.rfind(b"=", s, e - 6), text.rfind(b"/=", s, e - 6)) + 1  # name=value
            found.add((cut if cut > s and e - cut >= 6 else s, e))
    done = 0
    for sign in SIGN.finditer(text):
        at = sign.start()
        # signs within the last value would give shorter ones that overlap it
        if at >= done and ASSIGNED.search(text, max(0, at - 20), at) and (m := VALUE.match(text, at + 1)):
            found.add(m.span(1))
            done = m.end(1)
    kept: list[tuple[int, int]] = []  # in order, none overlaps another
    for span in sorted(found, key=lambda x: (x[0] - x[1], x)):
        i = bisect_left(kept, span)
        if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or span[1] <= kept[i][0]):
            kept.insert(i, span)
    return kept


def features(before: bytes, value: bytes, after: bytes, path: str, dictionary: frozenset[bytes]) -> list[float]:
    n = len(value)
    kinds = _KIND[np.frombuffer(value, np.uint8)]
    share = [float((kinds == k).mean()) for k in (1, 2, 3, 4)]
    turns = float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    covered = 0
    for run in re.findall(rb"[A-Za-z]+", value.lower()):
        i = 0
        while i < len(run):
            step = next((k for k in range(min(14, len(run) - i), 3, -1) if run[i : i + k] in dictionary), 0)
            covered += step
            i += step or 1
    hexed = float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None)
    repeat = max(counts.values()) / n
    near = before[-24:]
    return [
        n, *share, turns, entropy, entropy / max(1.0, math.log2(n) if n > 1 else 1.0), covered / n, hexed, repeat,
        float(value.startswith(PREFIXES)), float(BESIDE.search(near) is not None), float(re.search(rb"[=:]\s*[\"']?$", before) is not None),
        float(DECOY.search(before[-CONTEXT:]) is not None or DECOY.search(after[:24]) is not None), float(DECOY.search(value) is not None), float(EXAMPLE_PATH.search(path or "") is not None),
        float(b"." in value[1:-1]), float(before[-1:] == b"@" or after[:1] == b"@" or b"/" in value[:8]),
    ]


def labelled(n: int = 700, seed: int = 3) -> list[tuple[bytes, bytes, bytes, str, int]]:
    """Generated findings, half of them secrets: (before, value, after, path, label)."""
    g = random.Random(seed)
    of = lambda chars, k: "".join(g.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(g.choice(["th", "en", "er", "ing", "on", "re", "st", "ea", "in", "ou", "ti", "ly", "de", "es"]) for _ in range(g.randint(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    quote = lambda: g.choice(["", '"', "'"])
    out = []
    for _ in range(n):
        q = quote()
        before, value = g.choice(
            [
                (f"{prose(4)} ", "AKIA" + of(up + dig, 16)),
                (f"{prose(3)} token = {q}", of("0123456789abcdef", g.choice([32, 40, 64]))),
                (f"{prose(3)} TOKEN = {q}", of("0123456789ABCDEF", g.choice([32, 40]))),
                (f"{prose(3)} password={q}", of("0123456789abcdef", g.randint(12, 24))),
                (f"{prose(3)} secret: {q}", of(low + up + dig + "+/", g.randint(20, 44))),
                (f"{prose(2)} api_key={q}", g.choice(["sk_live_", "AIza", ""]) + of(low + up + dig, g.randint(24, 36))),
                (f"{prose(3)} ", g.choice(["ghp_", "glpat-", "npm_"]) + of(low + up + dig, 36)),
                (f"{prose(2)} Bearer ", "eyJ" + of(low + up + dig + "-_", g.randint(40, 90))),
                (f"{prose(2)} pwd: {q}", of(low + up + dig + "!$%", g.randint(9, 16))),
            ]
        )
        out.append((before.encode(), value.encode(), f"{q} {prose(3)}".encode(), g.choice(["src3", "src11", "config/app.env", "main.py"]), 1))
        before, value = g.choice(
            [
                (f"{prose(3)} ", f"{word()}.{word()}{g.randint(1, 99)}"),
                (f"{prose(3)} {word()}.", f"{word()}{g.randint(1, 99)}@mail{g.randint(1, 9)}.example.com"[:30]),
                (f"{prose(2)} http://", f"{word()}.example.org/{word()}/{g.randint(1, 9999)}"),
                (f"{prose(3)} version ", f"{g.randint(0, 9)}.{g.randint(0, 40)}.{g.randint(0, 99)}-{word()}{g.randint(1, 9)}.{word()}"),
                (f"{prose(3)} sha256: ", of("0123456789abcdef", 64)),
                (f"{prose(2)} commit ", of("0123456789abcdef", 40)),
                (f"{prose(2)} uuid ", "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
                (f"{prose(2)} password = {q}", g.choice(["changeme", "your_password_here", "xxxxxxxxxxxx", "example123", "placeholder"])),
                (f"{prose(2)} token: ", "".join(word() for _ in range(3))),
                (f"{prose(3)} ", "".join(word() for _ in range(4)) + str(g.randint(1, 2030))),
                (f"{prose(2)} ", f"{word()}_{word()}_{g.randint(1, 99)}.{g.choice(['png', 'html', 'csv'])}"),
                (f"{prose(2)} phone ", f"+{of(dig, 2)}-{of(dig, 3)}-{of(dig, 7)}"),
                (f"{prose(2)} auth: ", f"{word()}{word()}{word()}"),
            ]
        )
        out.append((before.encode(), value.encode(), f"{q} {prose(3)}".encode(), g.choice(["src3", "src11", "docs/readme.md", "tests/x.py", "main.py"]), 0))
    return out


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> frozenset[bytes]:
    """The most frequent words of 4 to 14 letters in all documents; partial counts are made before the shuffle."""
    each = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{4,14}\b"), F.lit(0))).alias("w"))
    return frozenset(r["w"].encode() for r in each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect())


def train(found: list[tuple[bytes, bytes, bytes, str, int]], words: frozenset[bytes]) -> Forest:
    return Forest().fit(np.array([features(*f[:4], words) for f in found]), np.array([f[4] for f in found]))


def findings(docs: DataFrame, model: Forest, words: frozenset[bytes], path: str = "source") -> DataFrame:
    """(doc_id, start, end, value_sha256, score) of every candidate; score is the forest's share of votes for a secret."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            seen = []
            for i, (text, where) in enumerate(zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist())):
                for s, e in candidates(text or b""):
                    seen.append(features(text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT], where or "", words))
                    for col, v in zip(rows, (i, s, e, hashlib.sha256(text[s:e]).hexdigest())):
                        col.append(v)
            score = model.predict(np.array(seen)) if seen else np.zeros(0)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(score)], names=["doc_id", "start", "end", "value_sha256", "score"])

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, value_sha256 string, score double")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = dictionary(docs)
    return findings(docs, train(labelled(), words), words).withColumn("secret", F.col("score") >= 0.5)
