"""Embedding and language-model clients, and their use inside partitions."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]
SCHEMA = "id long, embedding array<float>, status string, model string"


class HttpError(RuntimeError):
    def __init__(self, status: int | None, message: str):
        super().__init__(message)
        self.status = status

    @property
    def retryable(self) -> bool:
        """Too many requests, server errors and broken connections."""
        return self.status is None or self.status == 429 or self.status >= 500


def with_retries(call: Callable[[], object], retries: int = 3, base_ms: int = 500, sleep: Callable[[float], None] = time.sleep):
    """call, again after base_ms times 1, 2, 4 ... while its error is one that may pass."""
    for attempt in range(retries + 1):
        try:
            return call()
        except HttpError as e:
            if not e.retryable or attempt == retries:
                raise
            sleep(base_ms * 2**attempt / 1000)


def post(url: str, key: str, body: dict, timeout: float = 60.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, f"{url}: {e.code}") from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise HttpError(None, f"{url}: {e}") from e


class EmbeddingClient:
    """An HTTP embedding service; `send` can be replaced."""

    def __init__(self, base_url: str, key: str, model: str, dimension: int = 1024, batch: int = 32, send=post, sleep=time.sleep):
        self.url, self.key, self.model, self.dimension, self.batch, self.send, self.sleep = f"{base_url.rstrip('/')}/embeddings", key, model, dimension, batch, send, sleep

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            got = with_retries(lambda part=part: self.send(self.url, self.key, {"model": self.model, "input": part}), sleep=self.sleep)
            rows = sorted(got.get("data", []), key=lambda r: r["index"])
            if len(rows) != len(part) or any(len(r["embedding"]) != self.dimension for r in rows):
                raise ValueError("the service returned other vectors than asked for")
            out += [r["embedding"] for r in rows]
        return out


class ChatClient:
    """An HTTP chat service that answers one prompt."""

    def __init__(self, base_url: str, key: str, model: str, send=post, sleep=time.sleep):
        self.url, self.key, self.model, self.send, self.sleep = f"{base_url.rstrip('/')}/chat/completions", key, model, send, sleep

    def __call__(self, prompt: str) -> str:
        got = with_retries(lambda: self.send(self.url, self.key, {"model": self.model, "messages": [{"role": "user", "content": prompt}]}), sleep=self.sleep)
        try:
            return got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ValueError("the service's answer has no content") from e


def hashed(dimension: int = 64) -> Embed:
    """An embedder that needs no service: unit vectors of signed word hashes."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split() or [""]:
                g = random.Random(hashlib.sha256(w.encode()).digest())
                v[g.randrange(dimension)] += g.choice((-1.0, 1.0))
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v] if any(v) else [1.0] + [0.0] * (dimension - 1))
        return out

    return embed


def embed_rows(rows: DataFrame, embed: Embed, model: str, batch: int = 32, concurrency: int | None = None) -> DataFrame:
    """rows (id, text) -> id, embedding, status (done or error), model. A batch that fails is marked and doesn't stop others."""

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    vectors, status = embed(part["text"].tolist()), "done"
                except (HttpError, ValueError):
                    vectors, status = [None] * len(part), "error"
                yield pd.DataFrame({"id": part["id"], "embedding": vectors, "status": status, "model": model})

    rows = rows if concurrency is None else rows.repartition(concurrency)
    return rows.select("id", "text").mapInPandas(run, SCHEMA)
