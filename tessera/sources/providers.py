"""Embedding providers over HTTP: requests by partition, answers checked."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


#: How often a request is made before its task fails.
ATTEMPTS = 4


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except (urllib.error.URLError, TimeoutError) as failed:
            # What the service refuses stays refused; what it can't do now is asked again, later and later.
            if attempt == ATTEMPTS - 1 or isinstance(failed, urllib.error.HTTPError) and failed.code not in (408, 429, 500, 502, 503, 504):
                raise
            time.sleep(2**attempt)
    raise AssertionError


@dataclass(frozen=True)
class Provider:
    """Where vectors come from. kind: "embed" (POST /api/embed) or "embeddings" (POST /embeddings, bearer key)."""

    kind: str
    base_url: str
    model: str
    dims: int
    key: str = ""
    post: Callable[[str, dict, dict[str, str]], dict] = _post

    def __post_init__(self):
        if self.kind not in ("embed", "embeddings") or not self.base_url or not self.model or self.dims < 1:
            raise ValueError("a provider needs a known kind, a base URL, a model and a positive length")

    def vector(self, text: str) -> list[float]:
        url = self.base_url.rstrip("/")
        if self.kind == "embed":
            answer = self.post(f"{url}/api/embed", {"model": self.model, "input": text}, {})
            vector = answer["embeddings"][0] if answer.get("embeddings") else answer.get("embedding")
        else:
            answer = self.post(f"{url}/embeddings", {"model": self.model, "input": text}, {"authorization": f"Bearer {self.key}"} if self.key else {})
            vector = answer["data"][0]["embedding"]
        if vector is None or len(vector) != self.dims or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector):
            raise ValueError(f"expected {self.dims} finite numbers")
        return [float(x) for x in vector]


def embed(rows: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """rows with ``vector``; requests are made by the tasks, a partition at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=[provider.vector(t or "") for t in batch[text]])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "vector")
    return rows.drop("vector").mapInPandas(run, f"{names}, vector array<double>")
