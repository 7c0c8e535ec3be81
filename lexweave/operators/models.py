"""Model calls behind clients that can be exchanged; the ones here answer offline and alike in every run."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], np.ndarray]


def offline_generate(prompts: list[str]) -> list[str]:
    """The prompt's first sentence."""
    return [p.strip().split(". ")[0][:300] for p in prompts]


def hashing_embedder(dimension: int = 64) -> Embed:
    """Unit vectors of signed hashed words (runs of letters or digits, in lower case); a text without a word has the zero vector.

    A word's MD5 digest tells its component and its sign, so that any engine can make the same vectors.
    """
    known: dict[str, tuple[int, int]] = {}
    words = re.compile(r"[^\W_]+")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for r, t in enumerate(texts):
            for w in words.findall(t.lower()):
                at = known.get(w)
                if at is None:
                    if len(known) > 500_000:
                        known.clear()
                    h = hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()
                    at = known[w] = (int.from_bytes(h[:2], "big") % dimension, 1 if h[2] < 128 else -1)
                out[r, at[0]] += at[1]
            n = np.sqrt((out[r] * out[r]).sum())
            if n:
                out[r] /= n
        return out.astype(np.float32)

    return embed


def _post(url: str, body: dict, timeout: float) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def http_generate(url: str, model: str, options: dict | None = None, timeout: float = 90.0) -> Generate:
    """A client of a text model served over HTTP: a prompt is posted as JSON, the answer is its `response`, stripped.

    options are passed on, such as temperature or the number of tokens. A status of failure, a
    timeout or an answer without `response` raises, and is taken by `generated` as a failed call.
    """

    def call(prompts: list[str]) -> list[str]:
        return [_post(url, {"model": model, "prompt": p, "stream": False, "options": options or {}}, timeout)["response"].strip() for p in prompts]

    return call


def http_embed(url: str, model: str, timeout: float = 60.0) -> Embed:
    """A client of an embedding model served over HTTP: a batch of texts is posted as `input`, the answer holds `embeddings`."""

    def call(texts: list[str]) -> np.ndarray:
        out = np.array(_post(url, {"model": model, "input": texts}, timeout)["embeddings"], np.float32)
        if out.ndim != 2 or len(out) != len(texts):
            raise ValueError(f"{len(texts)} texts gave embeddings of shape {out.shape}")
        return out

    return call


def embedding_dimension(client: Embed) -> int:
    """The number of components that a client gives."""
    return len(client(["test"])[0])


def offline_rewrite(prompts: list[str]) -> list[str]:
    """The question at the end of a rewriting prompt, as it was asked."""
    return [p.rpartition("\n")[2] for p in prompts]


def generated(prompt: Column, client: Generate = offline_generate, batch: int = 4) -> Column:
    """A model's answers; null for null prompts, and where a call failed twice. One client a task, `batch` prompts a call."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = [None] * len(s)
            at = [i for i, p in enumerate(s) if p is not None]
            for a in range(0, len(at), batch):
                part = at[a : a + batch]
                for _ in range(2):
                    try:
                        for i, answer in zip(part, client([s.iloc[i] for i in part])):
                            out[i] = answer
                        break
                    except Exception:  # a failed call degrades to null, as the caller's fallback expects
                        continue
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(prompt)


def embedded(df: DataFrame, text: str, client: Embed, name: str = "embedding", batch: int = 10) -> DataFrame:
    """df with an embedding of each text (null for null), `batch` texts a call."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = [None] * len(s)
            at = [i for i, p in enumerate(s) if p is not None]
            for a in range(0, len(at), batch):
                for i, v in zip(at[a : a + batch], client([s.iloc[i] for i in at[a : a + batch]])):
                    out[i] = v.tolist()
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))
