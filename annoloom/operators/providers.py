"""The two places where models outside Spark plug in: synonym providers and embedders. Both get Arrow batches."""

from __future__ import annotations

import json
import os
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SynonymProvider(Protocol):
    """Answers prompts. ``open`` is called once a task and returns the function that answers a batch."""

    def open(self) -> Callable[[list[str], list[str]], list[str]]: ...


class StaticProvider:
    """Answers from a dict by prompt; others get ''."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def open(self) -> Callable[[list[str], list[str]], list[str]]:
        return lambda systems, prompts: [self.answers.get(p, "") for p in prompts]


#: Services by model name, as (address, variable that holds the key).
OPENAI = ("https://api.openai.com/v1", "OPENAI_API_KEY")
OPENROUTER = ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY")
SERVICES = {"gpt-4o-mini": OPENAI, "gpt-4.1-nano": OPENAI, "meta-llama/llama-3.3-70b-instruct:free": OPENROUTER, "meta-llama/llama-3.3-70b-instruct": OPENROUTER}
TEMPERATURE, MAX_TOKENS = 0.2, 10_000


def _post(address: str, key_name: str, body: dict, timeout: float) -> dict:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_name, '')}"}
    with urllib.request.urlopen(urllib.request.Request(address, json.dumps(body).encode(), headers), timeout=timeout) as reply:
        return json.load(reply)


class ChatProvider:
    """Asks a chat service, one prompt a call. A call that fails answers ''."""

    def __init__(self, model: str, address: str, key_name: str, timeout: float = 120.0):
        self.model, self.address, self.key_name, self.timeout = model, address, key_name, timeout

    def open(self) -> Callable[[list[str], list[str]], list[str]]:
        def one(system: str, prompt: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
            body = {"model": self.model, "messages": messages, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS}
            try:
                choices = _post(f"{self.address}/chat/completions", self.key_name, body, self.timeout).get("choices") or [{}]
            except (OSError, json.JSONDecodeError):
                return ""
            return (choices[0].get("message") or {}).get("content") or ""

        return lambda systems, prompts: [one(s, p) for s, p in zip(systems, prompts, strict=True)]


def provider_for(model: str, services: dict[str, tuple[str, str]] | None = None) -> ChatProvider:
    """The provider of a model name; an unknown name is an error."""
    services = SERVICES if services is None else services
    if model not in services:
        raise ValueError(f"model {model!r} is not one of {sorted(services)}")
    return ChatProvider(model, *services[model])


def ask(prompts: DataFrame, provider: SynonymProvider, key: str = "model") -> DataFrame:
    """(key, raw_response) for rows with (key, system_prompt, prompt). A batch whose call fails on the way (an
    operating system or run-time error) gives '' answers; other errors are errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = provider.open()
        for frame in frames:
            try:
                replies = answer(frame["system_prompt"].tolist(), frame["prompt"].tolist())
            except (OSError, RuntimeError):
                replies = [""] * len(frame)
            yield pd.DataFrame({key: frame[key], "raw_response": replies})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "system_prompt", "prompt").mapInPandas(run, f"{key} {kind}, raw_response string")


def replayed(prompts: DataFrame, saved: DataFrame, key: str = "model") -> DataFrame:
    """Saved answers in place of a provider."""
    return prompts.select(key).join(saved.select(key, "raw_response"), key, "left").na.fill("", ["raw_response"])


Embedder = Callable[[list[str]], list[list[float]]]


def hashed_trigrams(names: list[str], size: int = 64) -> list[list[float]]:
    """A plain embedder that needs no model: normalised counts of the hashed trigrams of each name."""
    out = []
    for name in names:
        text, counts = f"  {name.lower()} ", [0.0] * size
        for i in range(len(text) - 2):
            counts[zlib.crc32(text[i : i + 3].encode()) % size] += 1.0
        norm = sum(c * c for c in counts) ** 0.5 or 1.0
        out.append([c / norm for c in counts])
    return out


class ServiceEmbedder:
    """Asks an embedding service for a batch at a time."""

    def __init__(self, model: str, address: str, key_name: str, timeout: float = 120.0):
        self.model, self.address, self.key_name, self.timeout = model, address, key_name, timeout

    def __call__(self, names: list[str]) -> list[list[float]]:
        found = _post(f"{self.address}/embeddings", self.key_name, {"model": self.model, "input": names}, self.timeout)["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]


EMBEDDERS: dict[str, Embedder] = {"default": hashed_trigrams, "openai": ServiceEmbedder("text-embedding-ada-002", *OPENAI)}


def embedder_for(name: str, embedders: dict[str, Embedder] | None = None) -> Embedder:
    """The embedder of a name; an unknown name is an error."""
    embedders = EMBEDDERS if embedders is None else embedders
    if name not in embedders:
        raise ValueError(f"embedder {name!r} is not one of {sorted(embedders)}")
    return embedders[name]


def embed(names: DataFrame, embedder: Embedder) -> DataFrame:
    """(doc_id, db_id, name, embedding)."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder(texts.tolist()))

    return names.select("doc_id", "db_id", "name", vectors("name").alias("embedding"))
