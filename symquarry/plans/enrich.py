"""Enrichment of symbols by a model: which need it, applying results, and the providers."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "symbol_id long, description string, tags string, model string"


class Provider(Protocol):
    model: str

    def enabled(self) -> bool: ...

    def enrich(self, symbol: dict) -> tuple[str, str]:
        """(description, comma-separated tags) of a symbol."""


class NullProvider:
    model = ""

    def enabled(self) -> bool:
        return False

    def enrich(self, symbol: dict) -> tuple[str, str]:
        return "", ""


def tags_text(tags) -> str:
    parts = tags if isinstance(tags, list) else str(tags or "").split(",")
    return ",".join(t for t in (str(p).strip() for p in parts) if t)


class ChatProvider:
    """A chat-completion endpoint over plain HTTP."""

    def __init__(self, endpoint: str, model: str, key: str = ""):
        if not endpoint:
            raise ValueError("the endpoint is empty")
        self.endpoint, self.model, self.key = endpoint, model, key

    def enabled(self) -> bool:
        return True

    def enrich(self, symbol: dict) -> tuple[str, str]:
        ask = "Describe this symbol as JSON with description and tags.\n" + json.dumps(symbol, ensure_ascii=False)
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": "You describe source code."}, {"role": "user", "content": ask}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.endpoint, json.dumps(body).encode(), head), timeout=120) as answer:
            said = json.loads(answer.read())
        content = said.get("choices", [{}])[0].get("message", {}).get("content") or json.dumps(said)
        found = json.loads(content[content.index("{") : content.rindex("}") + 1]) if "{" in content else {}
        return found.get("description", ""), tags_text(found.get("tags"))


def load_config(index_dir: str) -> dict:
    path = os.path.join(index_dir, "config.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("ai", {})


def provider_of(config: dict) -> Provider:
    if not config.get("enabled"):
        return NullProvider()
    if config.get("provider", "openai-compatible") != "openai-compatible":
        raise ValueError(f"unsupported provider: {config['provider']}")
    return ChatProvider(config.get("endpoint", ""), config.get("model", ""), os.environ.get(config["api_key_env"], "") if config.get("api_key_env") else config.get("api_key", ""))


def pending(symbols: DataFrame) -> DataFrame:
    """Symbols without an enrichment, by qualified name."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return symbols.where(empty("ai_enriched_at") | empty("ai_description")).orderBy("qualified_name")


def run_provider(symbols: DataFrame, provider: Provider, key: str = "id") -> DataFrame:
    """One request per symbol, on the executors. An empty description, or a request that fails, keeps the symbol pending."""
    columns = [key, "kind", "name", "qualified_name", "signature", *(c for c in ("relative_path", "line_start") if c in symbols.columns)]

    def asked(symbol: dict) -> tuple[str, str]:
        try:
            return provider.enrich(symbol)
        except (OSError, ValueError, KeyError, IndexError):  # no answer, or one that is not as agreed
            return "", ""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(r[key], *asked(r), provider.model) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=["symbol_id", "description", "tags", "model"])

    return symbols.select(*columns).mapInPandas(run, RESULT)


def apply(symbols: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """symbols with results filled in; tags and descriptions stand in both pairs of columns."""
    good = results.where("description <> ''").select(F.col("symbol_id").alias(key), F.col("description").alias("__d"), F.col("tags").alias("__t"), F.col("model").alias("__m"))
    hit = F.col("__d").isNotNull()
    new = {"description": "__d", "tags": "__t", "ai_description": "__d", "ai_tags": "__t", "ai_model": "__m"}
    joined = symbols.join(good, key, "left")
    filled = joined.withColumns({c: F.when(hit, F.col(s)).otherwise(F.col(c)) for c, s in new.items()})
    return filled.withColumn("ai_enriched_at", F.when(hit, F.current_timestamp()).otherwise(F.col("ai_enriched_at"))).drop("__d", "__t", "__m")
