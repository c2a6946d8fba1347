"""Models behind one interface: a provider answers a batch of prompts, in a partition function."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    """name, and answers(texts, **options) of equal length; built once in each worker's partition."""

    name: str

    def answers(self, texts: list[str], **options) -> list[str | None]: ...


class NullProvider:
    """Answers nothing: every later stage falls back to its rules."""

    name = "null"

    def answers(self, texts: list[str], **options) -> list[str | None]:
        return [None] * len(texts)


class RuleProvider:
    """Answers with a JSON record that fixed patterns find: deterministic, offline."""

    name = "rule"
    PATTERNS = {
        "invoice_number": r"(?i)invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)", "currency": r"\b(USD|EUR|GBP|INR|JPY|CNY|MXN|BRL|AUD|CAD|CHF|SGD)\b",
        "product_name": r"(?i)product(?:\s+name)?\s*:\s*([^\n]+)", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    }

    def answers(self, texts: list[str], **options) -> list[str | None]:
        out = []
        for t in texts:
            found = {k: (m[1] if m.re.groups else m[0]).strip() for k, p in self.PATTERNS.items() if (m := re.search(p, t or ""))}
            out.append(json.dumps(found, sort_keys=True) if found else None)
        return out


class HttpProvider:
    """Posts prompts to a JSON endpoint that the options name; a request that fails answers nothing."""

    name = "http"

    def answers(self, texts: list[str], *, url: str, model: str = "", field: str = "response", timeout: float = 30, **options) -> list[str | None]:
        return [self._one(t, url, model, field, timeout, options) for t in texts]

    @staticmethod
    def _one(text: str, url: str, model: str, field: str, timeout: float, options: dict) -> str | None:
        body = json.dumps({"model": model, "prompt": text, "stream": False, **options}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as reply:
                return json.loads(reply.read()).get(field)
        except (OSError, ValueError):
            return None


PROVIDERS = {"null": NullProvider, "rule": RuleProvider, "http": HttpProvider}


def register(name: str, provider: type) -> None:
    """Make a provider known by name; its module must be importable on the executors."""
    PROVIDERS[name] = provider


def extracted(batches: DataFrame, provider: str = "rule", text: str = "text", **options) -> DataFrame:
    """batches with answer and status (ok, or failed with no answer); a failing batch fails alone."""
    kind = PROVIDERS[provider]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields) + ", answer string, status string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kind()
        for p in parts:
            try:
                got = model.answers(p[text].tolist(), **options)
            except Exception:  # noqa: BLE001  a model's failure is a row's state, not the job's
                got = [None] * len(p)
            yield p.assign(answer=got, status=["ok" if g is not None else "failed" for g in got])

    return batches.mapInPandas(run, schema)
