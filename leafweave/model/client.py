"""Calls of a language model for JSON answers, and a stand-in that needs none.

A client gives one answer for (system, user, schema).  ``answers`` runs it over
a DataFrame of prompts with a bounded number of partitions, so as many calls at
once; a call that fails for good becomes a row with its error, never a lost
row.  Persist the result before using it twice: a model may answer differently.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece that isn't halved any more, and how far from the middle a line end is looked for.
LEAST_PIECE, AROUND_MIDDLE = 500, 200


class CallFailed(RuntimeError):
    """A call failed as often as it may be tried."""


def stand_in(schema: dict | None, key: str = "root") -> Any:
    """The deterministic answer to a schema; it doesn't depend on the prompt."""
    if schema is None:
        return {"result": "mock"}
    kind = schema.get("type", "object" if key == "root" else "string")
    if kind == "object":
        return {k: stand_in(v, k) for k, v in schema.get("properties", {}).items()}
    if kind == "array":
        return [stand_in(schema.get("items", {"type": "string"}), "item" if key == "root" else f"{key}_item")]
    if kind == "string":
        return schema["enum"][0] if "enum" in schema else f"mock_{key}"
    return {"integer": 1, "number": 1.0, "boolean": True}.get(kind)


@dataclass(frozen=True)
class Client:
    """Settings of a model; small and picklable, so that tasks can hold it."""

    mock: bool = True
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    tries: int = 3
    timeout: float = 120.0
    #: For tests: takes (system, user, temperature) and gives the answer's text.
    call: Callable[[str, str, float], str] | None = None
    sleep: Callable[[float], None] = time.sleep

    @classmethod
    def of(cls, config: dict) -> Client:
        own = config.get("llm", {})
        return cls(own.get("mock", True), own.get("base_url", ""), own.get("model", ""), own.get("api_key", ""), own.get("max_retries", 3))

    def _asked(self, system: str, user: str, temperature: float) -> str:
        if self.call:
            return self.call(system, user, temperature)
        body = {"model": self.model, "temperature": temperature, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    def generate(self, system: str, user: str, schema: dict | None = None, temperature: float = 0.0) -> Any:
        """The answer as JSON; a failed call or one that isn't JSON is tried again after 1, 2, 4, then 8 seconds."""
        if self.mock:
            return stand_in(schema)
        error: Exception | None = None
        for k in range(self.tries):
            try:
                return json.loads(self._asked(system, user, temperature))
            except Exception as e:  # any failure of a remote call counts as one try
                error = e
                self.sleep(min(2**k, 8))
        raise CallFailed(f"failed after {self.tries} tries: {error}")

    def generate_halving(self, system: str, user: str, schema: dict, field: str, temperature: float = 0.0) -> tuple[list, list[str]]:
        """(entries of ``field``, pieces that failed): a text that fails is cut near its middle, at a line end if there is one, and its halves are tried."""
        try:
            return list(self.generate(system, user, schema, temperature).get(field, [])), []
        except CallFailed:
            if len(user) <= LEAST_PIECE:
                return [], [user]
        middle = len(user) // 2
        line = user.rfind("\n", middle - AROUND_MIDDLE, middle + AROUND_MIDDLE)
        cut = line if line > 0 else middle
        found, lost = [], []
        for half in (user[:cut].strip(), user[cut:].strip()):
            if half:
                got, failed = self.generate_halving(system, half, schema, field, temperature)
                found += got
                lost += failed
        return found, lost


def input_hash(system: Column, user: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of both."""
    return F.substring(F.sha2(F.concat(system, user), 256), 1, 16)


LOG = "run_id string, model string, mock boolean, temperature double, input_hash string, input_length long, output string, error string, elapsed_seconds double, timestamp string"


def answers(prompts: DataFrame, client: Client, system: str, schema: dict | None, field: str | None = None, temperature: float = 0.0, calls_at_once: int = 8) -> DataFrame:
    """prompts (user, ...) with the columns of a call's log; ``output`` is JSON, null if the call failed.

    With ``field``, failed texts are halved, ``output`` is the list of that
    field's entries and ``error`` tells how many pieces were lost.
    """
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user in batch["user"].fillna(""):
                began, out, error = time.time(), None, None
                try:
                    if field:
                        found, lost = client.generate_halving(system, user, schema, field, temperature)
                        out, error = json.dumps(found, ensure_ascii=False), f"{len(lost)} pieces lost, {sum(map(len, lost))} characters" if lost else None
                    else:
                        out = json.dumps(client.generate(system, user, schema, temperature), ensure_ascii=False)
                except CallFailed as e:
                    error = str(e)
                digest = hashlib.sha256((system + user).encode()).hexdigest()[:16]
                rows.append((uuid.uuid4().hex[:8], "mock" if client.mock else client.model, client.mock, temperature, digest, len(user), out, error, time.time() - began, datetime.fromtimestamp(began, timezone.utc).isoformat()))
            log = pd.DataFrame(rows, columns=[x.split()[0] for x in LOG.split(", ")], index=batch.index)
            yield pd.concat([batch, log], axis=1)

    return prompts.repartition(calls_at_once).mapInPandas(run, f"{own}, {LOG}")
