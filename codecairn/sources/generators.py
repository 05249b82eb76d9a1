"""Text-generation providers and their use over a table of prompts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codecairn.config import resolve_model
from codecairn.sources.embedders import http_headers

# Fixed value: instruction sent along with every prompt.
SYSTEM_TEXT = (
    "You describe source code. Be accurate and brief; say what the code does and why it is there."
)

HTTP_TIMEOUT = 600.0

Generator = Callable[[str, int], str]


class TemplateGenerator:
    """Offline provider: answers in the asked format, from the prompt alone."""

    # Fixed value: an element bullet of a prompt.
    _BULLET = re.compile(r"^ *- \*\*(.+?)\*\* \((\w+)\)", re.MULTILINE)

    def __init__(self, model: str) -> None:
        self.model = model

    def __call__(self, prompt: str, max_tokens: int) -> str:
        digest = hashlib.sha256(prompt.encode()).hexdigest()[:8]
        if prompt.rstrip().endswith("TRACE: <description>"):
            return "\n".join(
                f"FLOW: {name}\nTRACE: Follow the {name.lower()} path."
                for name in ("Start Up", "Main Work", "Wind Down")
            )
        listed = prompt.rpartition("## Elements to describe\n")[2]
        elements = self._BULLET.findall(listed) if listed != prompt else []
        parts = [f"Generated text {digest}."]
        for scope, kind in elements:  # every listed element is answered
            parts.append(f"### `{scope}`\n\nThe {kind} {scope}.")
        return "\n\n".join(parts) + "\n"


class HttpGenerator:
    """An HTTP endpoint taking one user message and answering content blocks."""

    def __init__(self, model: str, url: str | None = None) -> None:
        self.model = resolve_model(model)
        self.url = url or os.environ.get("CODECAIRN_GENERATE_URL", "")
        if not self.url:
            raise ValueError("set CODECAIRN_GENERATE_URL to use a generation endpoint")

    def __call__(self, prompt: str, max_tokens: int) -> str:
        body = {
            "model": self.model,
            "max_tokens": max_tokens,
            "system": SYSTEM_TEXT,
            "messages": [{"role": "user", "content": prompt}],
        }
        request = urllib.request.Request(
            self.url,
            data=json.dumps(body).encode(),
            headers={"Content-Type": "application/json", **http_headers()},
        )
        with urllib.request.urlopen(request, timeout=HTTP_TIMEOUT) as response:
            return json.load(response)["content"][0]["text"]


def make_generator(model: str) -> Generator:
    """The offline provider for ``template``, the HTTP provider for any other model."""
    return TemplateGenerator(model) if model == "template" else HttpGenerator(model)


def generate(
    prompts: DataFrame, model: str, factory: Callable[[str], Generator] = make_generator
) -> DataFrame:
    """``(prompt_hash, prompt, max_tokens)`` to ``(prompt_hash, response, error)``.

    A request that raises has no response but its error; the others go on.  The
    provider is built once per task.  Tasks are the unit of concurrency:
    coalesce the prompts to what the endpoint allows.
    """

    def attempt(provider: Generator, prompt: str, tokens: int) -> tuple[str | None, str | None]:
        try:
            return provider(prompt, tokens), None
        except Exception as exc:  # noqa: BLE001
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory(model)
        for batch in batches:
            done = [attempt(provider, p, int(n)) for p, n in zip(batch["prompt"], batch["max_tokens"])]
            yield pd.DataFrame(
                {"prompt_hash": batch["prompt_hash"], "response": [r for r, _ in done], "error": [e for _, e in done]}
            )

    wanted = prompts.select("prompt_hash", "prompt", "max_tokens")
    return wanted.mapInPandas(run, "prompt_hash string, response string, error string")
