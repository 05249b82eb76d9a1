"""Embedding providers and their use as Spark columns.

A provider turns a list of texts into a float32 matrix.  It is built on the
worker from its settings (never pickled with a loaded model) and kept for the
life of the Python worker, one instance per full set of settings.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codecairn.config import EmbeddingConfig

# Fixed values of the HTTP provider: pauses before a request is tried again, in
# seconds, and how long one request may take.
HTTP_PAUSES = (1, 2)
HTTP_TIMEOUT = 60.0

# Fixed value: tokens a local model reads at once; longer texts are read in pieces.
MODEL_MAX_TOKENS = 512


class HashingEmbedder:
    """Feature hashing: word counts in hashed buckets, unit length.

    A token is a run of ``[a-z0-9]`` of the lower-cased text; its bucket is
    the first six hex digits of its SHA-256, modulo the dimension.
    """

    _TOKEN = re.compile(r"[a-z0-9]+")
    _CACHE_LIMIT = 200_000

    def __init__(self, config: EmbeddingConfig) -> None:
        self.dimensions = config.dimensions
        self._buckets: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        found = self._buckets.get(token)
        if found is None:
            if len(self._buckets) >= self._CACHE_LIMIT:
                self._buckets.clear()
            found = int(hashlib.sha256(token.encode()).hexdigest()[:6], 16) % self.dimensions
            self._buckets[token] = found
        return found

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        for row, text in enumerate(texts):
            hits = [self._bucket(t) for t in self._TOKEN.findall(text.lower())]
            if hits:
                out[row] = np.bincount(hits, minlength=self.dimensions)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        norms[norms == 0.0] = 1.0
        return (out / norms).astype(np.float32)


def halves(text: str) -> tuple[str, str] | None:
    """A text cut at the blank nearest its middle, else in the middle; None if it is too short."""
    if len(text) < 2:
        return None
    middle = len(text) // 2
    blanks = (text.rfind(" ", 1, middle + 1), text.find(" ", middle, len(text) - 1))
    at = min((k for k in blanks if k > 0), key=lambda k: abs(k - middle), default=middle)
    return text[:at], text[at:]


def pooled(parts: Sequence[tuple[str, np.ndarray]]) -> np.ndarray:
    """One vector for a text read in parts: their mean by length, at unit length."""
    mean = sum(len(text) * vector for text, vector in parts)
    return mean / (np.linalg.norm(mean) or 1.0)


class ModelEmbedder:
    """A local sentence-embedding model; needs the optional package."""

    def __init__(self, config: EmbeddingConfig) -> None:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as exc:
            raise RuntimeError(
                "backend 'local' needs the sentence_transformers package; "
                "use backend 'hashing' or 'remote' without it"
            ) from exc
        self._model = SentenceTransformer(config.model_name, trust_remote_code=True)
        self._limit = min(self._model.max_seq_length or MODEL_MAX_TOKENS, MODEL_MAX_TOKENS)

    def _pieces(self, text: str) -> list[str]:
        """Parts that the model reads whole."""
        if len(self._model.tokenizer.tokenize(text)) <= self._limit - 2 or (cut := halves(text)) is None:
            return [text]
        return [piece for half in cut for piece in self._pieces(half)]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        pieces = [self._pieces(t) for t in texts]
        flat = [p for of in pieces for p in of]
        vectors = iter(self._model.encode(flat, normalize_embeddings=True, show_progress_bar=False))
        return np.stack([pooled([(p, next(vectors)) for p in of]) if len(of) > 1 else next(vectors) for of in pieces])


class TooLong(Exception):
    """The endpoint does not read a request of this size."""


class HttpEmbedder:
    """An HTTP endpoint taking ``{"input": [...]}`` and answering indexed embeddings.

    A request that is too long is cut in two: by texts while it has several, then
    the text itself, whose halves are pooled.  No text is shortened.
    """

    def __init__(
        self, config: EmbeddingConfig, post: Callable[[list[str]], tuple[int, dict]] | None = None
    ) -> None:
        if not config.api_url:
            raise ValueError("embedding.api_url is required when backend is 'remote'")
        self._config = config
        self._post = post or self._http_post
        self._sleep = time.sleep

    def _http_post(self, texts: list[str]) -> tuple[int, dict]:
        request = urllib.request.Request(
            self._config.api_url,
            data=json.dumps({"input": texts}).encode(),
            headers={"Content-Type": "application/json", **http_headers()},
        )
        try:
            with urllib.request.urlopen(request, timeout=HTTP_TIMEOUT) as response:
                return response.status, json.load(response)
        except urllib.error.HTTPError as error:
            return error.code, {}

    def _ask(self, texts: list[str]) -> dict[int, list[float]]:
        """Answers by position; server errors are tried again after each pause."""
        for pause in (*HTTP_PAUSES, None):
            status, answer = self._post(texts)
            if status < 400:
                return {item["index"]: item["embedding"] for item in answer["data"]}
            if status == 422:
                raise TooLong
            if status < 500 or pause is None:
                raise RuntimeError(f"embedding endpoint answered HTTP {status}")
            self._sleep(pause)
        raise AssertionError

    def _vectors(self, texts: list[str]) -> list[np.ndarray]:
        try:
            found = self._ask(texts)
        except TooLong:
            if len(texts) > 1:
                middle = len(texts) // 2
                return self._vectors(texts[:middle]) + self._vectors(texts[middle:])
            cut = halves(texts[0])
            if cut is None:
                raise RuntimeError("embedding endpoint refuses a text of one character") from None
            return [pooled([(half, self._vectors([half])[0]) for half in cut])]
        return [np.asarray(found[k], dtype=np.float32) for k in range(len(texts))]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        step = self._config.batch_size
        requests = (list(texts[at : at + step]) for at in range(0, len(texts), step))
        with ThreadPoolExecutor(self._config.max_concurrent) as pool:
            answers = list(pool.map(self._vectors, requests))
        return np.array([v for answer in answers for v in answer], dtype=np.float32)


def http_headers() -> dict[str, str]:
    """Extra request headers from ``CODECAIRN_HTTP_HEADERS`` (``name: value, ...``)."""
    pairs = (p.partition(":") for p in os.environ.get("CODECAIRN_HTTP_HEADERS", "").split(","))
    return {name.strip(): value.strip() for name, sep, value in pairs if sep}


# Provider class per backend name.
BACKENDS = {"hashing": HashingEmbedder, "local": ModelEmbedder, "remote": HttpEmbedder}

_providers: dict[EmbeddingConfig, object] = {}


def provider(config: EmbeddingConfig):
    """The worker's provider for these exact settings."""
    if config not in _providers:
        if config.backend not in BACKENDS:
            raise ValueError(f"unknown embedding backend {config.backend!r}")
        _providers[config] = BACKENDS[config.backend](config)
    return _providers[config]


def reset_providers() -> None:
    _providers.clear()


def embed_column(text: Column, config: EmbeddingConfig) -> Column:
    """``array<float>`` embedding of document texts, one Arrow batch at a time.

    Marked non-deterministic so that a plan never embeds a text twice.
    """

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        prefixed = [config.before_document + (t or "") for t in texts.to_pylist()]
        if not prefixed:
            return pa.array([], pa.list_(pa.float32()))
        matrix = provider(config).embed(prefixed)
        offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(matrix.astype(np.float32).ravel())
        )

    return embed.asNondeterministic()(text)


def embed_query(text: str, config: EmbeddingConfig) -> list[float]:
    """Embedding of one query text, on the driver."""
    return [float(x) for x in provider(config).embed([config.before_query + text])[0]]
