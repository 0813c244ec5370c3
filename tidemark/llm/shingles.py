"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidemark.llm.shared import mix64

BATCH_CHARS = 8_000_000


def hashed_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's words in order as 64-bit hashes: A-Z lower-cased, split at ASCII white space."""
    group, chars = [], 0
    for text in texts:
        if group and chars + len(text or "") > BATCH_CHARS:
            yield from _group(group)
            group, chars = [], 0
        group.append(text or "")
        chars += len(text or "")
    if group:
        yield from _group(group)


def _group(texts: list[str]) -> Iterator[np.ndarray]:
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    real = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[codes] if len(words) else np.empty(0, bool)
    stops = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy()]
    flat = hashes[codes[real]] if len(words) else np.empty(0, np.uint64)
    for i in range(len(texts)):
        yield flat[stops[i] : stops[i + 1]]


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words, of all of them; without words, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = mix64(total + words[j : len(words) - k + 1 + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
    return np.unique(total)
