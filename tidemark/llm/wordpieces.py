"""Byte-level BPE ids of whole texts, quick enough for a corpus.

The vocabulary's pattern always starts a new word at a space, unless white space stands on both sides of
it.  So texts are cut at their spaces, and the merge ranks see each different stretch of a batch once; the
ids are then put together by position.  A text with a space between white space goes through them whole, and
so does one that holds a special token, which is one id wherever it stands.
The ids are those of the tokenizer's own file (a test holds the two against each other).
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space around a space: there a cut would change the words.
UNSAFE = re.compile(r"\s \s")
#: Characters handled at once, which bounds memory.
BATCH_CHARS = 2_000_000


class Vocabulary(NamedTuple):
    """``ranks_path``: a byte-level vocabulary as ranks; ``pattern``: how it cuts words; ``special``: tokens that
    aren't cut, and their ids."""

    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        with open(vocabulary.ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(k) for k in ranks]
        self.special = [token for token, _ in vocabulary.special]
        #: Ids are below this.
        self.limit = max(len(self.size), *(i + 1 for _, i in vocabulary.special), 0)
        coder = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))
        self.ids = coder.encode_ordinary
        self.all_ids = lambda text: coder.encode(text, allowed_special="all")

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as unsigned 32-bit numbers; none for null or an empty text."""
        group, chars = [], 0
        for text in texts:
            if group and chars + len(text or "") > BATCH_CHARS:
                yield from self._group(group)
                group, chars = [], 0
            group.append(text or "")
            chars += len(text or "")
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i: np.array(self.all_ids(t), np.uint32) for i, t in enumerate(texts) if UNSAFE.search(t) or any(s in t for s in self.special)}
        parts = pc.split_pattern(pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string()), " ")
        stops = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        # After a stretch with white space at an edge comes a guard, which keeps it apart from the next one's.
        edge = pc.invert(pc.equal(coded.dictionary, pc.utf8_trim_whitespace(coded.dictionary)))
        edge = pc.or_(edge, pc.equal(pc.binary_length(coded.dictionary), 0))
        guards = pc.if_else(edge, pa.scalar(" a", pa.large_string()), pa.scalar("", pa.large_string()))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, guards, pa.scalar("", pa.large_string()))
        ends_at = np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1]
        ids = np.array(self.ids(spaced.buffers()[2].to_pybytes()[: ends_at[-1]].decode()), np.uint32)
        ends = np.cumsum(self.size[ids])
        guarded = edge.to_numpy(zero_copy_only=False).astype(np.int64)
        length = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        last = np.searchsorted(ends, np.cumsum(length + 2 * guarded) - 2 * guarded) + 1
        first = np.concatenate([[0], last[:-1] + guarded[:-1] * len(self.ids(" a"))])
        codes = coded.indices.to_numpy()
        counts = (last - first)[codes]
        counts[stops[:-1]] = 0  # what stands before a text's first space has no space of its own
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[np.repeat(first[codes] - total[:-1], counts) + np.arange(total[-1])]
        for i, text in enumerate(texts):
            if i in whole:
                yield whole[i]
                continue
            head = self.ids(text.partition(" ")[0])
            rest = flat[total[stops[i]] : total[stops[i + 1]]]
            yield np.concatenate([np.array(head, np.uint32), rest])


_encoders: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One for each worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def public_vocabulary(ranks: str = "byte_bpe_50k.tiktoken", tokenizer: str = "byte_bpe_50k.json") -> Vocabulary:
    """An installed public vocabulary, with the special tokens that its tokenizer's file names."""
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    return Vocabulary(public_tokenizers.path(ranks), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added))
