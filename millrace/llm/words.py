"""Words of whole batches of texts, found by array operations on their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD, SPACE, BREAK = 0, 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, between words, or the end of a piece."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(spaces)] = SPACE
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """The words of some texts, in order."""

    # Number of each word's distinct form, and the forms.
    ids: np.ndarray
    forms: pa.Array
    # Number of each word's text.
    texts: np.ndarray
    # Whether a word follows the one before it in the same piece of the same text.
    follows: np.ndarray


def lowered_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Split texts (nulls are empty) into words, with A-Z as lower case.

    Takes about 10 times the bytes of the batch; nothing is done word by word.
    """
    texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    held = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if n and data else b""
    lowered = held.translate(_LOWER)
    raw = np.frombuffer(lowered, np.uint8)
    kind = np.frombuffer(held.translate(kinds.tobytes()), np.uint8)
    inside = kind == WORD
    edges = (offsets - offsets[0]).astype(np.int64) if n else np.zeros(1, np.int64)
    # A word begins or ends where its neighbour byte isn't in a word, or in another text.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    filled = np.diff(edges) > 0
    begins[edges[:-1][filled]] = inside[edges[:-1][filled]]
    ends[edges[1:][filled] - 1] = inside[edges[1:][filled] - 1]
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, edges))
    of_text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    cuts = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - at, out=cuts[1:])
    forms = pa.Array.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])]
    ).dictionary_encode()
    follows = np.zeros(len(at), bool)
    if len(at):
        broken = np.searchsorted(np.flatnonzero(kind == BREAK), at)
        follows[1:] = (of_text[1:] == of_text[:-1]) & (broken[1:] == broken[:-1])
    ids = forms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, forms.dictionary, of_text, follows)
