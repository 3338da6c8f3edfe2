"""``text.code_tokens`` on Arrow arrays, for tasks that go on with numpy: a word is looked at once per slice, not per use."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom import fixed

SLICE_BYTES = 1 << 22
_LETTER = np.zeros(256, bool)
_LETTER[[i for i in range(128) if re.fullmatch(fixed.WORD, chr(i))]] = True
_SIMPLE = "^([A-Z]?[a-z]*|[A-Z]+|[0-9]+)$"
_PART = re.compile(fixed.WORD_PART, re.ASCII)


def text_slices(texts: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES`` of all texts together, one row at least."""
    ends = np.concatenate(([0], np.cumsum(sum(pc.binary_length(t).to_numpy(False).astype(np.int64) for t in texts))))
    start = 0
    while start < len(ends) - 1:
        stop = max(int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1, start + 1)
        yield start, stop
        start = stop


def code_token_pairs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, and the pairs of a row and the number of a token that it holds, by row. Texts aren't null."""
    texts = texts.cast(pa.large_string())
    n, (_, at, held) = len(texts), texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(held or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = _LETTER[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    filled = offsets[1:] > offsets[:-1]
    for edge, place in ((first, offsets[:-1][filled]), (last, offsets[1:][filled] - 1)):
        edge[place] = letter[place]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(begin, offsets)))
    ends = np.concatenate(([0], np.cumsum(end - begin)))
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[letter])).dictionary_encode()
    code, words = words.indices.to_numpy(False).astype(np.int64), words.dictionary
    # A compound word stands for itself and its parts.
    mixed = np.flatnonzero(~pc.match_substring_regex(words, _SIMPLE).to_numpy(False))
    parts = [_PART.findall(w) for w in words.take(pa.array(mixed)).to_pylist()]
    sizes = np.zeros(len(words), np.int64)
    sizes[mixed] = [len(p) for p in parts]
    starts = len(words) + np.cumsum(sizes) - sizes
    parts = pa.array([p for ps in parts for p in ps], pa.large_string())
    tokens = pc.ascii_lower(pa.concat_arrays([words, parts])).dictionary_encode()
    number, tokens = tokens.indices.to_numpy(False).astype(np.int64), tokens.dictionary
    of = np.flatnonzero(sizes[code])
    times = sizes[code[of]]
    inner = np.repeat(starts[code[of]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    row, token = np.concatenate((row, np.repeat(row[of], times))), np.concatenate((number[code], number[inner]))
    pair = np.unique(row * max(len(tokens), 1) + token)
    return tokens.cast(pa.string()), pair // max(len(tokens), 1), pair % max(len(tokens), 1)
