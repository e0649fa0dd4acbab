"""Counts that describe a text, computed for Arrow batches of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import text_buffers, word_bounds

SPACE, BREAK, LOWER, UPPER, DIGIT, SYMBOL, SHOUT, STOP, OTHER, LEAD, TRAIL = range(11)
N_CLASSES = 11
CLASS_OF = np.full(256, OTHER, dtype=np.uint8)
CLASS_OF[0x80:0xC0] = TRAIL
CLASS_OF[0xC0:] = LEAD
for _chars, _class in ((b" ", SPACE), (b"\t\n\x0b\x0c\r", BREAK), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b"#*$%&|<>", SYMBOL), (b"!", SHOUT), (b".,;:?'\"()-", STOP)):
    CLASS_OF[list(_chars)] = _class


class Profile:
    """Counts per row: ``classes`` (rows x N_CLASSES bytes), ``n_words``, ``word_chars``, ``n_distinct``,
    ``top_word``, ``n_repeat_words``, ``n_lines``, ``n_dup_lines``; and the words as codes."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = text_buffers(texts)
        rows = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.row_of_byte = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
        self.classes = np.bincount(self.row_of_byte * N_CLASSES + CLASS_OF[data], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
        starts, stops, self.n_words = word_bounds(data, offsets)
        self.n_words = self.n_words.astype(np.int64)
        self.word_chars = self.classes[:, LOWER:].sum(axis=1) - self.classes[:, TRAIL]
        self.codes, self.words = encode_words(data, starts, stops)
        self.row_of_word = np.repeat(np.arange(rows, dtype=np.int64), self.n_words)
        self.word_at = np.concatenate([[0], np.cumsum(self.n_words)])
        self.n_distinct = np.zeros(rows, np.int64)
        self.top_word = np.zeros(rows, np.int64)
        self.n_repeat_words = np.zeros(rows, np.int64)
        bits = max(1, int(len(self.words)).bit_length())
        for row in np.flatnonzero(self.n_words):
            codes = self.codes[self.word_at[row] : self.word_at[row + 1]]
            counts = np.unique(codes, return_counts=True)[1]
            self.n_distinct[row], self.top_word[row] = len(counts), counts.max()
            if len(codes) > 3 and len(counts) < len(codes):
                self.n_repeat_words[row] = repeated_words(codes, bits)
        self.n_lines = np.zeros(rows, np.int64)
        self.n_dup_lines = np.zeros(rows, np.int64)
        raw = data.tobytes()
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            self.n_lines[row], self.n_dup_lines[row] = len(lines), len(lines) - len(set(lines))


def encode_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of all words, and the distinct words."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    packed = data[~_SPACE[data]]  # words are exactly the bytes that are not space
    offsets = np.concatenate([[0], ends]).astype(np.int32 if len(packed) < 2**31 else np.int64)
    kind = pa.BinaryArray if offsets.dtype == np.int32 else pa.LargeBinaryArray
    words = kind.from_buffers(pa.binary() if kind is pa.BinaryArray else pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = pc.dictionary_encode(words)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


_SPACE = (CLASS_OF == SPACE) | (CLASS_OF == BREAK)


def repeated_words(codes: np.ndarray, bits: int) -> int:
    """Words inside 3-word windows that occur twice or more, first ones included."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    if bits <= 21:
        key = (a << (2 * bits)) | (b << bits) | c
    else:  # exact for any vocabulary: number the pairs first
        pair = np.unique((a << 32) | b, return_inverse=True)[1]
        key = (pair << 32) | c
    inverse, counts = np.unique(key, return_inverse=True, return_counts=True)[1:]
    window = counts[inverse] > 1
    if not window.any():
        return 0
    word = np.zeros(len(codes), dtype=bool)
    word[:-2] |= window
    word[1:-1] |= window
    word[2:] |= window
    return int(word.sum())
