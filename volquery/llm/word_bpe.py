"""Fast exact ids of a lower-casing word-end BPE tokenizer.

The tokenizer file is read by ``tokenizers``; plain words are encoded by a byte-pair engine that looks
up merged strings instead of merge pairs.  The two agree provided that every merged string, encoded
alone, comes out as one token: merges inside a span do not depend on what is outside, so a string that
is ever merged passes through the steps it takes alone, and these are merges of the file.  Strings that
fail this test can never be produced and are left out of the table.  Words with characters outside the
plain set go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that Unicode composition leaves alone and that lower-case one to one.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
MARK = "\x7f"  # ends a pre-token inside the engine; not a plain character
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FIRST_MERGE = 1000


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, others for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class WordBpe:
    """Tables made on the driver (``load``); engines are opened on first use in a worker."""

    path: str
    ranks: dict[bytes, int]
    id_of_rank: np.ndarray
    engines: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        joined = ["".join(m) for m in merges]
        inner = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        outer = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=end))
        alone = {
            True: outer.encode_batch_fast([t.removesuffix(end) for t in joined], add_special_tokens=False),
            False: inner.encode_batch_fast(joined, add_special_tokens=False),
        }
        byte = byte_of_symbol()
        ranks, ids = {bytes([b]): b for b in range(256)}, np.full(FIRST_MERGE + len(merges), -1, np.int32)
        for symbol, b in byte.items():
            ids[b] = vocab[symbol]
            ranks[bytes([b]) + MARK.encode()] = 256 + b
            ids[256 + b] = vocab[symbol + end]
        for i, token in enumerate(joined):
            ends = token.endswith(end)
            if alone[ends][i].ids == [vocab[token]]:
                raw = bytes(byte[c] for c in token.removesuffix(end)) + MARK.encode() * ends
                if ranks.setdefault(raw, FIRST_MERGE + i) == FIRST_MERGE + i:
                    ids[FIRST_MERGE + i] = vocab[token]
        return cls(path, ranks, ids)

    def tables(self) -> tuple[str, dict[bytes, int], np.ndarray, dict]:
        """What a worker needs to build its own: plain objects, as broadcasts are pickled by reference.
        The last is empty; a worker keeps its engines there from task to task."""
        return self.path, self.ranks, self.id_of_rank, {}

    def _engine(self, kind: str):
        if kind not in self.engines:
            if kind == "plain":
                import regex
                import tiktoken

                engine = tiktoken.Encoding("plain", pat_str=rf"\n|[^{MARK}\n]+{MARK}", mergeable_ranks=self.ranks, special_tokens={})
                self.engines[kind] = (engine, regex.compile(PIECES))
            else:
                from tokenizers import Tokenizer

                self.engines[kind] = Tokenizer.from_file(self.path)
        return self.engines[kind]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one array; where each word's ids begin and how many they are."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        parts, at = [], 0
        if plain.any():
            engine, pieces = self._engine("plain")
            text = "\n".join(words.filter(pa.array(plain)).to_pylist()).lower() + "\n"
            coded = engine.encode_to_numpy(pieces.sub(rf"\g<0>{MARK}", text), disallowed_special=())
            ends = np.flatnonzero(coded == 10)  # the line breaks between words
            flat = self.id_of_rank[coded[coded != 10]]
            edges = np.concatenate([[0], ends - np.arange(len(ends))])
            starts[plain], sizes[plain] = edges[:-1], np.diff(edges)
            parts, at = [flat], len(flat)
        other = np.flatnonzero(~plain)
        for i in range(0, len(other), 10_000):
            chosen = other[i : i + 10_000]
            found = [x.ids for x in self._engine("other").encode_batch_fast(words.take(pa.array(chosen)).to_pylist(), add_special_tokens=False)]
            n = np.array([len(x) for x in found], dtype=np.int64)
            starts[chosen], sizes[chosen] = at + np.cumsum(n) - n, n
            parts.append(np.array([x for ids in found for x in ids], dtype=np.int32))
            at += int(n.sum())
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), starts, sizes
