"""Token ids of whole texts from a tokenizer file, by way of a table of the words seen."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words that a task remembers before it starts anew; words that are encoded in one call.
MOST_WORDS, JOINED = 400_000, 1_000
#: Words that the tokenizer's pattern cuts into one or two pieces: letters, and punctuation but for apostrophes.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)?([.,;:!?|%$&*#()\-]+)?")


class _Places(dict):
    """Numbers words as they come; the new ones wait to be encoded together."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Encodes texts word by word, which equals encoding them whole for a tokenizer that drops white space.

    Words end at ASCII white space only; what else the tokenizer splits or drops is left to it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends_piece = None
        if suffix:
            self.ends_piece = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends_piece[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places, self.ids = _Places(), np.empty(0, np.uint32)
        self.starts = self.lengths = np.empty(0, np.int64)

    def _learn(self) -> None:
        new, self.places.new = [w.decode("utf-8", "replace") for w in self.places.new], []
        if not new:
            return
        pieces = np.zeros(len(new), np.int64)
        if self.ends_piece is not None:
            pieces[:] = [2 - m.groups().count(None) if (m := PLAIN.fullmatch(w)) else 0 for w in new]
        starts, lengths, flat, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        plain = np.flatnonzero(pieces)
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            ids = np.array(self._ids([" ".join([new[k] for k in part])])[0], np.uint32)
            ends, last = np.flatnonzero(self.ends_piece[ids]) + 1, np.cumsum(pieces[part])
            if last[-1] != len(ends):  # not as the pattern was taken to be: one by one
                pieces[part] = 0
                continue
            bounds = np.append(0, ends[last - 1])
            starts[part], lengths[part] = at + bounds[:-1], np.diff(bounds)
            flat.append(ids)
            at += len(ids)
        rest = np.flatnonzero(pieces == 0)
        for k, ids in zip(rest, self._ids([new[k] for k in rest])):
            starts[k], lengths[k] = at, len(ids)
            flat.append(np.array(ids, np.uint32))
            at += len(ids)
        self.ids, self.starts, self.lengths = np.concatenate(flat), np.append(self.starts, starts), np.append(self.lengths, lengths)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.places) > MOST_WORDS:
            self._forget()
        at = [np.fromiter(map(self.places.__getitem__, ws), np.int64, len(ws)) for ws in (t.split() for t in texts)]
        self._learn()
        out = []
        for x in at:
            starts, n = self.starts[x], self.lengths[x]
            total = int(n.sum())
            out.append(self.ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(total)])
        return out


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """One to a Python worker."""
    return WordTokens(path)
