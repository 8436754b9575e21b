"""Token ids of many texts by a given tokenizer file.

Byte-level BPE never joins text across the start of a run of spaces, so a batch is cut
there, each distinct piece is encoded once, and the ids are put together by index. Texts
with other white space or with a special token's string are encoded whole by the
tokenizer itself, as are all texts where the file holds another kind of model.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from fleetscope.llm.spans import SPACE, named

# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x3C]] = True
_LOADED: dict[str, "Encoder"] = {}


def token_file(name: str) -> str:
    """Path of a public tokenizer's file on this machine; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "Encoder":
    if name not in _LOADED:
        _LOADED[name] = Encoder(token_file(name))
    return _LOADED[name]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.quick = self._merger(spec)

    @staticmethod
    def _merger(spec: dict):
        """An encoder of single pieces, if the file is plain byte-level BPE with merges in the order of their ids."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if not plain or "merges" not in model or model.get("dropout") or model.get("ignore_merges"):
            return None
        letters, vocab = _byte_letters(), model["vocab"]
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(b <= a for a, b in zip(ids, ids[1:])):
            return None
        import tiktoken

        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in added}
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(_ODD[data])
        padded = np.r_[data, np.zeros(2, np.uint8)]
        a, b, c = data[at], padded[at + 1], padded[at + 2]
        odd = a < 0x20
        odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
        odd |= ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
        rows = set((np.searchsorted(offsets, at[odd], "right") - 1).tolist())
        text = data.tobytes()
        for mark in self.special:
            found = text.find(mark)
            while found >= 0:
                rows.add(int(np.searchsorted(offsets, found, "right")) - 1)
                found = text.find(mark, found + 1)
        return np.array(sorted(rows), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of rows in ids) of the UTF-8 texts ``data[offsets[i]:offsets[i + 1]]``."""
        rows = len(offsets) - 1
        if self.quick is None:
            odd = np.arange(rows)
        else:
            odd = self._odd_rows(data, offsets)
        usual = np.ones(rows, bool)
        usual[odd] = False
        flat, counts = self._pieces(data, offsets, usual) if usual.any() else (np.zeros(0, np.uint32), np.zeros(rows, np.int64))
        if not len(odd):
            return flat, np.r_[0, np.cumsum(counts)]
        cuts, parts = np.r_[0, np.cumsum(counts)], []
        special = {}
        for k in odd.tolist():
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
            special[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        for k in range(rows):
            parts.append(special[k] if k in special else flat[cuts[k] : cuts[k + 1]])
        sizes = [len(x) for x in parts]
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)].astype(np.int64)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        space = SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(data)]
        row = np.searchsorted(offsets, starts, "right") - 1
        own = usual[row]
        starts, ends, row = starts[own], ends[own], row[own]
        which, first = named(data, starts, ends)
        text = data.tobytes()
        found = [self.quick(text[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        length = sizes[which]
        at = np.cumsum(length) - length
        ids = pool[np.arange(int(length.sum())) + np.repeat(begin[which] - at, length)]
        return ids, np.bincount(row, weights=length, minlength=rows).astype(np.int64)
