"""Token ids of whole texts, as ``tokenizers`` gives them, with a cache of chunks.

The byte-level vocabulary's splitting rule never lets a token cross the start of
`` word`` (one space, then a non-space) or a lone line feed between non-spaces. A text
therefore encodes as the concatenation of such chunks, and a chunk is encoded once
while it stays in a bounded cache. A chunk of letters is one word to the splitting rule, so
the vocabulary's merges are applied to it directly; other chunks go through the library. Texts
with any other white space, or with the string of an added token, are encoded whole by it.
"""

from __future__ import annotations

import json
from array import array

#: Chunks in each of a cache's two generations.
CACHE_CHUNKS = 300_000


class _Odd(Exception):
    """A chunk that can't be encoded apart from its neighbours."""


class _Chunks(dict):
    """Ids by chunk. A full cache becomes the older generation, from which used chunks come back."""

    def __init__(self, word, other):
        super().__init__()
        self.word, self.other, self.older = word, other, {}

    def __missing__(self, chunk: str) -> bytes:
        core = chunk[1:] if chunk[:1] == " " else chunk
        if len(core) > 1 and core[-1] in ".," and core[:-1].isalpha():
            return self[chunk[:-1]] + self[core[-1]]  # letters and punctuation never share a token
        ids = self.older.get(chunk)
        if ids is None:
            if core.isalpha():
                ids = self.word(chunk)
            elif chunk != "\n" and (not core or core[0].isspace() or core[-1].isspace()):
                raise _Odd
            else:
                ids = self.other(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        #: chunks are right for plain byte-level splitting only
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        word = self._words(spec["model"]) if self.by_chunk and spec["model"].get("type") == "BPE" else None
        self.chunks = _Chunks(word or self.encode, self.encode)

    def _words(self, model: dict):
        """The same merges without offsets, if the vocabulary's ids are in the order of the merges; else None."""
        import tiktoken

        vocab, sign = model["vocab"], _byte_of_sign()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        special = set(self.added)
        if ids != sorted(ids) or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        ranks = {bytes(sign[c] for c in t): n for t, n in vocab.items() if t not in special}
        bpe = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})._core_bpe
        one = bpe.encode_single_piece
        return lambda chunk: array("I", one(chunk.encode())).tobytes()

    def encode(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or "\0" in text or any(a in text for a in self.added):
            return self.encode(text)
        parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        if not parts[-1]:
            parts.pop()
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except _Odd:
            return self.encode(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
