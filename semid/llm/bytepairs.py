"""Reading byte-level BPE vocabularies, and texts as chunks that encode independently."""

from __future__ import annotations

import base64
import json
from array import array
from functools import lru_cache

#: Chunks remembered by a worker, each of up to ``LONGEST`` characters; beyond, it starts anew.
REMEMBERED, LONGEST = 400_000, 64
#: Below this code point the libraries' Unicode tables surely agree.
PLAIN = "ɐ"


class Unsafe(Exception):
    """The text can't be cut at its single spaces."""


def cut(text: str) -> list[str]:
    """The pieces between single spaces, each of which but the first has lost the space before it.

    No match of the pattern runs from a character that isn't white space into a space,
    so pieces encode independently, unless one ends in white space or is empty (then
    spaces meet other white space, and how they match depends on what follows).
    """
    return text.split(" ")


def ends_in_space(piece: str) -> bool:
    return not piece or piece[-1].isspace()


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies spell a printable byte as its own character and the others, in order, from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them for a vocabulary file.

    Distinct chunks are encoded once while remembered. Plain chunks go through the
    faster library over the same vocabulary where its merges are in the order of its
    ids; texts with special strings and all others go through the library itself.
    """

    def __init__(self, json_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(json_file)
        with open(json_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], _byte_of_char()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=plain, special_tokens={}) if merged == sorted(merged) else None
        self.first: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.fast is None or text.isascii() is False and max(text) >= PLAIN:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return array("I", found).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if ends_in_space(piece):
            raise Unsafe
        out = self.ids(" " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = cut(text)
        try:
            if pieces[0] and ends_in_space(pieces[0]):
                raise Unsafe
            return b"".join([self.ids(pieces[0]) if pieces[0] else b"", *map(self.__getitem__, pieces[1:])])
        except Unsafe:
            return self.ids(text)


@lru_cache(1)
def chunk_encoder(json_file: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(json_file, pattern)
