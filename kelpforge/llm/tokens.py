"""Byte-level BPE ids of whole texts, with the ids of words kept between documents.

The ids are those of the ``tokenizers`` library for the same file. Words not met before are merged by ``tiktoken``,
which is several times as fast on short strings; it takes its ranks from that file, and only if the file's merges
stand in the order of their ids, the same condition under which both are the same function. Else ``tokenizers`` does
that too.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from sys import getsizeof

#: Bytes of a dictionary's entry beside its key and value.
ENTRY = 100
#: A blank before a visible character always begins a new pre-token of the byte-level pattern, so what lies
#: between two such blanks is encoded alone. ``\s`` of Python covers the libraries' white space and four more.
_WORD = re.compile(r" (?=\S)")
#: The byte-level pattern, a fixed value of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain_encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, special tokens' strings being ordinary text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
    if all(vocab["".join(p)] == 256 + k for k, p in enumerate(pairs)):
        import tiktoken

        special, letters = {x["content"] for x in spec["added_tokens"]}, _byte_letters()
        ranks = {bytes(letters[c] for c in word): k for word, k in vocab.items() if word not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id, special tokens being their strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special, letters = {x["id"]: x["content"] for x in spec["added_tokens"]}, _byte_letters()
    words = {k: word for word, k in spec["model"]["vocab"].items()} | special
    return [special[k].encode() if k in special else bytes(letters[c] for c in words[k]) for k in range(max(words) + 1)]


class WordEncoder:
    """Ids of whole texts as packed unsigned 32-bit integers of the machine's (little-endian) order.

    A text is cut before each blank that a visible character follows; the ids of each part are computed once and kept
    in a table, which is emptied when parts and ids hold about ``limit`` bytes, the objects' own ones included.
    """

    def __init__(self, path: str, limit: int = 56 << 20):
        self._encode = plain_encoder(path)
        self._known: dict[str, bytes] = {}
        self._held, self._limit = 0, limit

    def _pack(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_WORD.split(x) for x in texts]
        firsts = [self._pack(x.pop(0)) for x in cut]
        if self._held > self._limit:
            self._known.clear()
            self._held = 0
        known = self._known
        for part in set().union(*cut).difference(known):
            known[part] = ids = self._pack(f" {part}")
            self._held += ENTRY + getsizeof(part) + getsizeof(ids)
        find = known.__getitem__
        return [first + b"".join(map(find, parts)) for first, parts in zip(firsts, cut, strict=True)]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that later tasks there find the words that earlier ones met."""
    return WordEncoder(path)
