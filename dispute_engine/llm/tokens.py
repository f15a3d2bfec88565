"""Byte-level BPE token ids inside Spark tasks, equal to the tokenizers library's.

The vocabulary file is a parameter; nothing is trained. ``encoder(path)`` gives
one encoder per worker process. Whole texts go through the fast byte-pair
encoder built on the file's own vocabulary (a byte-level vocabulary's merge
order is its id order); the special token's string is cut out first, as the
tokenizers library does, and texts with very long white-space runs, which
overflow that encoder's stack, go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

# Fixed values of the public vocabulary: the pre-tokenising pattern and the special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_LONG_SPACES = re.compile(r"\s{20000}")


def default_vocab() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, all others, in order,
    for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


@lru_cache(maxsize=2)
def pieces(vocab: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id."""
    with open(vocab, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    table = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()
             if all(c in letters for c in piece)}
    table.update({t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])})
    return [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=2)
def library(vocab: str):
    """The tokenizers library's encoder, truncation and padding off."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocab)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def encoder(vocab: str):
    """text -> list of ids, as the library's encode(text, add_special_tokens=False)."""
    import tiktoken

    table = pieces(vocab)
    special = next((i for i, p in enumerate(table) if p == SPECIAL.encode()), None)
    ranks = {p: i for i, p in enumerate(table) if p and i != special}
    plain = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    exact = library(vocab)

    def encode(text: str) -> list[int]:
        if len(text) > 20_000 and _LONG_SPACES.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        if special is None or SPECIAL not in text:
            return plain(text)
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                ids.append(special)
            ids += plain(part)
        return ids

    return encode


# The same pattern for texts whose letters and digits are ASCII or Latin-1 letters; far quicker.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANKS = "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}{_LETTERS}0-9]+"
                    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_OTHER = re.compile("[^\\x00-\\x1b -\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\xff]")


@lru_cache(maxsize=1)
def _any_script():
    import regex
    return regex.compile(PATTERN).findall


def words(text: str) -> list[str]:
    """The pre-tokenised pieces of a text, the special token's string as one of its own."""
    if SPECIAL in text:
        out: list[str] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL)
            out += words(part)
        return out
    return _any_script()(text) if _OTHER.search(text) else _LATIN.findall(text)
