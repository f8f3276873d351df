"""Public tokenizers inside tasks: loading, cutting texts into independent units, unit caches."""
from __future__ import annotations

import os
import re
from functools import lru_cache

#: A cut before a space that a non-space follows.  Byte-level BPE never joins what such a cut
#: parts: its pre-tokenizer takes a single space only as the first character of a piece, and gives
#: the last space of a run to the piece behind it.
_CUT = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?:\s|\Z)")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the library of files is installed on every worker."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of a vocabulary file, once per worker process; one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def encode(name: str, text: str) -> list[int]:
    return tokenizer(name).encode(text, add_special_tokens=False).ids


def vocabulary_size(name: str) -> int:
    return tokenizer(name).get_vocab_size(with_added_tokens=True)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte, and the byte."""
    # fixed values: printable Latin-1 bytes stand for themselves, the others are U+0100 and so on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


def space_units(text: str) -> list[str]:
    """``text`` cut before single spaces; those spaces left out: the text is " ".join(units)."""
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")


#: A line break between two non-spaces is a piece of its own.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: Units longer than this aren't kept in caches.
KEPT = 100


def unit_parts(unit: str) -> list[tuple[str, bool]]:
    """A unit taken apart where byte-level BPE takes it apart anyway: at single line breaks, and before a full
    stop or comma that ends it or a line, after an ASCII letter.  True: the part begins the unit, behind its space."""
    out = []
    for k, line in enumerate(_LINE.split(unit)):
        if k:
            out.append(("\n", False))
        if line[-1:] in (".", ",") and line[-2:-1].isascii() and line[-2:-1].isalpha():
            out += [(line[:-1], not k), (line[-1], False)]
        else:
            out.append((line, not k))
    return out


class UnitLengths(dict):
    """unit -> its number of tokens, of units that follow a space, encoded when first met.

    ``fixed`` entries stay; the others are emptied when there are ``limit``, so a worker's memory is bounded.
    """

    def __init__(self, vocabulary: str, fixed: dict[str, int], limit: int = 300_000):
        super().__init__(fixed)
        self.vocabulary, self.fixed, self.limit = vocabulary, fixed, limit
        self.bare: dict[str, int] = {}  # parts that don't follow a space

    def first(self, unit: str) -> int:
        """The same for a text's first unit, without a space before it."""
        return sum(self._bare(p) for p, _ in unit_parts(unit) if p)

    def _bare(self, part: str) -> int:
        if part not in self.bare:
            if len(self.bare) >= self.limit:
                self.bare.clear()
            n = len(encode(self.vocabulary, part))
            if len(part) > KEPT:
                return n
            self.bare[part] = n
        return self.bare[part]

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.limit + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        (head, _), *rest = unit_parts(unit)
        if rest:
            n = self[head] + sum(self._bare(p) for p, _ in rest)
        else:
            n = len(encode(self.vocabulary, " " + unit))
        if len(unit) <= KEPT:
            self[unit] = n
        return n
