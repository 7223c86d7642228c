"""Classes of characters as the tokenizer libraries see them.

The regex module and the libraries follow different Unicode versions; characters that they class differently are found
here by asking the tokenizers library itself, on the driver, once.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters of a range that is asked about at once.
LARGEST = 1024
STAND_IN = {OTHER: "!", LETTER: "a", NUMBER: "1", SPACE: " "}


@functools.lru_cache(maxsize=1)
def packed_classes() -> bytes:
    """zlib of one byte a code point: its class under ``\\p{L}``, ``\\p{N}``, ``\\s`` of the libraries' pattern."""
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out = np.full(0x110000, SPACE, np.uint8)
    # Characters of one class behind a character of that class are one pre-token: whole ranges are asked about, and halved where they are mixed.
    ranges = [(0, 0xD800), (0xE000, 0x110000)]
    while ranges:
        low, high = ranges.pop()
        if high - low <= LARGEST:
            text = "".join(map(chr, range(low, high)))
            for mark, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(splitter.pre_tokenize_str(mark + text)) == 1:
                    out[low:high] = kind
                    break
            else:
                if high - low > 1:
                    ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
        else:
            ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
    return zlib.compress(out.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


@functools.lru_cache(maxsize=1)
def packed_disputes() -> bytes:
    """zlib of text: the characters that the regex module classes otherwise, each followed by a stand-in of the right class."""
    table = unpack(packed_classes())
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    everything = "".join(map(chr, points.tolist()))
    mine = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for run in regex.finditer(pattern, everything):
            mine[points[run.start() : run.end()]] = kind
    wrong = [c for c in np.flatnonzero(mine != table).tolist() if not 0xD800 <= c < 0xE000]
    return zlib.compress("".join(chr(c) + STAND_IN[int(table[c])] for c in wrong).encode())


class Splitter:
    """Pre-tokens of the pattern under the libraries' classes."""

    def __init__(self, pattern: str, disputes: bytes):
        pairs = zlib.decompress(disputes).decode()
        self.stand_in = dict(zip(map(ord, pairs[::2]), pairs[1::2], strict=True))
        self.pattern = regex.compile(pattern)
        self.disputed = np.zeros(0x110000, bool)
        self.disputed[list(self.stand_in)] = True

    def undisputed(self, texts: list[str]) -> bool:
        """Whether no character of the texts is in dispute."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return not self.disputed[points].any()

    def __call__(self, text: str, plain: bool = False) -> list[str]:
        if plain or text.isascii() or self.undisputed([text]):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]
