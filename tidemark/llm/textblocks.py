"""Words of UTF-8 texts block by block, so that a very long text never becomes
one long list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Bytes that are split into words at a time; a word is never cut.
BLOCK_BYTES = 1 << 20
# Bytes between words.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
NOT_ALNUM = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")
ALNUM_WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")


def blocks(raw: bytes, separator: re.Pattern, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes, each ending before a separator."""
    lo = 0
    while lo < len(raw):
        hi = lo + size
        if hi < len(raw):
            end = separator.search(raw, hi)
            hi = end.start() if end else len(raw)
        yield raw[lo:hi]
        lo = hi


def spaced_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, case kept."""
    return (part.split() for part in blocks(raw, SPACE))


def alnum_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of ASCII letters (A-Z lower-cased), digits and bytes above ASCII."""
    return (ALNUM_WORD.findall(part.lower()) for part in blocks(raw, NOT_ALNUM))
