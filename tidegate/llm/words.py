"""Splitting texts into strings that a BPE tokenizer encodes one by one with the same ids.

Neither tokenizer's patterns match across a space that has no white space beside it: the one with word
ends drops white space, the byte-level one puts such a space first in the next match. So a text may be
cut at these spaces, and what a piece encodes to does not depend on its neighbours. Python's idea of
white space includes all of Unicode's, and the four controls 1C-1F beside; a piece is only ever cut
where both agree.
"""

from __future__ import annotations

import re

#: A space with white space, or nothing, beside it is not a cut.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")
_CONTROLS = re.compile("[\x1c-\x1f]")


def spaced_words(text: str) -> list[str]:
    """Pieces whose concatenation is the text; all but the first begin with their space."""
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts or any(map(_edged, parts)):
        return _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def _edged(part: str) -> bool:
    return part[0].isspace() or part[-1].isspace()


def bare_words(text: str) -> list[str]:
    """White space apart, for a tokenizer that drops it."""
    return [text] if _CONTROLS.search(text) else text.split()


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable in
    Latin-1, else the next letter from code point 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out
