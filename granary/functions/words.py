"""Words of a text: its runs of letters or digits after NFKC, case folding and removal of invisible format characters."""

from __future__ import annotations

import unicodedata

import regex

#: Bytes of plain texts: letters in lower case, digits, and a blank for all else.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_RUN = regex.compile(r"[\p{L}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def words(text: str | None) -> list[str]:
    """The words in order; null and letterless texts have none."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN).decode("ascii").split()
    return _RUN.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", _FORMAT.sub("", text)).casefold()))
