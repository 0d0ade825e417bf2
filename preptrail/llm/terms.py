"""Terms of whole texts: maximal runs of characters that are not among some ASCII characters."""

import string
from collections.abc import Callable

import pyarrow as pa

LETTERS = string.ascii_letters
LETTERS_AND_DIGITS = string.ascii_letters + string.digits


def splitter(kept: str) -> Callable[[bytes | None], list[bytes]]:
    """A function from a text in UTF-8 to its terms, repeats included; null has none.

    Terms consist of the ASCII characters ``kept`` and of all characters outside ASCII, whose bytes are none
    of ASCII. A-Z are lower-cased, nothing else.
    """
    table = bytearray(range(256))
    for byte in range(128):
        table[byte] = ord(chr(byte).lower()) if chr(byte) in kept else ord(" ")
    table = bytes(table)

    def terms(text: bytes | None) -> list[bytes]:
        return text.translate(table).split() if text else []  # of white space only blanks are left

    return terms


def texts(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as bytes in UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
