"""Text helpers of the operators that run in Python workers.  They work on UTF-8 bytes, where every character
that ends a word or a line is one byte."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: The white space \x20\x09-\x0D, which is also what bytes.split() splits at.
SPACE = b" \t\n\x0b\x0c\r"

# A-Z to a-z; bytes of \x00-\x2F, \x3A-\x60 (once lower-cased) and \x7B-\x7F to a space; the rest as it is.
ALNUM = bytes(ord(" ") if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def encoded(text: str | None) -> bytes:
    """UTF-8; a lone surrogate, which no well-formed table holds, becomes a question mark."""
    return b"" if text is None else text.encode("utf-8", "replace")


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The bytes of a string column; null gives none."""
    col = batch.column(batch.schema.get_field_index(name))
    for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()):
        yield x.as_py() or b""
