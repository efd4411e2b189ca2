"""Decoding of file contents: an override, a byte-order mark, strict UTF-8, else what the first bytes look like most.

Beside UTF-8 these are told apart: UTF-16 with or without a mark (by where its zero bytes are), ISO-2022-JP (by its escapes),
cp932 and EUC-JP (by how much of what they give is kana and kanji, and how little half-width kana), and Western texts of few
bytes beyond ASCII (cp1252). What is none of them is read as cp932, with what can't be read replaced.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "cp932"
SNIFF = 4096


def sniff(data: bytes, override: str | None = None) -> str:
    """The encoding of a file; its first bytes decide."""
    if override:
        return override
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    head = data[:SNIFF]
    if re.search(rb"\x1b\$[@B]|\x1b\([JI]", head) and _read(head, "iso2022_jp") is not None:
        return "iso2022_jp"
    if (wide := _wide(head)) is not None:
        return wide
    if _read(head, "utf-8") is not None:
        return "utf-8"
    scores = {name: _japanese(text) for name in (FALLBACK, "euc_jp") if (text := _read(head, name)) is not None}
    if scores:
        return max(scores, key=scores.get)  # the first of equals
    if sum(b >= 128 for b in head) < 0.2 * len(head) and _read(head, "cp1252") is not None:
        return "cp1252"
    return FALLBACK


def _read(head: bytes, name: str) -> str | None:
    """The text of a file's first bytes, if they are in an encoding; a character may be cut off at the end."""
    try:
        return codecs.getincrementaldecoder(name)().decode(head)
    except UnicodeDecodeError:
        return None


def _wide(head: bytes) -> str | None:
    """UTF-16 without a mark: texts have the zero bytes of their spaces and line ends on one side."""
    even, odd = head[::2].count(0), head[1::2].count(0)
    least = max(2, len(head) // 40)
    for name, zeros, others in (("utf-16-le", odd, even), ("utf-16-be", even, odd)):
        if zeros >= least and others * 8 <= zeros and _read(head, name) is not None:
            return name
    return None


def _japanese(text: str) -> float:
    """How much a text that was read as Japanese looks like it."""
    kana = len(re.findall("[\u3040-\u30ff\u3001\u3002]", text))
    kanji = len(re.findall("[\u4e00-\u9fff]", text))
    odd = len(re.findall("[\uff61-\uff9f\ue000-\uf8ff\u0080-\u009f]", text))
    return 2 * kana + kanji - 2 * odd


def _known(name: str) -> bool:
    try:
        return bool(codecs.lookup(name))
    except LookupError:
        return False


def decoded(content: Column, override: str | None = None) -> Column:
    """struct(encoding, text, failed): failed tells that bytes had to be replaced. One Arrow batch of files at a time."""

    @F.pandas_udf("encoding string, text string, failed boolean")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for data in contents:
                data = bytes(data) if data is not None else b""
                name = sniff(data, override)
                try:
                    rows.append((name, data.decode(name), False))
                except (UnicodeDecodeError, LookupError):
                    rows.append((name, data.decode(name if _known(name) else "utf-8", errors="replace"), True))
            yield pd.DataFrame(rows, columns=["encoding", "text", "failed"])

    return decode(content)
