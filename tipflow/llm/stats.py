"""Statistics of whole texts, computed for a slice of an Arrow column at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType

from tipflow.llm.common import _SPACE, grams, slices, utf8, word_hashes

WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "punctuation", "dup_lines", "repeat_words",
            "distinct_words", "log_line_words")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _flags(b"0123456789")
_PUNCTUATION = _flags(b".,;:!?\"'()-")
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            repeats += line in seen
            seen.add(line)
    return len(seen) + repeats, repeats


def _repeated(windows: np.ndarray, n: int) -> int:
    """Words in windows that are found twice or more; ``windows`` begin at each word but the last two."""
    if len(windows) < 2:
        return 0
    ordered = np.argsort(windows, kind="stable")
    same = windows[ordered[1:]] == windows[ordered[:-1]]
    twice = np.zeros(n, bool)
    hit = np.concatenate([ordered[1:][same], ordered[:-1][same]])
    for i in range(WINDOW):
        twice[hit + i] = True
    return int(twice.sum())


def measure(column) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (whole numbers) and FEATURES of each row; a null text counts as empty."""
    data, at = utf8(column)
    counts, features = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for a, b in slices(at):
        bounds = at[a:b + 1]
        text = data[bounds[0]:bounds[-1]]
        edge = bounds - bounds[0]

        def total(mask):
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[edge])

        words, first = word_hashes(data, bounds, lower=False)
        n = np.diff(first)
        windows, _ = grams(words, first, WINDOW) if len(words) else (words, words)
        repeats = np.array([_repeated(windows[x:max(x, y - WINDOW + 1)], y - x) for x, y in zip(first[:-1], first[1:])])
        distinct = np.array([len(np.unique(words[x:y])) for x, y in zip(first[:-1], first[1:])])
        lines = np.array([_lines(text[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:])]).reshape(-1, 2)
        chars = total(_BEGINS[text] & ~_SPACE[text])
        symbols = total(_SYMBOL[text])
        counts.append(np.stack([n, chars, symbols, lines[:, 1], repeats], 1).astype(np.int64))
        some, some_chars = np.maximum(n, 1), np.maximum(chars, 1)
        letters = np.maximum(total(_LETTER[text]), 1)
        features.append(np.stack([
            np.log1p(n), np.log1p(chars / some), np.sqrt(symbols / some_chars), np.sqrt(total(_UPPER[text]) / letters),
            np.sqrt(total(_DIGIT[text]) / some_chars), np.sqrt(total(_PUNCTUATION[text]) / some_chars),
            np.sqrt(lines[:, 1] / np.maximum(lines[:, 0], 1)), np.sqrt(repeats / some), distinct / some,
            np.log1p(n / np.maximum(lines[:, 0], 1))], 1))
    return np.concatenate(counts), np.concatenate(features)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., COUNTS..., features) of every row of ``docs (text)``; ``keep`` names other columns."""
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, LongType())
    schema = schema.add("features", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            counts, features = measure(batch.column("text"))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES)), pa.array(features.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(c) for c in counts.T.copy()), lists], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)
