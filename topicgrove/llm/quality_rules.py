"""Quality rules: how much of a text lies in repeated n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.storage import named_again, numbered, place_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: n-gram length -> largest share of a text's word characters that may lie in n-grams found twice or more
LIMITS = {5: 0.25, 7: 0.23, 10: 0.20}
LINE_LIMIT = 0.30
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, repeat_share double, base_failed boolean, kept boolean"


def _covered(rolling: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window whose rolling hash occurs more than once."""
    _, where, count = np.unique(rolling, return_inverse=True, return_counts=True)
    twice = (count[where] > 1).astype(np.int32)
    edge = np.zeros(words + 1, np.int32)
    edge[: len(twice)] += twice
    edge[n : n + len(twice)] -= twice
    return np.cumsum(edge[:words]) > 0


def profile(text: str | None) -> tuple:
    """The columns of ``quality_profile`` for one text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass").split()
    n = len(data)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)

    repeat_words, worst, too_much = 0, 0.0, False
    if n >= min(LIMITS):
        joined = np.frombuffer(b" ".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, n) + 1) - 1
        leads = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
        starts = np.concatenate(([0], ends[:-1] + 1))
        chars = leads[ends] - leads[starts]
        hashes = np.fromiter(map(hash, data), np.int64, n).view(np.uint64)
        rolling = hashes.copy()
        for k in range(2, max(LIMITS) + 1):
            if k > n:
                break
            rolling = rolling[:-1] * _BASE + hashes[k - 1 :]  # of k words, from that of k - 1
            if k in LIMITS:
                inside = _covered(rolling, k, n)
                share = float(chars[inside].sum()) / word_chars
                worst, too_much = max(worst, share), too_much or share > LIMITS[k]
                if k == 5:
                    repeat_words = int(inside.sum())
    failed = n < 10 or 100 * repeat_words > 20 * n
    line_share = dup_chars / line_chars if line_chars else 0.0
    kept = not failed and not too_much and line_share <= LINE_LIMIT
    return n, word_chars, symbols, dup_lines, repeat_words, line_share, worst, failed, kept


def quality_profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and the verdict of the repetition rules, all columns kept.

    Words are runs of anything but ASCII white space. Polynomial hashes of 64-bit word hashes roll over 5, 7 and 10
    words in numpy; a window found twice or more covers its words. ``base_failed``: under 10 words, or over
    20 % of the words in repeated 5-word windows. ``kept`` also asks that no length covers more characters than
    ``LIMITS`` allows and that repeated lines hold at most ``LINE_LIMIT`` of the characters of lines with a word.
    A null or empty text has no words and fails. Equal rows get equal results, an empty table stays empty, a text of
    any length is measured whole in one task; of columns whose names clash with the new ones, but for case, the new
    ones remain.
    """
    rows, names = numbered(docs), [c.split()[0] for c in _COLUMNS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
    at = place_of(docs, text_col)  # the text is read where it stands, so that no batch holds it twice
    if docs.schema.fields[at].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} is no string column")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t.as_py()) for t in batch.column(at)]
            made = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), _COLUMNS])
    return named_again(rows.mapInArrow(measure, schema), docs.columns, **{n: F.col(n) for n in names})
