"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi in one pass."""

from __future__ import annotations

import re
import zlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.storage import named_again, numbered, place_of

SPACE = "▁"
#: characters of the chunks that are kept, about 50 MB with their ids, and of the longest of them
CACHED_CHARS, LONGEST_KEPT = 1_200_000, 64
#: below the worst piece, as the unigram model sets it for a character that no piece holds
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces, scores and ids of a SentencePiece model file; ids of the best-scored segmentation of a text.

    A space becomes U+2581 and one more leads the text, where the model asks for it. Among all ways to cut the
    text into pieces the one of the greatest sum of scores is taken; of equal sums, the one whose last piece is
    longest. A character that no piece holds is written as its UTF-8 bytes' pieces, or the unknown id where there
    are none. Texts are cut before runs of U+2581 and around line feeds, where no piece of the model crosses;
    each cut of the text is solved once; short ones are kept in a cache bounded by its characters.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size, self.unknown = model.get_piece_size(), model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.single: set[str] = set()
        least, crossing = 0.0, False
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i) or i == self.unknown:
                self.bytes_of.append(b"")
            else:
                score = model.get_score(i)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                least = min(least, score)
                crossing |= SPACE in piece.lstrip(SPACE) or "\n" in piece
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown_score = least - UNKNOWN_PENALTY
        self.cut = re.compile(r"(?s).+" if crossing else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.lead = model.encode("a", out_type=str)[0].startswith(SPACE)
        self.kept: dict[str, bytes] = {}
        self.kept_chars = 0

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: each match that the automaton reports at a position relaxes that position's best sum."""
        n = len(chunk)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        holes = [i for i, c in enumerate(chunk, 1) if c not in self.single] if not self.single.issuperset(chunk) else []
        hole = 0
        for last, (length, score, piece) in self.automaton.iter(chunk):
            end = last + 1
            while hole < len(holes) and holes[hole] < end:  # earlier ends are final once their holes are relaxed
                self._relax_hole(best, came, holes[hole])
                hole += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], came[end] = total, (length, piece)
            if hole < len(holes) and holes[hole] == end:
                self._relax_hole(best, came, end)
        for end in holes[hole:]:
            self._relax_hole(best, came, end)
        ids: list[int] = []
        while n:
            length, piece = came[n]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(chunk[n - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
            n -= length
        return ids[::-1]

    def _relax_hole(self, best: list[float], came: list[tuple[int, int]], end: int) -> None:
        total = best[end - 1] + self.unknown_score
        if total > best[end]:
            best[end], came[end] = total, (1, -1)

    def encode(self, text: str | None) -> bytes:
        """Little-endian int32 ids; none for a null or empty text."""
        if not text:
            return b""
        text = (" " + text if self.lead else text).replace(" ", SPACE)
        chunks = self.cut.findall(text)
        if self.kept_chars > CACHED_CHARS:
            self.kept, self.kept_chars = {}, 0
        known, long = self.kept, {}
        for chunk in set(chunks).difference(known):
            coded = np.array(self.segment(chunk), "<i4").tobytes()
            if len(chunk) > LONGEST_KEPT:
                long[chunk] = coded
            else:
                known[chunk] = coded
                self.kept_chars += len(chunk)
        both = ChainMap(known, long) if long else known
        return b"".join(map(both.__getitem__, chunks))

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids: exact for what ``encode`` gave, but for U+2581, which is read as a space."""
        each = np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else ids
        text = b"".join(map(self.bytes_of.__getitem__, each.tolist())).decode("utf-8", "replace")
        return text[1:] if self.lead and text[:1] == " " else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_pieces, pieces_crc32, decoded_ok and, if asked for, piece_ids; all columns kept.

    Whole texts; null or empty ones have no ids. ``decoded_ok``: decoding the ids gives the text again, U+2581 read
    as a space. Of columns whose names clash with the new ones, but for case, the new ones remain. Repeated rows stay
    and get equal results; an empty table stays empty. A text of any length is encoded whole, in one task, in time and
    memory that grow with it.
    """
    rows = numbered(docs)
    kinds = {"n_pieces": "long", "pieces_crc32": "long", "decoded_ok": "boolean"} | ({"piece_ids": "array<int>"} if keep_ids else {})
    at = place_of(docs, text_col)  # the text is read where it stands, so that no batch holds it twice
    if docs.schema.fields[at].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} is no string column")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                coded = [model.encode(t) for t in texts]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                right = [model.decode(c) == t.replace(SPACE, " ") for c, t in zip(coded, texts, strict=True)]
                made = [pa.array(sizes), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(right)]
                if keep_ids:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                    made.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *kinds])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{n} {k}" for n, k in kinds.items())])
    return named_again(rows.mapInArrow(encode, schema), docs.columns, **{n: F.col(n) for n in kinds})
