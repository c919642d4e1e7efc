"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a public model reads a segment once; at each
position its output links give every piece that ends there, and each relaxes the best
score of that position (Viterbi). Characters that no piece covers cost the model's unknown
penalty and are written as byte pieces, so that every text can be decoded to itself.

A text is escaped as the model does (a space in front, spaces as U+2581). No piece has
U+2581 behind another character (checked when the model is read), so the best path of a
text is the best paths of its segments (spaces and what follows up to the next space), and
repeated segments are read once per worker. A U+2581 of the text itself is written as bytes.

Ties: the longest last piece wins, as in the library. Scores are added in double precision.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
#: Below the lowest score of a piece; the library's fixed value.
UNKNOWN_PENALTY = 10.0
#: Segments up to so many characters are remembered by a worker, so many of them at once.
CACHED_CHARS, CACHED_SEGMENTS = 64, 300_000
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: A parameter wherever it is used.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """Pieces and scores of a model file; read on the driver, shipped to tasks."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], names: list[str]):
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(p) for p in pieces):
            raise ValueError("a piece has a space behind another character: segments would not be independent")
        if len(byte_ids) != 256:
            raise ValueError("the model needs 256 byte pieces")
        self.pieces, self.byte_ids, self.names = pieces, byte_ids, names
        self.unknown = min(score for _, score in pieces.values()) - UNKNOWN_PENALTY
        self.singles = {p for p in pieces if len(p) == 1}
        self.key = uuid.uuid4().hex
        self._automaton, self._texts = None, None
        self._cache: dict[str, bytes] = {}

    @classmethod
    def from_model(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = {n: (i, model.get_score(i)) for i, n in enumerate(names)
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        bytes_ = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        return cls(plain, [bytes_[b] for b in sorted(bytes_)], names)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_texts": None, "_cache": {}}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for piece, (number, score) in self.pieces.items():
                self._automaton.add_word(piece, (len(piece), number, score))
            self._automaton.make_automaton()
        return self._automaton

    def viterbi(self, segment: str) -> list[int]:
        """Ids of the best path through one segment."""
        if self.singles.issuperset(segment):  # no character is unknown
            best, through = [0.0] + [-float("inf")] * len(segment), [None] * (len(segment) + 1)
            for last, hit in self.automaton.iter(segment):
                total = best[last + 1 - hit[0]] + hit[2]
                if total > best[last + 1]:  # longest first, as below
                    best[last + 1], through[last + 1] = total, hit
            found, at = [], len(segment)
            while at:
                found.append(through[at][1])
                at -= through[at][0]
            return found[::-1]
        n = len(segment)
        best, piece, back = [0.0] + [-float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        single = bytearray(n + 1)  # ends of pieces of one character
        settled = 1

        def settle(upto):
            """A character that is no piece of its own may be unknown."""
            for end in range(settled, upto):
                if not single[end] and best[end - 1] + self.unknown > best[end]:
                    best[end], piece[end], back[end] = best[end - 1] + self.unknown, -1, end - 1
        for last, (length, number, score) in self.automaton.iter(segment):
            end = last + 1
            if end > settled:
                settle(end)
                settled = end
            if length == 1:
                single[end] = 1
            start = end - length
            if best[start] + score > best[end]:  # longest first: an equal shorter one does not win
                best[end], piece[end], back[end] = best[start] + score, number, start
        settle(n + 1)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += [self.byte_ids[b] for b in reversed(segment[at - 1].encode())]
            at = back[at]
        return ids[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """The ids of a segment, 4 bytes each."""
        found = self._cache.get(segment)
        if found is None:
            found = array("i", self.viterbi(segment)).tobytes()
            if len(segment) <= CACHED_CHARS:
                if len(self._cache) >= CACHED_SEGMENTS:
                    self._cache.clear()
                self._cache[segment] = found
        return found

    def packed(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each; none for an empty one."""
        if not text:
            return b""
        ids: list[bytes] = []
        for i, run in enumerate(text.split(SPACE)):  # literal U+2581 goes out as bytes
            if i:
                ids.append(array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes())
            escaped = (" " + run if not i else run).replace(" ", SPACE)
            segments = SEGMENT.findall(escaped)
            found = list(map(self._cache.get, segments))
            ids += found if None not in found else [f or self.segment_ids(s) for s, f in zip(segments, found)]
        return b"".join(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one."""
        return array("i", self.packed(text)).tolist()

    @property
    def texts(self) -> list[bytes]:
        """The bytes that each id stands for; none for control and unknown ids."""
        if self._texts is None:
            self._texts = [b""] * len(self.names)
            for piece, (number, _) in self.pieces.items():
                self._texts[number] = piece.replace(SPACE, " ").encode()
            for byte, number in enumerate(self.byte_ids):
                self._texts[number] = bytes([byte])
        return self._texts

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, without the space that encoding put in front."""
        return b"".join(map(self.texts.__getitem__, ids)).removeprefix(b" ")


def worker_model(model: Pieces) -> Pieces:
    """The model that a worker process keeps: tasks that follow each other share its automaton and segments."""
    import sys
    import types
    held = sys.modules.setdefault("riskrank_pieces", types.ModuleType("riskrank_pieces"))
    if getattr(held, "model", model).key != model.key or not hasattr(held, "model"):
        held.model = model
    return held.model


def encode(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` (whether decoding the ids gives the text back).

    Null and empty texts have no ids (and round-trip to the empty text). Repeated rows stay
    repeated; other columns are not read. The model is a parameter of bounded size (its
    vocabulary) and is shipped with the tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batch):
        held = worker_model(model)
        flat, ends, same = array("i"), [0], []
        for text in batch.column(1).to_pylist():
            ids = array("i", held.packed(text or ""))
            flat.extend(ids)
            ends.append(len(flat))
            same.append(held.decode(ids) == (text or "").encode())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends).astype("i8")),
                                           pa.array(same, pa.bool_())],
                                          names=["doc_id", "ids", "n_tokens", "round_trip"])
    return map_texts(rows, run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded rows; null ids give a null text."""
    def run(batches):
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
