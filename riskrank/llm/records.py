"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A file is a series of frames (the TFRecord framing): the payload's length (8 bytes), the masked
CRC-32C of those 8 bytes, the payload, the masked CRC-32C of the payload; all little-endian. A payload is
one document: the width of an id in bytes (4 bytes), 1 for a null doc_id (4 bytes), the doc_id (8
bytes), then the ids with the end id.

Documents are range-partitioned by doc_id, so that files follow each other in that order; each
task encodes its documents, writes its own files, whose names are unique, and returns an index
row for each frame. The index is a table that Spark commits: files of failed or repeated attempts are in
no index and are never read. Readers need index rows only, all or any selection in any order.

Encoding splits a text where byte-level pre-tokenisation always ends a token. The tokenizer
gets each different piece once; the ids of a text are those of its pieces, one after another
(tested against whole texts).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, sliced, written
from .warc import _filesystem

END_ID = 2
FILE_BYTES = 1 << 30
#: Frames that start in the same range of so many bytes of a file are read in one go.
READ_BYTES = 16 << 20
#: Pieces a worker remembers with their ids; a batch that begins beyond that starts anew.
CACHE_PIECES = 1_000_000
HEADER, HEADER_BYTES = "<IIq", 16
INDEX = "part int, file string, offset long, length long, before long, n_tokens long"
DOCUMENT = "doc_id long, n_tokens long, ids_crc32 long, ids array<int>"
_PIECES, _LINES = re.compile(r" (?=\S)"), re.compile(r"\n(?=\S)")
#: The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
#: themselves, the others follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(BYTE_LETTERS[32])


# -- checksums ----------------------------------------------------------------
def _advance_table(bits: int) -> np.ndarray:
    """CRC-32C (reflected polynomial 0x82F63B78) of every value of ``bits`` bits."""
    crc = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0x82F63B78), crc >> 1)
    return crc


_PAIR = _advance_table(16)
ROW = 64  # bytes whose checksums are computed side by side


def _through(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with the images ``columns`` (4 tables of 256) applied to each x."""
    return columns[0][x & 255] ^ columns[1][(x >> 8) & 255] ^ columns[2][(x >> 16) & 255] ^ columns[3][x >> 24]


def _zeros(n_bytes: int) -> list[np.ndarray]:
    """Maps that append ``n_bytes * 2 ** k`` zero bytes, k = 0 to 39 (n_bytes: a power of two)."""
    x = np.arange(256, dtype=np.uint32)
    one = np.stack([x << (8 * i) for i in range(4)])
    step = np.stack([_PAIR[v & 0xFFFF] ^ (v >> 16) for v in one])  # two bytes
    for _ in range(max(n_bytes.bit_length() - 2, 0)):
        step = np.stack([_through(step, c) for c in step])
    out = [step]
    for _ in range(39):
        out.append(np.stack([_through(out[-1], c) for c in out[-1]]))
    return out


_ROWS, _TWO = _zeros(ROW), _zeros(2)


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload (of an even number of bytes), all computed side by side.

    Every payload is cut, from its end, in rows; a row's checksum is moved over the rows
    behind it, and a payload's checksum is the exclusive or of its rows'."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    rows = -(-sizes // ROW)
    pad = rows * ROW - sizes
    data = b"".join(x for p, n in zip(payloads, pad.tolist()) for x in (bytes(n), p))  # leading zeros change nothing
    grid = np.frombuffer(data, "<u2").reshape(-1, ROW // 2).T
    crc = np.zeros(grid.shape[1], np.uint32)
    for column in np.ascontiguousarray(grid):
        crc = (crc >> 16) ^ _PAIR[(crc & 0xFFFF) ^ column]
    last = np.cumsum(rows)
    behind = np.repeat(last, rows) - 1 - np.arange(len(crc))
    for k in range(int(rows.max(initial=0)).bit_length()):
        moved = np.flatnonzero(behind >> k & 1)
        crc[moved] = _through(_ROWS[k], crc[moved])
    out = np.zeros(len(payloads), np.uint32)
    full = np.flatnonzero(rows)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(crc, (last - rows)[full])
    first = np.full(len(payloads), 0xFFFFFFFF, np.uint32)  # the initial value, moved over the payload
    for k in range(int((sizes // 2).max(initial=0)).bit_length()):
        moved = np.flatnonzero(sizes // 2 >> k & 1)
        first[moved] = _through(_TWO[k], first[moved])
    return out ^ first ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The payloads framed with their lengths and masked checksums."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crc, body_crc = masked(crc32c(heads)), masked(crc32c(payloads))
    return [b"".join((h, a.tobytes(), p, b.tobytes())) for h, a, p, b in zip(heads, head_crc, payloads, body_crc)]


def payloads_of(data: bytes, spots: list[tuple[int, int]]) -> list[bytes]:
    """The payloads of the frames at ``(offset, length)`` of ``data``; a wrong length or checksum raises."""
    out = [data[at + 12:at + n - 4] for at, n in spots]
    heads = [data[at:at + 8] for at, _ in spots]
    sums = np.array([struct.unpack_from("<I", data, at + 8) + struct.unpack_from("<I", data, at + n - 4) for at, n in spots], np.uint32)
    for p, h in zip(out, heads):
        if struct.unpack("<Q", h)[0] != len(p):
            raise ValueError("a frame's length differs from the index")
    if (masked(crc32c(heads)) != sums[:, 0]).any() or (masked(crc32c(out)) != sums[:, 1]).any():
        raise ValueError("a frame does not match its checksum")
    return out


# -- encoding -----------------------------------------------------------------
class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library, without special
    tokens; strings of special tokens in a text are ordinary text.

    A piece is what stands between the ends of tokens that are certain: before a space
    that a word follows, around a line end that a word follows, between a letter and a final comma,
    stop or colon. A piece of letters alone is one pre-token, which the tokenizer's model takes at
    once; all others go through the whole tokenizer."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.line_end = self._ids("\n")
        self.tails = {c: self._ids(c) for c in ",.;:"}
        self.pieces, self.heads = _Known(self, " "), _Known(self, "")
        if any(self._word(w) != self._ids(w) for w in (" abc", "é", " Straße")):
            raise ValueError("the tokenizer is not a byte-level one")

    def _ids(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of letters after a space at most."""
        text = text.replace(" ", _SPACE) if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _piece(self, text: str) -> bytes:
        """Ids of a piece, with the space before it if there is one."""
        bare = text[1:] if text[:1] == " " else text
        return self._word(text) if bare.isalpha() and (bare.isascii() or max(bare) < "\u0250") else self._ids(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``width`` bytes each."""
        for known in (self.heads, self.pieces):
            if len(known) > CACHE_PIECES:
                known.clear()
        head, rest, end = self.heads, self.pieces.__getitem__, self.line_end
        out = []
        for text in texts:
            lines = []
            for line in _LINES.split(text):
                first, *others = _pieces_of(line)
                lines.append(head[first] + b"".join(map(rest, others)))
            out.append(end.join(lines))
        return out


class _Known(dict):
    """Ids by piece; a new piece is encoded when it is asked for. ``before`` stands before each."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, piece: str) -> bytes:
        if piece[-1:] in self.encoder.tails and "a" <= piece[-2:-1] <= "z":
            found = self[piece[:-1]] + self.encoder.tails[piece[-1]]
        else:
            found = self.encoder._piece(self.before + piece)
        self[piece] = found
        return found


def _pieces_of(line: str) -> list[str]:
    """The pieces of a line: cut at spaces that a word follows."""
    if line.isprintable() and "  " not in line and line[-1:] != " ":  # no white space follows a space
        return line.split(" ")
    return _PIECES.split(line)


def worker_encoder(path: str) -> Encoder:
    """One encoder for each worker process: tasks that follow each other share what it has learnt."""
    import sys
    import types
    held = sys.modules.setdefault("riskrank_encoders", types.ModuleType("riskrank_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


# -- files --------------------------------------------------------------------
def write_records(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the documents into record files in ascending order of doc_id; gives the index:
    ``INDEX`` with the archive's ``path`` and ``start``, the number of ids of all documents before.

    Null texts are empty ones. Null ids come last; rows that share an id are ordered by a hash
    of their text (equal rows are alike). Equal keys are spread over files by row number. An empty table writes no file. A
    text of any length is one record. Other columns are not read."""
    path = path or shared_path(docs.sparkSession, "token-ids")

    def run(batches):
        import pyarrow.compute  # noqa: F401 - binds pa.compute on the worker
        from pyspark import TaskContext
        part, encode = TaskContext.get().partitionId(), worker_encoder(tokenizer)
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, at, before, end = None, "", 0, 0, np.array([end_id], f"<u{encode.width}").tobytes()
        for batch in sliced(batches, 1):
            payloads = [struct.pack(HEADER, encode.width, doc_id is None, doc_id or 0) + ids + end
                        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()))]
            index = []
            for frame in frames(payloads):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.rec", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(frame)
                n = (len(frame) - 16 - HEADER_BYTES) // encode.width
                index.append((part, name, at, len(frame), before, n))
                at += len(frame)
                before += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), _INDEX_TYPES)], names=_INDEX_NAMES)
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.col("doc_id").isNull().alias("last"), F.xxhash64("text").alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    key = ["last", "doc_id", "tie", "row"]
    index = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text").mapInArrow(run, INDEX)
    index = written(index, "record-index")
    # one row a task that wrote; the window over them is bounded by the number of partitions
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("ahead"))
    return index.join(parts, index["part"] == parts["p"]) \
                .select(*_INDEX_NAMES, F.lit(path).alias("path"), (F.col("ahead") + F.col("before")).alias("start"))


def read_records(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """``start`` and ``DOCUMENT`` of the index rows given, read from the files and checked.

    Rows are dealt by byte ranges of the files, so the number of tasks follows the bytes
    that are read, not those of the index; a task reads each of its ranges in one go."""
    total = index.agg(F.sum("length")).first()[0] or 0
    block = (F.col("offset") / READ_BYTES).cast("long").alias("block")
    spots = index.select("path", "file", block, "offset", "length", "start") \
                 .repartition(max(1, -(-total // READ_BYTES)), "path", "file", "block") \
                 .sortWithinPartitions("path", "file", "offset")
    schema = "start long, " + DOCUMENT if with_ids else "start long, " + DOCUMENT.rpartition(", ")[0]

    def run(batches):
        held = []
        for batch in batches:
            for spot in zip(*(c.to_pylist() for c in batch.columns)):
                if held and spot[:3] != held[0][:3]:
                    yield _documents(held, with_ids)
                    held = []
                held.append(spot)
        if held:
            yield _documents(held, with_ids)
    return spots.mapInArrow(run, schema)


def _documents(spots: list[tuple], with_ids: bool) -> pa.RecordBatch:
    """The documents of frames of one file, by one read."""
    first, size = spots[0][3], spots[-1][3] + spots[-1][4] - spots[0][3]
    fs, root = _filesystem(spots[0][0])
    with fs.open_input_file(f"{root}/{spots[0][1]}") as file:
        data = file.read_at(size, first)
    doc_ids, counts, crcs, lists = [], [], [], []
    for p in payloads_of(data, [(s[3] - first, s[4]) for s in spots]):
        width, null, doc_id = struct.unpack_from(HEADER, p)
        ids = np.frombuffer(p, f"<u{width}", offset=HEADER_BYTES).astype("<u4")
        doc_ids.append(None if null else doc_id)
        counts.append(len(ids))
        crcs.append(zlib.crc32(ids.tobytes()))
        lists.append(ids)
    columns = [pa.array([s[5] for s in spots], pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
    names = ["start", "doc_id", "n_tokens", "ids_crc32"]
    if with_ids:
        ends = np.cumsum([0, *counts])
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.int64()) for c in INDEX.split(", ")]
