"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search.

The text is marked (a leading space, every space written as the mark), then the automaton is fed character by
character; at each position its output links list all pieces that end there, and each relaxes the best score of that
position. The path with the highest sum of scores wins; of equal sums, the one whose last piece is longest. A
character that no piece covers scores below every piece and is spelled in bytes.

Null and empty texts give no ids and decode to the empty text. Rows are independent (repeated rows repeat their
result, a null id stays null, an empty table gives an empty result); only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime
from .tokencount import MARK

MEMO = 700_000

_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("n_byte_pieces", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def piece_table(model_path: str) -> dict:
    """``pieces``: text to (id, score); ``bytes``: ids of the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.normalize(" a  b ") != f"{MARK * 2}a{MARK * 2}b{MARK}":
        raise ValueError("only models with an identity normaliser and a leading space are supported")
    pieces, spelled = {}, [0] * 256
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            spelled[int(text[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[text] = (i, sp.get_score(i))
    return {"pieces": pieces, "bytes": spelled}


class PieceCodec:
    """Encodes texts to ids and back. Units between marks are searched apart when no piece spans their boundary."""

    def __init__(self, pieces: dict[str, tuple[int, float]], spelled: list[int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, (i, score) in pieces.items():
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces.values()) - 10
        self.spelled = spelled
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        size = max([*(i for i, _ in pieces.values()), *spelled]) + 1
        self.written: list[bytes] = [b""] * size
        for text, (i, _) in pieces.items():
            self.written[i] = text.replace(MARK, " ").encode()
        for b, i in enumerate(spelled):
            self.written[i] = bytes([b])
        self.memo: dict[str, bytes] = {}

    def search(self, text: str) -> list[int]:
        """Ids of the best path through an already marked text."""
        n = len(text)
        best = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here are settled

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if best[done] is None:
                    best[done], back[done] = best[done - 1] + self.unknown, (1, -1)

        for last, (length, piece, score) in self.automaton.iter(text):
            settle(last)
            end = last + 1
            total = best[end - length] + score
            if best[end] is None or total > best[end] or total == best[end] and length > back[end][0]:
                best[end], back[end] = total, (length, piece)
        settle(n)
        ids, end = [], n
        while end:
            length, piece = back[end]
            if piece < 0:
                ids += [self.spelled[b] for b in reversed(text[end - 1].encode())]
            else:
                ids.append(piece)
            end -= length
        return ids[::-1]

    def _unit(self, key: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = np.array(self.search(MARK + key), "<u4").tobytes()
        if len(key) <= 64:
            self.memo[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit values."""
        if not text:
            return b""
        if not self.apart:
            return np.array(self.search(MARK + text.replace(" ", MARK)), "<u4").tobytes()
        if text[0] == " " or MARK in text or "  " in text:
            keys = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        else:
            keys = text.split(" ")
        get = self.memo.get
        return b"".join([get(k) or self._unit(k) for k in keys])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.written.__getitem__, ids))[1:]


_codecs: dict[int, PieceCodec] = {}


def _code_batches(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = shared.value["id"]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(shared.value["pieces"], shared.value["bytes"])
    codec = _codecs[key]
    low, high = min(codec.spelled), max(codec.spelled)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            coded = codec.encode(text)
            ids = np.frombuffer(coded, "<u4")
            raw = text.encode()
            back = codec.decode(ids.tolist())
            rows.append((doc_id, len(raw), len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(coded), sha256(back).hexdigest(), back == raw.replace(MARK.encode(), b" ")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string(), pa.bool_()], strict=True)], names=_OUT.names)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and describe both.

    ``round_trip`` says whether the decoded text equals the source (a literal mark in a text decodes as a space, as the
    format has it). ``model_path`` is read on the driver; the piece table (some 10^4 entries) is what is broadcast.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    found = piece_table(model_path)
    shared = spark.sparkContext.broadcast(found | {"id": hash(tuple(sorted(found["pieces"].items())))})
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_code_batches, shared), _OUT)
