"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks; nothing is trained.

Each byte ``b`` is written as the character ``U+0100 + b``, so that every token is a string of such characters, its piece.
A piece's score is its negative rank and normalisation is the identity: sentencepiece then joins the adjacent pair of the
lowest rank first, the leftmost of equal ones, which is byte-level BPE. Texts are split into pre-tokens by a pattern and
each is encoded by itself; a pre-token that is a token of the vocabulary is that token, as merges don't reach every one.
Ids are ranks. Decoding looks the pieces up and maps their characters back to bytes.

Null texts count as empty and give no ids; very long texts and pre-tokens are encoded whole (the merge queue is
n log n). Repeated rows are encoded alike, an empty table gives none, other columns stay. Ids outside of the
vocabulary are an error, as is a vocabulary that lacks one of the 256 bytes. Bytes that aren't UTF-8 are replaced by U+FFFD
before encoding, as in any decoding to text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

#: Pre-tokens whose ids a worker remembers; the memory starts afresh beyond that.
REMEMBERED = 200_000
#: Longer pre-tokens are encoded each time.
REMEMBERED_CHARS = 64
#: Bytes of text (or ids) whose results a worker holds before it hands them on.
HELD = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file of lines ``base64(token) rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


#: What each byte is in a piece.
PIECES = {b: 0x100 + b for b in range(256)}


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(PIECES)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model of a vocabulary; its ids are the ranks, and the one after them is the unknown piece it must have."""
    n = len(ranks)
    if sorted(ranks.values()) != list(range(n)) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be gapless from 0 and hold all 256 bytes")
    model = proto.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        model.pieces.add(piece=to_piece(token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(n), type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = n + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = n, -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """A model in a worker. Ids of short pre-tokens are remembered as bytes, as few of them make up most of a text."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.tokens = [to_bytes(p) for p in pieces]
        self.split = regex.compile(pattern).findall
        # Tokens that merges of their own bytes don't give.
        self.whole = {t.decode(): [i] for i, (t, ids) in enumerate(zip(self.tokens, self.model.encode(pieces, num_threads=1))) if ids != [i] and is_text(t)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        new = set(words).difference(self.known)
        if new and len(self.known) >= REMEMBERED:
            self.known, new = {}, set(words)
        for word in new:
            ids = self.whole.get(word) or self.model.encode(to_piece(word.encode()), num_threads=1)
            self.known[word] = np.array(ids, dtype="<i4").tobytes()
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<i4")
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del self.known[word]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is not of this vocabulary")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec_of(model: bytes, pattern: str) -> Codec:
    """One for each worker process and model; a worker that starts anew builds it anew."""
    name = hashlib.sha256(model + pattern.encode()).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(model, pattern)
    return _codecs[name]


class Tokenizer:
    """Adds ids to texts and texts to ids. The model (about 20 bytes a token) is broadcast once.

    Ids are ``array<int>`` or, packed, ``binary``: unsigned 32-bit integers, the lowest byte first. Rows pass through
    Arrow in the order and partition they have; a worker holds the ids of about ``HELD`` bytes of text at a time.
    A column that has the name of the new one gives way to it.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.model: Broadcast = spark.sparkContext.broadcast(serialise(ranks))
        self.pattern = pattern

    def _added(self, df: DataFrame, source: Column, name: str, kind: T.DataType, arrow: pa.DataType, work: Callable[[Codec, Any], Any]) -> DataFrame:
        model, pattern = self.model, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = codec_of(model.value, pattern)
            for batch in batches:
                source, start, made, size = batch.column(batch.num_columns - 1), 0, [], 0
                for i, value in enumerate(source, 1):
                    value = value.as_py()
                    made.append(None if value is None else work(codec, value))
                    size += 0 if value is None else len(value)
                    if size >= HELD or i == len(source):
                        part = batch.slice(start, i - start)
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, arrow)], names=[*part.schema.names[:-1], name])
                        start, made, size = i, [], 0
        rest = df.drop(name)
        schema = T.StructType([*rest.schema.fields, T.StructField(name, kind)])
        return df.select(*(F.col(f"`{c}`") for c in rest.columns), source.alias("_source")).mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
        source = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
        kind, arrow = (T.BinaryType(), pa.binary()) if packed else (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))

        def work(codec: Codec, value: bytes) -> bytes | np.ndarray:
            found = codec.encode(value.decode("utf-8", "replace"))
            return found.tobytes() if packed else found
        return self._added(df, source, ids, kind, arrow, work)

    def decode(self, df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``decoded`` is ``binary``; cast it to a string for the text. Null gives null."""
        packed = isinstance(df.schema[ids].dataType, T.BinaryType)
        return self._added(df, F.col(ids), decoded, T.BinaryType(), pa.binary(), lambda codec, value: codec.decode(np.frombuffer(value, "<i4") if packed else value))


def tokenizer(spark: SparkSession, path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, which only the driver reads."""
    return Tokenizer(spark, read_ranks(path), pattern)
