"""Token ids of a byte-level BPE vocabulary by a sentencepiece model made from it.

The vocabulary file lists byte strings by rank. model_bytes writes them as the pieces of a sentencepiece BPE model:
bytes are mapped to printable letters, the score of a piece is its negative rank, normalisation is the identity.
sentencepiece joins the pair of neighbours whose union is the piece of the highest score, which is the merge rule of
byte-level BPE, so a pre-token gets the same ids. Texts are cut into pre-tokens first, as merges never cross them.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The pattern that cuts a text into pre-tokens.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker keeps; a full memory is emptied.
KEPT = 200_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is visible, else the next free letter from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _flag(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _flag(3, kind))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary: id = rank, then the unknown piece, which no text can reach."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    pieces = b"".join(_piece("".join(letters[b] for b in t), -float(ranks[t]), 1) for t in order)
    pieces += _piece("⁇unknown", -1e9, 2)
    trainer = _block(2, _flag(3, 2) + _flag(40, len(order)))  # BPE; id of the unknown piece
    normalizer = _block(3, _block(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))  # no dummy prefix, no trimming, no escaping
    return pieces + trainer + normalizer


def read_ranks(path: str | Path) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Encoder:
    """Ids of texts and texts of ids."""

    def __init__(self, path: str | Path) -> None:
        import sentencepiece

        ranks = read_ranks(path)
        self.bytes_of = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.cut = regex.compile(PRETOKEN)
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Null and empty texts give empty lists; spellings of special tokens are ordinary text."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for ws in cut for w in ws) if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = list(dict.fromkeys(w for ws in cut for w in ws))
        # latin-1 gives a letter for each byte, translate then maps it
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in new]
        self.known.update(zip(new, self.model.encode(mapped, num_threads=1), strict=True))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """The inverse mapping: the bytes of the ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file; a bare name is a file that the job sent along."""
    return Encoder(path if Path(path).is_absolute() and Path(path).exists() else SparkFiles.get(Path(path).name))


def _send(spark: SparkSession, directory: str, name: str) -> str:
    """Send the vocabulary with the job, so that executors needn't have the folder."""
    path = f"{directory}/{name}.tiktoken"
    spark.sparkContext.addFile(str(Path(path).resolve()))
    return path


def token_ids(df: DataFrame, text: str = "text", out: str = "ids", name: str = VOCABULARY, directory: str = TOKENIZER_DIR) -> DataFrame:
    """Adds the ids of a text column; see Encoder.encode_batch for null and empty texts. Other columns pass unread."""
    path = _send(df.sparkSession, directory, name)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series(e.encode_batch([t if isinstance(t, str) else None for t in texts]))

    return df.withColumn(out, ids(text))


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = VOCABULARY, directory: str = TOKENIZER_DIR) -> DataFrame:
    """Adds the number of tokens of a text column."""
    path = _send(df.sparkSession, directory, name)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([len(x) for x in e.encode_batch([t if isinstance(t, str) else None for t in texts])], dtype="int64")

    return df.withColumn(out, count(text))


def decoded(df: DataFrame, ids: str = "ids", out: str = "decoded", name: str = VOCABULARY, directory: str = TOKENIZER_DIR) -> DataFrame:
    """Adds the text of a column of ids; a null list gives an empty text."""
    path = _send(df.sparkSession, directory, name)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for lists in batches:
            yield pd.Series([e.decode(list(x)) if x is not None else "" for x in lists])

    return df.withColumn(out, back(ids))
