"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every token's bytes are mapped to 256 printable characters, and the model holds one piece per token, scored by
its negative rank, with an identity normaliser and no added or removed spaces. sentencepiece merges the pair
with the best score, leftmost first, which is the lowest rank, so a pre-token gets the ids of the rank
file. Texts are cut into pre-tokens by the given pattern; decoding maps ids back to bytes.

The serialised model is written by hand (three small messages), so it needs no protocol compiler, and is sent to
the workers with the function.

Cases with a defined result: a null text is an empty text; an empty text has no ids, the digest of no bytes and
decodes to nothing; unpaired surrogates can't occur in Spark strings; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.chunks import Memory
from flowsieve.llm.common import give_back, per_text, worker_memory


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for every byte: the byte's own where Latin-1 prints it, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is the unknown piece, piece r + 1 the token of rank r.

    Field numbers are those of the public sentencepiece model format.
    """
    letters = byte_characters()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [_field(1, unknown)]
    for rank, token in enumerate(by_rank):
        text = "".join(map(letters.__getitem__, token)).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) \
        + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts by a serialised model and the tokens of its ranks."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.letters = byte_characters()
        self.tokens = tokens
        self.memory = Memory(self._chunks, limit=100_000)

    def _chunks(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as 32-bit numbers, ids as decimal text) of every chunk."""
        pre = [self.split(p) for p in parts]
        letters = self.letters.__getitem__
        pieces = list({t for line in pre for t in line})
        mapped = ["".join(map(letters, t.encode("utf-8", "surrogatepass"))) for t in pieces]
        ids = dict(zip(pieces, self.model.encode(mapped, num_threads=1))) if pieces else {}
        out = []
        for line in pre:
            own = [i - 1 for t in line for i in ids[t]]
            out.append((np.array(own, "<u4").tobytes(), " ".join(map(str, own)).encode()))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decimal ids joined by a space) of every text."""
        out = []
        for parts in self.memory.values(texts):
            out.append((np.frombuffer(b"".join([p[0] for p in parts]), "<u4"), b" ".join([p[1] for p in parts])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Tokenizer:
    """A rank file and a pattern, sent to the workers as a serialised model."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.tokens = sorted(ranks, key=ranks.get)
        self.model, self.pattern = serialised(ranks), pattern
        self.mark = (hashlib.sha256(self.model).hexdigest(), pattern)

    def codec(self) -> Codec:
        """The worker's codec, kept with its memory for later tasks."""
        kept = worker_memory()
        if kept.get("codec", (None,))[0] != self.mark:
            kept["codec"] = self.mark, Codec(self.model, self.tokens, self.pattern)
        return kept["codec"][1]


def _task(batches, each, codec, rows: int = 100):
    """per_text over a task's batches; the worker keeps the codec for later tasks, but not the chunks this one has met."""
    try:
        yield from per_text(batches, each, rows)
    finally:
        codec().memory.clear()
        give_back()


def _texts(column) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def encoded(docs: DataFrame, tokenizer: Tokenizer, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns but the text, with the ids as array<int>."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() == ids.lower()])
    kept = [f for f in rows.schema.fields if f.name.lower() != text.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        out = part[[f.name for f in kept]].copy()
        out[ids] = [i.astype("int32") for i, _ in shared.value.codec().encode(_texts(part[text]))]
        return out

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInPandas(lambda batches: _task(batches, each, lambda: shared.value.codec()), f"{fields}`{ids}` array<int>")


def decoded(rows: DataFrame, tokenizer: Tokenizer, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns but the ids, with the decoded text; bytes that aren't UTF-8 become U+FFFD."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() == text.lower()])
    kept = [f for f in rows.schema.fields if f.name.lower() != ids.lower()]
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        out = part[[f.name for f in kept]].copy()
        codec = shared.value.codec()
        out[text] = [codec.decode(np.asarray([] if i is None else i, "int64")).decode("utf-8", "replace") for i in part[ids]]
        return out

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInPandas(lambda batches: per_text(batches, each, 200), f"{fields}`{text}` string")


def digests(docs: DataFrame, tokenizer: Tokenizer, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes, decodes the ids again, and digests both."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        codec = shared.value.codec()
        out = []
        for ids, decimal in codec.encode(_texts(part["text"])):
            row = (len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
            out.append((*row, ids.astype("int32")) if with_ids else row)
        made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids, index=part.index)
        return pd.concat([part[["doc_id"]], made], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(lambda batches: _task(batches, each, lambda: shared.value.codec()),
                            f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
