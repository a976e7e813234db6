"""Token files in patched frame-of-reference blocks.

Documents are put in id order by a range shuffle of the whole texts (a large id range or a repeated id is split by
text and row), encoded with the tokenizers library, and appended to segments of about SEGMENT_IDS ids. A
segment is one binary value that can be read alone:

    header   magic, number of ids, blocks and documents
    index    where each block begins in the packed area, its width, minimum and number of exceptions
    packed   every block's (id - minimum), cut to the block's width, 64-bit words
    patches  positions inside the blocks and values of the ids that don't fit
    lengths  ids of every document, each with its end id

A block's width is the least one that fits PERCENTILE of its ids; wider ids go to its exception list. Spark writes
the segments as binary rows of Parquet files, one file per task, so that a lost executor costs one task and
unfinished files never count. A document lies in one segment, so memory is bounded by a slice of texts, a segment, the
longest document and the table of known pre-tokens.

Cases with a defined result: a null or empty text is the end id alone; rows with a null id come first; repeated ids follow
each other in text order; an empty table gives no segments and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.bpe import byte_characters
from flowsieve.llm.chunks import long_space
from flowsieve.llm.common import give_back, worker_memory

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
MAGIC = b"PFR1"
#: Fixed value: the pattern of the library's byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts and characters of a slice, whose distinct chunks are encoded once. A slice takes some 20 bytes a character.
SLICE_ROWS, SLICE_CHARS = 20_000, 6_000_000
#: Pre-tokens that a worker keeps from task to task, some 80 MB at most, and the length of the longest one.
KNOWN, LONGEST = 400_000, 32
HEADER = "<4sIII"


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of every value."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(float))).astype(np.int64) + 1, 0)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values into rows of 64-bit words, lowest bits first."""
    out = np.zeros((len(values), BLOCK * width // 64), np.uint64)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, j] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out


def write_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a segment. A block of 128 ids fills whole 64-bit words at any width."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    if n % BLOCK:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint64)
    above = grid - low[:, None]
    bits = np.sort(_bits(above), axis=1)
    width = bits[:, int(np.ceil(PERCENTILE * BLOCK)) - 1] if blocks else np.zeros(0, np.int64)
    late = above >> width[:, None].astype(np.uint64) != 0
    patches = late.sum(axis=1)
    starts = np.zeros(blocks, np.uint32)
    size = width * BLOCK // 64
    if blocks:
        starts[1:] = np.cumsum(size)[:-1]
    packed = np.zeros(int(size.sum()), np.uint64)
    fitting = np.where(late, np.uint64(0), above)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            places = starts[at][:, None].astype(np.int64) + np.arange(w * BLOCK // 64)
            packed[places] = _pack(fitting[at], int(w))
    row, column = np.nonzero(late)
    index = np.zeros(blocks, [("start", "<u4"), ("low", "<u4"), ("patches", "<u2"), ("width", "<u2")])
    index["start"], index["low"], index["patches"], index["width"] = starts, low, patches, width
    return b"".join([struct.pack(HEADER, MAGIC, n, blocks, len(lengths)), index.tobytes(), packed.astype("<u8").tobytes(),
                     column.astype("<u1").tobytes(), above[row, column].astype("<u4").tobytes(),
                     np.asarray(lengths, "<u4").tobytes()])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents) of a segment."""
    magic, n, blocks, docs = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    kind = np.dtype([("start", "<u4"), ("low", "<u4"), ("patches", "<u2"), ("width", "<u2")])
    index = np.frombuffer(data, kind, blocks, struct.calcsize(HEADER))
    at = struct.calcsize(HEADER) + index.nbytes
    width = index["width"].astype(np.int64)
    words = int((width * BLOCK // 64).sum())
    packed = np.frombuffer(data, "<u8", words, at).astype(np.uint64)
    at += 8 * words
    late = int(index["patches"].sum())
    column = np.frombuffer(data, "<u1", late, at)
    value = np.frombuffer(data, "<u4", late, at + late)
    lengths = np.frombuffer(data, "<u4", docs, at + 5 * late)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            places = index["start"][rows][:, None].astype(np.int64) + np.arange(w * BLOCK // 64)
            grid[rows] = _unpack(packed[places], int(w))
    grid[np.repeat(np.arange(blocks), index["patches"]), column] = value
    grid += index["low"].astype(np.uint64)[:, None]
    return grid.reshape(-1)[:n].astype("<u4"), lengths


class Encoder:
    """Ids of whole texts by the tokenizers library; `tokenizer` is the content of its file.

    Where its settings are plain byte-level BPE, texts of a slice are cut before spaces (see chunks) by Arrow. The distinct chunks that
    start with a space and another character are joined and cut by the library's pattern in one call, and each distinct
    pre-token goes through the library's BPE model once. Other texts and chunks go through the library as they are.
    """

    def __init__(self, tokenizer: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(tokenizer)
        settings = json.loads(tokenizer)
        self.special = [t["content"] for t in settings["added_tokens"]]
        before = settings["pre_tokenizer"] or {}
        self.plain = (settings["normalizer"] is None and settings["post_processor"] is None and settings["model"]["type"] == "BPE"
                      and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex"))
        self.cut = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.known: dict[str, bytes] = {}
        # 0xFF is no byte of UTF-8 and a line end no letter of a byte, so they part the pre-tokens
        self.letters = dict(enumerate(byte_characters())) | {0xFF: "\n"}

    def _whole(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch(parts, add_special_tokens=False)]

    def _pre_tokens(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as 32-bit numbers; the first KNOWN short ones that the worker meets stay known."""
        new = [p for p in parts if p not in self.known]
        mapped = "\udcff".join(new).encode("utf-8", "surrogateescape").decode("latin-1").translate(self.letters)
        model = self.library.model
        made = dict(zip(new, [array("I", [t.id for t in model.tokenize(p)]).tobytes() for p in mapped.split("\n")])) if new else {}
        found = [made[p] if p in made else self.known[p] for p in parts]
        room = KNOWN - len(self.known)
        if room > 0:
            self.known.update(islice(((p, v) for p, v in made.items() if len(p) <= LONGEST), room))
        return found

    def _after_space(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of a space and each piece; no piece is empty or starts with white space."""
        if not len(pieces):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        pre = pa.array(self.cut(" " + " ".join(_strings(pieces))), pa.large_string()).dictionary_encode()
        found = self._pre_tokens(_strings(pre.dictionary))
        code = pre.indices.to_numpy()
        starts = np.flatnonzero(pc.starts_with(pre.dictionary, " ").to_numpy(zero_copy_only=False)[code])
        if len(starts) != len(pieces):
            raise ValueError("a chunk was not cut before its space")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, size = _gathered(np.frombuffer(b"".join(found), "<u4"), counts, code)
        return ids, np.add.reduceat(size, starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of the texts."""
        whole = [not self.plain or long_space(t) or any(s in t for s in self.special) for t in texts]
        pieces = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts)], pa.large_string()), " ")
        bounds = pieces.offsets.to_numpy().copy()
        coded = pieces.values.dictionary_encode()
        del pieces      # it is as large as the slice
        distinct = coded.dictionary
        alone = pc.or_(pc.equal(distinct, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, 0, 1))).to_numpy(zero_copy_only=False)
        ids, counts = self._after_space(distinct.filter(pa.array(~alone)))
        begins = dict.fromkeys(t if w else t.partition(" ")[0] for w, t in zip(whole, texts))
        others = self._whole([" " + p for p in _strings(distinct.filter(pa.array(alone)))] + list(begins))
        ids = np.concatenate([ids, *others])
        counts = np.concatenate([counts, np.fromiter(map(len, others), np.int64, len(others))])
        # where a distinct chunk's ids are: those of pieces after a space, of pieces alone, then of what begins a text or is a whole one
        number = np.empty(len(distinct), np.int64)
        number[np.argsort(alone, kind="stable")] = np.arange(len(distinct))
        code = number[coded.indices.to_numpy()]
        del coded
        begin = {t: len(distinct) + i for i, t in enumerate(begins)}
        code[bounds[:-1]] = [begin[t if w else t.partition(" ")[0]] for w, t in zip(whole, texts)]
        ids, size = _gathered(ids, counts, code)
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(ends[bounds])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _gathered(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of the lists that `code` numbers; indices exist for a part of them at a time."""
    first = np.cumsum(counts) - counts
    size = counts[code]
    out, done = np.empty(int(size.sum()), "<u4"), 0
    for at in range(0, len(code), step):
        own = size[at:at + step]
        ends = np.cumsum(own)
        out[done:done + int(ends[-1])] = ids[np.repeat(first[code[at:at + step]] - ends + own, own) + np.arange(ends[-1])]
        done += int(ends[-1])
    return out, size


def _encoder(tokenizer: str) -> Encoder:
    """The worker's encoder, kept for later tasks."""
    kept = worker_memory()
    if kept.get("tokenizers", (None,))[0] != tokenizer:
        kept["tokenizers"] = tokenizer, Encoder(tokenizer)
    return kept["tokenizers"][1]


def segments(docs: DataFrame, tokenizer_path: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, first, doc_ids, n_ids, segment): the segments of each part in order; parts are in id order."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    tie = F.xxhash64("text")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = (rows.withColumn("_tie", tie).withColumn("_row", F.monotonically_increasing_id())
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie", "_row")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie", "_row").select("doc_id", "text"))

    def pack(batches):
        os_environ_off()
        encoder = _encoder(shared.value)
        part, first = TaskContext.get().partitionId(), 0
        held, lengths, names, size = [], [], [], 0

        def out():
            return pd.DataFrame({"part": [part], "first": [first], "doc_ids": [list(names)], "n_ids": [size],
                                 "segment": [write_segment(np.concatenate(held), np.array(lengths))]})

        for known, texts in _slices(batches):
            ids, counts = encoder.encode(texts)
            del texts
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            low = 0
            for name, count, stop in zip(known, counts.tolist(), np.cumsum(counts).tolist()):
                lengths.append(count)
                names.append(name)
                size += count
                if size >= SEGMENT_IDS:
                    held.append(ids[low:stop])
                    low = stop
                    yield out()
                    first += size
                    held, lengths, names, size = [], [], [], 0
            held.append(ids[low:].copy())     # a view would keep the whole slice
            del ids
            give_back()
        if names:
            yield out()
        held.clear()
        give_back()

    return ordered.mapInPandas(pack, "part int, first bigint, doc_ids array<bigint>, n_ids bigint, segment binary")


def _slices(batches) -> Iterator[tuple[list[int | None], list[str]]]:
    """(ids, texts) of slices of a task's rows, whatever its batches are."""
    names, texts, chars = [], [], 0
    for batch in batches:
        for name, text in zip(batch["doc_id"], batch["text"]):
            text = text if isinstance(text, str) else ""
            if texts and (len(texts) >= SLICE_ROWS or chars + len(text) > SLICE_CHARS):
                yield names, texts
                names, texts, chars = [], [], 0
            names.append(None if pd.isna(name) else int(name))
            texts.append(text)
            chars += len(text)
    if texts:
        yield names, texts


def os_environ_off() -> None:
    """One thread per task: Spark runs as many tasks as it has cores."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, **names: str) -> None:
    segments(docs, tokenizer_path, end_id, **names).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments with the number of ids in the parts before theirs; one small row per part is summed."""
    found = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (found.groupBy("part").agg(F.sum("n_ids").alias("_n"))
             .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before")))
    return found.join(F.broadcast(parts), "part")


def documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the segments."""
    def each(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, lengths = read_segment(row.segment)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                for low in range(0, len(ends), 1000):
                    pairs = list(zip(starts[low:low + 1000], ends[low:low + 1000]))
                    made = {"doc_id": pd.array([None if d is None or pd.isna(d) else int(d) for d in row.doc_ids[low:low + 1000]], "Int64"),
                            "start": row.before + row.first + starts[low:low + 1000],
                            "n_tokens": lengths[low:low + 1000].astype(np.int64),
                            "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in pairs]}
                    if with_ids:
                        made["ids"] = [ids[a:b].astype("int64") for a, b in pairs]
                    yield pd.DataFrame(made)
        give_back()

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return files.select("before", "first", "doc_ids", "segment").mapInPandas(each, schema)
