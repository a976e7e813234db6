"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

A text is encoded by tokenizer A (a tokenizers file, byte-level) after a space and by tokenizer B (a sentencepiece model, which adds the
space itself). Both cut the same bytes; where both end a token, a group ends. Almost all groups are one token of each, in long runs in
which the numbers of A's and B's tokens keep one distance. So ends are compared at that distance: equal stretches are probed with
doubling and then halving lengths and skipped whole; where the ends differ, the side that is behind moves until both meet again, which
gives an irregular group and a new distance. Links are pairs of tokens whose bytes overlap.

Chunks of text that start at a space after another character than white space are encoded independently by both tokenizers (no piece of
B has a space mark after another character, which is checked), so a chunk's end is an end of both. The distinct new chunks of a slice of
texts are joined to long texts, encoded and aligned there, and cut again at their ends; a document's groups and links are those of
its chunks in order. A task keeps a table of known chunks, bounded by bytes, and drops it at its end.

A pair's count is the number of documents that hold it linked. Every document's distinct pairs are written once with their multiplicity,
counted by pair, and looked up again. The pair table is held by the tasks in ranges of A's ids of at most PAIRS_PER_PASS pairs,
one pass a range, so its size bounds no result: neither driver nor tasks hold more than a range.

Cases with a defined result: a null or empty text, and one whose bytes either tokenizer changes (such as one with U+2581), has zeros and an
empty digest; special tokens inside texts are plain text; equal texts get equal results and count as documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.bpe import byte_characters
from flowsieve.llm.common import worker_memory
from flowsieve.llm.resampling import slices
from flowsieve.llm.token_files import os_environ_off
from flowsieve.session import settle

PAIRS_PER_PASS = 2_000_000
TABLE_BYTES = 48_000_000
ROWS = 1000                 # documents whose pairs are handled at once
_ENTRY_BYTES = 420          # a chunk's key and values, without their characters
JOINED_CHARS = 8000         # characters of new chunks that are encoded and aligned as one text
_ODD_SPACE = re.compile(r"^ |\s ")
_CUT = re.compile(r"(?<=\S) ")
_SPACE = "▁"

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_DOCUMENT = ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, pairs binary, times binary"


def _chunks(text: str) -> list[str]:
    """The chunks of a space and the text, each without the space it starts with."""
    if not _ODD_SPACE.search(text):
        return text.split(" ")
    first, *rest = _CUT.split(" " + text)
    return [first[1:], *rest]


def skip(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many ends from a's i-th and b's j-th on are equal; ends are 32-bit numbers."""
    n, width, growing = 0, 1, True
    while width:
        mine = a[4 * (i + n):4 * (i + n + width)]
        if mine and mine == b[4 * (j + n):4 * (j + n + width)]:
            n += len(mine) // 4
            width = width * 2 if growing else width // 2
        else:
            growing, width = False, width // 2
    return n


def align(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """One-to-one stretches (i, j, length), irregular groups (i, end, j, end), and the links inside the latter.

    `a` and `b` are the increasing ends of two cuts of the same bytes.
    """
    raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
    ends_a, ends_b = a.tolist(), b.tolist()
    stretches, groups, links = [], [], []
    i = j = 0
    while i < len(ends_a):
        n = skip(raw_a, raw_b, i, j) if ends_a[i] == ends_b[j] else 0
        if n:
            stretches.append((i, j, n))
            i, j = i + n, j + n
            if i == len(ends_a):
                break
        first_a, first_b = i, j
        x, y = ends_a[i], ends_b[j]
        links.append((i, j))
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
            links.append((i, j))
        i, j = i + 1, j + 1
        groups.append((first_a, i, first_b, j))
    return stretches, groups, links


class _PairTexts(dict):
    """`a|b` of a pair's number."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __missing__(self, pair: int) -> str:
        if len(self) > 200_000:
            self.clear()
        self[pair] = text = f"{pair // self.width}|{pair % self.width}"
        return text


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_file: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        byte_of = {c: n for n, c in enumerate(byte_characters())}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: name for name, i in self.a.get_vocab().items()}
        self.a_bytes = [special.get(i) or bytes(map(byte_of.__getitem__, names[i])) if i in names else b"" for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece has a space mark after another character: texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(_SPACE)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of ' ' + text by A and B; None where the bytes of the tokens aren't those of the text."""
        found_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        found_b = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, found_a, found_b):
            raw, a, b = (" " + text).encode(), a.ids, b or [self.space]
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


#: Groups as text, packed pairs of the links, numbers of A's tokens, B's tokens and groups of a chunk.
Chunk = tuple[str, bytes, int, int, int]


class Aligner:
    """Encodes and aligns texts; keeps a bounded table of chunks."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.len_a = np.array([len(t) for t in tokenizers.a_bytes], np.int64)
        self.len_b = np.array([len(t) for t in tokenizers.b_bytes], np.int64)
        self.width = len(self.len_b)
        self.dtype = np.dtype("<u4") if len(self.len_a) * self.width < 1 << 32 else np.dtype("<u8")
        self.known: dict[str, Chunk | None] = {}
        self.held = 0
        self.texts = _PairTexts(self.width)

    def _align(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> list[Chunk]:
        """The chunks of one joined text, from its ids."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        stretches, groups, links = align(ends_a, ends_b)
        at_a, at_b = np.empty(0, np.int64), np.empty(0, np.int64)
        if stretches:
            from_a, from_b, length = np.array(stretches, np.int64).T
            at_a = np.arange(length.sum()) + np.repeat(from_a - np.cumsum(length) + length, length)
            at_b = at_a + np.repeat(from_b - from_a, length)
        texts = list(map(self.texts.__getitem__, (a[at_a] * self.width + b[at_b]).tolist()))
        # groups in order, as text and by the end of their last A token
        group_end = at_a
        if groups:
            ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
            odd = [f"{','.join(ids_a[i:j])}|{','.join(ids_b[k:n])}" for i, j, k, n in groups]
            group_end = np.concatenate((at_a, np.array([g[1] - 1 for g in groups])))
            link_a, link_b = np.array(links, np.int64).T
            at_a, at_b, texts = np.concatenate((at_a, link_a)), np.concatenate((at_b, link_b)), texts + odd
            order = np.argsort(group_end, kind="stable")
            group_end, texts = group_end[order], list(map(texts.__getitem__, order.tolist()))
            order = np.argsort(at_a + at_b, kind="stable")
            at_a, at_b = at_a[order], at_b[order]
        pairs = (a[at_a] * self.width + b[at_b]).astype(self.dtype).tobytes()
        size = self.dtype.itemsize
        stop = np.cumsum([len(c.encode()) + 1 for c in chunks])
        stop_a, stop_b = np.searchsorted(ends_a, stop) + 1, np.searchsorted(ends_b, stop) + 1
        if not (np.array_equal(ends_a[stop_a - 1], stop) and np.array_equal(ends_b[stop_b - 1], stop)):
            raise ValueError("a token runs over the end of a chunk")
        stop_group, stop_link = np.searchsorted(group_end, stop_a), np.searchsorted(at_a, stop_a) * size
        out, i, j, g, k = [], 0, 0, 0, 0
        for next_i, next_j, next_g, next_k in zip(stop_a.tolist(), stop_b.tolist(), stop_group.tolist(), stop_link.tolist()):
            out.append((";".join(texts[g:next_g]), pairs[k:next_k], next_i - i, next_j - j, next_g - g))
            i, j, g, k = next_i, next_j, next_g, next_k
        return out

    def _learn(self, new: list[str]) -> dict[str, Chunk | None]:
        joined: list[list[str]] = []
        room = 0
        for chunk in new:
            if not chunk or chunk[-1].isspace():       # the next space would belong to a run of them
                joined.append([chunk])
                room = 0
            elif len(chunk) < room:
                joined[-1].append(chunk)
                room -= len(chunk) + 1
            else:
                joined.append([chunk])
                room = JOINED_CHARS - len(chunk)
        found: dict[str, Chunk | None] = {}
        for chunks, ids in zip(joined, self.tokenizers.encode([" ".join(c) for c in joined])):
            if ids is not None:
                found.update(zip(chunks, self._align(chunks, *ids)))
            elif len(chunks) == 1:
                found[chunks[0]] = None
            else:       # some chunk's bytes are changed: each on its own
                for chunk, own in zip(chunks, self.tokenizers.encode(chunks)):
                    found[chunk] = None if own is None else self._align([chunk], *own)[0]
        return found

    def _table(self, wanted: set[str]) -> dict[str, Chunk | None]:
        """A table with all wanted chunks; it starts anew when it would grow too large."""
        new = [c for c in wanted if c not in self.known]
        found = self._learn(new)
        more = sum(_ENTRY_BYTES + 20 * len(c) for c in new)
        if self.held + more > TABLE_BYTES:
            own = {c: self.known[c] for c in wanted if c in self.known} | found
            self.known, self.held = {}, 0
            return own
        self.known.update(found)
        self.held += more
        return self.known

    def documents(self, texts: list[str | None]) -> list[dict]:
        """Counts, the groups' digest, and the distinct linked pairs with their multiplicity, of every text."""
        cut = [_chunks(t) if t else () for t in texts]
        table = self._table(set().union(*cut))
        out = []
        for parts in cut:
            rows = list(map(table.__getitem__, parts))
            if not rows or None in rows:
                out.append(NO_TOKENS)
                continue
            groups, packed, n_a, n_b, n_groups = zip(*rows)
            pairs = np.frombuffer(b"".join(packed), self.dtype)
            distinct, times = np.unique(pairs, return_counts=True)
            out.append({"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": len(pairs),
                        "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest(),
                        "pairs": distinct.tobytes(), "times": times.astype("<u4").tobytes()})
        return out


NO_TOKENS = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": b"", "times": b""}


def _tokenizers(content: tuple[str, bytes]) -> Tokenizers:
    """The worker's tokenizers; they are of a fixed size, unlike the table of chunks, which belongs to a task."""
    kept = worker_memory()
    if kept.get("both", (None,))[0] != content:
        kept["both"] = content, Tokenizers(*content)
    return kept["both"][1]


def documents(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, np.dtype]:
    """(doc_id, counts, groups_sha256, pairs, times) of every row, the number of B's ids, and the type of the pairs."""
    with open(a_path, encoding="utf-8") as file, open(b_path, "rb") as model:
        content = file.read(), model.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    own = Aligner(Tokenizers(*content))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os_environ_off()
        aligner = Aligner(_tokenizers(shared.value))
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                found = aligner.documents(texts)
                columns = [pa.array([f[c] for f in found], pa.int64()) for c in COUNTS]
                columns += [pa.array([f["groups_sha256"] for f in found], pa.string())]
                columns += [pa.array([f[c] for f in found], pa.binary()) for c in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns],
                                                 ["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_DOCUMENT}"), own.width, own.dtype


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _numbers(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of packed numbers, their number in every row)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype), np.array([len(p) // dtype.itemsize for p in parts], np.int64)


def pair_counts(aligned: DataFrame, dtype: np.dtype) -> DataFrame:
    """(pair, docs): how many documents hold each pair; tasks add their documents up before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _cut(batches):
            new, times = np.unique(_numbers(batch.column(0), dtype)[0], return_counts=True)
            held, place = np.unique(np.concatenate((held, new.astype(np.int64))), return_inverse=True)
            docs = np.bincount(place, np.concatenate((docs, times)), len(held)).astype(np.int64)
            if len(held) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(docs)], ["pair", "docs"])
                held, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(docs)], ["pair", "docs"])

    return aligned.select("pairs").mapInArrow(add, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs"))


def ranges(counts: DataFrame, width: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of A's ids with at most `limit` pairs each, or a single id with more (it has at most `width`)."""
    out: list[tuple[int, int]] = []
    held = 0
    # one row per id of A's vocabulary
    for row in counts.groupBy(F.floor(F.col("pair") / F.lit(width)).alias("a")).agg(F.count("*").alias("n")).sort("a").collect():
        if out and held + row["n"] <= limit:
            out[-1], held = (out[-1][0], row["a"]), held + row["n"]
        else:
            out.append((row["a"], row["a"]))
            held = row["n"]
    return out


def _add_pass(rows: DataFrame, counts: DataFrame, first: int, last: int, width: int, dtype: np.dtype) -> DataFrame:
    """Adds what the pairs of A's ids from `first` to `last` contribute to n_best and count_sum."""
    table = counts.filter(F.col("pair").between(first * width, (last + 1) * width - 1)).sort("pair").toArrow()
    pair, docs = (table.column(c).to_numpy() for c in ("pair", "docs"))
    owner = pair // width
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    best = docs == np.repeat(np.maximum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))
    shared = rows.sparkSession.sparkContext.broadcast((pair, docs, best))
    names = ["doc_id", *COUNTS, "groups_sha256", "pairs", "times", "n_best", "count_sum"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = shared.value
        for batch in _cut(batches):
            column = dict(zip(batch.schema.names, batch.columns))
            asked, sizes = _numbers(column["pairs"], dtype)
            times = _numbers(column["times"], np.dtype("<u4"))[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
            hit = pair[at] == asked
            edges = np.concatenate(([0], np.cumsum(sizes)))
            for name, each in (("n_best", times * (hit & best[at])), ("count_sum", times * docs[at] * hit)):
                total = np.diff(np.concatenate(([0], np.cumsum(each)))[edges])
                column[name] = pa.array(column[name].to_numpy() + total)
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names)

    return rows.select(*names).mapInArrow(look_up, rows.select(*names).schema)


def report(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text",
           pairs_per_pass: int = PAIRS_PER_PASS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    aligned, width, dtype = documents(docs, a_path, b_path, doc_id=doc_id, text=text)
    aligned = settle(aligned)
    counts = settle(pair_counts(aligned, dtype))
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    found = ranges(counts, width, pairs_per_pass)
    for k, (first, last) in enumerate(found):
        rows = _add_pass(rows, counts, first, last, width, dtype)
        if k + 1 < len(found):
            rows = settle(rows)
    return rows.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def pair_table(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text") -> DataFrame:
    """(a, b, docs, best): corpus-wide counts of linked ids, and whether they are the highest of the A id."""
    rows, width, dtype = documents(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), a_path, b_path)
    counts = settle(pair_counts(rows, dtype)).select(
        F.floor(F.col("pair") / F.lit(width)).cast("int").alias("a"), (F.col("pair") % F.lit(width)).cast("int").alias("b"), "docs")
    top = counts.groupBy("a").agg(F.max("docs").alias("_top"))
    return counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("_top")).alias("best"))
