"""Near-duplicate documents by a Jaccard join of word shingles over a token-group matrix.

A document is the set of its shingles' 64-bit hashes (tokens). Documents with equal sets are one text. Texts are partitioned into
groups of similar ones, each group is known by the union of its tokens, and only groups whose union can
reach the overlap that a text needs are opened.

1. One pass over the texts writes the leading tokens of every set in hash order. Of a set of m tokens at most m - ceil(t m) can
   lack in a partner of similarity t, so among its first 2 (m - ceil(t m)) + 1 tokens at least half are shared with any partner. The
   first bound asks whether the union of all other texts covers that many. Tokens travel in compact binary
   rows by token range, each once per task, so a token of a third of all documents costs as much as the number of tasks;
   what comes back to a task is which of its tokens others have, and how often they occur (their order).
2. Texts that pass are partitioned into groups by a band of set sizes and the smallest of their shared tokens, and by the smallest
   under two other orders. The whole sets of texts in groups that share a token with others are fetched. Groups are cut into blocks
   of bounded size, each a task of its own: it is searched breadth first with exact overlaps against texts not reached yet, so a dense
   family costs one sweep, and a spanning forest of the links is returned.
3. Texts that are connected now become one group, whatever they were before. The matrix has a row for each group and shared token; of
   a whole set only the m - ceil(t m) + 1 rarest tokens count, among which every partner still meets. First each group is held against a block of
   the largest group of a common row, which costs as much as there are texts, and groups that are linked become one; then every
   pair of groups that still differ, have sizes in reach of each other and meet in a row is opened: the smaller group's texts go to
   the larger group's blocks. In a task a text with fewer than ceil(t m) tokens in the other side's union is left out.

Components of the forest are found by distributed star steps. Every document then gets its class.

Cases with a defined result: documents without words (null or empty texts) have no shingles and link with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; equal texts with equal ids are one class; null ids take their class id from
the others of their class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import BROADCAST_ROWS, give_back, held_small, packed
from flowsieve.llm.graph import components
from flowsieve.llm.words import Words, encoded, mixed
from flowsieve.session import settle

#: Postings that a task holds before it writes them; documents per token range, which sets the number of ranges.
HELD = 1 << 20
DOCS_PER_RANGE = 2000
BLOCK = 500
LARGE = 50 * BLOCK
#: Tokens of a block from which its worker gives freed memory back.
LARGE_TASK = 1 << 17
SLICE = 200
SALTS = 16
_SALT = 0x5851F42D4C957F2D


class Sets:
    """Distinct sorted tokens of every text of a slice."""

    def __init__(self, texts: list[bytes], n: int):
        words = Words(texts, lower=True)
        token, at = words.shingles(n)
        doc = words.doc[at]
        short = np.flatnonzero((words.count > 0) & (words.count < n))
        if len(short):
            whole = np.array([words.sequence(i) for i in short], np.uint64)
            token, doc = np.concatenate([token, whole]), np.concatenate([doc, short])
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.token[self.first[i]:self.first[i + 1]]


def _slices(batches, rows: int = SLICE):
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start:start + rows]


def _needed(size, percent: int):
    """Least overlap with any set of the given similarity: ceil(percent / 100 * size)."""
    return -(-size * percent // 100)


def _leading(size, percent: int):
    """(number of leading tokens, how many of them every partner of at least that size shares)."""
    spare = size - _needed(size, percent)
    count = np.minimum(size, 2 * spare + 1)
    return count, count - spare


def _low48(ids: np.ndarray) -> bytes:
    return ids.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _from48(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 4), "<u2")
    out[:, :3] = np.frombuffer(data, "<u2", 3 * n, at).reshape(n, 3)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def postings(docs: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Rows of three kinds: 0 documents (doc_id, mark, size, digest), 1 tokens of a unit in a token range, 2 a unit's texts.

    A unit is a task or a part of it. Token ids are hashes without the lowest bits that 48 bits below the range leave out; equal
    ids of different tokens only let more texts pass.
    """
    cut = np.uint64(max(0, 16 - bits))

    def each(batches):
        task, part_number = TaskContext.get().partitionId(), 0
        seen: set[bytes] = set()
        tokens, refs, sizes, marks, held = [], [], [], [], 0
        blank = {"doc_id": None, "mark": None, "size": None, "digest": None, "unit": None, "range": None, "data": None}

        def flush(unit: int):
            ids = np.concatenate([*tokens, np.empty(0, np.uint64)])
            ids >>= cut
            ref = np.concatenate([*refs, np.empty(0, np.int32)])
            tokens.clear()
            refs.clear()
            order = np.argsort(ids, kind="stable")
            ids, ref = ids[order], ref[order]
            del order
            unique, start, times = np.unique(ids, return_index=True, return_counts=True)
            once = times == 1
            again = np.repeat(~once, times)
            place = unique >> np.uint64(48)
            numbers, first = np.unique(place, return_index=True)
            rows = []
            for number, low, high in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(unique)]):
                own, single, count = unique[low:high], once[low:high], times[low:high]
                alone = ref[start[low:high][single]]
                rows.append({**blank, "kind": 1, "unit": unit, "range": number, "data": np.array(
                    [single.sum(), (~single).sum()], "<u4").tobytes() + _low48(own[single]) + _low48(own[~single])
                    + alone.astype("<u4").tobytes() + count[~single].astype("<u4").tobytes()})
            table = np.array([len(sizes), again.sum()], "<u4").tobytes() + np.array(sizes, "<u4").tobytes() + b"".join(marks) \
                + ids[again].astype("<u8").tobytes() + ref[again].astype("<u4").tobytes()
            rows.append({**blank, "kind": 2, "unit": unit, "data": table})
            return pd.DataFrame(rows)

        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.iloc[start:start + SLICE]
                sets = Sets(encoded(part["text"]), n)
                count, _ = _leading(sets.size, percent)
                digests: list[bytes | None] = []
                for i, (size, k) in enumerate(zip(sets.size.tolist(), count.tolist())):
                    if not size:
                        digests.append(None)
                        continue
                    own = sets[i]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    if digests[-1] in seen:
                        continue
                    seen.add(digests[-1])
                    tokens.append(own[:k].copy())     # a view would keep the slice's tokens
                    refs.append(np.full(k, len(sizes), np.int32))
                    sizes.append(size)
                    marks.append(digests[-1])
                    held += k
                yield pd.DataFrame({**blank, "kind": 0, "doc_id": part["doc_id"], "mark": part["mark"], "size": sets.size, "digest": digests},
                                   index=part.index)
                if held > HELD:
                    yield flush(task << 24 | part_number)
                    part_number += 1
                    sizes, marks, held = [], [], 0
                    seen.clear()
                    give_back()
        if sizes:
            yield flush(task << 24 | part_number)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(_columns(each), f"kind int, doc_id {kind}, mark bigint, size bigint, digest binary, unit bigint, range bigint, data binary")


def _columns(function):
    """Frames with nullable whole numbers, in the order of the schema."""
    def each(batches):
        for frame in function(batches):
            for name in ("mark", "size", "unit", "range"):
                frame[name] = frame[name].astype("Int64")
            yield frame[["kind", "doc_id", "mark", "size", "digest", "unit", "range", "data"]]
    return each


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For every unit the ids of one token range that occur twice or more: (id, text number or -1, occurrences)."""
    ids, refs, times, units = [], [], [], []
    for unit, data in zip(rows["unit"].tolist(), rows["data"]):
        one, more = np.frombuffer(data, "<u4", 2).tolist()
        ids.append(_from48(data, one + more, 8))
        at = 8 + 6 * (one + more)
        refs.append(np.concatenate([np.frombuffer(data, "<u4", one, at).astype(np.int64), np.full(more, -1)]))
        times.append(np.concatenate([np.ones(one, np.int64), np.frombuffer(data, "<u4", more, at + 4 * one).astype(np.int64)]))
        units.append(np.full(one + more, len(units)))
    ids, refs, times, unit = map(np.concatenate, (ids, refs, times, units))
    unique, back = np.unique(ids, return_inverse=True)
    total = np.bincount(back, times, len(unique)).astype(np.int64)[back]
    hit = total > 1
    order = np.argsort(unit[hit], kind="stable")
    unit, ids, refs, total = unit[hit][order], ids[hit][order], refs[hit][order], total[hit][order]
    ids = ids | np.uint64(int(rows["range"].iloc[0]) << 48)
    found, first = np.unique(unit, return_index=True)
    out = []
    for number, low, high in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(unit)]):
        data = np.array([high - low], "<u8").tobytes() + ids[low:high].astype("<u8").tobytes() + refs[low:high].astype("<i4").tobytes() \
            + total[low:high].astype("<u4").tobytes()
        out.append((int(rows["unit"].iloc[number]), 3, data))
    del ids, refs, times, unit, unique, back, total, hit, order
    give_back()
    return pd.DataFrame(out, columns=["unit", "kind", "data"])


def _passing(percent: int):
    """Texts of a unit that the first bound lets pass: (digest, size, grp, tokens)."""
    step = float(-np.log(percent / 100))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.loc[rows["kind"] == 2, "data"].iloc[0]
        docs, local = np.frombuffer(table, "<u4", 2).tolist()
        size = np.frombuffer(table, "<u4", docs, 8).astype(np.int64)
        at = 8 + 20 * docs
        local_id = np.frombuffer(table, "<u8", local, at)
        local_ref = np.frombuffer(table, "<u4", local, at + 8 * local).astype(np.int64)
        ids, refs, times = [], [], []
        for data in rows.loc[rows["kind"] == 3, "data"]:
            n = int(np.frombuffer(data, "<u8", 1)[0])
            ids.append(np.frombuffer(data, "<u8", n, 8))
            refs.append(np.frombuffer(data, "<i4", n, 8 + 8 * n).astype(np.int64))
            times.append(np.frombuffer(data, "<u4", n, 8 + 12 * n).astype(np.int64))
        empty = pd.DataFrame(columns=["digest", "size", "grp", "tokens"], dtype=object)
        if not ids:
            return empty
        ids, refs, times = map(np.concatenate, (ids, refs, times))
        # tokens that several texts of the unit have came back once
        many = refs < 0
        order = np.argsort(ids[many])
        many_id, many_times = ids[many][order], times[many][order]
        token = np.concatenate([ids[~many], local_id])
        ref = np.concatenate([refs[~many], local_ref])
        often = np.concatenate([times[~many], many_times[np.searchsorted(many_id, local_id)] if local else np.empty(0, np.int64)])
        order = np.lexsort((token, often, ref))
        token, ref = token[order], ref[order]
        first = np.searchsorted(ref, np.arange(docs + 1))
        # the smallest partner shares the fewest leading tokens; one less than that may be left out, the most frequent ones
        _, least = _leading(_needed(size, percent), percent)
        out = []
        for i in np.flatnonzero(np.diff(first) >= least).tolist():
            own = token[first[i]:first[i + 1] - (int(least[i]) - 1)].astype(np.uint64)
            band = int(np.log(size[i]) / step)
            group = mixed(np.array([int(mixed(own ^ np.uint64(_SALT)).min()) ^ band], np.uint64)).view(np.int64)[0]
            digest = table[8 + 4 * docs + 16 * i:8 + 4 * docs + 16 * i + 16]
            out.append((digest, int(size[i]), int(group), own.view(np.int64)))
        del ids, refs, times, many, many_id, many_times, token, ref, often, order
        give_back()
        return pd.DataFrame(out, columns=["digest", "size", "grp", "tokens"]) if out else empty
    return each


def _met(cells: DataFrame, name: str) -> DataFrame:
    """Cells (token, name) of the tokens that two or more values of `name` have."""
    ends = cells.groupBy("token").agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    return cells.join(ends.filter("_low < _high").select("token"), "token")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, tokens): of a set of m tokens the m - ceil(t m) + 1 rarest ones with their places, without those that no other set has.

    Sets of similarity t share one of them, as rarity is one order for all sets. What many texts share, a passage for
    instance, is thus left out unless it makes up nearly all of a text. Linked sets of sizes s <= m share at least
    t / (1 + t) (s + m) >= 2 t / (1 + t) s tokens, so their rarest common token is among the first s - ceil(2 t / (1 + t) s) + 1 of
    the smaller one (`front`), and from it on both have at least as many tokens (`rest`) as they share.
    """
    cells = settle(sets.select("rep", F.explode("tokens").alias("token")))
    often = cells.groupBy("token").agg(F.count("*").alias("often"))
    order = cells.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("order"))
    size = F.size("order")
    count = F.expr(f"cast(size(order) - (size(order) * {percent} + 99) div 100 + 1 as int)")
    front = F.expr(f"size(order) - (2 * {percent} * size(order) + {99 + percent}) div {100 + percent} + 1")
    placed = F.transform(F.slice("order", F.lit(1), count), lambda t, i: F.struct(
        t["token"].alias("token"), (i < front).alias("front"), (size - i).cast("long").alias("rest"), t["often"].alias("often")))
    return order.select("rep", F.transform(F.filter(placed, lambda t: t["often"] > 1), lambda t: t.dropFields("often")).alias("tokens"))


def matrix(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, one): rows of the token-group matrix that two or more groups share.

    `one` is (members, class, low, high, front, rest): a group and, of its texts with the token, the sizes, the least size of one that
    has it in front (null: none) and the largest rest.
    """
    groups = classes.groupBy("class").agg(F.count("*").alias("members"))
    cells = sketches.join(classes, "rep").select(F.explode("tokens").alias("t"), "class", "size").groupBy("t.token", "class").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.min(F.when(F.col("t.front"), F.col("size"))).alias("front"),
        F.max("t.rest").alias("rest"))
    met = _met(settle(cells), "class").join(groups, "class")
    return settle(met.select("token", F.struct("members", "class", "low", "high", "front", "rest").alias("one")))


def group_pairs(cells: DataFrame, percent: int, *, hubs: bool) -> DataFrame:
    """(g, h, g_members, h_members): groups of a common row that can have a link whose rarest common token the row is, g the larger one.

    With `hubs` g is the largest group of the row, so that there are at most as many pairs as cells. Otherwise the group with the
    smaller text of the link must have the token in front. Texts that have a token in front consist of it and of tokens no
    rarer: such texts with a common passage are linked, so they are one group by now and meet the others once.
    """
    if hubs:
        pairs = cells.join(cells.groupBy("token").agg(F.max("one").alias("far")), "token")
    else:
        small = cells.filter("one.front IS NOT NULL").withColumnRenamed("one", "small")
        pairs = small.join(cells.withColumnRenamed("one", "large"), "token").filter(
            "small.class != large.class AND small.front <= large.high")
        pairs = pairs.select(F.least("small", "large").alias("one"), F.greatest("small", "large").alias("far"))
    reach = (F.col("far.high") * 100 >= F.col("one.low") * percent) & (F.col("one.high") * 100 >= F.col("far.low") * percent) & (
        F.least("one.rest", "far.rest") * (100 + percent) >= (F.col("one.low") + F.col("far.low")) * percent)
    return pairs.filter("one < far").filter(reach).select(
        F.col("far.class").alias("g"), F.col("one.class").alias("h"), F.col("far.members").alias("g_members"),
        F.col("one.members").alias("h_members")).distinct()


def across(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, *, hubs: bool) -> DataFrame:
    """(a, b): a forest of the links between the groups of each pair.

    A task holds a block of g and a share of the texts of its partners. With `hubs` only the first block of g is taken.
    """
    shares = pairs.groupBy("g").agg(F.ceil(F.max("g_members") / BLOCK).cast("int").alias("blocks"),
                                    F.ceil(F.sum("h_members") / BLOCK).cast("int").alias("shares"))
    shares = settle(shares)
    texts = classes.select("rep", "class")
    part = lambda number, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(number)).cast("int")
    upto = lambda number: F.explode(F.sequence(F.lit(0), number - 1))
    own = texts.join(shares, F.col("class") == F.col("g")).withColumn("x", part("blocks", 3))
    own = own.filter("x = 0") if hubs else own
    own = own.select("g", "x", upto(F.col("shares")).alias("y"), F.lit(0).alias("side"), "rep", F.col("class").alias("known"))
    far = pairs.select("g", "h").join(shares, "g").join(texts, F.col("h") == F.col("class"))
    far = far.select("g", upto(F.lit(1) if hubs else F.col("blocks")).alias("x"), part("shares", 7).alias("y"), F.lit(1).alias("side"),
                     "rep", F.col("class").alias("known"))
    work = own.unionByName(far).join(sets, "rep")
    return work.groupBy("g", "x", "y").applyInPandas(_open_task(percent), "a bigint, b bigint")


def opened(rep: np.ndarray, side: np.ndarray, known: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among the sets of a task.

    Sets with equal `known` are connected already; with two sides only links across count, for links inside a side are
    another task's.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(n), size)
    two = side.min() != side.max()
    if two:
        # the bound: enough of a set must lie in the union of the other side
        inside = np.zeros(n, np.int64)
        for s in (0, 1):
            union = np.unique(tokens[side[doc] != s])
            mine = side[doc] == s
            hit = np.isin(tokens[mine], union, assume_unique=False)
            inside += np.bincount(doc[mine][hit], minlength=n)
        able = inside >= _needed(size, percent)
        if not able[side == 0].any() or not able[side == 1].any():
            return []
    else:
        able = np.ones(n, bool)
    keep = able[doc]
    tokens, doc = tokens[keep], doc[keep]
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    # postings: sets of each token; a token of one set only links nothing
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
    length = np.diff(np.concatenate((start, [len(tokens)])))
    unique = tokens[start] if len(tokens) else tokens
    shared = length > 1
    unique, start, length = unique[shared], start[shared], length[shared]
    open_ = able.copy()
    members: dict[int, list[int]] = {}
    for i, k in enumerate(known.tolist()):
        members.setdefault(k, []).append(i)
    edges: list[tuple[int, int]] = []
    for i in np.flatnonzero(able):
        if not open_[i]:
            continue
        open_[i] = False
        stack = [int(i)]
        while stack:
            x = stack.pop()
            # what is connected to x already is reached as well; popped, so that it is done once per class
            for y in members.pop(int(known[x]), ()):
                if open_[y]:
                    open_[y] = False
                    stack.append(y)
            at = np.minimum(np.searchsorted(unique, sets[x]), max(0, len(unique) - 1))
            at = at[unique[at] == sets[x]] if len(unique) else at[:0]
            if not len(at):
                continue
            hits = np.concatenate([doc[s:s + l] for s, l in zip(start[at].tolist(), length[at].tolist())])
            hits = hits[open_[hits]]
            if not len(hits):
                continue
            overlap = np.bincount(hits, minlength=n)
            near = np.flatnonzero(overlap * 100 >= percent * (size[x] + size - overlap))
            near = near[open_[near] & (near != x)]
            if two:
                near = near[side[near] != side[x]]
            for y in near.tolist():
                if open_[y]:
                    edges.append((int(rep[x]), int(rep[y])))
                    open_[y] = False
                    stack.append(y)
    return edges


def _open_task(percent: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "side"])     # rows that repeat an id and its text give the set again
        if len(rows) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.asarray(t, np.int64).view(np.uint64) for t in rows["tokens"]]
        edges = opened(rows["rep"].to_numpy(), rows["side"].to_numpy(), rows["known"].to_numpy(), sets, percent)
        if sum(map(len, sets)) > LARGE_TASK:
            give_back()
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
    return each


def similar(docs: DataFrame, n: int = 4, percent: int = 85, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; links are pairs with 100 * overlap >= percent * union."""
    found = _classes(docs, n, percent, doc_id, text)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 4, percent: int = 85, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with all its columns: that of the smallest id (nulls last), then text hash. Rows without words all stay."""
    found = settle(_classes(docs, n, percent, doc_id, text).filter("size > 0").select("root", "doc_id", "mark"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    several = found.groupBy("root").agg(F.count("*").alias("rows"), F.min(row).alias("best")).filter("rows > 1")
    several = held_small(several)
    members = settle(found.join(several.select("root", "best"), "root").withColumn("stays", row == F.col("best")))
    out = held_small(members.filter("NOT stays").select("doc_id", "mark").distinct())
    rows = packed(docs).withColumn("_mark", F.xxhash64(F.col("_row")[text]))
    rows = rows.join(out, F.col("_row")[doc_id].eqNullSafe(out["doc_id"]) & (F.col("_mark") == out["mark"]), "left_anti")
    if members.filter("stays").groupBy("root").count().filter("count > 1").isEmpty():
        return rows.select("_row.*")
    # rows that repeat both id and text: one of them
    again = members.filter("stays").groupBy("doc_id", "mark").count().filter("count > 1")
    again = held_small(again.select(F.struct("doc_id", "mark").alias("_key")))
    rows = rows.withColumn("_key", F.struct(F.col("_row")[doc_id].alias("doc_id"), F.col("_mark").alias("mark")))
    same = rows.join(again, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
    return rows.join(again, "_key", "left_anti").select("_row.*").unionByName(same.select("_row.*"))


def _classes(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, size, root, class) for every row: hash of the text, the class's own number and its smallest id."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    ranges = max(64, docs.select("doc_id").count() // DOCS_PER_RANGE)
    found = settle(postings(docs, n, percent, min(22, (ranges - 1).bit_length())))
    sketches = found.filter("kind = 0").select("doc_id", "mark", "size", "digest")
    # one text per digest; a row whose id is null stands for it only where all ids are null
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best")
    texts = settle(sketches.filter("size > 0").groupBy("digest", "size").agg(best).withColumn("rep", F.xxhash64("digest")))
    shared = found.filter("kind = 1").select("unit", "range", "data").groupBy("range").applyInPandas(
        _shared, "unit bigint, kind int, data binary")
    passing = shared.unionByName(found.filter("kind = 2").select("unit", "kind", "data")).groupBy("unit").applyInPandas(
        _passing(percent), "digest binary, size bigint, grp bigint, tokens array<bigint>")
    # a text may pass in several units
    passing = settle(passing.withColumn("rep", F.xxhash64("digest")))
    groups = settle(passing.groupBy("rep").agg(F.min("grp").alias("grp")))
    met = _met(passing.select(F.explode("tokens").alias("token"), "grp").distinct(), "grp").select("grp").distinct()
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members")).join(met.withColumn("met", F.lit(True)), "grp", "left")
    wanted = _sized(groups, settle(sizes.filter("members > 1 OR met").drop("met"))).select("rep").join(texts, "rep")
    wanted = settle(wanted.select("rep", "size", "best.doc_id", "best.mark"))
    sets = settle(_whole_sets(docs, wanted, n).dropDuplicates(["rep"]))

    edges = settle(_inside(passing.join(wanted.select("rep"), "rep"), sets, percent))
    rare = settle(rarest(sets, percent))
    joined = components(edges)
    classes = wanted.select("rep", "size").join(joined, F.col("rep") == F.col("node"), "left")
    classes = settle(classes.select("rep", "size", F.coalesce("component", "rep").alias("class")))
    done, news, cells = None, True, None
    for hubs in (True, True, False):
        if news:
            cells = matrix(rare, classes)
        elif hubs:
            continue
        pairs = group_pairs(cells, percent, hubs=hubs)
        # a pair was compared in full if the hub was one block and both groups are what they were
        pairs = settle(pairs if done is None else pairs.join(done, pairs.columns, "left_anti"))
        news = False
        if not pairs.isEmpty():
            more = settle(across(pairs, classes, sets, percent, hubs=hubs))
            news = not more.isEmpty()
        if news:
            classes = settle(_joined(classes, more))
        full = pairs.filter(F.col("g_members") <= BLOCK)
        done = full if done is None else done.unionByName(full)
    classes = classes.join(texts.select("rep", F.col("best.doc_id").alias("least")), "rep")
    classes = classes.select(F.col("rep").alias("node"), F.col("class").alias("component"), "least")
    # a large class is dealt over several tasks
    smallest = classes.groupBy("component").agg(F.min("least").alias("class"))
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = classes.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(smallest, ["component", "salt"])
    classes = classes.select(F.col("node").alias("rep"), "class", "component")
    named = texts.join(classes, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("root"), F.coalesce("class", "best.doc_id").alias("class"))
    return (sketches.select("doc_id", "mark", "size", "digest").join(named, "digest", "left")
            .select("doc_id", "mark", "size", "root", "class"))


def _joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes after more links between texts; only the classes that the links join are looked at."""
    of = classes.select(F.col("rep").alias("node"), "class")
    ends = edges.join(of.withColumnRenamed("class", "a_class"), F.col("a") == F.col("node")).drop("node")
    ends = ends.join(of.withColumnRenamed("class", "b_class"), F.col("b") == F.col("node"))
    found = components(ends.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
    return classes.join(found, F.col("class") == F.col("node"), "left").select(
        "rep", "size", F.coalesce("component", "class").alias("class"))


def _inside(sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside the blocks of the groups by three orders of the tokens."""
    least = lambda seed: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(seed))))
    keys = settle(sketches.select("rep", F.explode(F.array("grp", least(1), least(2))).alias("grp")).distinct())
    sizes = settle(keys.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1"))
    block = F.pmod(F.xxhash64("rep", "grp"), F.ceil(F.col("members") / BLOCK)).cast("int")
    work = _sized(keys, sizes).select("grp", block.alias("block"), F.lit(0).alias("side"), "rep", F.col("rep").alias("known"))
    return work.join(sets, "rep").groupBy("grp", "block").applyInPandas(_open_task(percent), "a bigint, b bigint")


def _sized(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Texts of the groups in `sizes` with their group's number of members.

    A short table of groups is copied to the texts. Otherwise only large groups are, as there are few of them, and no task of the
    join by group gets more than LARGE texts of one.
    """
    if sizes.count() <= BROADCAST_ROWS:
        return groups.join(F.broadcast(sizes), "grp")
    large = held_small(sizes.filter(F.col("members") > LARGE))
    return groups.join(large, "grp").unionByName(
        groups.join(large, "grp", "left_anti").join(sizes.filter(F.col("members") <= LARGE), "grp"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, tokens): the sets of the wanted texts, read again from one document of each, known by its id and the hash of its text."""
    ids = held_small(wanted.select("doc_id", "mark", "rep"))
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["mark"] == ids["mark"])).select(docs["text"], "rep")

    def each(batches):
        for part in _slices(batches):
            sets = Sets(encoded(part["text"]), n)
            tokens = [sets[i].view(np.int64) for i in range(len(part))]
            marks = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in tokens]
            yield pd.DataFrame({"rep": part["rep"], "mark": marks, "tokens": tokens}, index=part.index)
        give_back()

    made = rows.mapInPandas(each, "rep bigint, mark binary, tokens array<bigint>")
    return made.filter(F.xxhash64("mark") == F.col("rep")).drop("mark")
