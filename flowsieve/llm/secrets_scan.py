"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hex runs) are spans by themselves. Weak ones, namely random-looking
tokens, account names and endpoints, are found by the same scan but reported only as parts of a
credential: a token with an identifier in its scope, a name with a secret in its scope, an endpoint
with both. A scope is SCOPE code points around a part.

Positions come from the texts between the matches, so a scan is one regular expression over texts that pass a cheap test
first. Parts are then rows, and scopes are interval joins on (document, bin of positions): bins are as wide as a
scope, so a bin holds few parts even in a very long document, and only narrow rows are shuffled. Documents with equal parts share
the work.

Cases with a defined result: a null or empty text has no spans, the digest of the empty string, and an empty span list; overlapping
spans are all listed; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import held_small, packed
from flowsieve.session import settle

# What counts as a part. (kind, pattern, test that is cheaper than the pattern)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: twenty or more characters with a digit, a capital and a small letter
TOKEN = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}")
NAME = r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+"""
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "token", "name", "endpoint"]
SCOPE = 200
BIN = 256
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _spans(text: Column, kind: str, pattern: str, test: str | Column, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap; a match whose group is shorter than `least` is dropped.

    split() gives the texts between the matches; all arrays are arguments, evaluated once, not inside the fold.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(whole, F.length)
    rows = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length), F.transform(whole, F.length), size)
    number = F.lit(KINDS.index(kind))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["0"]
        end = begin + row["1"]
        span = F.struct(begin.alias("start"), end.alias("end"), number.alias("kind"))
        out = F.when(row["2"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.when(row["1"].isNull(), state).otherwise(F.struct(end.alias("at"), out.alias("out")))

    found = F.aggregate(rows, start, step, lambda state: state["out"])
    passed = text.rlike(test) if isinstance(test, str) else test
    return F.when(passed, found).otherwise(F.array().cast(_SPAN))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base` and `weak`, the spans of strong and weak parts of every text, and drops nothing."""
    column = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        _spans(column, "assign", ASSIGN, r"(?i)passw|secret|token|api_?key", 2, 8),
        _spans(column, "access", ACCESS, column.contains("AKIA"), 0, 16),
        _spans(column, "hex", HEX, HEX))
    weak = F.concat(
        _spans(column, "token", TOKEN, TOKEN),
        _spans(column, "name", NAME, NAME),
        _spans(column, "endpoint", ENDPOINT, column.contains("://")))
    return docs.withColumn("base", F.array_sort(base)).withColumn("weak", weak)


def _binned(rows: DataFrame, reach: int) -> DataFrame:
    """A row for each bin that the span, widened by `reach`, touches."""
    low = F.floor((F.col("start") - reach) / F.lit(BIN)).cast("int")
    high = F.floor((F.col("end") - 1 + reach) / F.lit(BIN)).cast("int")
    return rows.withColumn("bin", F.explode(F.sequence(low, high)))


def _near(rows: DataFrame, others: DataFrame, reach: int, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) another part within `reach`; 0 asks for an overlap.

    Anti joins go over the rows that were found near, as a row has several bins.
    """
    right = _binned(others.select("key", F.col("start").alias("start"), F.col("end").alias("end")), 0).select(
        "key", "bin", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    apart = (F.col("o_start") - F.col("end") < reach) & (F.col("start") - F.col("o_end") < reach)
    left = _binned(rows, reach).alias("l")
    right = right.alias("r")
    joined = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.bin") == F.col("r.bin")) & apart, "left_semi")
    hit = joined.select("key", "start", "end", "kind").distinct()
    return hit if how == "left_semi" else rows.join(hit, ["key", "start", "end", "kind"], "left_anti")


def linked(found: DataFrame) -> DataFrame:
    """(key, more): the weak parts that belong to a credential, for every distinct set of parts that has some."""
    rows = found.filter(F.size("weak") > 0).select("key", "base", "weak").dropDuplicates(["key"])
    each = lambda name: rows.select("key", F.explode(name).alias("s")).select("key", "s.start", "s.end", "s.kind")
    number = KINDS.index
    base, weak = settle(each("base")), settle(each("weak"))
    endpoint = weak.filter(F.col("kind") == number("endpoint"))
    token = _near(weak.filter(F.col("kind") == number("token")), base.unionByName(endpoint), 0, "left_anti")
    name = _near(weak.filter(F.col("kind") == number("name")), base, 0, "left_anti")
    identifier = settle(base.filter(F.col("kind") == number("access")).unionByName(name))
    secret = base.filter(F.col("kind") != number("access"))
    token = settle(_near(token, identifier, SCOPE, "left_semi"))
    secret = settle(secret.unionByName(token))
    name = _near(identifier.filter(F.col("kind") == number("name")), secret, SCOPE, "left_semi")
    endpoint = _near(_near(endpoint, identifier, SCOPE, "left_semi"), secret, SCOPE, "left_semi")
    kept = token.unionByName(name).unionByName(endpoint)
    return kept.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, by start, then kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The other columns with `base` and `spans` (arrays of start, end and kind number) in place of the text.

    Columns of these names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base", "weak", "spans", "more", "_key")])
    found = settle(parts(docs, text).drop(text))
    found = found.withColumn("_key", F.when(F.size("weak") > 0, F.sha2(F.concat_ws(
        "|", spans_text(F.col("base")), F.lit("/"), spans_text(F.col("weak"))), 256)))
    more = linked(found.withColumnRenamed("_key", "key")).withColumnRenamed("key", "_key")
    return (found.join(more, "_key", "left")
            .withColumn("spans", F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).drop("_key", "weak", "more"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", *, column: str = "text") -> DataFrame:
    """The rows, each span of the text replaced by a mark; overlapping spans share one. Texts without spans stay as they are."""
    rows = packed(docs).withColumn("_text", F.col("_row")[column]).withColumn("_mark", F.xxhash64("_text"))
    # only texts with spans are looked up again, by the hash of the whole text
    spans = scanned(rows.select("_text", "_mark"), text="_text").filter(F.size("spans") > 0)
    spans = held_small(spans.select("_mark", "spans").dropDuplicates(["_mark"]))
    found = rows.join(spans, "_mark", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    between = lambda a, b: F.substring(F.col("_text"), a + 1, b - a)

    def step(state: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(between(state["at"], s["start"]), F.lit(mark)))
                       ).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), piece.alias("out"))

    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(F.col("_text"), state["at"] + 1, F.lit(2**31 - 1)))
    clean = F.aggregate(F.array_sort("spans"), start, step, rest)
    found = found.withColumn("_text", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("_text")))
    return found.select(*[F.col("_text").alias(c) if c == column else F.col("_row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))
