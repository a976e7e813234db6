"""Language by compression: the language whose dictionary makes a text shortest.

Every language gets a raw-content zstandard dictionary of passages of its labelled texts. A text is lower-cased, all but its letters
become spaces, and its UTF-8 is cut into pieces of PIECE bytes, so that a dictionary weighs the same at the end of a long text as at
its start. All pieces are encoded with every dictionary; the least sum of bytes wins, and the language with more labelled texts, then the
smaller name, wins a tie. The margin is 1 - least / second least, the score margin / (margin + NARROW); a text whose score is
below one half is marked as rejected, since its margin is below NARROW.

Dictionaries are fitted on a bounded sample: of each language up to PASSAGES passages of PASSAGE_CHARS characters, one a text, from texts
with the least hashes and at hashed places, and of those DICTIONARY_BYTES; all dictionaries together have at most ALL_BYTES. Equal texts
count once. Everything else reads whole texts.

Cases with a defined result: a null text and one without a letter are `und` with score 0 and rejected; so is every text when nothing was
labelled; with one labelled language all texts with a letter have it, with score 1; null and blank labels teach nothing; equal
texts get equal results, and repeated rows stay; an empty table gives an empty result; other columns are kept as they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import BROADCAST_ROWS, text_slices

PASSAGES, PASSAGE_CHARS = 400, 1000
DICTIONARY_BYTES, ALL_BYTES = 1 << 16, 1 << 26
LEVEL, PIECE = 6, 1 << 12
NARROW = 0.02
UNKNOWN = "und"
_DRAWS = 1 << 40


@dataclass(frozen=True)
class Model:
    """Languages, those with more labelled texts first, and their dictionaries."""
    languages: list[str]
    dictionaries: list[bytes]


def letters(text: str | Column) -> Column:
    """The text in lower case with a space for every run of other characters than letters; a null text is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(""))


def fit(docs: DataFrame, learn: Column | None = None, *, text: str = "text", lang: str = "lang") -> Model:
    """Dictionaries of the languages of the rows for which `learn` is true."""
    known = docs.filter((F.lit(True) if learn is None else learn) & F.col(text).isNotNull() & (F.trim(lang) != ""))
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [])
    spark = docs.sparkSession
    # a share that draws twice the passages wanted, so that the ordered rows of a language are few
    shares = spark.createDataFrame([(k, min(1.0, 2 * PASSAGES / n)) for k, n in counts.items()], "lang string, share double")
    # the driver has counted its rows: one per language
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_ROWS else shares
    mark = F.xxhash64("text")
    drawn = rows.join(shares, "lang").withColumn("draw", F.pmod(mark, F.lit(_DRAWS)))
    drawn = drawn.filter(F.col("draw") < F.col("share") * F.lit(float(_DRAWS))).withColumn("letters", letters("text"))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("letters") - F.lit(PASSAGE_CHARS - 1), F.lit(1))).cast("int") + 1
    passage = F.substring(F.col("letters"), start, F.lit(PASSAGE_CHARS))
    once = drawn.filter("letters <> ''").groupBy("lang", "draw").agg(F.min(passage).alias("passage"))
    order = Window.partitionBy("lang").orderBy("draw")
    kept = once.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= PASSAGES)
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    found: dict[str, list[str]] = {}
    for row in kept.select("lang", "passage", "at").sort("lang", "at").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["passage"])
    names = sorted(found, key=lambda k: (-counts[k], k))
    return Model(names, [" ".join(found[k]).encode()[:size] for k in names])


class Coder:
    """Encodes texts with all dictionaries of a model."""

    def __init__(self, languages: list[str], dictionaries: list[bytes]):
        import zstandard
        self.languages = languages
        self.encode = []
        for content in dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.encode.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Bytes of the encoded text, language by language."""
        raw = text.encode()
        pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(map(len, map(encode, pieces))) for encode in self.encode]

    def judge(self, texts: pd.Series) -> pd.DataFrame:
        """(lang_pred, score, rejected) of texts of letters and spaces."""
        out = []
        for text in texts:
            if not text or not self.encode:
                out.append((UNKNOWN, 0.0, True))
                continue
            sizes = np.array(self.sizes(text))
            best = int(sizes.argmin())
            if len(sizes) == 1:
                out.append((self.languages[best], 1.0, False))
                continue
            margin = 1.0 - sizes[best] / np.delete(sizes, best).min()
            score = margin / (margin + NARROW)
            out.append((self.languages[best], float(score), bool(score < 0.5)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"], index=texts.index)


def identify(docs: DataFrame, model: Model, keep: list[str], *, text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected for every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.dictionaries))
    rows = docs.select(*[F.col(c) for c in keep], letters(text).alias("_letters"))

    def each(batches):
        coder = Coder(*shared.value)
        for batch in batches:
            for part in text_slices(batch["_letters"]):
                rows = batch.iloc[part]
                yield pd.concat([rows[keep], coder.judge(rows["_letters"])], axis=1)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return rows.mapInPandas(each, fields + "lang_pred string, score double, rejected boolean")
