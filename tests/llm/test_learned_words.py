"""Language by compression, importance resampling and tokenizer alignment against brute force and held-out rows."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsieve.llm import alignment, language, queries, resampling

SF_DIR = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["", " ", "  two  spaces ", "tail ", "\n lines \n\n", "a ▁ mark", "<|endoftext|> and <s> <unk> </s>", "nul \x00 byte\x7f", "x" * 3000,
             "漢字かな交じり文 と 空白", "🙂 🙃🙂", "é́ combining", "1234567890 12 3", "don't we'll THEY'VE", " no break   wide", "a\t b \r\n c"]


# --- language ---

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op11_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
        assert r["rejected"] == (r["score"] < 0.5)
    held = [r for r in found if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    right = [r for r in held if r["lang_pred"] == r["lang"]]
    sure = [r for r in held if not r["rejected"]]
    assert len(right) / len(held) > 0.98
    assert sum(r["lang_pred"] == r["lang"] for r in sure) / len(sure) >= len(right) / len(held)


def test_sizes_decide_with_ties_to_the_commoner_language(spark, docs):
    model = language.fit(docs.filter("doc_id % 2 = 0"))
    assert model.languages[0] == "en" and all(len(d) <= language.DICTIONARY_BYTES for d in model.dictionaries)
    assert model == language.fit(docs.filter("doc_id % 2 = 0").repartition(7))
    coder = language.Coder(model.languages, model.dictionaries)
    for r in language.identify(docs, model, ["doc_id", "text"]).withColumn("letters", language.letters("text")).collect():
        if r["letters"]:
            sizes = coder.sizes(r["letters"])
            assert r["lang_pred"] == model.languages[sizes.index(min(sizes))]
            raw = r["letters"].encode()
            assert sizes[0] == sum(len(coder.encode[0](raw[i:i + language.PIECE])) for i in range(0, len(raw), language.PIECE))


def test_language_of_odd_empty_and_clashing_rows(spark, odd, empty, clashing):
    model = language.fit(odd)
    found = language.identify(odd, model, ["doc_id", "text"]).collect()
    assert len(found) == odd.count()
    assert {r["lang_pred"] for r in found if not re.search(r"[^\W\d_]", r["text"] or "")} == {"und"}
    assert language.identify(empty, model, ["doc_id"]).count() == 0
    nothing = language.fit(empty)
    assert nothing == language.Model([], [])
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(odd, nothing, ["doc_id"]).collect()} == {("und", 0.0, True)}
    one = language.fit(odd.filter("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(odd, one, ["doc_id"]).collect()} == {("en", 1.0), ("und", 0.0)}
    assert language.identify(clashing, model, ["doc_id", "size", "kept"]).columns == ["doc_id", "size", "kept", "lang_pred", "score", "rejected"]


def test_copies_teach_once(spark, docs):
    copy = docs.filter("lang = 'fr'").limit(1)
    many = docs
    for _ in range(6):
        many = many.unionByName(copy)
    passages = language.fit(many).dictionaries[language.fit(many).languages.index("fr")]
    text = copy.select(language.letters("text").alias("t")).first()["t"][:200]
    assert passages.decode("utf-8", "ignore").count(text) <= 1


# --- resampling ---

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, target, least, most, buckets, percent, least_words):
    def parts(text):
        words = WORDS.findall(lowered(text))
        return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1)]
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(parts(text)[1])
    for text in target:
        t.update(parts(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, found = parts(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    ranks = collections.Counter((*r[:4], n + 1) for n, r in enumerate(drawn))
    rest = collections.Counter((*r[:4],) for r in out) - collections.Counter((*r[:4],) for r in drawn)
    return ranks + collections.Counter({(*k, None): n for k, n in rest.items()})


@pytest.mark.parametrize("least,most,buckets,percent,least_words", [(1, 1, 10_000, 10, 20), (1, 3, 500, 40, 1), (2, 2, 97, 100, 0), (1, 2, 1000, 0, 5)])
def test_resampling_equals_brute_force(spark, odd, least, most, buckets, percent, least_words):
    target = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    # a third of all rows are equal, and the cut falls between them
    rows = odd.unionByName(odd.filter("doc_id = 7").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(110)))).drop("again"))
    found = resampling.resample(rows, target, least=least, most=most, buckets=buckets, percent=percent, least_words=least_words)
    got = collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    want = expected([(r["doc_id"], r["text"]) for r in rows.collect()], [r["text"] for r in target.collect()], least, most, buckets,
                    percent, least_words)
    assert got == want


def test_drawn_rows_and_odd_tables(spark, odd, empty, clashing):
    target = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = resampling.resample(odd, target)
    rows = resampling.drawn(odd, found)
    assert rows.columns == odd.columns
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in found.filter("rank IS NOT NULL").collect())
    assert resampling.resample(empty, target).count() == 0
    without = resampling.resample(odd, target.limit(0))
    assert without.count() == odd.count()
    assert resampling.resample(clashing, target).columns == found.columns
    assert resampling.drawn(clashing, resampling.resample(clashing, target, percent=50, least_words=0)).columns == clashing.columns


def test_ranks_when_the_sketch_is_off(spark):
    scored = spark.range(200).selectExpr("id AS doc_id", "id AS mark", "30L AS words", "1L AS n_features", "0L AS weight", "id * 7 % 200 AS score")
    ranks = sorted((r["rank"], -r["score"]) for r in resampling.ranked(scored, 37, 20).filter("rank IS NOT NULL").collect())
    assert ranks == [(n + 1, -(199 - n)) for n in range(74)]


# --- alignment ---

def token_bytes():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    chars = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    names = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, names, piece


def brute(texts):
    """What the contract states, token by token."""
    a, b, names, piece = token_bytes()
    found, holders = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(names[i] for i in ids_a) != raw or b"".join(map(piece, ids_b)) != raw:
            found.append(None)
            continue
        spans = []
        for ids, size in ((ids_a, lambda i: len(names[i])), (ids_b, lambda i: len(piece(i)))):
            at, own = 0, []
            for i in ids:
                own.append((at, at + size(i), i))
                at += size(i)
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        members = [[[], []] for _ in cuts]
        for side, own in enumerate(spans):
            for _, e, i in own:
                members[bisect.bisect_left(cuts, e)][side].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in members]
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        found.append((len(ids_a), len(ids_b), groups, links))
        holders.update(set(links))
    top = collections.defaultdict(int)
    for (i, _), n in holders.items():
        top[i] = max(top[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((n_a, n_b, len(groups), len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("per_pass", [300, 2_000_000])
def test_alignment_equals_brute_force(spark, odd, per_pass):
    more = spark.createDataFrame([(9000 + n, t) for n, t in enumerate(ODD_TEXTS + ODD_TEXTS[:5])], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(more)
    found = alignment.report(rows, A_FILE, B_FILE, pairs_per_pass=per_pass)
    got = collections.Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                              for r in found.collect())
    texts = rows.collect()
    want = collections.Counter((r["doc_id"], *w) for r, w in zip(texts, brute([r["text"] for r in texts])))
    assert got == want
    assert sum(1 for r in got if r[-1] == "" and r[0] is not None) >= 5


def test_alignment_of_empty_and_clashing_tables(spark, empty, clashing):
    assert alignment.report(empty, A_FILE, B_FILE).count() == 0
    assert alignment.report(clashing, A_FILE, B_FILE).count() == clashing.count()
    table = alignment.pair_table(clashing, A_FILE, B_FILE).collect()
    best = collections.defaultdict(int)
    for r in table:
        best[r["a"]] = max(best[r["a"]], r["docs"])
    assert table and all(r["best"] == (r["docs"] == best[r["a"]]) for r in table)


ENDS = st.lists(st.integers(1, 40), min_size=1, max_size=60, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS)
def test_runs_groups_and_links(x, y):
    a, b = np.array(x + [41]), np.array(y + [41])
    stretches, groups, links = alignment.align(a, b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    pieces = sorted([(i + k, i + k + 1, j + k, j + k + 1) for i, j, n in stretches for k in range(n)] + groups)
    assert [a[p[1] - 1] for p in pieces] == both and [b[p[3] - 1] for p in pieces] == both
    assert all(p[1] - p[0] == 1 == p[3] - p[2] or (p in groups) for p in pieces)
    starts = lambda e: [0, *e[:-1]]
    overlap = {(i, j) for i, (s, e) in enumerate(zip(starts(a), a)) for j, (t, f) in enumerate(zip(starts(b), b)) if s < f and t < e}
    assert sorted(links + [(i + k, j + k) for i, j, n in stretches for k in range(n)]) == sorted(overlap)
