"""Alignment of two tokenizers against both libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import align, common, queries, tokens


@pytest.fixture(scope="module")
def known():
    return align.aligner(*align.default_paths())


def by_hand(known, text):
    """Lists of (ids of A, ids of B) of one text, encoded whole."""
    if not text:
        return []
    of = {letter: byte for byte, letter in tokens.byte_letters().items()}
    found = known.a.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(of[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    b = [(i, bytes([int(p[3:5], 16)]) if known.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(known.b.encode(text), known.b.encode(text, out_type=str))]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    ends = lambda side: np.cumsum([len(x) for _, x in side])
    groups = defaultdict(lambda: ([], []))
    common_ends = np.intersect1d(ends(a), ends(b))
    for k, side in enumerate((a, b)):
        for (i, _), group in zip(side, np.searchsorted(common_ends, ends(side)).tolist()):
            groups[group][k].append(i)
    return [groups[g] for g in sorted(groups)]


def answers(known, texts):
    grouped = [by_hand(known, t) for t in texts]
    counts = Counter(pair for g in grouped for pair in {(i, j) for a, b in g for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for g in grouped:
        links = [(i, j) for a, b in g for i in a for j in b]
        spelt = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sums = sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), *sums, hashlib.sha256(spelt.encode()).hexdigest() if g else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", " \n x", "a", "foo ", "foo  ", "foo \n bar\tbaz \r\n", "héllo wörld 一二三 中文 字", "😀😀 👩‍👩‍👧 x", "naïve space　wide em end", "“quoted” text \u0085 nel",
    "a▁b", "▁", "<s> </s> <unk> <|endoftext|> <0x0A> x", "\x00 nul \x7f del \x1c fs", "é combining", "    indented\n\n\n    code();\r\n", "don't we'll I'M", "1234567890 12.5e-7 $3,000", "ﬁ ligature ½ ² K", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ab " * 3000, "‮right​ zero﻿", "مرحبا بالعالم שלום", "𝔘𝔫𝔦 𐍈 \U0010ffff", "foo;\r bar {\r baz",
]


def test_texts_are_aligned_as_wholes(known):
    rng = random.Random(3)
    signs = ["a", "the", "é", "中", "😀", " ", "  ", "\n", "\t", "'s", "1", " ", "　", "“", "▁", ";", "\r", "ing", "\x00", "ß", "́", ".", "Ω"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for chunk in (align.CHUNK, 40):
        known.clear()
        got = list(align.gathered(known, pa.array(texts, pa.string()), chunk))
        assert len(got) == len(texts)
        for text, t in zip(texts, got):
            want = by_hand(known, text)
            groups = np.concatenate(t.groups) if t.same else np.zeros(0, np.int64)
            assert [(g >> 32, g & 0xFFFFFFFF) for g in groups.tolist()] == [(len(a), len(b)) for a, b in want], repr(text)
            if want:
                spelt = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
                assert t.hash.hexdigest() == hashlib.sha256(spelt.encode()).hexdigest(), repr(text)


@pytest.mark.parametrize("sent", [align.SENT, 0])
def test_query_is_the_plain_reading(spark, sf_dir, known, sent, monkeypatch):
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    monkeypatch.setattr(align.counted, "__defaults__", (sent,))
    rows = queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in rows} == dict(zip(texts, answers(known, texts.values()))) and len(rows) == len(texts)


@pytest.mark.parametrize("sent", [align.SENT, 0])
def test_odd_rows(spark, known, sent):
    """Nulls, empty and very long texts, repeated rows and ids, an empty table, extra columns with clashing names."""
    texts = [*ODD, *ODD, "long text, " * 150_000, "x" * 100_000]
    frame = spark.createDataFrame([(i // 2 if i else None, t, "k", [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, pairs array<int>")
    digests = common.Scratch(spark, "t").keep(align.digested(frame).withColumn("row", F.monotonically_increasing_id()), "d")
    got = sorted((r.key is not None, r.key or 0, *(r[c] for c in NAMES)) for r in align.counted(digests, len(known.b_words.sizes), sent).collect())
    assert got == sorted((i > 0, i // 2, *a) for i, a in enumerate(answers(known, texts)))
    assert align.counted(common.Scratch(spark, "t").keep(align.digested(frame.limit(0)).withColumn("row", F.monotonically_increasing_id()), "d"), 32_000, sent).count() == 0


def test_alignments_keep_rows(spark, known):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "a_ids int, text string, _value string")
    for r in align.alignments(frame).collect():
        want = by_hand(known, r.text)
        assert r.text == ODD[r.a_ids]
        assert r.alignment.a_ids == [i for a, _ in want for i in a] and r.alignment.b_ids == [i for _, b in want for i in b]
        assert [tuple(g) for g in r.alignment.groups] == [(len(a), len(b)) for a, b in want]


def test_wide_groups_count_equal_pairs_before_they_form(known, monkeypatch):
    a, b = (align.Ragged(np.array(x), np.array([3, 1])) for x in ([5, 5, 6, 7], [1, 2, 1, 9]))
    whole, ones = known.linked(a, b)
    monkeypatch.setattr(align, "WIDE", 2)
    few, times = known.linked(a, b)
    assert len(few.flat) < len(whole.flat)
    assert Counter(whole.flat.tolist()) == Counter({p: int(n) for p, n in zip(few.flat.tolist(), times)})
