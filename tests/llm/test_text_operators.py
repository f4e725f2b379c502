"""Each text operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and extra
columns whose names the operators use themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm import common, linededup, lm, minhash, packing, quality, repair, spm, tokens, words

CLASH = ["key", "line", "removed", "component_id", "p_tail", "n_lines", "row", "id", "hash", "node", "part", "n", "sig", "ids", "tokens", "_text", "kept", "expected_grade"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, s in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Ünï", "x1"]) + str(rng.randrange(3000)) for _ in range(60_000))
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "zz")
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "a"), (5, "one", "b"), (6, base, "a"), (7, near, "b"), (8, base, "a"), (8, base, "a"),
        (9, long, "b"), (10, long + " end", "a"), (11, "İstanbul ẞ ﬁ 日本語 x <|endoftext|> it's 42", "c"), (None, "no id here at all", "a"), (None, None, None), (12, "a b\na b\n\nc", "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def word_list(text):
    return (text or "").encode().lower().split()


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = word_list(t)
        k = min(size, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def groups(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(docs, texts, size):
    sets = sets_of(texts, size)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, size).collect()}
    assert {i: r.component_id for i, r in found.items()} == groups(sets, 80)
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_large_nodes_and_chains_keep_every_link(spark):
    """A group too large for a node, a chain whose ends aren't similar, and documents between two groups."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(n, " ".join(w if rng.random() > 0.01 else f"r{rng.randrange(10**6)}" for w in base), "hot") for n in range(700)]
    chain = [f"c{i}" for i in range(100)]
    for n in range(12):
        rows.append((1000 + n, " ".join(f"d{j}" if j < 4 * n else w for j, w in enumerate(chain)), "chain"))
    sets = sets_of({i: t for i, t, _ in rows}, 2)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    assert found == groups(sets, 80)


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd, 2).collect()
    assert len(rows) == len(odd_rows())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[1].component_id == 1 and by[5].component_id == 4 and by[7].component_id == 6 and by[8].component_id == 6 and by[10].component_id == 9
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(frame(spark, []), 2).count() == 0
    kept = minhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 9, 11, 12]


def removed_by_hand(rows, percent=80):
    seen, gone = [], {}
    for i, text in rows:
        gone[i] = []
        for n, line in enumerate(text.split("\n")):
            s = frozenset(word_list(line))
            if s and any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                gone[i].append(n)
            seen.append(s)
    return gone


def test_lines_against_all_pairs(docs, texts):
    found = {r.doc_id: r for r in linededup.removed_lines(docs).collect()}
    by_hand = removed_by_hand(sorted((i, t) for i, t in texts.items() if t is not None))
    assert {i: list(r.removed) for i, r in found.items()} == by_hand
    assert all(r.n_lines == len(texts[i].split("\n")) for i, r in found.items())


def test_oversize_parts_are_joined_in_a_grid(docs, monkeypatch):
    expected = {(r.doc_id, tuple(r.removed)) for r in linededup.removed_lines(docs).collect()}
    monkeypatch.setattr(linededup, "PART", 40)
    assert {(r.doc_id, tuple(r.removed)) for r in linededup.removed_lines(docs).collect()} == expected
    monkeypatch.setattr(linededup, "PARTNERS", 1)  # a second round for lines that are unlike the first partner
    monkeypatch.setattr(linededup, "FEW", 2)
    for asked in (linededup.ASKED, 0):
        monkeypatch.setattr(linededup, "ASKED", asked)
        assert {(r.doc_id, tuple(r.removed)) for r in linededup.removed_lines(docs).collect()} == expected


def test_entries_meet_all_that_the_filters_leave():
    """Without a bound every pair comes out, whatever FEW is; with one, lines beyond it are given up, none is lost."""
    rng = np.random.default_rng(2)
    n = 400
    sizes = rng.integers(4, 9, n)
    entries = linededup.Entries(rng.integers(0, 3, n).astype("<u4"), np.arange(n).astype("<u8") // 2, sizes.astype("<u4"), np.zeros(n, "<u4"), np.zeros((n, 2), "<u8"), rng.integers(0, 50, n).astype("<f4"))
    entries.n[1::2] = entries.n[::2]  # both entries of a line are of one set
    a, b, none = linededup.join_entries(entries, 80, None)
    token, key, size = entries.token, entries.key, entries.n.astype(int)
    by_hand = {(min(key[i], key[j]), max(key[i], key[j])) for i in range(n) for j in range(n) if token[i] == token[j] and key[i] != key[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])}
    assert set(zip(a, b)) == by_hand and not len(none)
    few_a, few_b, up = linededup.join_entries(entries, 80, 3)
    assert set(zip(few_a, few_b)) < by_hand and len(few_a) < len(a) / 4
    x, y, _ = linededup.join_entries(entries, 80, None, up)
    assert set(zip(few_a, few_b)) | set(zip(x, y)) == by_hand


def test_lines_of_odd_rows(spark, odd):
    clean = linededup.dedup_lines(odd)
    assert clean.columns == odd.columns
    rows = clean.collect()
    assert len(rows) == len(odd_rows())
    by = {r.doc_id: r.text for r in rows}
    assert by[1] is None and by[2] == "" and by[3] == "   \n\t " and by[4] == "one" and by[5] == "" and by[8] == "" and by[12] == "a b\n\nc"
    dropped = {r.doc_id for r in linededup.dedup_lines(odd, drop_emptied=True).collect()}
    assert 5 not in dropped and {1, 2, 3, 4, 12} <= dropped
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_a_million_blank_lines_keep_lines_apart(spark):
    ends = "one two three four", "five six seven eight"
    gap = "\n" * (1 << 20)
    rows = [(1, ends[0], "a"), (2, ends[0] + gap + ends[1], "a"), (3, "x" + "\n" * 1_200_000 + ends[1], "a")]
    found = {r.doc_id: (r.n_lines, list(r.removed)) for r in linededup.removed_lines(frame(spark, rows)).collect()}
    assert found == {1: (1, []), 2: ((1 << 20) + 1, [0]), 3: (1_200_001, [1_200_000])}


def test_words_are_told_apart():
    column = pa.array(["Ab cd\nAB", None, "", "x" * 70_000 + " ß\x0bß"])
    found = list(words.scan(column))
    assert [len(w.hashes) for w in found] == [6]
    h = found[0].hashes.tolist()
    assert h[0] == h[2] and h[4] == h[5] and len(set(h)) == 4
    short = [x for w in words.scan(column, chunk=9) for x in w.hashes.tolist()]
    assert short == h


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_word_ids_are_the_librarys(texts, library):
    rows = [t for t in texts.values()] + [t for _, t, _ in odd_rows()] + ["a\x1cb", "x y", "it's'll", "²½x", "é <|startoftext|>x", "K"]
    got = [part for _, ids, sizes in tokens.encoder(tokens.default_path()).encode(rows, 7) for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids + [7] for t in rows]


def assert_packed(pieces, ids, window=2048):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for start, length, crc, size in sorted(parts):
            assert (start, size) == (at, len(ids[i])) and crc == zlib.crc32(ids[i][start : start + length].tobytes())
            at += length
        assert at == len(ids[i])
    for s, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s == max(by_seq) and at < window
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_places_every_id_once(docs, texts, library):
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    pieces = packing.pack(docs).collect()
    assert_packed(pieces, ids)
    total = Counter()
    first = Counter()
    for p in pieces:
        total[p.source] += p.length
        if p.sequence_id < 10:
            first[p.source] += p.length
    whole = sum(total.values())
    assert all(abs(first[s] - 20480 * n / whole) < 12 for s, n in total.items())


def test_mixture_carries_deficits():
    m = packing.Mixture([50_000, 700, 9, 0, 30_000], window=64, block=8)
    end = np.zeros(5, np.int64)
    for b in range(-(-m.total // 512)):
        starts, _ = m.laid(b)
        assert (starts[0] == end).all() and (np.diff(starts, axis=0) >= 0).all()
        end = starts[-1]
    assert end.tolist() == m.totals.tolist()
    equal = packing.Mixture([1000, 1000, 50], [2, 1, 1], window=40, block=4)
    assert np.diff(equal.laid(0)[0], axis=0)[:3].tolist() == [[20, 10, 10]] * 3


def test_packing_odd_rows(spark, odd, library):
    pieces = packing.pack(odd).collect()
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in odd_rows())
    assert packing.pack(frame(spark, [])).count() == 0
    few = packing.pack(odd, weights={"a": 1.0, "b": 1.0, "c": 1.0, None: 1.0}, with_ids=True)
    assert sum(len(p.ids) // 4 for p in few.collect()) == sum(p.length for p in pieces)


def test_repair_round_trip(spark, odd, library, tmp_path):
    folder = f"file://{tmp_path}/ids"
    repair.write_ids(odd, folder)
    rows = sorted(repair.read_ids(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    expected = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t, _) in zip(rows, expected, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    assert repair.fetch_ids(spark, folder, 11) == [library.encode(odd_rows()[11][1], add_special_tokens=False).ids + [2]]
    repair.write_ids(frame(spark, []), folder + "0")
    assert repair.read_ids(spark, folder + "0").count() == 0


def test_grammar_expands_to_what_it_was_made_of():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(1, np.uint32), np.full(5000, 7), rng.integers(0, 9, 20_000), np.tile(rng.integers(0, 500, 700), 30)):
        rules, seq = repair.compress(ids.astype(np.uint32), 1000)
        lengths = repair.expansion_lengths(rules, 1000)
        assert (repair.expand(seq, rules, lengths, 1000) == ids).all()
        a, b = len(ids) // 3, 2 * len(ids) // 3
        assert (repair.between(seq, rules, lengths, 1000, a, b) == ids[a:b]).all()
    assert len(seq) < len(ids) / 3


def test_sentencepiece_is_the_librarys(texts, monkeypatch):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = spm.Pieces(spm.default_path())
    own = sentencepiece.SentencePieceProcessor(model_file=spm.default_path())
    rows = [t for t in texts.values() if t][:80] + ["", " ", "  a  b", "\t☃ é　x ﬁ", "x" * 300, "a\nb", "日本語 text"]
    rng = random.Random(9)
    rows += ["".join(rng.choice("ab  \n\té☃XY1.") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in rows:
        assert model.encode(t) == own.encode(t)
        assert model.decode(model.encode(t)) == t
    for chunk in (words.CHUNK, 50):
        monkeypatch.setattr(words.scan, "__defaults__", (words.scan.__defaults__[0], chunk, False))
        ids, sizes = model.encode_all(pa.array([*rows, None, "a \u2581 b", "\u2581", "x" * 300_000]))
        found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found[: len(rows)] == [own.encode(t) for t in rows] and found[len(rows)] == []
        assert found[len(rows) + 1 : -1] == [own.encode("a \u2581 b"), own.encode("\u2581")] and len(found[-1]) > 1000
        data, lengths = model.bytes_of(ids, sizes)
        said = [x.tobytes().decode()[1:] for x in np.split(data, np.cumsum(lengths)[:-1])]
        assert said[: len(rows)] == rows and said[-1] == "x" * 300_000
    proto = sentencepiece_model_pb2.ModelProto()
    with open(spm.default_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model.merges = False
    model.clear()
    score = lambda ids: sum(proto.pieces[i].score for i in ids)
    for w in sorted({w for t in rows for w in t.split()})[:800]:
        assert score(model.encode(w)) == score(unigram.encode(w))  # ties may be cut differently


def test_sentencepiece_on_odd_rows(spark, odd):
    back = spm.decode(spm.encode(odd, ids="ids"), ids="ids", text="decoded")
    assert back.columns == [*[c for c in odd.columns if c != "ids"], "ids", "decoded"]
    for r in back.collect():
        assert r.decoded == r.text
    assert spm.encode(frame(spark, [])).count() == 0


def test_quality_reads_labelled_texts_whole(spark):
    """A long text's words are all fitted on; past the bound on words no further document is."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = spark.createDataFrame([(1, say("good", 5000)), (2, say("poor", 30)), (3, say("vile", 30)), (4, say("fine", 40))], "doc_id bigint, text string")
    graded = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, 2)], "doc_id bigint, grade int")
    assert len(quality.train(docs, graded).names) == 5000 + 30 + 30 + 40
    few = len(quality.train(docs, graded, held=1).names)
    assert few in (5000 + 60, 40 + 60)


def test_quality_is_learned_and_rows_survive(spark, docs, odd):
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    all_ = common.table(spark, "/root/testdata/sf0.01", "documents")
    graded = quality.grades_of(labels)
    model = quality.train(all_, graded.filter("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    held = quality.score(all_.select("doc_id", "text"), model).join(graded.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    good = held[held.grade == 2]
    assert (good.p_tail >= quality.LEAST_TAIL).mean() > 0.95
    assert held[held.grade == 1].expected_grade.mean() < good.expected_grade.mean() - 0.4
    scored = quality.score(odd, model)
    assert scored.count() == len(odd_rows()) and scored.columns == [*[c for c in odd.columns if c not in ("expected_grade", "p_tail")], "expected_grade", "p_tail"]
    bare = spark.createDataFrame([(None, None, None), (4, 7, 0), (4, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.select_good(odd, bare).count() == len(odd_rows())
    assert quality.select_good(odd, bare).columns == odd.columns
    assert quality.select_good(frame(spark, []), bare).count() == 0


@pytest.mark.parametrize("size, most, apart", [("sf0.001", 1.0, 0.1), ("sf0.01", 0.25, 1.0), ("sf0.1", 0.1, 1.5)])
def test_held_out_toxic_documents_are_told_apart(size, most, apart):
    """Of each size at most so many are selected, and so much lower is their grade than that of good ones.  At sf0.001
    8 toxic documents are learned from, half of them without an insult: held-out ones only sink there."""
    table = lambda name: pq.read_table(f"/root/testdata/{size}/{name}.parquet").to_pandas().set_index("doc_id")
    labels = table("labels").join(table("documents")["text"], how="inner")
    grades, ids = np.where(labels.toxic == 1, 0, 1 + labels.quality).astype(np.int64), labels.index.to_numpy()
    tails = np.zeros((len(ids), 2))
    for fold in range(4):
        out = ids % 4 == fold
        model = quality.fit(quality.features(pa.array(labels.text[~out])), grades[~out], np.ones((~out).sum()), 3)
        tails[out] = model.tails(quality.features(pa.array(labels.text[out])))
    toxic, good = tails[grades == 0], tails[grades == 2]
    assert (toxic[:, 1] >= quality.LEAST_TAIL).mean() <= most
    assert toxic.sum(1).mean() < good.sum(1).mean() - apart
    assert (good[:, 1] >= quality.LEAST_TAIL).mean() > 0.95


def test_every_word_of_the_sample_has_a_weight():
    texts = ["good plain words"] * 60 + ["good vile words"] * 2 + ["good words odd"]
    x = quality.features(pa.array(texts))
    grades = np.array([2] * 60 + [0] * 2 + [1])
    model = quality.fit(x, grades, np.ones(63), 3)
    assert set(model.names) == set(x.words) and len(model.names) == 5
    tails = model.tails(quality.features(pa.array(["good plain words", "good vile words"])))
    assert tails[1, 1] < tails[0, 1] - 0.3


def test_repeated_ids_and_ties_of_grades(spark):
    """A doc_id that repeats with its label counts once, equal texts fare alike, and a long text is read to its end."""
    texts = ["good plain words"] * 40 + ["good vile words"] * 40
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "a")] * 50 + [(41, "good vile words", "b")]
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)] + [(0, 1, 0)] * 5, "doc_id bigint, quality int, toxic int")
    model = quality.train(frame(spark, rows), quality.grades_of(labels))
    once = quality.train(frame(spark, rows[:80]), quality.grades_of(labels))
    assert (model.weights == once.weights).all()
    got = quality.score(frame(spark, rows), model).collect()
    assert len({r.p_tail for r in got if r.text == texts[0]}) == 1
    long = quality.features(pa.array(["good " * 500_000 + "vile"]))
    assert len(long.words) == 2
    kept = {r.doc_id for r in quality.select_good(frame(spark, rows), labels).collect()}
    assert kept == set(range(40))


def test_model_scores_and_base(docs, texts):
    rows = {r.doc_id: r for r in lm.score(docs, docs.filter(~lm.held_out())).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words_ = {i: [*word_list(t), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in words_.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words_[i]), sum(counts[w] > 0 for w in words_[i]), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words_[i]), rel=1e-12)
    assert sum(r.score for i, r in rows.items() if out[i]) > sum(r.base_score for i, r in rows.items() if out[i])


def test_model_is_a_distribution(spark):
    """Over all known words, one unknown one and the end, the chances after a context add up to 1."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    train = [(i, " ".join(rng.choice(vocab[: 3 + i % 27]) for _ in range(20)), "s") for i in range(60)]
    seen = sorted({w for _, t, _ in train for w in t.split()})
    probe = [(0, "w0", "s"), (1, "", "s")] + [(2 + n, f"w0 {w}", "s") for n, w in enumerate([*seen, "never"])]
    got = {r.doc_id: r for r in lm.score(frame(spark, probe), frame(spark, train)).collect()}
    # P(w0 w end) / P(w0 end) sums over w to (1 - P(end | w0)) weighted by P(end | w) / P(end | w0); score pairs apart instead
    first = {r.doc_id: r for r in lm.score(frame(spark, [(n, w, "s") for n, w in enumerate([*seen, "never"])]), frame(spark, train)).collect()}
    assert all(-20 < r.score < 0 for r in [*got.values(), *first.values()])
    assert sum(10**r.score for r in first.values()) + 10 ** got[1].score < 1


def test_rare_words_are_predicted_in_their_contexts(spark, monkeypatch):
    """However few words are sent to all tasks, a pair of rare words is learned as such and the scores stay."""
    rng = random.Random(4)
    train = [(i, " ".join(rng.choice("abcdefgh") for _ in range(50)) + (" left right" if i < 12 else ""), "s") for i in range(100)]
    probe = frame(spark, [(0, "left right", "s"), (1, "left a", "s"), (2, "right left", "s"), (3, "never right", "s")])
    score = lambda: {r.doc_id: (r.n_known, r.score) for r in lm.score(probe, frame(spark, train)).collect()}
    whole = score()
    assert all(whole[0][1] > whole[i][1] + 0.5 for i in (1, 2, 3))
    monkeypatch.setattr(lm, "SHARE", 64)  # words below 80 uses
    few = score()
    assert {i: x[0] for i, x in few.items()} == {i: x[0] for i, x in whole.items()}
    assert all(few[i][1] == pytest.approx(whole[i][1], abs=1e-4) for i in whole)


def test_seating_is_possible():
    counts = np.array([1, 2, 5, 100, 100_000])
    tables = lm.seat(counts, np.full(5, 0.2), np.full(5, 50.0), 0.75, 1.0, np.random.default_rng(0))
    assert (tables >= 1).all() and (tables <= counts).all() and tables[0] == 1


def test_model_on_odd_rows(spark, odd):
    rows = lm.score(odd, odd.filter("doc_id < 9")).collect()
    assert len(rows) == len(odd_rows()) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    empty = lm.score(odd, frame(spark, [])).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in empty)
    assert lm.score(frame(spark, []), odd).count() == 0
