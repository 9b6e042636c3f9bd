"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import gc
import itertools
import math
import os
import random
import re
import time
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

import corpus_pipeline
from billweave.llm import blocks, line_dedup, lm_scores, minhash, mixing, piece_codec, quality, rans, token_counts, token_store, toxicity, vector_dedup
from billweave.llm import components as component_rounds
from billweave.llm import queries as registered
from billweave.llm.components import components
from billweave.llm.shared import let_go, recorded, written

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def root_of(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# pieces


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.model(PIECES)
    chance = random.Random(1)
    made = ["".join(chance.choice("ab the▁ \nineré日x0😀\t") for _ in range(chance.randint(0, 40))) for _ in range(500)]
    for text in [*made, "", " ", " " * 500 + "x", "\x00a", "a" * 2000, "</s> <s> <0x41>"]:
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    for _ in range(300):
        ids = [chance.randrange(3, 32000 if chance.random() < 0.5 else 259) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)


def test_pieces_of_odd_rows(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = piece_codec.with_text(piece_codec.with_pieces(odd_docs, PIECES), PIECES).collect()
    assert len(coded) == 11
    for r in coded:
        assert r.piece_ids == library.encode(r.text or "") and r.decoded == library.decode(r.piece_ids)
    assert piece_codec.with_pieces(no_docs, PIECES).count() == 0


# quality: the registered query is checked against its statement


def test_quality_of_odd_rows(odd_docs, no_docs):
    rows = quality.judged(odd_docs).collect()
    assert len(rows) == 11
    assert {r.base_failed for r in rows if r.n_words < 20} == {True}
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.judged(no_docs).count() == 0


# lines


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def test_edits_and_keys():
    chance = random.Random(3)
    for _ in range(1500):
        a = [chance.choice("abc") for _ in range(chance.randint(4, 14))]
        b = list(a)
        for _ in range(chance.randint(0, 4)):
            i = chance.randrange(len(b) + 1)
            b[i : i + chance.randint(0, 1)] = [chance.choice("abc")] * chance.randint(0, 1)
        a, b = "".join(a), "".join(b)
        for edits in (1, 2, 3):
            near = distance(a, b) <= edits
            assert line_dedup.within(a, b, edits) == near
            short, long = sorted((a, b), key=len)
            if near and len(short) > edits:
                assert set(line_dedup.keys_of(short, edits)[0]) & set(line_dedup.keys_of(long, edits)[1])


def test_keys_of_a_block_are_those_of_its_lines():
    texts = ["a line of some length é\n\nshort\na line of some length é", "another line, of more than forty characters in all\n \t\n" + "long " * 40]
    lines, keys, owners, roles = line_dedup._block_keys([text.encode() for text in texts], 2, 1)
    plain = {line_dedup.line_id(x): x for text in texts for x in text.split("\n") if x.strip()}
    assert lines == plain
    names, each = list(lines), Counter(zip(owners.tolist(), roles.tolist(), keys.tolist()))
    expected = Counter()
    for i, name in enumerate(names):
        for role, some in zip((1, 2), line_dedup.keys_of(plain[name], 2, line_dedup.PER_EDIT)):
            expected.update((i, role, key) for key in some)
    assert each == expected and expected
    distinct, both, low, high = line_dedup._distinct_keys(keys, owners, roles, np.array(names))
    for key, role, least, most in zip(distinct.tolist(), both.tolist(), low.tolist(), high.tolist()):
        found = [(names[i], r) for i, r, k in expected if k == key]
        assert (least, most) == (min(found)[0], max(found)[0]) and role == sum({r for _, r in found})
    assert len(distinct) == len({k for _, _, k in expected})


def test_texts_without_repeated_lines_are_made_once(spark):
    docs = spark.createDataFrame([(1, "one line\nanother"), (2, "one line"), (None, None)], "doc_id long, text string")
    kept = line_dedup.without_repeated_lines(docs)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "one line\nanother"), (None, None)}


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)  # so that keys are cut into blocks
    chance, base = random.Random(5), "the quick brown fox jumps over the lazy dog again and again"
    rows = []
    for i in range(40):
        line = list(base)
        for _ in range(chance.randint(0, 3)):
            line[chance.randrange(len(line))] = chance.choice("xyz")
        rows.append((i, "".join(line) + "\nshort\n" + "".join(chance.choice("abcdef") for _ in range(50))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs).collect()}
    first, copies = {}, Counter()
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            if len(line) >= line_dedup.LEAST:
                first.setdefault(line, (i, k))
                copies[line] += 1
    links = [(a, b) for a, b in itertools.combinations(first, 2) if distance(a, b) <= line_dedup.EDITS]
    degree = Counter(x for pair in links for x in pair)
    root = root_of([(first[a], first[b]) for a, b in links], first.values())
    assert set(found) == set(first.values())
    for line, at in first.items():
        r = found[at]
        assert (r.n_copies, r.n_links, (r.class_doc_id, r.class_line_no)) == (copies[line], degree[line], root[at])


def test_lines_of_odd_rows(odd_docs, no_docs):
    kept = line_dedup.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[8] == 0 or ids[8] == 1
    assert ids[3] == ids[4] == ids[5] == ids[7] == 1 and ids[None] == 2
    assert line_dedup.without_repeated_lines(no_docs).count() == line_dedup.line_classes(no_docs).count() == 0


def test_short_lines_equal_brute_force(spark):
    chance, rows = random.Random(23), []
    for i in range(60):
        lines = ["menu", "Home", "no", "", "  ", "\t", "a longer line of 24 chars", f"menu {i % 7}", "ab" * chance.randint(1, 24)]
        for base in ("copyright by nobody", "all rights reserved by me", "this line has nearly forty characters in"):
            line = list(base)[: chance.randint(len(base) - 1, len(base))]
            for _ in range(chance.randint(0, 2)):
                line[chance.randrange(len(line))] = chance.choice("xyz")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    first, copies = {}, Counter()
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (i, k))
                copies[line] += 1
    links = [(a, b) for a, b in itertools.combinations(first, 2) if distance(a, b) <= min(2, len(a) // 20, len(b) // 20)]
    degree = Counter(x for pair in links for x in pair)
    root = root_of([(first[a], first[b]) for a, b in links], first.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs).collect()}
    assert {at: (r.n_copies, r.n_links, (r.class_doc_id, r.class_line_no)) for at, r in found.items()} == {
        at: (copies[line], degree[line], root[at]) for line, at in first.items()
    }
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    stays = {at for at in first.values() if root[at] == at}
    made = {i: "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip() or (i, k) in stays) for i, text in rows}
    assert kept == {i: text for i, text in made.items() if text.strip()}


# near-duplicates


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b")
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_a_task_remembers_the_words_of_many_batches():
    pieces, made = piece_codec.PieceModel(PIECES), []
    pieces.words.compute = lambda word: made.append(word) or b""
    for _ in range(2):
        for k in range(20):
            pieces.words.turn()
            pieces.encode(" ".join(f"w{n}" for n in range(5000 * k, 5000 * k + 5000)))
    assert len(made) == 100_000


def test_the_words_of_a_batch_are_encoded_together(monkeypatch):
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceModel(PIECES)
    chance = random.Random(2)
    made = [" ".join("".join(chance.choices("aaeehtnéßñ0'.\r", k=chance.randint(1, 60))) for _ in range(40)) for _ in range(50)]
    monkeypatch.setattr(pieces, "_word", lambda word: pytest.fail("a word on its own"))
    coded = pieces.encode_all(pa.array(made))
    assert [np.frombuffer(ids, np.int32).tolist() for ids in coded] == library.encode(made)
    monkeypatch.undo()
    odd = ["", " a", "a  b", "\nfoo\n", "x\n\ny z", "▁x y▁", "a\0b \x07c", "日本 語é", "a " + "y" * 70, "ÿ ÷ ¿ \x80", "", "é"]
    coded = pieces.encode_all(pa.array(odd))
    assert [np.frombuffer(ids, np.int32).tolist() for ids in coded] == library.encode(odd)
    cut = [0, *np.cumsum([len(ids) // 4 for ids in coded])]
    assert pieces.decode_all(np.frombuffer(b"".join(coded), np.int32), np.array(cut)) == library.decode(library.encode(odd))
    assert pieces.encode_all(pa.array([], pa.string())) == []


def test_a_worker_keeps_what_one_operator_needs():
    assert toxicity._memo() is toxicity._memo()
    first = toxicity._memo()
    first["word"]
    pieces = piece_codec.model(PIECES)
    assert piece_codec.model(PIECES) is pieces and toxicity._memo() is not first
    kept = weakref.ref(piece_codec.model(PIECES))
    del pieces
    let_go()
    gc.collect()
    assert kept() is None and "word" not in toxicity._memo()


def test_few_links_are_followed_in_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)], "a long, b long").repartition(9)
    expected = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}
    rounds, stars = [], component_rounds._stars
    monkeypatch.setattr(component_rounds, "_stars", lambda links: rounds.append(1) or stars(links))
    assert {r.node: r.root for r in components(edges, "a", "b").collect()} == expected
    assert not rounds
    monkeypatch.setattr(component_rounds, "HELD", 40)  # tasks hold less than all links, so rounds go first
    assert {r.node: r.root for r in components(edges, "a", "b").collect()} == expected
    assert rounds


def test_minhash_of_odd_rows(odd_docs, no_docs):
    rows = minhash.components_of(odd_docs).collect()
    assert len(rows) == 11
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert all(r.kept and r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    kept = minhash.without_near_duplicates(odd_docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids[1] == 1 and ids[2] == 0 and ids[None] == 2
    assert minhash.components_of(no_docs).count() == 0


def test_hub_with_many_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words)) for i in range(3)]
    for i in range(3, 120):
        copy = list(words)
        for k in range(4):
            copy[(i * 7 + k * 23) % 100] = f"n{i}x{k}"
        rows.append((i, " ".join(copy)))
    found = minhash.components_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def components_by_brute_force(rows, width, percent=80):
    sets = {i: minhash.shingles(text, width) for i, text in rows}
    links = []
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * common >= percent * (len(x) + len(y) - common):
            links.append((a, b))
    return root_of(links, sets)


def test_template_meets_all_its_near_copies(spark):
    chance = random.Random(11)
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words))]
    for i in range(1, 150):
        copy = list(words)
        for k in chance.sample(range(0, 100, 3), 4):
            copy[k] = f"n{i}x{k}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    found = {r.doc_id: r.component_id for r in minhash.components_of(docs).collect()}
    assert found == components_by_brute_force(rows, 2)


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 8, raising=False)  # so that buckets are cut into blocks
    chance, made = random.Random(17), [[f"w{i}" for i in range(60)]]
    for i in range(1, 260):
        copy = list(chance.choice(made))
        for k in chance.sample(range(60), chance.randint(3, 5)):
            copy[k] = f"n{i}x{k}"
        made.append(copy)
    rows = [(i, " ".join(words)) for i, words in enumerate(made)]
    found = {r.doc_id: r.component_id for r in minhash.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components_by_brute_force(rows, 2)


def test_all_pairs_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 8)
    roots = {i: 0 if i < 40 else i for i in range(46)}  # one component and six outsiders
    rest = spark.createDataFrame([(1, i, 1, 100, r) for i, r in roots.items()], "key long, node long, copies long, n long, root long")
    full = np.packbits(np.ones(minhash.OUTLINE, np.uint8)).tobytes()  # outlines that rule nothing out
    drawn = rest.select("node", F.lit(full).alias("outline"))
    found = {(r.a, r.b) for r in minhash.rest_pairs(rest, drawn, 80).collect()}
    assert found == {(a, b) for a, b in itertools.combinations(roots, 2) if roots[a] != roots[b]}


# token store


def test_range_coder():
    chance = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 300_000):
        ids = chance.zipf(1.3, n) % 49_000
        table = rans.Table(*np.unique(np.append(ids, 7), return_counts=True))
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        if n > 262_144:
            assert (rans.decode(block, table, 1) == ids[262_144:]).all()
            with pytest.raises(ValueError):
                rans.decode(block[:-4] + b"abcd", table)


def test_store_round_trip(spark, odd_docs, no_docs, tmp_path):
    tokenizer = Tokenizer.from_file(registered.WORD_PIECES)
    token_store.write_tokens(odd_docs, registered.WORD_PIECES, str(tmp_path / "a"), block_ids=50)
    rows = sorted(token_store.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    expected = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    start = 0
    for r, (doc_id, text) in zip(rows, expected, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc_id, start, ids)
        start += len(ids)
    token_store.write_tokens(no_docs, registered.WORD_PIECES, str(tmp_path / "b"))
    assert token_store.read_tokens(spark, str(tmp_path / "b")).count() == 0


# token counts


def test_plain_words_are_cut_as_the_library_cuts_them(monkeypatch):
    words = token_store.Words(registered.WORD_PIECES)
    whole, encode_whole = [], words._whole
    monkeypatch.setattr(words, "_whole", lambda new: (whole.extend(new), encode_whole(new)))
    dice = random.Random(5)
    signs = "aZbé 'sStTLl'dD<|>startoftext0 9²½ÀÖ×ßÿ÷ªµİıſẞΣς\u0301\u0300\u200b\x85\xa0\x1c\x7f\x00\u3000한ᄀ漢\t\nǅ😀ﬁ.,;!?~"
    texts = ["".join(dice.choices(signs, k=dice.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>a<|startoftext|>", "don't I'LL we'Ve it'S''s", "Früher, ÉTÉ: 12%"]
    library = Tokenizer.from_file(registered.WORD_PIECES)
    expected = [np.array(c.ids, "<u4").tobytes() for c in library.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == expected == words.encode(texts)
    assert "<|endoftext|>a<|startoftext|>" in whole and not {"don't", "Früher,", "12%"} & set(whole)
    simple = Tokenizer(BPE({"a": 0, "b": 1}, []))  # another way of cutting is left to the library
    assert not token_store._cuts_alike(simple)


def test_counts_look_no_further_than_pieces_reach():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "b" * 2000: -3.0}
    began = time.process_time()
    assert token_counts.CountTrie(pieces).count("ab" * 4000) == 4001
    assert time.process_time() - began < 1


def test_counts_equal_plain_viterbi(spark, odd_docs, no_docs):
    log_p = token_counts.zipf_pieces(PIECES)

    def plain(word):
        word = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[-1][0] + token_counts.UNKNOWN, -(-best[-1][1] + len(word[end - 1].encode())))]
            for start in range(max(0, end - 20), end):
                p = log_p.get(word[start:end])
                if p is not None:
                    options.append((best[start][0] + p, best[start][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    trie = token_counts.CountTrie(log_p)
    words = {w for text in list(texts(spark).values())[:60] for w in text.split()} | {"日本", "😀", "a"}
    assert all(trie.count(w) == plain(w) for w in words)
    rows = token_counts.with_token_counts(odd_docs, PIECES).collect()
    assert len(rows) == 11 and {r.n_tokens for r in rows if not (r.text or "").strip()} == {0}
    assert token_counts.with_token_counts(no_docs, PIECES).count() == 0


# mixing


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()))
    size, target, taken, biggest = Counter(), {}, Counter(), Counter()
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    sources, weight = sorted(size), {}
    for place, source in enumerate(sources):
        weight[source] = (3, 1, 2)[place % 3]
    expected, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / sum(weight[s] for s in sources if s not in capped)
        expected = {s: 2 * size[s] if s in capped else level * weight[s] for s in sources}
        over = {s for s in sources if expected[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in sources:
        assert math.isclose(target[s], expected[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(no_docs).count() == 0


# vectors


def test_vectors_equal_brute_force(spark):
    chance = np.random.default_rng(2)
    centers = chance.standard_normal((30, 64))
    rows = []
    for i in range(400):
        v = centers[i % 30] + 0.25 * chance.standard_normal(64)
        rows.append((i, [float(np.float32(x)) for x in v], i % 30 % 3))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, rows[5][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in vector_dedup.linked(frame).collect()}
    good = [(i, np.array(v), label) for i, v, label in rows if i < 2000]
    links = []
    for (i, v, a), (j, w, b) in itertools.combinations(good, 2):
        if a == b and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
            links.append((i, j))
    degree, root = Counter(x for pair in links for x in pair), root_of(links, [r[0] for r in rows])
    assert links and len(found) == len(rows)
    missed = sum(found[i].n_links != degree[i] for i in found)
    assert missed == 0
    assert all(found[i].component_id == root[i] and found[i].kept == (root[i] == i) for i in found)
    assert vector_dedup.linked(frame.limit(0)).count() == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.01 * len(held)


def test_toxicity_counts_and_keeps_little(spark):
    rows = [(i, f"common words {'here' if i % 2 else 'there'} w{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    packed = toxicity._featurized(docs.selectExpr("id", "text", "1 label", "0 shard"), 12)
    counts = Counter(c for _, text in rows for c in toxicity.coordinates(text, 12).tolist())
    assert toxicity._included(packed, 12, 20).tolist() == sorted(c for c, n in counts.items() if n >= 20)
    paths = []
    with recorded(paths):
        _, weights = toxicity.learn(docs, docs.selectExpr("id", "cast(id % 2 as int) label"), 12)
    assert len(weights) and [os.path.exists(path.removeprefix("file:")) for path in paths] == [False, True]


def test_toxicity_of_odd_rows(odd_docs, no_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0


# language model


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    docs = {i: t.split() for i, t in texts(spark).items()}

    def grams(words, n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    total = [Counter(g for w in docs.values() for g in grams(w, n)) for n in (0, 1, 2, 3)]
    words = sum(map(len, docs.values()))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in lm_scores.scores(frame).collect()}
    for i, w in docs.items():
        own = [Counter(grams(w, n)) for n in (0, 1, 2, 3)]
        score = 0.0
        for k in range(len(w)):
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                count, before = total[n][gram] - own[n][gram], total[n - 1][gram[:-1]] - own[n - 1][gram[:-1]]
                penalty = math.log(0.4) * (min(3, k + 1) - n)
                if n == 1:
                    score += math.log(max(count, 0.5) / max(1, words - len(w))) + penalty
                elif count > 0:
                    score += math.log(count / before) + penalty
                    break
        assert math.isclose(found[i].log_score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_packed_keys_take_little_more_than_their_entropy():
    dice = np.random.default_rng(3)
    for n, mask in itertools.product((0, 1, 2, 9, 5000), (2**64 - 1, 2**64 - 256, 255)):
        keys = np.unique(dice.integers(0, 2**64 - 1, n, np.uint64, endpoint=True) & np.uint64(mask))
        assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
        counts = dice.integers(0, 3, n).astype(np.uint64)
        assert (blocks.unpack_counts(blocks.pack_counts(counts, 1), 1) == counts).all()
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (blocks.unpack_keys(blocks.pack_keys(ends)) == ends).all()
    # keys of 56 bits in one of 128 ranges: log2(2^49 / 9700) + 1.44 bits each
    keys = np.unique((dice.integers(0, 2**49, 9700, np.uint64) << np.uint64(8)) + np.uint64(5 << 57))
    assert len(blocks.pack_keys(keys)) < 4.75 * len(keys)
    assert len(blocks.pack_keys(keys[:180])) < 5.5 * 180


def test_scores_of_odd_rows(odd_docs, no_docs):
    rows = lm_scores.scores(odd_docs).collect()
    assert len(rows) == 11 and {r.mean_log_score for r in rows if r.n_words == 0} == {None}
    assert lm_scores.scores(no_docs).count() == 0


# pipeline


def test_pipeline_stages(spark, odd_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, written(stage(spark, docs, FOLDER))
        assert docs.columns == columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, FOLDER).count() >= 0
        assert stage(spark, odd_docs.limit(0), FOLDER).count() == 0


def test_stages_leave_no_tables_to_the_next(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = list(corpus_pipeline._left)
        docs = written(stage(spark, docs, FOLDER))
        assert not any(map(os.path.exists, left))
    assert any(map(os.path.exists, corpus_pipeline._left))
    # a result that is not written yet keeps its tables
    lazy = corpus_pipeline.STAGES[1][1](spark, odd_docs, FOLDER)
    kept = corpus_pipeline.STAGES[2][1](spark, lazy, FOLDER)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in corpus_pipeline.STAGES[2][1](spark, written(lazy), FOLDER).collect())


def test_pipeline_keeps_one_of_each_copy(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r.decodes for r in rows)
    assert len({r.doc_id for r in rows}) <= spark.read.parquet(f"{FOLDER}/documents.parquet").count()
