"""Ids beyond 2^53 beside null ids come back as they are."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers

from billweave.llm import line_dedup, lm_scores, minhash, token_store

IDS = [1152921504606846977, None, 9007199254740993, -3, 7]


def test_large_ids_beside_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of {k}") for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in lm_scores.scores(docs).collect()} == set(IDS)
    store = str(tmp_path / "store")
    token_store.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), store)
    rows = sorted(token_store.read_tokens(spark, store).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [-3, 7, 9007199254740993, 1152921504606846977, None]


def test_outlines_rule_out_no_similar_pair():
    chance = np.random.default_rng(2)
    base = [chance.choice(1 << 30, 300, replace=False).astype(np.uint64) for _ in range(3)]
    sets = []
    for k in range(60):
        own = base[k % 3].copy()
        changed = chance.choice(300, chance.integers(0, 80), replace=False)
        own[changed] = chance.integers(1 << 31, 1 << 40, len(changed)).astype(np.uint64)
        sets.append(np.unique(own[: chance.integers(200, 301)]))
    drawn = []
    for s in sets:
        bits = np.zeros(minhash.OUTLINE, np.uint8)
        bits[(s % np.uint64(minhash.OUTLINE)).astype(np.int64)] = 1
        drawn.append(np.packbits(bits).tobytes())
    frame = pd.DataFrame({"node": range(60), "n": [len(s) for s in sets], "root": range(60), "outline": drawn})
    found = set(map(tuple, minhash._possible(frame, frame, 80).to_numpy().tolist()))
    similar = set()
    for a, b in itertools.combinations(range(60), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            similar.add((a, b))
    assert similar and similar <= found and len(found) < 0.01 * 60 * 59 / 2
    joined = frame.assign(root=[k if k % 4 == 0 else -1 for k in range(60)])  # most rows are of one component
    mixed = set(map(tuple, minhash._possible(joined, joined, 80).to_numpy().tolist()))
    assert mixed == {(a, b) for a, b in found if a % 4 == 0 or b % 4 == 0}
    halves = minhash._possible(frame[:30], frame[30:], 80).to_numpy().tolist()
    assert set(map(tuple, halves)) == {(a, b) for a, b in found if a < 30 <= b}


def test_rows_of_one_id_keep_their_own_lines(spark):
    """Rows that share an id are documents of their own; equal ones keep the lines once; a text of very many lines ends."""
    shared = "a line that several rows of this table have in common"
    rows = [
        (1, f"{shared}\nthe first row has this line alone"),
        (1, f"{shared}\nthe second row of id one has another line"),
        (1, f"{shared}\nthe first row has this line alone"),
        (2, "\n".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(20_000))),
        (None, shared),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = [(r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs).collect()]
    lines = Counter(line for _, text in kept for line in text.split("\n"))
    assert [lines[x] for x in (shared, "the first row has this line alone", "the second row of id one has another line")] == [1, 1, 1]
    assert sorted(i for i, _ in kept) == [1, 1, 2]
