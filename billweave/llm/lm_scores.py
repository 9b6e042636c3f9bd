"""Stupid-backoff language-model scores from the corpus itself.

n-grams of one to `ORDER` words are counted over all documents, in tables partitioned by the hash of the n-gram; the n-grams of
every document are joined with their counts, and the logarithms are summed per document. A document is scored by the
others: its own occurrences are subtracted from every count. Rows of the shuffle are packed: one holds the distinct n-grams of a
block of documents in one hash range with their counts (see `blocks`).

An n-gram that no other document has backs off to the next shorter one, times `BACKOFF`. A word that no other document has counts
`UNSEEN`.
"""


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.blocks import blocked, pack_counts, pack_keys, range_bits, ranges_of, texts_of, unpack_counts, unpack_keys, with_answers
from billweave.llm.minhash import A, mixed
from billweave.llm.shared import Memo, held_alone, text_of

ORDER = 3
BLOCK_BYTES = 4 << 20  # text of a block: its n-grams take some 60 times as much while they are sorted
KEY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)  # 56 bits of a hash; two of 10^9 n-grams share a key with a chance of 7 in a million each
BACKOFF = 0.4
UNSEEN = 0.5


@held_alone
def _memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def ngrams(texts: list[bytes], order: int):
    """(document, place in it, keys) of all words of a block: keys[n - 1] has the hash of the n words that end there, and is meaningless
    where the place is below n - 1. Words are separated by the ASCII space characters."""
    memo = _memo()
    memo.turn()
    hashes = []
    for text in texts:
        words = text.split()
        hashes.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    lengths = np.array([len(h) for h in hashes], np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, run = [], h
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n > 1:
                run = mixed(np.concatenate((np.zeros(1, np.uint64), run[:-1])) * A + h)
            keys.append(mixed(run + np.uint64(n)) & KEY_BITS)
    return doc, place, keys


def _distinct(place: np.ndarray, keys: list[np.ndarray]):
    """The distinct keys of all orders, ascending, the place of each word's key among them, and their counts."""
    valid = [place >= n for n in range(len(keys))]
    flat = np.concatenate([k[v] for k, v in zip(keys, valid)])
    return (valid, *np.unique(flat, return_inverse=True, return_counts=True))


def _log_scores(doc, place, valid, at, total: np.ndarray, n_docs: int, words: int) -> np.ndarray:
    """Sum of log scores per document; `total` has the corpus count of every distinct key."""
    order = len(valid)
    docs_of = np.concatenate([doc[v] for v in valid])
    _, again, own = np.unique(docs_of * len(total) + at, return_inverse=True, return_counts=True)
    others = total[at] - own[again]
    count, begin = np.zeros((order, len(doc))), 0
    for n, v in enumerate(valid):
        size = int(v.sum())
        count[n, v] = others[begin : begin + size]
        begin += size
    lengths = np.bincount(doc, minlength=n_docs)
    rest = np.maximum(1.0, words - lengths)[doc]
    score = np.log(np.maximum(count[0], UNSEEN) / rest) + np.log(BACKOFF) * np.minimum(place, order - 1)
    for n in range(1, order):  # longer n-grams replace shorter ones
        hit = np.flatnonzero((count[n] > 0) & (place >= n))
        score[hit] = np.log(count[n, hit] / count[n - 1, hit - 1]) + np.log(BACKOFF) * (np.minimum(place[hit], order - 1) - n)
    return np.bincount(doc, score, minlength=n_docs)


def scores(docs: DataFrame, order: int = ORDER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of `docs`.

    Null and empty texts have no words, the score 0 and a null mean. Repeated rows are documents of their own, so copies
    explain each other. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    blocks = blocked(rows, BLOCK_BYTES)
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = range_bits(2 * words)

    def send(batches):
        for frame in batches:
            for block, sizes, payload in zip(frame["block"], frame["sizes"], frame["payload"]):
                _, place, keys = ngrams(texts_of(payload, sizes), order)
                _, distinct, _, counts = _distinct(place, keys)
                cut = ranges_of(distinct, bits)
                yield pd.DataFrame(
                    {
                        "range": [r for r, _, _ in cut],
                        "block": block,
                        "keys": [pack_keys(distinct[a:b]) for _, a, b in cut],
                        "counts": [pack_counts(counts[a:b], 1) for _, a, b in cut],
                    }
                )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in frame["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate([unpack_counts(c, 1) for c in frame["counts"]]).astype(np.int64)
        others = np.bincount(at, own)[at].astype(np.int64) - own
        ends = np.cumsum([len(k) for k in keys])
        packed = [pack_counts(others[e - len(k) : e], 0) for k, e in zip(keys, ends)]
        return pd.DataFrame({"block": frame["block"], "range": frame["range"], "packed": packed})

    sent = blocks.select("block", "sizes", "payload").mapInPandas(send, "range int, block long, keys binary, counts binary")
    answers = sent.groupBy("range").applyInPandas(count, "block long, range int, packed binary")

    def score(batches):
        for frame in batches:
            for ids, sizes, payload, answer in zip(frame["doc_ids"], frame["sizes"], frame["payload"], frame["answers"]):
                doc, place, keys = ngrams(texts_of(payload, sizes), order)
                valid, distinct, at, own = _distinct(place, keys)
                parts = [unpack_counts(a["packed"], 0) for a in (answer if answer is not None else [])]
                others = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
                if len(others) != len(distinct):
                    raise ValueError("the counts of a block are not those of its n-grams")
                sums = _log_scores(doc, place, valid, at, others + own, len(ids), words)
                lengths = np.bincount(doc, minlength=len(ids))
                means = [s / n if n else None for s, n in zip(sums, lengths)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if i is None else int(i) for i in ids], "Int64"),
                        "n_words": lengths,
                        "log_score": sums,
                        "mean_log_score": pd.array(means, "Float64"),
                    }
                )

    joined = with_answers(blocks.select("block", "doc_ids", "sizes", "payload"), answers)
    return joined.select("doc_ids", "sizes", "payload", "answers").mapInPandas(
        score, "doc_id long, n_words long, log_score double, mean_log_score double"
    )
