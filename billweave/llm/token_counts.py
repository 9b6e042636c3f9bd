"""Token counts by unigram segmentation, computed in a trie that pre-tokens share.

A text is cut at white space; each pre-token is a space mark and its characters. The best segmentation of a string into
vocabulary pieces has the largest sum of log-probabilities; its forward score at a position depends only on
the characters before it. So the scores are kept at the nodes of a trie of the distinct pre-tokens: a prefix
that many words share is computed once, and the node where a word ends stores its number of pieces.

The vocabulary file is a merge table and holds ranks, not probabilities. A piece's probability follows Zipf's law:
log p = -log(rank + 2). A character that no piece covers costs `UNKNOWN` and counts its UTF-8 bytes. Equal
scores take the segmentation with fewer pieces.
"""

import math

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.shared import held_alone, small_batches, text_of

MARK = "▁"
UNKNOWN = -30.0
MOST_NODES = 400_000  # of a task's trie, which starts anew beyond that


class Node:
    __slots__ = ("below", "score", "count")

    def __init__(self, score: float, count: int):
        self.below: dict[str, Node] | None = None
        self.score, self.count = score, count


class CountTrie:
    """Forward scores and piece counts of all prefixes seen so far."""

    def __init__(self, log_p: dict[str, float]):
        # the pieces from their last character to the first: [log-probability or None, {character before: the same}]
        self.ends: dict[str, list] = {}
        for piece, p in log_p.items():
            below = self.ends
            for character in reversed(piece):
                entry = below.setdefault(character, [None, {}])
                below = entry[1]
            entry[0] = p
        self.counts: dict[str, int] = {}
        self.root, self.nodes = Node(0.0, 0), 1

    def count(self, text: str) -> int:
        """Number of pieces of a pre-token."""
        known = self.counts.get(text)
        if known is None:
            known = self.counts[text] = self._insert(MARK + text)
        return known

    def _insert(self, text: str) -> int:
        node, known = self.root, 0
        scores, counts = [node.score], [node.count]
        for character in text:  # the part that another pre-token began with
            if node.below is None or (following := node.below.get(character)) is None:
                break
            node, known = following, known + 1
            scores.append(node.score)
            counts.append(node.count)
        ends = self.ends
        for end in range(known, len(text)):
            character = text[end]
            best, fewest = scores[end] + UNKNOWN, counts[end] + len(character.encode())
            below, start = ends, end
            # longer and longer ends, until no piece ends so
            while start >= 0 and (entry := below.get(text[start])) is not None:
                p, below = entry
                if p is not None:
                    score = scores[start] + p
                    if score > best or (score == best and counts[start] + 1 < fewest):
                        best, fewest = score, counts[start] + 1
                start -= 1
            following = Node(best, fewest)
            if node.below is None:
                node.below = {}
            node.below[character] = node = following
            scores.append(best)
            counts.append(fewest)
        self.nodes += len(text) - known
        return node.count

    def turn(self) -> None:
        if self.nodes > MOST_NODES:
            self.counts, self.root, self.nodes = {}, Node(0.0, 0), 1


def zipf_pieces(path: str) -> dict[str, float]:
    """Log-probabilities by rank of the ordinary pieces of a piece model file."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (library.is_byte, library.is_control, library.is_unknown, library.is_unused)
    ranks = range(library.vocab_size())
    return {library.id_to_piece(i): -math.log(i + 2) for i in ranks if not any(test(i) for test in special)}


@held_alone
def trie(path: str) -> CountTrie:
    return CountTrie(zipf_pieces(path))


def with_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `n_pretokens` and `n_tokens` of each whole text. Null and empty texts count 0; repeated rows stay;
    columns of these two names are replaced. A very long pre-token takes time in proportion to its length."""

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        table = trie(path)
        table.turn()
        words = [value.split() for value in texts]
        get = table.counts.get
        totals = []
        for each in words:
            found = list(map(get, each))
            if None in found:
                found = list(map(table.count, each))
            totals.append(sum(found))
        return pd.DataFrame({"n_pretokens": list(map(len, words)), "n_tokens": totals}, dtype="int64")

    small_batches(docs.sparkSession)
    counts = docs.withColumn("_counts", counted(text_of(text)))
    kept = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens")]
    return counts.select(*kept, "_counts.n_pretokens", "_counts.n_tokens")
