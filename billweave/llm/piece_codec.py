"""SentencePiece encoding and decoding with a prefix table.

A BPE piece model merges, again and again, the adjacent symbols whose union is the piece of the best score.
The pieces of a text are then the only sequence in which every piece stands for itself and every two
neighbours stay apart when they are encoded on their own. So each prefix of a text has one last piece: the
one match of the piece automaton that ends there and is compatible with the last piece of the prefix before
it. The table of last pieces takes one pass over the matches, and the ids come from walking it backwards.
"""

import functools
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from billweave.llm.shared import Memo, held_alone, small_batches, text_of

MARK = "▁"
PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
UNJOINED = float("-inf")
COMPATIBLE_KEPT = 200_000  # answers of the pair test that a task remembers
WORDS_KEPT = 120_000  # words of a generation of the memo
PLAIN_WORDS = 10_000  # words that `PlainWords` encodes at once
PAIRS_AT_ONCE = 4_000  # pairs whose merges are made at once
PLAIN_LONG = 64  # characters of the longest word that `PlainWords` takes
PAIR_BITS = 20  # of the table of pair tests in `PlainWords`
PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The pair tests of `PieceModel` for many pairs at once: every step makes the best merge of each pair that is left."""

    def __init__(self, pieces: "PieceModel"):
        ids, size = pieces.id_of, pieces.size

        def symbol(text: str) -> int | None:
            return ids.get(text, size + ord(text) if len(text) == 1 else None)

        longest = max(map(len, ids), default=1)
        self.size, self.symbols, self.length = size, np.full((size, longest), -1, np.int32), np.zeros(size, np.int64)
        keys, gains, joined = array("q"), array("d"), array("i")
        for piece, i in ids.items():
            self.symbols[i, : len(piece)], self.length[i] = [symbol(c) for c in piece], len(piece)
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 22 | right)
                    gains.append(pieces.score[piece])
                    joined.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.gain = np.append(np.array(gains, np.float64)[order], UNJOINED)
        self.joined = np.append(np.array(joined, np.int64)[order], -1)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each union in `gain` and `joined`; the last one where there is none."""
        keys = left << 22 | right
        at = np.searchsorted(self.keys, keys)
        known = (left >= 0) & (right >= 0) & (at < len(self.keys))
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, at, len(self.keys))

    def _symbols(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = np.minimum(tokens, self.size - 1)
        symbols, length = self.symbols[piece, : int(self.length[piece].max())].astype(np.int64), self.length[piece]
        alone = tokens >= self.size
        symbols[alone], length[alone] = -1, 1
        symbols[alone, 0] = tokens[alone]
        return symbols, length

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge joins the two tokens of a pair."""
        cuts = range(0, len(left), PAIRS_AT_ONCE)
        return np.concatenate([self._some_apart(left[k : k + PAIRS_AT_ONCE], right[k : k + PAIRS_AT_ONCE]) for k in cuts])

    def _some_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        (a, n), (b, m) = self._symbols(left), self._symbols(right)
        row, column = np.arange(len(left))[:, None], np.arange(int((n + m).max()) + 1)
        behind = np.clip(column - n[:, None], 0, b.shape[1] - 1)
        symbols = np.where(column < n[:, None], a[row, np.minimum(column, a.shape[1] - 1)], np.where(column < (n + m)[:, None], b[row, behind], -1))
        joins = self._join(symbols[:, :-1], symbols[:, 1:])
        answers, pair, column = np.zeros(len(left), bool), np.arange(len(left)), column[:-1]
        while len(pair):
            gains = self.gain[joins]
            k = gains.argmax(axis=1)  # of equal ones the leftmost
            row = np.arange(len(pair))
            over = gains[row, k] == UNJOINED
            answers[pair[over]] = True
            go = ~over & (k != n - 1)
            pair, n, k, symbols, joins = pair[go], n[go], k[go], symbols[go], joins[go]
            if not len(pair):
                break
            row, n = np.arange(len(pair)), n - (k < n - 1)
            made = self.joined[joins[row, k]]
            later = column > k[:, None]
            symbols = np.hstack([np.where(later, symbols[:, 1:], symbols[:, :-1]), np.full((len(pair), 1), -1)])
            # where the last symbol came up, none is left behind it
            symbols[row, k] = made
            moved = np.hstack([joins[:, 1:], np.full((len(pair), 1), len(self.keys))])
            joins = np.where(later, moved, joins)
            joins[row, k] = self._join(made, symbols[row, k + 1])
            front = np.flatnonzero(k > 0)
            joins[front, k[front] - 1] = self._join(symbols[front, k[front] - 1], made[front])
        return answers


class PlainWords:
    """The prefix tables of many short words of Latin-1 characters at once, in numpy. They are filled by the place in the word: first all prefixes
    of one character, then those of two and so on. The mark is the character 0 here; it also parts the words."""

    def __init__(self, pieces: "PieceModel"):
        self.size, self.merges = pieces.size, Merges(pieces)
        made = {piece.replace(MARK, "\0"): i for piece, (i, _) in pieces.automaton.items() if "\0" not in piece}
        plain = {piece: i for piece, i in made.items() if max(piece) < "\u0100"}
        for value in range(1, 128):  # characters without a piece stand for themselves, above the vocabulary
            plain.setdefault(chr(value), pieces.size + value)
        letters = "".join(re.escape(c) for c in plain if len(c) == 1 and c != "\0")
        self.takes = re.compile(f"[{letters}]{{1,{PLAIN_LONG}}}").fullmatch
        most = sum(map(len, plain)) + 1
        child, tokens, used = np.zeros((most, 256), np.uint16 if most < 1 << 16 else np.int32), np.full(most, -1, np.int32), 1
        for piece, i in plain.items():
            node = 0
            for value in piece.encode("latin-1"):
                if not child[node, value]:
                    child[node, value], used = used, used + 1
                node = int(child[node, value])
            tokens[node] = i
        self.child, self.token = child[:used].astype(np.uint16 if used < 1 << 16 else np.int32), tokens[:used].copy()
        self.pairs, self.apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.fallback = np.array(pieces.fallback[:128], np.int32)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair tests of `PieceModel`, by a table that keeps the last pair of each of its places."""
        keys = left.astype(np.int64) << 22 | right
        at = (keys.view(np.uint64) * PAIR_MIX >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        answers, new = self.apart[at], np.flatnonzero(self.pairs[at] != keys)
        if len(new):
            asked, where = np.unique(keys[new], return_inverse=True)
            found = self.merges.apart(asked >> 22, asked & 0x3FFFFF)
            answers[new] = found[where]
            places = (asked.view(np.uint64) * PAIR_MIX >> np.uint64(64 - PAIR_BITS)).view(np.int64)
            places, first = np.unique(places, return_index=True)
            self.pairs[places], self.apart[places] = asked[first], found[first]
        return answers

    def encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that `takes` matches, each after a mark, or with a line end before it."""
        if not words:
            return []
        text = np.frombuffer(("\0" + "\0".join(words) + "\0" * 2).encode("latin-1"), np.uint8)
        n = len(text) - 2
        marks = np.flatnonzero(text[:n] == 0)
        ends = np.append(marks[1:], n)
        begins = marks + (text[marks + 1] == 10)  # no mark before a line end
        begin = np.repeat(begins, ends - marks)
        # all pieces at all places; none goes beyond its word, as no piece has a mark behind another character
        at, node, width, found = np.arange(n), self.child[0, text[:n]], 1, []
        while len(at):
            token = self.token[node]
            hit = token >= 0
            found.append((at[hit], token[hit], np.full(np.count_nonzero(hit), width)))
            node = self.child[node, text[np.minimum(at + width, n)]]
            alive = node > 0
            at, node, width = at[alive], node[alive], width + 1
        start, token, widths = (np.concatenate(column) for column in zip(*found))
        place = start + widths - begin[start]
        inside = place > 0
        start, token, widths, place = start[inside], token[inside], widths[inside], place[inside]
        order = np.argsort(place.astype(np.int16), kind="stable")
        start, token, widths = start[order], token[order], widths[order]
        limits = np.append(0, np.cumsum(np.bincount(place)))
        last, length = np.full(n + 1, -1, np.int32), np.ones(n + 1, np.int64)
        for a, b in zip(limits[:-1], limits[1:]):
            s, t, w = start[a:b], token[a:b], widths[a:b]
            fits = s == begin[s]
            rest = np.flatnonzero(~fits & (last[s] >= 0))
            fits[rest] = self._apart(last[s[rest]], t[rest])
            s, t, w = s[fits], t[fits], w[fits]
            last[s + w], length[s + w] = t, w
        taken, at, word = [], ends, np.arange(len(words))
        while len(at):
            taken.append((word, last[at]))
            at = at - length[at]
            more = at > begins[word]
            at, word = at[more], word[more]
        sizes = np.bincount(np.concatenate([word for word, _ in taken]), minlength=len(words))
        closes = np.cumsum(sizes)
        ids = np.empty(closes[-1], np.int32)
        for k, (word, token) in enumerate(taken):
            ids[closes[word] - 1 - k] = token
        if len(ids) and ids.min() < 0:
            raise ValueError("a prefix has no last piece")
        ids = np.where(ids < self.size, ids, self.fallback[np.maximum(ids - self.size, 0)]).astype("<i4").tobytes()
        cuts = (4 * closes).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


class PieceModel:
    """The pieces of a BPE model with byte fallback, read from a model file."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        self.size = size
        self.bytes_of: list[bytes] = []
        self.fallback = [0] * 256
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.starts_marked = np.zeros(size, bool)
        n_bytes = 0
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:-1], 16)
                self.fallback[value] = i
                self.bytes_of.append(bytes([value]))
                n_bytes += 1
            elif library.is_control(i):
                self.bytes_of.append(b"")
            elif library.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.starts_marked[i] = piece.startswith(MARK)
                if not library.is_unused(i):
                    self.score[piece], self.id_of[piece] = library.get_score(i), i
        if n_bytes != 256:
            raise ValueError("the model has no byte fallback")
        self.text_of = {i: piece for piece, i in self.id_of.items()}
        self.compatible: dict[int, bool] = {}
        # Where no piece joins a letter to a following space or to a line end, words can be encoded apart.
        self.apart = not any(MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1) for piece in self.score)
        self.words, self.parts = Memo(self._word, WORDS_KEPT), Memo(self._packed)

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Only single symbols and pieces that the merges really make can be in a result. Decoding alone does without."""
        automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self._merged(piece) == [piece]:
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        return automaton

    def _merged(self, text: str) -> list[str]:
        """The merges themselves, for strings as short as two pieces."""
        symbols, score = list(text), self.score.get
        gains = [score(a + b, UNJOINED) for a, b in zip(symbols, symbols[1:])]
        while gains and (best := max(gains)) != UNJOINED:
            k = gains.index(best)  # of equal ones the leftmost
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score(symbols[k - 1] + symbols[k], UNJOINED)
            if k < len(gains):
                gains[k] = score(symbols[k] + symbols[k + 1], UNJOINED)
        return symbols

    def _text(self, token: int) -> str:
        return self.text_of[token] if token < self.size else chr(token - self.size)

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when they meet. Tokens above the vocabulary are single characters
        without a piece."""
        key = left << 22 | right
        known = self.compatible.get(key)
        if known is None:
            a, b = self._text(left), self._text(right)
            if len(self.compatible) >= COMPATIBLE_KEPT:
                self.compatible.clear()
            known = self.compatible[key] = self._merged(a + b) == [a, b]
        return known

    def encode_part(self, text: str) -> list[int]:
        """Ids of a string in which spaces are marks already."""
        n = len(text)
        last, length = [-1] * (n + 1), [1] * (n + 1)
        done, size, compatible = 0, self.size, self.compatible
        for end, (token, width) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # nothing fits there but the character itself
                done += 1
                if last[done] < 0:
                    last[done] = size + ord(text[done - 1])
            if last[end] < 0:
                start = end - width
                if start == 0:
                    last[end], length[end] = token, width
                else:
                    left = last[start]
                    known = compatible.get(left << 22 | token)
                    if known or (known is None and self._apart(left, token)):
                        last[end], length[end] = token, width
        for k in range(done + 1, n + 1):
            if last[k] < 0:
                last[k] = size + ord(text[k - 1])
        ids: list[int] = []
        while n:
            token = last[n]
            if token < size:
                ids.append(token)
            else:
                ids.extend(self.fallback[b] for b in reversed(text[n - 1].encode()))
            n -= length[n]
        ids.reverse()
        return ids

    def _packed(self, part: str) -> bytes:
        return np.array(self.encode_part(part), np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """A word that follows one space, or with a line end before it."""
        return self._packed(word if word[0] == "\n" else MARK + word)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.apart:
            return self._packed(MARK + text.replace(" ", MARK))
        words = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" in words:  # runs of spaces
            return b"".join(map(self.parts.__getitem__, PARTS.findall(MARK + text.replace(" ", MARK))))
        return b"".join(map(self.words.__getitem__, words))

    @functools.cached_property
    def plain(self) -> PlainWords:
        return PlainWords(self)

    def _learn(self, words: list[str]) -> None:
        """Have all the words in the memo."""
        memo = self.words
        new = [word for word in words if word not in memo]
        memo.update({word: memo.old[word] for word in new if word in memo.old})
        new = [word for word in new if word not in memo]
        plain = [word for word in new if self.plain.takes(word)]
        for k in range(0, len(plain), PLAIN_WORDS):
            part = plain[k : k + PLAIN_WORDS]
            memo.update(zip(part, self.plain.encode(part)))
        memo.update({word: self._word(word) for word in new if word not in memo})

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """`encode` of every text. Texts are split and their distinct words numbered in Arrow, so only distinct words are looked up."""
        self.words.turn()
        self.parts.turn()
        if not self.apart:
            return [self.encode(text) for text in texts.to_pylist()]
        spaced = pc.replace_substring(pc.replace_substring(texts.cast(pa.large_string()), MARK, " "), "\n", " \n")
        bare = pc.or_(pc.starts_with(spaced, " "), pc.or_(pc.ends_with(spaced, " "), pc.match_substring(spaced, "  ")))
        bare = pc.or_(bare, pc.equal(spaced, ""))  # texts with empty words
        split = pc.split_pattern(spaced.filter(pc.invert(bare)), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._learn(distinct)
        packed = [self.words[word] for word in distinct]
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(packed), "<i4"))
        ids = lists.take(words.indices).flatten().to_numpy()
        ends = np.append(0, np.cumsum(sizes[words.indices.to_numpy()]))[split.offsets.to_numpy()]
        coded = iter([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
        return [self.encode(text.as_py()) if alone else next(coded) for text, alone in zip(texts, bare.to_pylist())]

    @functools.cached_property
    def raw(self) -> pa.Array:
        return pa.array(self.bytes_of, pa.large_binary())

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """`decode` of the lists that lie between neighbouring `ends`, their bytes taken in one step."""
        taken = self.raw.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
        raw = taken.buffers()[2]
        raw = raw.to_pybytes() if raw is not None else b""
        limits, texts = offsets[ends].tolist(), []
        for a, b, first, end in zip(limits[:-1], limits[1:], ends[:-1].tolist(), ends[1:].tolist()):
            while first < end and offsets[first + 1] == offsets[first]:
                first += 1
            if first < end and self.starts_marked[ids[first]]:
                a += 1
            try:
                texts.append(raw[a:b].decode())
            except UnicodeDecodeError:
                texts.append(self.decode(ids[first:end]))
        return texts

    def decode(self, ids) -> str:
        """Text of ids; a byte that is no part of a character becomes U+FFFD."""
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.bytes_of[i]), None)
        if first is not None and self.starts_marked[first]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError as error:
            text, start = "", 0
            while error is not None:
                text += raw[start : start + error.start].decode() + "�"
                start += error.start + 1
                try:
                    text, error = text + raw[start:].decode(), None
                except UnicodeDecodeError as another:
                    error = another
            return text


@held_alone
def model(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)


def with_pieces(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """`docs` with the column `ids`: the piece ids of each whole text, without begin or end ids.

    A null or empty text has no ids. Any column of the name `ids` is replaced; all others stay, and so do
    repeated rows. Texts of any length take time in proportion to their length.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        packed = model(path).encode_all(texts)
        ends = np.cumsum([0] + [len(p) // 4 for p in packed])
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    small_batches(docs.sparkSession)
    return docs.withColumn(ids, encode(text_of(text)))


def with_text(docs: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """`docs` with the column `text`: what the ids stand for. Null ids give an empty text."""

    @F.arrow_udf(StringType())
    def decode(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy()
        first = int(offsets[0])
        return pa.array(model(path).decode_all(lists.values.to_numpy()[first : int(offsets[-1])], offsets - first), pa.string())

    return docs.withColumn(text, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
