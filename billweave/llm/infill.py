"""Fill-in-the-middle texts: cuts between tokens, found on bytes and told in code points by a sparse exception index.

Texts reach Python as UTF-8 and stay bytes. Tokens end where a byte that is no space is followed by one that is, so the cuts of a
text come out as byte offsets. `Exceptions` holds, for the multibyte characters of a text alone, where they stand and how many bytes more than
one they and all before them take; a binary search in it converts a byte offset into a code point or back. A text without such
characters needs no entry: both offsets are the same there.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from billweave.llm.shared import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Where the multibyte characters of a UTF-8 text stand, and the bytes beyond one a character up to each of them."""

    def __init__(self, raw: np.ndarray):
        self.at = np.flatnonzero(raw >= 0xC0)  # lead bytes
        lead = raw[self.at]
        excess = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(excess)))
        self.chars = self.at - self.before[:-1]  # the same places in code points

    def chars_at(self, cut: int) -> int:
        """Code points before a byte offset that lies between two characters."""
        return cut - int(self.before[np.searchsorted(self.at, cut)])

    def bytes_at(self, cut: int) -> int:
        """Bytes before a code point offset."""
        return cut + int(self.before[np.searchsorted(self.chars, cut)])


@cache
def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of a text end: every word with the spaces before it, and the spaces after the last word."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space = _spaces()[raw]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw))


def arranged(text: bytes, draws: tuple[int, int, int, int], rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    ends = token_ends(raw)
    n, (h1, h2, h3, h4) = len(ends), draws
    if not text or h3 % 100 >= rate or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = (int(ends[k - 1]) if k else 0 for k in (first, last))
    index = Exceptions(raw)
    low_chars, high_chars = index.chars_at(low), index.chars_at(high)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm:
        return n, "spm", low_chars, high_chars - low_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low_chars, high_chars - low_chars, b"".join((p, prefix, s, suffix, m, middle))


def _arrange(rate: int, spm: int):
    @arrow_udf(MADE)
    def arrange(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        draws = zip(*(h.to_numpy(zero_copy_only=False).tolist() for h in (h1, h2, h3, h4)))
        rows = [arranged(value.as_buffer().to_pybytes(), drawn, rate, spm) for value, drawn in zip(text.cast(pa.binary()), draws)]
        n, form, prefix, middle, output = zip(*rows) if rows else ((), (), (), (), ())
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
        columns.append(pa.array(output, pa.binary()).cast(pa.string()))
        return pa.StructArray.from_arrays(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return arrange


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, id: str = "doc_id", text: str = "text", into: str = "fim") -> DataFrame:
    """`docs` with a struct column `into`: n (tokens), form, prefix_chars, middle_chars and output of every text.

    Of a hundred texts `rate` are cut at two places between tokens, and of a hundred cut ones `spm` get the form spm (suffix first), the
    others psm. What is drawn depends on `seed` and the id alone, so repeated rows and reruns agree; rows without an id draw as if
    it were an empty one. A null text counts as empty. An empty text and one that holds a mark stay plain, with null cuts. All columns
    of `docs` are kept; one that is called as `into` is replaced, so choose another name for it. An empty table gives an empty one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    return docs.withColumn(into, _arrange(rate, spm)(text_of(text), *draws))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of `fill_in_middle` was made of. Parts hold no mark, so the first three marks are the places of the cuts."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), 4)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
