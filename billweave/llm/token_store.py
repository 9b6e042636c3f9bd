"""Token ids of a corpus in files of range-coded blocks.

A store is a folder of three Parquet tables. `table` holds the shared frequencies, `parts` the number of ids before each part, and
`blocks` the blocks of whole documents: part, block, the documents' ids and lengths, the place of the first id in the part,
and the coded bytes of `rans`. Parts and blocks follow the document ids. Every block decodes on its own, so Spark reads a store in
parallel; checksums cover the bytes and the ids.
"""

import json
import os
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.normalizers import Sequence
from tokenizers.pre_tokenizers import ByteLevel

from billweave.llm import rans
from billweave.llm.shared import Memo, discard, held_alone, small_batches, text_of, write_table

BLOCK_IDS = 1 << 18  # a block closes at the first document end beyond that
# Ids travel as text: beside a null, pandas would turn whole numbers into doubles and round those above 2^53.
TOKENS = "part int, block int, at long, doc_ids array<string>, lengths array<long>, ids binary"
MEMO_WORDS = 200_000
# How a tokenizer must cut words so that `PLAIN` ones may be cut here: composed, in lower case, then by this pattern and byte by byte.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUTTERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
# Printable ASCII and the letters of Latin-1: no form but the composed one, and one lower-case character for each.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _cuts_alike(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer's file cuts words as `CUT` does and marks the last token of every cut."""
    made = json.loads(tokenizer.to_str())
    steps, cutters = (made[k] or {} for k in ("normalizer", "pre_tokenizer"))
    special = [t["content"] for t in made["added_tokens"]]
    marked = made["model"].get("end_of_word_suffix") == "</w>" and not made["model"].get("dropout")
    return marked and steps.get("normalizers") == NORMALIZERS and cutters.get("pretokenizers") == CUTTERS and all(t.startswith("<|") for t in special)


class Words:
    """Packed ids by word. The tokenizer drops white space and no token reaches over it, so words can be encoded apart; the
    words that a batch brings anew are encoded together.

    Most of the library's time goes into normalizing and cutting each word. `PLAIN` words are cut here, where the tokenizer's file says how,
    and the library encodes their distinct cuts in one call. Any other word takes the whole way through the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.cuts, self.model = Memo(None, MEMO_WORDS), Memo(None, MEMO_WORDS), None
        if _cuts_alike(self.tokenizer):
            self.model = Tokenizer.from_file(path)
            self.model.normalizer, self.model.pre_tokenizer = Sequence([]), ByteLevel(add_prefix_space=False, use_regex=False)
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, words: list[str]) -> None:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.memo.update((word, struct.pack(f"<{len(c.ids)}I", *c.ids)) for word, c in zip(words, coded))

    def _plain(self, words: list[str]) -> None:
        """Words of which each is cut into lower-case cuts; those that the batch brings anew are encoded as one text."""
        cuts = self.cuts
        cuts.turn()
        pieces = [CUT(word.lower()) for word in words]
        asked = set().union(*pieces)
        cuts.update({cut: cuts.old[cut] for cut in asked - cuts.keys() if cut in cuts.old})
        new = list(asked - cuts.keys())
        if new:
            ids = np.array(self.model.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(new):
                raise ValueError("the tokenizer's cuts are not those of its file")
            packed = ids.tobytes()
            cuts.update((cut, packed[a:b]) for cut, a, b in zip(new, [0, *ends[:-1]], ends))
        get = cuts.__getitem__
        self.memo.update((word, get(p[0]) if len(p) == 1 else b"".join(map(get, p))) for word, p in zip(words, pieces))

    def encode(self, texts) -> list[bytes]:
        """The packed ids of every text. Texts are split and their distinct words numbered in Arrow, so only distinct words are looked up."""
        memo = self.memo
        memo.turn()
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # at \x20 and \x09 to \x0D
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [word for word in distinct if word not in memo]
        memo.update({word: memo.old[word] for word in new if word in memo.old})
        new = [word for word in new if word not in memo]
        if self.model and new:
            plain = pc.match_substring_regex(pa.array(new, pa.large_string()), PLAIN).to_numpy(zero_copy_only=False).tolist()
            plain = [alike and "<|" not in word for word, alike in zip(new, plain)]  # special tokens begin so
            self._plain([word for word, alike in zip(new, plain) if alike])
            new = [word for word, alike in zip(new, plain) if not alike]
        self._whole(new)
        packed = [memo[word] for word in distinct]
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(packed), "<u4"))
        ids = lists.take(words.indices).flatten().to_numpy()
        ends = np.append(0, np.cumsum(sizes[words.indices.to_numpy()]))[parts.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


@held_alone
def _words(path: str) -> Words:
    return Words(path)


def _tokenize(path: str, end: int, block_ids: int):
    """Sorted rows (doc_id, text) of a task to blocks of packed ids."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        part, block, at = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, packed, size = [], [], [], 0

        def closed():
            row = {"part": part, "block": block, "at": at, "doc_ids": doc_ids, "lengths": lengths, "ids": b"".join(packed)}
            return pd.DataFrame({name: [value] for name, value in row.items()})

        for frame in batches:
            for doc_id, ids in zip(frame["doc_id"], _words(path).encode(frame["text"])):
                ids += tail
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                packed.append(ids)
                size += len(ids) // 4
                if size >= block_ids:
                    yield closed()
                    block, at = block + 1, at + size
                    doc_ids, lengths, packed, size = [], [], [], 0
        if doc_ids:
            yield closed()

    return run


def _count(batches):
    counts = np.zeros(0, np.int64)
    for frame in batches:
        for ids in frame["ids"]:
            seen = np.bincount(np.frombuffer(ids, "<u4"))
            if len(seen) > len(counts):
                seen[: len(counts)] += counts
                counts = seen
            else:
                counts[: len(seen)] += seen
    tokens = np.flatnonzero(counts)
    yield pd.DataFrame({"token": tokens, "n": counts[tokens]})


def _table(rows: DataFrame) -> rans.Table:
    """The shared frequencies: one row per token of the vocabulary at most."""
    counts = rows.toPandas()
    return rans.Table(counts["token"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode the whole texts of `docs`, append `end` to each, and write them to `folder` in ascending order of the id.

    Null texts are empty: they hold the end id alone. Null ids come last; rows of equal ids are ordered by length and text. An empty
    table gives an empty store. A document longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.length("text")]  # the limits of the ranges hold no texts
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    named = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    tokens, path = write_table(named.mapInPandas(_tokenize(tokenizer, end, block_ids), TOKENS))
    counts = tokens.select("ids").mapInPandas(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts, _ = write_table(counts.coalesce(1), f"{folder}/table")
    held = spark.sparkContext.broadcast(_table(counts))
    ends = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)
    sizes = tokens.select("part", ends.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    sizes.select("part", before).coalesce(1).write.parquet(f"{folder}/parts")

    def pack(batches):
        for frame in batches:
            frame["coded"] = [rans.encode(np.frombuffer(ids, "<u4"), held.value) for ids in frame.pop("ids")]
            yield frame

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    coded = tokens.mapInPandas(pack, TOKENS.replace("ids binary", "coded binary"))
    coded = coded.withColumn("doc_ids", F.col("doc_ids").cast("array<bigint>"))
    coded.write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(spark, path)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store: `start` counts the ids of all documents before, `ids` are
    little-endian 32-bit integers."""
    held = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{folder}/table")))

    def unpack(batches):
        for frame in batches:
            for part, at, doc_ids, lengths, coded in zip(frame["part"], frame["at"], frame["doc_ids"], frame["lengths"], frame["coded"]):
                ids = rans.decode(coded, held.value).astype("<u4")
                ends = np.cumsum(np.asarray(lengths, np.int64))
                starts = ends - lengths
                yield pd.DataFrame(
                    {
                        "part": part,
                        "doc_id": pd.array([None if d is None else int(d) for d in doc_ids], "Int64"),
                        "local": at + starts,
                        "n_tokens": lengths,
                        "ids": [ids[a:b].tobytes() for a, b in zip(starts, ends)],
                    }
                )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    rows = blocks.mapInPandas(unpack, "part int, doc_id long, local long, n_tokens long, ids binary")
    parts = spark.read.parquet(f"{folder}/parts")
    # one row per task that wrote the store
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids")
