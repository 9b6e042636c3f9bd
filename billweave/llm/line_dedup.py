"""Near-equal lines by a segment-partition edit join.

Two lines within `EDITS` edits are cut alike: one is split into EDITS + 1 segments, and at least one segment must occur unchanged in the
other, near its own place. So lines are joined on (length, segment number, segment): a line is indexed by its segments,
and probes with the substrings of itself that a segment of a line not longer could match. Candidates are
verified with a banded bit-parallel edit distance.

The keys go through a packed shuffle first, where only keys that different lines share are kept; lines that keep none are done.
Keys that hold many lines are cut into blocks that meet in pairs, each in a task of its own.

All lines that are not blank take part. The shorter of two lines must have `PER_EDIT` characters for each edit, so lines with fewer are equal
or different, and from EDITS * PER_EDIT on all `EDITS` are allowed.
"""

import functools
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.blocks import blocked, pack, pack_keys, range_bits, ranges_of, texts_of, unpack, unpack_keys, with_answers
from billweave.llm.components import Forest, components
from billweave.llm.shared import known_id, let_go, text_of, written

EDITS = 2
PER_EDIT = 20
LEAST = 1
BLANK = " \t\n\v\f\r"
HOT = 400  # lines of a key that one task compares with each other
EMPTY = pd.DataFrame({"line": [], "links": [], "root": []}, dtype="int64")
SIGN = re.compile(r"[^\x20\x09-\x0D]")


def line_id(line: str) -> int:
    """64 bits that stand for a line."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, width) of the edits + 1 even segments of a line; the last ones are longer by one."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for k in range(parts):
        width = short + (k >= parts - longer)
        out.append((at, width))
        at += width
    return out


def allowed(length: int, edits: int, per: int) -> int:
    """The edits that a line may be apart from longer ones."""
    return min(edits, length // per) if per else edits


@functools.lru_cache(maxsize=4096)
def _cuts(n: int, edits: int, per: int) -> tuple[list, list]:
    """(seed, start, end) of the index keys and of the probe keys of a line of `n` characters; the seed is the indexed line's length and segment.

    A line not longer than this one, by `gap` characters, has its k-th segment unchanged at a place that is off by at most k, by at most
    edits - k seen from the end, as otherwise the rest would need too many edits.
    """
    own = allowed(n, edits, per)
    index = [(n << 8 | k, a, a + w) for k, (a, w) in enumerate(segments(n, own))] if own else []
    probes = []
    for gap in range(edits + 1):
        most = allowed(n - gap, edits, per)
        if most < max(gap, 1):
            continue
        for k, (a, w) in enumerate(segments(n - gap, most)):
            low = max(0, a - k, a + gap - (most - k))
            high = min(n - w, a + k, a + gap + (most - k))
            probes += [(n - gap << 8 | k, start, start + w) for start in range(low, high + 1)]
    return index, probes


def keys_of(line: str, edits: int, per: int = 0) -> tuple[list[int], list[int]]:
    """Index keys and probe keys of a line; with `per`, the shorter line must have that many characters for each edit."""
    digest = xxhash.xxh3_64_intdigest
    index, probes = _cuts(len(line), edits, per)
    return [digest(line[a:b], seed) for seed, a, b in index], [digest(line[a:b], seed) for seed, a, b in probes]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: common ends are cut off, and the rest takes one word of bits per
    character, holding the band of 2 * edits + 1 diagonals for every number of errors."""
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common beginning, by halves
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        same = a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]
        low, high = (middle, high) if same else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return len(a) + len(b) <= edits
    if len(a) > len(b):
        a, b = b, a
    # Bit d of states[e]: with e errors, as many characters of b are read as of a, plus d - edits.
    full = (1 << (2 * edits + 1)) - 1
    states = [(((1 << (e + 1)) - 1) << edits) & full for e in range(edits + 1)]
    for i, character in enumerate(a):
        match = 0
        for d in range(2 * edits + 1):
            j = i + d - edits
            if 0 <= j < len(b) and b[j] == character:
                match |= 1 << d
        new = []
        for e, state in enumerate(states):
            bits = state & match
            if e:
                before = states[e - 1]
                bits |= before | before >> 1 | new[e - 1] << 1  # replaced, missing in b, added in b
            new.append(bits & full)
        states = new
        if not states[-1]:
            return False
    return bool(states[-1] >> (len(b) - len(a) + edits) & 1)


def _lines(text: bytes, least: int):
    """(number, line) of the lines that take part."""
    for number, line in enumerate(text.decode().split("\n")):
        if len(line) >= least and line.strip(BLANK):
            yield number, line


def _block_keys(texts: list[bytes], edits: int, least: int):
    """The distinct lines of a block by id, and all their keys: the key, the place of its line among these, and one bit of role."""
    lines = {}
    for text in texts:
        for _, line in _lines(text, least):
            lines.setdefault(line_id(line), line)
    keys, sizes = array("Q"), array("q")
    for line in lines.values():
        for some in keys_of(line, edits, PER_EDIT):
            keys.extend(some)
            sizes.append(len(some))
    sizes = np.array(sizes, np.int64)
    owners = np.repeat(np.arange(len(sizes)) // 2, sizes)
    roles = np.repeat(np.resize(np.array([1, 2], np.uint8), len(sizes)), sizes)
    return lines, np.array(keys, np.uint64), owners, roles


def _distinct_keys(keys: np.ndarray, owners: np.ndarray, roles: np.ndarray, names: np.ndarray):
    """The distinct keys, ascending, with two bits of role and the lowest and highest line id."""
    order = np.argsort(keys)
    keys, owners = keys[order], names[owners[order]]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    if not len(starts):
        return keys, roles, owners, owners
    return keys[starts], np.bitwise_or.reduceat(roles[order], starts), np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)


def shared_keys(blocks: DataFrame, n_chars: int, edits: int, least: int) -> DataFrame:
    """(block, range, packed): one flag per key of a block, 1 where another line has the key in the other role."""
    bits = range_bits(n_chars // 8)

    def send(batches):
        let_go()
        for frame in batches:
            for block, sizes, payload in zip(frame["block"], frame["sizes"], frame["payload"]):
                lines, *each = _block_keys(texts_of(payload, sizes), edits, least)
                keys, roles, low, high = _distinct_keys(*each, np.fromiter(lines, np.int64, len(lines)))
                roles, cut = roles.astype(np.uint64), ranges_of(keys, bits)
                # more than one line in the block is known at once; of the others the line goes along
                alone = (low == high).astype(np.uint64)
                yield pd.DataFrame(
                    {
                        "range": [r for r, _, _ in cut],
                        "block": block,
                        "keys": [pack_keys(keys[a:b]) for _, a, b in cut],
                        "roles": [pack(roles[a:b] | alone[a:b] << np.uint64(2)) for _, a, b in cut],
                        "lines": [low[a:b].tobytes() for _, a, b in cut],
                    }
                )

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        let_go()
        keys = [unpack_keys(k) for k in frame["keys"]]
        roles = np.concatenate([unpack(r) for r in frame["roles"]])
        lines = np.concatenate([np.frombuffer(b, np.int64) for b in frame["lines"]])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        several = np.bincount(at, roles & np.uint64(4) == 0, len(distinct)) > 0
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, at, lines)
        np.maximum.at(high, at, lines)
        role = np.zeros(len(distinct), np.uint64)
        np.bitwise_or.at(role, at, roles & np.uint64(3))
        live = ((several | (low != high)) & (role == 3))[at].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        packed = [pack(live[e - len(k) : e]) for k, e in zip(keys, ends)]
        return pd.DataFrame({"block": frame["block"], "range": frame["range"], "packed": packed})

    sent = blocks.select("block", "sizes", "payload").mapInPandas(send, "range int, block long, keys binary, roles binary, lines binary")
    return sent.groupBy("range").applyInPandas(decide, "block long, range int, packed binary")


def live_lines(blocks: DataFrame, answers: DataFrame, edits: int, least: int) -> DataFrame:
    """(line, text, keys, roles) of the distinct lines that share a key with another line."""

    def run(batches):
        let_go()
        for frame in batches:
            for sizes, payload, answer in zip(frame["sizes"], frame["payload"], frame["answers"]):
                lines, keys, owners, roles = _block_keys(texts_of(payload, sizes), edits, least)
                distinct, at = np.unique(keys, return_inverse=True)
                parts = [unpack(a["packed"]) for a in (answer if answer is not None else [])]
                live = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                if len(live) != len(distinct):
                    raise ValueError("the answers of a block are not those of its keys")
                kept = np.flatnonzero(live[at])
                kept = kept[np.lexsort((keys[kept], owners[kept]))]
                keys, owners, roles = keys[kept], owners[kept], roles[kept]
                if len(keys):  # a line's equal keys are one
                    starts = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(owners, prepend=-1) != 0))
                    keys, owners, roles = keys[starts], owners[starts], np.bitwise_or.reduceat(roles, starts)
                cuts = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(keys)).tolist()
                held, names = list(lines), owners[cuts[:-1]].tolist()
                keys, roles = (keys ^ np.uint64(1 << 63)).view(np.int64).tolist(), roles.tolist()
                rows = [(held[i], lines[held[i]], keys[a:b], roles[a:b]) for i, a, b in zip(names, cuts, cuts[1:])]
                yield pd.DataFrame(rows, columns=["line", "text", "keys", "roles"])

    joined = with_answers(blocks.select("block", "sizes", "payload"), answers).select("sizes", "payload", "answers")
    found = joined.mapInPandas(run, "line long, text string, keys array<long>, roles array<int>")
    return found.groupBy("line").agg(F.min_by(F.struct("text", "keys", "roles"), "text").alias("r")).select("line", "r.*")


def _links(frame: pd.DataFrame, edits: int, own: tuple[int, int] | None) -> pd.DataFrame:
    """Links among the lines of one key, or between two blocks of them; each link is counted at its smallest shared key."""
    names, texts, roles = frame["line"].to_list(), frame["text"].to_list(), frame["role"].to_list()
    all_keys = [dict(zip(k, r)) for k, r in zip(frame["keys"], frame["roles"])]
    key, blocks = frame["key"].iloc[0], frame["own"].to_list()
    lengths = list(map(len, texts))
    order = sorted(range(len(names)), key=lengths.__getitem__)
    count, forest = {}, Forest()
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if lengths[j] - lengths[i] > edits:
                break
            if own is not None and blocks[i] == blocks[j]:
                continue
            # the shorter line is the indexed one; of equal lengths either may be
            if not ((roles[i] & 1 and roles[j] & 2) or (lengths[i] == lengths[j] and roles[i] & 2 and roles[j] & 1)):
                continue
            if within(texts[i], texts[j], allowed(lengths[i], edits, PER_EDIT)):
                mine, other = all_keys[i], all_keys[j]
                if min(_met(mine, other, lengths[i] == lengths[j])) == key:
                    for k in (i, j):
                        count[names[k]] = count.get(names[k], 0) + 1
                    forest.link(names[i], names[j])
    if not count:
        return EMPTY
    return pd.DataFrame({"line": list(count), "links": list(count.values()), "root": [forest.root(n) for n in count]}, dtype="int64")


def _met(mine: dict, other: dict, equal: bool):
    """Keys at which two lines are compared."""
    for key in mine.keys() & other.keys():
        if (mine[key] & 1 and other[key] & 2) or (equal and mine[key] & 2 and other[key] & 1):
            yield key


def links(lines: DataFrame, edits: int) -> DataFrame:
    """(line, links, root) of lines (line, text, keys, roles): the numbers of links are to be added by line."""
    lines = written(lines)
    zipped = F.explode(F.arrays_zip("keys", "roles")).alias("z")
    keyed = lines.select("line", zipped).select("line", F.col("z.keys").alias("key"), F.col("z.roles").alias("role"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    placed = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / HOT).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("line", "key"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    sent = placed.withColumn("pair", F.explode(meets)).select("key", "line", "role", "own", "pair.low", "pair.high")
    full = sent.join(lines, "line")
    lanes = 8 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.withColumn("lane", F.pmod(F.xxhash64("key", "low", "high"), F.lit(lanes)))

    def one_lane(frame: pd.DataFrame) -> pd.DataFrame:
        out = [EMPTY]
        for (_, low, high), group in frame.groupby(["key", "low", "high"], sort=False):
            if len(group) > 1:
                out.append(_links(group, edits, None if low == high else (low, high)))
        return pd.concat(out)

    return full.groupBy("lane").applyInPandas(one_lane, "line long, links long, root long")


def line_classes(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, id: str = "doc_id", text: str = "text", mark: str | None = None
) -> DataFrame:
    """(line, doc_id, line_no, n_chars, n_copies, n_links, class_doc_id, class_line_no, kept) of every distinct line that takes part.

    `doc_id` and `line_no` are the line's first occurrence, `n_links` the number of other distinct lines within the edits that the shorter one
    allows, the class its smallest occurrence reachable over links; `kept` where the line itself is that one. Blank lines, those shorter than
    `least` characters, null and empty texts have no rows. Documents without id come last. Rows that share an id are told apart by the
    column `mark`, a number; without one they are as one document. An empty table gives an empty one.
    """
    number = F.lit(0) if mark is None else F.col(mark)
    named = F.concat_ws(" ", known_id(id, text).cast("string"), number.cast("string"))
    blocks = blocked(docs.select(named.alias("doc_id"), text_of(text).alias("text")))
    n_chars = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, n: t + n))).first()[0] or 0
    answers = shared_keys(blocks, n_chars, edits, least)
    found = written(links(live_lines(blocks, answers, edits, least), edits))

    def occurrences(batches):
        for frame in batches:
            for ids, sizes, payload in zip(frame["doc_ids"], frame["sizes"], frame["payload"]):
                seen = {}
                for doc_id, text in zip(ids, texts_of(payload, sizes)):
                    for number, line in _lines(text, least):
                        name, here = line_id(line), (*map(int, doc_id.split()), number)
                        first = seen.get(name)
                        seen[name] = (min(first[0], here), first[1] + 1, len(line)) if first else (here, 1, len(line))
                rows = [(name, *first, n, chars) for name, (first, n, chars) in seen.items()]
                yield pd.DataFrame(rows, columns=["line", "doc_id", "mark", "line_no", "n", "n_chars"])

    schema = "line long, doc_id long, mark long, line_no int, n long, n_chars long"
    each = blocks.select("doc_ids", "sizes", "payload").mapInPandas(occurrences, schema)
    first = F.min(F.struct("doc_id", "mark", "line_no")).alias("first")
    distinct = each.groupBy("line").agg(first, F.sum("n").alias("n_copies"), F.max("n_chars").alias("n_chars"))
    counts = found.groupBy("line").agg(F.sum("links").alias("n_links"))
    roots = components(found, "line", "root")
    named = distinct.join(counts, "line", "left").join(roots.withColumnRenamed("node", "line"), "line", "left")
    named = written(named.withColumn("root", F.coalesce("root", "line")))
    smallest = named.filter("n_links IS NOT NULL").groupBy("root").agg(F.min("first").alias("smallest"))
    classed = named.join(smallest, "root", "left").withColumn("class", F.coalesce("smallest", "first"))
    return classed.select(
        "line", "first.doc_id", "first.line_no", "n_chars", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), (F.col("class") == F.col("first")).alias("kept"),
        *([F.col("first.mark").alias("mark")] if mark is not None else []),
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` where every class of lines keeps its first occurrence only, in the order of ids and lines.

    Other lines, blank ones, and those shorter than `least` characters, stay. A document that had lines to compare and keeps none of them, and nothing else
    but white space, goes; null and empty texts stay. `n_chars`, where there is one, is counted anew in changed texts. Rows of one id are documents
    of their own, in an order that a rerun keeps; of equal ones the first keeps the lines.
    """

    @F.arrow_udf("string")
    def kept_lines(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        let_go()
        made = []
        for whole, kept in zip(texts.to_pylist(), numbers.to_pylist()):
            kept = set(kept or ())
            made.append("\n".join(line for k, line in enumerate(whole.split("\n")) if k in kept or not (len(line) >= least and SIGN.search(line))))
        return pa.array(made, pa.string())

    rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("_mark")))
    own_id, own_text = f"row.`{id}`", f"row.`{text}`"
    rows = rows.select("row", "_mark", known_id(own_id, own_text).alias("_doc"), text_of(own_text).alias("whole"))
    classes = line_classes(rows, edits, least, "_doc", "whole", mark="_mark")
    keep = classes.filter("kept").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("line_no").alias("_no"))
    keep = keep.groupBy("_doc", "_mark").agg(F.collect_list("_no").alias("_kept"))  # no more than the document's own lines
    joined = rows.join(keep, ["_doc", "_mark"], "left")
    # called so, a task makes its texts once: otherwise the filter and the columns would each have workers of their own make them
    made = joined.withColumn("made", kept_lines.asNondeterministic()("whole", "_kept"))
    changed = F.col("made") != F.col("whole")
    gone = changed & ~F.col("made").rlike(r"[^\x20\x09-\x0D]")
    new_text = F.when(changed, F.col("made")).otherwise(F.col(f"row.`{text}`"))
    out = made.filter(~gone).withColumn("_new", new_text)
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col("_new").alias(name))
        elif name == "n_chars":
            columns.append(F.when(changed, F.length("made")).otherwise(F.col("row.n_chars")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return out.select(*columns)
