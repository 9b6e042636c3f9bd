"""Quality rules whose limits follow the data: quantile sketches per language and source, then a join.

Everything is DataFrame functions. A text's measures are whole numbers; ratios are in thousandths. The sketch
of a measure counts its values in bins that keep the highest eight binary digits, so it merges by adding
counts, in any order with the same result, and a quantile is at most one part in 128 too low.

A measure fails where it lies beyond a fence: the upper quartile plus `REACH` times its distance from the median, and below
likewise for the word length. The distance counts as `LEAST` at least, so that a group of equal documents does not
reject the first that differs a little.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.llm.shared import text_of, written

WINDOW = 8
REACH = 6
LEAST = {"word_length": 100, "symbols": 20, "dup_lines": 70, "repeats": 40}
TWO_SIDED = ("word_length",)
MIN_DOCS = 100  # smaller groups take the limits of their language, smaller languages those of all documents
SALTS = 16


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more."""

    def by_hashes(hashes):
        starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return _let(F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)])), by_windows)

    def by_windows(windows):
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, by_pairs))

    def by_pairs(pairs):
        def twice(pair, k):
            before = F.when(k > 0, F.get(pairs, k - 1).getField("x") == pair.getField("x"))
            after = F.get(pairs, k + 1).getField("x") == pair.getField("x")
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return _let(F.sort_array(F.transform(F.filter(pairs, twice), lambda p: p.getField("i"))), covered)

    def covered(starts):
        widths = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.get(starts, k + 1) - s))
        return F.aggregate(widths, F.lit(0), lambda total, width: total + width)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), by_hashes)


def features(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of every row's whole text. A null text is an empty one; repeated rows stay repeated."""
    whole = text_of(text)
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = F.struct(
        F.col(id).alias("doc_id"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda a: F.struct(F.size(a).alias("all"), F.size(F.array_distinct(a)).alias("different"))).alias("lines"),
        _let(
            words,
            lambda a: F.struct(
                F.size(a).cast("bigint").alias("n_words"),
                F.length(F.concat_ws("", a)).cast("bigint").alias("word_chars"),
                _repeated(a).cast("bigint").alias("n_repeat_words"),
            ),
        ).alias("words"),
    )
    return docs.select(measured.alias("m")).select(
        "m.doc_id",
        "m.lang",
        "m.source",
        "m.words.n_words",
        "m.words.word_chars",
        "m.n_symbols",
        F.col("m.lines.all").cast("bigint").alias("n_lines"),
        (F.col("m.lines.all") - F.col("m.lines.different")).cast("bigint").alias("n_dup_lines"),
        "m.words.n_repeat_words",
    )


def _measures() -> dict[str, Column]:
    """The measures that have limits, in thousandths."""

    def ratio(above: str, below: str) -> Column:
        return F.expr(f"(1000 * {above}) div nullif({below}, 0)")

    return {
        "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    """The fixed part of the rules."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """Sketches of the measures of rows that pass the fixed rules: (level, lang, source, measure, bin, n), where level 0
    is a source in a language, 1 a language and 3 everything."""
    measures = _measures()
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), m.alias("v")) for name, m in measures.items()]))
    rows = counts.filter(~base_failed()).select("lang", "source", each.alias("e")).select("lang", "source", "e.*")
    shift = "greatest(0, length(bin(v)) - 8)"
    bins = rows.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
    keys = ["lang", "source", "measure", "bin"]
    finest = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sets = [keys, ["lang", "measure", "bin"], ["measure", "bin"]]
    level = F.shiftright(F.grouping_id(), 2)
    return finest.groupingSets(sets, *keys).agg(level.alias("level"), F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Limits per (level, lang, source): number of documents, and low and high of each measure."""
    group = ["level", "lang", "source", "measure"]
    running = Window.partitionBy(*group).orderBy("bin")  # at most some thousand bins
    placed = sketch.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("bin")))

    quartiles = placed.groupBy(*group).agg(
        F.max("all").alias("docs"), quantile(25).alias("q1"), quantile(50).alias("q2"), quantile(75).alias("q3")
    )
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])[F.col("measure")]
    high = F.col("q3") + REACH * F.greatest(least, F.col("q3") - F.col("q2"))
    low = F.col("q1") - REACH * F.greatest(least, F.col("q2") - F.col("q1"))
    low = F.when(F.col("measure").isin(*TWO_SIDED), low).otherwise(F.lit(-1))
    limits = quartiles.select(*group, "docs", F.struct(low.alias("low"), high.alias("high")).alias("limit"))
    picks = [F.max(F.when(F.col("measure") == name, F.col("limit"))).alias(name) for name in LEAST]
    return limits.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *picks)


def group_limits(limits: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per language and source with the limits that hold there."""
    packed = limits.select("level", "lang", "source", "docs", F.struct(*LEAST).alias("limits"))
    of_all = packed.filter("level = 3").select("limits").scalar()
    languages = packed.filter("level = 1").select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), F.col("limits").alias("l_limits"))
    groups = packed.filter("level = 0")
    joined = groups.join(languages, groups["lang"].eqNullSafe(languages["l"]), "left")
    chosen = F.when(F.col("docs") >= min_docs, F.col("limits")).when(F.col("l_docs") >= min_docs, F.col("l_limits")).otherwise(of_all)
    return joined.select("lang", "source", chosen.alias("limits"))


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> DataFrame:
    """Features, `base_failed` and `kept` of every row.

    Rows without language or source form groups of their own. An empty table gives an empty one. The documents are
    read once: their counts are written, and sketches and verdicts read those. The limits join on salted
    groups, so a source with a third of all rows is spread over tasks.
    """
    counts = written(features(docs, **columns))
    limits = group_limits(fences(sketches(counts)), min_docs)
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    same = (
        rows["lang"].eqNullSafe(salted["lang"])
        & rows["source"].eqNullSafe(salted["source"])
        & (rows["salt"] == salted["salt"])
    )
    joined = rows.join(salted, same, "left").select(*[rows[c] for c in counts.columns], "limits")
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value >= F.col(f"limits.{name}.low")) & (value <= F.col(f"limits.{name}.high"))
    failed = base_failed()
    return joined.select(
        *counts.columns, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept")
    )
