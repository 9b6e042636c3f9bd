"""Fill-in-the-middle against a plain version over code points, and on odd rows."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from billweave.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab \n\t\x0b\x85\xa0éß日😀<P>SM"), max_size=60)


def plainly(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_index_converts_every_cut(text):
    raw = text.encode()
    index = infill.Exceptions(np.frombuffer(raw, np.uint8))
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    for chars in range(len(text) + 1):
        cut = len(text[:chars].encode())
        assert index.chars_at(cut) == chars and index.bytes_at(chars) == cut


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tokens_end_where_the_pattern_says(text):
    ends = infill.token_ends(np.frombuffer(text.encode(), np.uint8)).tolist()
    assert ends == [len(text[: m.end()].encode()) for m in TOKEN.finditer(text)]


def test_forms_equal_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forms = set()
    for rate, spm, seed in ((50, 80, 42), (100, 30, 7)):
        made = infill.fill_in_middle(docs, rate, spm, seed).withColumn("back", infill.restored(F.col("fim.form"), F.col("fim.output")))
        for row in made.collect():
            assert tuple(row.fim) == plainly(row.doc_id, row.text, rate, spm, seed)
            assert row.back == (row.text or "")
            forms.add(row.fim.form)
    assert forms == {"plain", "psm", "spm"}


def test_forms_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("output", F.lit("mine")).withColumn("form", F.lit(1)).withColumn("h1", F.lit(2))
    made = infill.fill_in_middle(docs, rate=100).withColumn("back", infill.restored(F.col("fim.form"), F.col("fim.output")))
    rows = made.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row.fim) == plainly(row.doc_id, row.text, rate=100) and row.back == (row.text or "")
        assert (row.output, row.form, row.h1) == ("mine", 1, 2)
    marked = spark.createDataFrame([(k, "a b <S> c <M") for k in range(9)] + [(k, "a <S <P <M b") for k in range(9)], "doc_id long, text string")
    marked = infill.fill_in_middle(marked, rate=100).withColumn("back", infill.restored(F.col("fim.form"), F.col("fim.output")))
    assert all((r.fim.form == "plain") == ("<S>" in r.text) and r.back == r.text for r in marked.collect())
    assert infill.fill_in_middle(no_docs).count() == 0
