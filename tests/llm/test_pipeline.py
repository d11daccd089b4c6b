"""The stages of the pipeline, each on odd rows and empty tables, and all of them together against brute force."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("skyfare.llm")

import corpus_pipeline
from skyfare.llm.units import tokenizer, tokenizer_path
from skyfare.sources.scratch import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, cuts string, component_id int"
ITEM = "one passage of exactly twelve words that a test set holds alone"


def plain(k):
    return f"The {k}th text tells of town {k * 7} and river {k * 11}, where {k * 13} people live. " * 4


GOOD = [(k, plain(k)) for k in range(60)]
BAD = [(1000 + k, f"BUY {k}!! NOW!! $$$ {k * 3} " * 30) for k in range(60)]
ODD = [
    (2000, plain(3)),  # a copy
    (2001, plain(5) + "end"),  # a near copy
    (2002, plain(91) + ITEM + " and on."),
    (2003, plain(92) + "Write to a.b@mail.example.org at once."),
    (2004, plain(93) * 200),
    (2005, None),
    (2006, ""),
    (2007, plain(94)),
    (2007, plain(94)),  # a repeated row
    (None, plain(95)),
]


def documents(spark, rows):
    full = [(k, t, None if k == 2007 else "en", "web", None if k == 2005 else len(t or ""), "k", "c", 9) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "pipeline-test")
    labels = [(k, 1) for k, _ in GOOD] + [(k, 0) for k, _ in BAD] + [(None, 1), (0, None)]
    documents(spark, [*GOOD, *BAD, *ODD]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet"
    )
    return path


def test_all_stages_together(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    wanted = dict(GOOD) | {k: t for k, t in ODD if k not in (2000, 2001, 2005, 2006)}
    wanted[2002] = wanted[2002].replace(ITEM, "")
    wanted[2003] = wanted[2003].replace("a.b@mail.example.org", "[EMAIL]")
    model = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert {k for k in rows if k not in (2005, 2006)} == set(wanted)
    for k, text in wanted.items():
        ids = model.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(rows[k].ids, "<u4").tolist(), rows[k].n_tokens) == (ids, len(ids))
    assert rows[2007].lang is None and rows[0].source == "web"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_empty_tables(spark, folder, name, stage):
    docs = documents(spark, ODD)
    rows = stage(spark, docs, folder).collect()
    ids = [r.doc_id for r in rows]
    if name == "quality classifier":  # what it thinks of texts without words is the model's own affair
        assert set(ids) >= {2000, 2001, 2002, 2003, 2004, 2007, None} and ids.count(2007) == 2
    elif name == "n-gram Jaccard join":
        assert sorted(ids, key=str) == sorted({k for k, _ in ODD}, key=str)
        assert ids.count(2007) == 1
    else:
        assert sorted(ids, key=str) == sorted((k for k, _ in ODD), key=str)
    if name != "BPE encoding":
        assert tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        assert all(r.text is None for r in rows if r.doc_id == 2005)
    else:
        assert {r.n_tokens for r in rows if r.doc_id in (2005, 2006)} == {0}
    assert stage(spark, documents(spark, []), folder).collect() == []


def test_unlike_texts_under_one_id_and_rows_without_ids(spark, folder):
    """Each of A, B and C stays once, whatever ids their copies have; texts without words all stay."""
    a, b, c, d = (plain(200 + k) for k in range(4))
    rows = [(1, a), (1, b), (2, a + "x"), (3, b + "y"), (4, c), (None, d), (None, d + "z"), (None, c), (5, None), (5, ""), (None, " \n"), (None, " \n"), (4, c)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.unlike(spark, documents(spark, rows), folder).collect()]
    wanted = [(1, a), (1, b), (4, c), (5, None), (5, ""), (None, " \n"), (None, " \n")]
    assert sorted(map(str, [x for x in kept if x not in ((None, d), (None, d + "z"))])) == sorted(map(str, wanted))
    # of the two without an id, which are near copies, one stays
    assert sum(x in ((None, d), (None, d + "z")) for x in kept) == 1
