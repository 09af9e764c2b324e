"""Every operator and pipeline stage on odd tables: nulls, ties, repeated rows, no rows, columns with names of helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provender.llm import embeddings, fingerprints, html, jaccard, lines, mixing, packing, quality, sharding, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own, in any place.
CLASHES = "_in _host _none _lines _keys _key _page _pages _on _kept _n _s _id _text _tie _block _added _of _e _row _start _at _piece _range _rank _d0 _t0 _c _good _wrapper host page rest whole cut before blocks rank id many data kind size cell block_ token f k c n sig zone rep g prefix skip part ids sizes shard_ table salt _a _b distance tokens docs".split()
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ROWS = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "one", "en", "a"), (None, "null id one two three four five six", "en", "b"), (None, None, None, None),
    (4, "tie tie tie tie tie tie\nline", "en", "b"), (5, "tie tie tie tie tie tie\nline", "en", "b"), (6, "é ünï 日本 🙂\nline", None, "c"), (7, LONG, "en", "c"),
    (8, "again and again and again and\nline", "en", "a"), (8, "again and again and again and\nline", "en", "a"), (9, "﻿\x00odd text", "en", None), (-5, "below nothing", "en", "a"),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASHES}) if extra else df


@pytest.fixture(scope="module")
def model():
    return quality.fit(["a b c", "!! ## !!"], np.array([1, 0]), epochs=2)


def run(name, docs, model):
    if name == "quality":
        return quality.classify(docs, model)
    if name == "lines":
        return lines.drop_boilerplate(docs)
    if name == "distinct lines":
        return lines.drop_boilerplate(docs, distinct=True)
    if name == "html":
        return html.main_text(docs.withColumnRenamed("text", "html").withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/"))))
    if name == "mixing":
        return mixing.mix(docs)
    if name == "packing":
        keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "piece", "start", "length", "ids"))
        return packing.pack(packing.pieces(docs, keep=keep))
    if name == "sharding":
        return sharding.shards(docs, ["lang", "source", "n_chars"], 4, ["text", "doc_id"])
    if name == "prints":
        return fingerprints.edited_prints(fingerprints.neighbours(docs, "fingerprint", derive=fingerprints.fingerprints, each=4))
    return {"jaccard": jaccard.jaccard_classes, "substrings": substrings.dedup}[name](docs)


KEEP = ["quality", "lines", "distinct lines", "html", "mixing", "packing", "sharding", "prints"]


@pytest.mark.parametrize("name", [*KEEP, "jaccard", "substrings"])
def test_odd_rows(spark, model, name):
    """One result for each row at least, the other columns as they were, repeated rows alike, and the same however rows are dealt."""
    docs = frame(spark, ROWS).repartition(3)
    out = run(name, docs, model)
    got = out.collect()
    if name in KEEP:
        assert set(docs.columns) - {"text"} <= {*out.columns, "ids", "length"}
        assert all(r[c] == 1 for r in got for c in CLASHES if c in out.columns and (name, c) not in (("packing", "ids"), ("prints", "_text")))
    assert sorted({r["doc_id"] for r in got}, key=str) == sorted({r[0] for r in ROWS}, key=str)
    if name not in ("mixing", "packing"):
        assert len(got) == len(ROWS)
    alone = {"jaccard": ["n_shingles", "component_id"], "substrings": ["n_words", "n_removed", "kept"], "quality": ["score"], "lines": ["text", "n_dropped"], "distinct lines": ["text", "n_dropped"], "html": ["text"], "prints": ["fingerprint"], "sharding": ["curve"]}.get(name, ["n_tokens"] if name == "mixing" else ["length"])
    twice = {tuple(r[c] for c in alone) for r in got if r["doc_id"] == 8}
    assert len(twice) == 1
    again = run(name, frame(spark, ROWS[::-1], extra=False).repartition(2), model).collect()
    key = lambda rows: sorted(repr((r["doc_id"], *(r[c] for c in alone))) for r in rows)
    assert key(got) == key(again)


@pytest.mark.parametrize("name", [*KEEP, "jaccard", "substrings"])
def test_no_rows(spark, model, name):
    assert run(name, frame(spark, []), model).count() == 0
    nothing = frame(spark, [(None, None, None, None)] * 3)
    got = run(name, nothing, model).collect()
    assert len(got) == 3 and all(r["doc_id"] is None for r in got)


def test_vectors(spark):
    vector = [1.0, 2.0, 3.0]
    rows = [(1, vector), (1, vector), (2, [x * 2 for x in vector]), (None, vector), (3, None), (4, [0.0] * 3), (5, [float("inf"), 0.0, 0.0]), (6, [1e300, 2e300, 3e300]), (7, [1.0, 2.0]), (8, [1.0, -2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHES})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (6, 3, 1, False), (0, 0, None, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 0, 7, True), (8, 0, 8, True)], key=repr)
    assert embeddings.near_vectors(df.where("vec_id > 100")).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, stage):
    """A stage takes odd tables, with columns beyond those of documents, and gives the columns of documents, or of pieces."""
    name, f = stage
    sf_dir = "/root/testdata/sf0.001"
    got = f(spark, frame(spark, ROWS), sf_dir)
    if name != "packing":
        assert got.columns == corpus_pipeline.COLUMNS
    ids = {r["doc_id"] for r in got.collect()}
    assert ids <= {r[0] for r in ROWS}
    if name != "quality":  # these keep a row of every document, but for copies
        assert {0, 1, 3, 4, 6, 7, 8, None, -5} <= ids
    assert f(spark, frame(spark, []), sf_dir).count() == 0
    nulls = f(spark, frame(spark, [(None, None, None, None)] * 2), sf_dir).collect()
    assert all(r["doc_id"] is None for r in nulls) and (name == "quality" or len(nulls) == 2)


def test_repeated_documents_in_the_pipeline(spark):
    """Copies go, whichever rows they are, and one of each stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text, "en", "a") for i in (5, 3, 9)] + [(10, text + " more", "en", "b"), (11, "something else that stands alone here", "en", "b")]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 11]


EDGES = [(1 << 53) + 1, (1 << 60) + 1, (1 << 60) + 3, (1 << 63) - 1, None]


@pytest.mark.parametrize("name", [*KEEP, "jaccard", "substrings"])
def test_large_ids(spark, model, name):
    """Ids over 2**53 stay exact beside a null one, all in one batch."""
    docs = frame(spark, [(i, f"text number {k} " + "some words that follow here " * 3, "en", "a") for k, i in enumerate(EDGES)]).coalesce(1)
    got = run(name, docs, model).collect()
    assert {r["doc_id"] for r in got} == set(EDGES)
    if name == "jaccard":
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in EDGES}


def test_large_ids_of_vectors(spark):
    vectors = [(i, [float(x == k) for x in range(8)]) for k, i in enumerate(EDGES)]
    got = embeddings.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)).collect()
    assert {(r["vec_id"], r["component_id"]) for r in got} == {(i, i) for i in EDGES}


def test_order_of_windows_by_id(spark):
    """A window belongs to the smallest id; the largest id comes before none."""
    run13 = " ".join(f"w{i}" for i in range(13))
    rows = [(None, run13 + " a", "en", "a"), ((1 << 63) - 1, "b " + run13, "en", "a"), (None, "c " + run13, "en", "b")]
    got = {(r["doc_id"], r["kept"]) for r in substrings.dedup(frame(spark, rows)).collect()}
    assert got == {((1 << 63) - 1, "b " + run13), (None, "a"), (None, "c")}
    got = substrings.dedup(frame(spark, [r for r in rows if r[0] is None])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0]
