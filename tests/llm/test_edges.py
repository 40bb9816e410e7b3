"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from cairn.llm import decontaminate, mixing, ogg, passages, pii, quotes, secrets, simhash, toxicity, warc

EXTRA = "fp long, key long, size long, seed long, target double, words string, hash string, digits boolean, base string, given string, at int, pii string, root long, score double, h long, taken int, doc string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "wort und satz " * 15_000
TEXTS = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (None, "one two three four five six"), (None, None),
    (5, LONG), (6, "é ü 😀 İ x"), (7, "a" * 200_000), (8, "1" * 100_000), (9, "password=" * 3000), (10, "A.B@c." * 2000), (5, "other text with the same id"),
]
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def frame(spark, rows):
    pad = (None,) * len(EXTRA.split(","))
    full = [(i, t, None if n % 3 else "en", None if n % 2 else f"s{n % 4}", None, *pad) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (1, "one two three four five six"), (4, "a b")], "item_id long, text string")


def test_passages(docs, none):
    got = {(r.doc_id, r.other_id) for r in passages.shared_passages(docs).collect()}
    assert got <= {(None, 1), (1, None)}
    assert passages.shared_passages(none).count() == 0


def test_pii(docs, none):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(TEXTS) and rows[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(not r.pii for r in rows if r.doc_id not in (10,))
    assert pii.redact(pii.find_pii(docs)).count() == len(TEXTS)
    assert pii.find_pii(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - t) <= 0.5 for n, t in by.values())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0
    kept = mixing.mixed_documents(docs).collect()
    assert sum(r.taken for r in kept) == sum(r.taken for r in rows)
    assert all(len((r.text or "").split()) == min(r.taken, len((r.text or "").split())) for r in kept)


def test_decontamination(docs, none, benchmark):
    assert sorted((r.doc_id is None, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()) == [(False, 1), (True, 1)]
    assert decontaminate.decontaminate(docs, benchmark).count() == len(TEXTS) - 3
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(TEXTS)


def test_ogg(docs, none):
    rows = ogg.media_roundtrip(docs).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r.n_bytes == 0]
    assert len(empty) == 3 and {r.payload_bytes for r in empty} == {64} and len({r.media_sha256 for r in empty}) == 1
    assert ogg.media_roundtrip(none).count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\r\nx: y", "same"), (3, None, "same"), (3, "u", "same"), (2, "http://é", None), (None, "n", ""), (4, "b", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash", None) for r in rows], "page_id long, url string, html string, digest string, top long").repartition(2)
    path = warc.new_path(spark, "edge")
    warc.write_warc(pages, path)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()), key=repr)
    assert got == sorted([(1, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (2, 0, "response", None), (0, 0, "revisit", 2), (4, 300_000, "response", None)], key=repr)
    path = warc.new_path(spark, "edge")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_secrets(docs, none):
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == len(TEXTS)
    spans = {r.doc_id: [tuple(s) for s in r.base] for r in rows}
    assert spans[8] == [(0, 2, 100_000)] and spans[9] == [(0, 0, 27_000)] and spans[2] == spans[3] == []
    assert secrets.find_secrets(none).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "bot", "> hello there\nyes"), (1, 1, "bot", "> hello there\nyes"), (1, None, None, None), (None, 1, "user", "> yes"), (2, 0, "user", ">\n>>> "), (2, 1, "user", "> " * 500)]
    talk = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn int, role string, text string, own string, position int")
    got = quotes.link_quotes(talk).collect()
    assert len(got) == len(rows)
    assert [(r.reply_conv, r.reply_turn, r.depth, r.text) for r in got if r.conv_id == 1 and r.turn == 1] == [(1, 0, 1, "yes")] * 2
    assert sorted(r.position for r in got if r.conv_id == 1) == [1, 2, 3, 4]
    assert quotes.link_quotes(talk.limit(0)).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    zero = [r for r in rows if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and None not in ids and ids.count(5) == 2 and ids.count(2) + ids.count(3) + ids.count(4) == 1
    assert simhash.near_groups(none).count() == 0 and simhash.one_of_each(none).count() == 0


NAMES = "id,hash,given,stays,_id,_h,_hash,_nth,_bad_id,_bad_hash,bad_id,bad_hash,of_id,of_hash,of_source,rounds,part,n,nth,count,best,words,seed,start,hits,item,item_id,c0,k,m,a,b,text_hash,_key,_all,_end,_n,_part,_local,_cands,cands,digits,toxic,label".split(",")


@pytest.fixture(scope="module")
def clashing(spark):
    """The documents with a column of every name that the operators use inside, each with a value to keep."""
    rows = [(i, t, "en", None if n % 3 else "s", None, *[f"{c}{n}" for c in NAMES]) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)).repartition(3)


def kept_whole(df, names):
    """Every row's columns still belong together."""
    rows = df.collect()
    assert df.columns[: 5 + len(NAMES)] == names
    for r in rows:
        assert len({r[c][len(c) :] for c in NAMES}) == 1
    return rows


def test_clashing_names(clashing, labels, benchmark):
    names = clashing.columns
    assert len(kept_whole(toxicity.drop_toxic(clashing, labels.limit(0)), names)) == len(TEXTS)
    assert 0 < len(kept_whole(simhash.one_of_each(clashing), names)) < len(TEXTS)
    assert len(kept_whole(decontaminate.decontaminate(clashing, benchmark), names)) == len(TEXTS) - 3
    assert len(kept_whole(pii.redact(pii.find_pii(clashing)), names)) == len(TEXTS)
    assert len(kept_whole(mixing.mixed_documents(clashing), names)) > 0
    assert passages.shared_passages(clashing).count() == 0
    for rows in (ogg.media_roundtrip(clashing), secrets.find_secrets(clashing), simhash.near_groups(clashing), mixing.mix(clashing)):
        assert rows.count() > 0


def test_pipeline_stages(spark, clashing, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 0), (None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None), (3, "")], "item_id long, text string")
    for name, rows in (("full", True), ("bare", False)):
        folder = tmp_path / name
        for t, df in (("labels", labels), ("benchmark", bench)):
            (df if rows else df.limit(0)).write.parquet(f"{folder}/{t}.parquet")
        for docs in (clashing, none, none.union(none)):
            step = docs
            for stage, run in corpus_pipeline.STAGES[:-1]:
                step = corpus_pipeline.materialize(run(spark, step, str(folder)), stage)
                assert step.columns == docs.columns
            final = corpus_pipeline.STAGES[-1][1](spark, step, str(folder))
            assert final.count() == 0 if docs is not clashing else final.count() > 0
