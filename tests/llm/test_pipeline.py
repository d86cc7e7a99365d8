"""The corpus pipeline, stage by stage, against brute force; and what is registered."""

import hashlib
import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from privtab.llm import langid, queries
from tests.llm.test_operators import VOCABULARY, brute_classes, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, {doc_id: text}; the last is the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in rows)
            out.append({r.doc_id: r.text for r in rows})
        else:
            out.append({r.doc_id: r for r in rows})
    return out


def test_language_keeps_clean_documents(stages):
    assert stages[1] == {i: t for i, t in stages[0].items() if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_stays(stages):
    classes = brute_classes(list(stages[1].items()))
    assert stages[2] == {i: stages[1][i] for i, (_, c) in classes.items() if c == i}


def test_repeated_passages_go(stages):
    first, want = {}, {}
    split = {i: words_of(t) for i, t in stages[2].items()}
    for i in sorted(split):
        for a in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][a:a + 13]), i)
    for i, w in split.items():
        cover = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a:a + 13])] < i:
                cover[a:a + 13] = [True] * 13
        want[i] = b" ".join(x for x, c in zip(w, cover) if not c).decode() if any(cover) else stages[2][i]
    assert stages[3] == want


def test_contaminated_documents_go(spark, stages):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def windows(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().translate(low))
        return {tuple(w[a:a + 10]) for a in range(len(w) - 9)}

    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert stages[4] == {i: t for i, t in stages[3].items() if not windows(t) & items}


def test_tokens(stages):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCABULARY)
    assert stages[5].keys() == stages[4].keys()
    for i, r in stages[5].items():
        assert r.ids == library.encode(stages[4][i], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.asarray(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(stages[4][i].encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == {
        i: r.ids_sha256 for i, r in stages[5].items()}


def awkward(spark):
    """Null ids, texts and languages, repeated rows, empty texts, clashing extra columns."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()[:60]]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").collect()[0].text
    long = next(r for r in rows if len(r[1] or "") > 400)
    rows += [(None, long[1], None, None, None), (None, long[1], "en", "s", 5), (None, None, "en", "s", None), (9001, None, None, None, None),
             (9002, "", "en", "s", 0), (9003, " \t\n", "en", "s", 3), long, long, (None, f"{long[1]} {item}", "en", "s", 1),
             (9004, f"{long[1][:300]} {item}", "en", "s", 1)]
    named = "doc_id long, text string, lang string, source string, n_chars long, sig string, node int, carry string, doc int"
    return spark.createDataFrame([(*r, "x", 1, "c", 2) for r in rows], named).repartition(4), item


def test_stages_take_awkward_rows(spark):
    docs, item = awkward(spark)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        sizes.append(len(rows))
        if name == "language_id":
            assert all(r.text for r in rows) and {9001, 9002, 9003}.isdisjoint({r.doc_id for r in rows})
            assert sum(r.doc_id is None for r in rows) == 3
        elif name == "near_duplicates":
            ids = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
            assert len(set(ids)) == len(ids) and sum(r.doc_id is None for r in rows) == 3
        elif name == "decontamination":
            assert all(item not in r.text for r in rows)
            assert sum(r.doc_id is None for r in rows) == 2 and 9004 not in {r.doc_id for r in rows}
        elif name == "bpe_tokens":
            assert all(r.n_tokens == len(r.ids) for r in rows)
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:]))


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_language_model_is_small():
    """What goes to the executors does not depend on the number of documents."""
    assert langid.FEATURES * langid.CLUSTERS * 4 < 1 << 16
    assert queries.vocabulary() == VOCABULARY
