"""corpus_pipeline: run() and each stage on planted rows, against what brute force expects of them."""

import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tarn.llm import packing, runtime, toxicity
from tarn.llm import textops as tx
from tarn.llm.queries import PACKING_TOKENIZER
from tarn.llm.runtime import read_table

RNG = random.Random(23)
WORDS = ["".join(RNG.choices("bcdfglmnprst", k=3)) + "".join(RNG.choices("aeiou", k=2)) for _ in range(500)]
EMAIL = "jane.doe7@example.com"


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def toxic(n):
    w = prose(n).split()
    for _ in range(8):
        w.insert(RNG.randrange(len(w)), RNG.choice(["vile", "foul", "nasty"]))
    return " ".join(w)


LEAK = prose(40)
BASE = prose(90)
#: Of each kind by id: clean 0-599, toxic 600-799, near copies of each other 800-804, leaks 810-811, personal data 820-821, odd texts 830-832.
TEXTS = {i: prose(80) for i in range(600)} | {i: toxic(80) for i in range(600, 800)}
TEXTS |= {800: BASE, 801: BASE, 802: BASE + " ending", 803: "opening " + BASE, 804: BASE.upper()}
TEXTS |= {810: prose(20) + " " + LEAK + " " + prose(20), 811: LEAK, 820: f"{prose(40)} {EMAIL} 3/4/1885", 821: f"{prose(40)} {EMAIL} 2020-02-29", 830: None, 831: "", 832: " \n\t"}
ITEMS = [(1, LEAK), (2, prose(40)), (3, None), (4, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t), f"x{i}") for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(600 <= i < 800)) for i in range(800)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Each stage's rows on all planted documents, and on none."""
    docs, out = read_table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, folder)
        out[name] = (df.columns, df.collect(), stage(spark, docs.limit(0), folder).count())
    return docs.columns, {r.doc_id: r for r in docs.collect()}, out


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(ids):
    """ids that have a near copy of a smaller id; copies of copies are planted as copies of the first."""
    sets = {i: shingles(TEXTS[i] or "") for i in ids}
    return {i for i in ids for j in ids if j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def leaks(ids):
    """ids whose text holds an item word by word."""
    return {i for i in ids for _, x in ITEMS if x and f" {x} " in f" {TEXTS[i] or ''} "}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "benchmark leaks", "personal data", "packing"]


@pytest.mark.parametrize(("name", "gone"), [("toxicity", lambda ids: {i for i in ids if 600 <= i < 800}), ("near copies", near_copies), ("benchmark leaks", leaks)])
def test_filters(stages, name, gone):
    columns, docs, out = stages
    got_columns, rows, of_none = out[name]
    assert got_columns == columns and of_none == 0
    assert {r.doc_id for r in rows} == set(TEXTS) - gone(list(TEXTS)) and len(rows) == len({r.doc_id for r in rows})
    assert all(r == docs[r.doc_id] for r in rows)


def test_personal_data(stages):
    columns, docs, out = stages
    got_columns, rows, of_none = out["personal data"]
    assert got_columns == columns and of_none == 0 and len(rows) == len(docs)
    mails = set()
    for r in rows:
        old = docs[r.doc_id]
        assert (r.lang, r.source, r.extra) == (old.lang, old.source, old.extra) and r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id in (820, 821):
            head, mail, day = r.text.rsplit(" ", 2)
            assert head == old.text.rsplit(" ", 2)[0] and mail != EMAIL and day != old.text.rsplit(" ", 1)[1]
            assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@example\.com", mail) and re.fullmatch(r"\d\d/\d\d/\d{4}" if r.doc_id == 820 else r"\d{4}-\d\d-\d\d", day)
            assert (r.n_chars == old.n_chars) == (r.doc_id == 821)  # a date written 3/4 gets its zeros
            mails.add(mail)
        else:
            assert r.text == old.text
    assert len(mails) == 1


def packed(rows, texts):
    """The pieces are those of texts, once each, in sequences of at most 4,096 tokens without gaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PACKING_TOKENIZER)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_packing(stages):
    _, docs, out = stages
    _, rows, of_none = out["packing"]
    assert of_none == 0
    packed(rows, {i: r.text for i, r in docs.items()})


def test_run(spark, folder, stages):
    _, docs, out = stages
    ids = {i for i in TEXTS if not 600 <= i < 800}
    ids -= near_copies(ids)
    ids -= leaks(ids)
    replaced = {r.doc_id: r.text for r in out["personal data"][1]}
    packed(corpus_pipeline.run(spark, folder).collect(), {i: replaced[i] for i in ids})


def test_memory_is_given_back(spark):
    """Executors collect when a stage writes a table, but not again and again."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    runtime.give_back(spark, 0)
    before = full()
    runtime.give_back(spark, 0)
    seen = full()
    assert seen > before
    runtime.give_back(spark)
    assert full() == seen


def test_workers_keep_what_is_theirs():
    """A vocabulary outlasts the tasks of its own stage and no others."""
    list(tx.lean(lambda x: x, "words")([]))
    tx.KEPT["words"] = {"path": [1]}
    assert list(tx.lean(lambda x: x, "words")([1])) == [1] and tx.KEPT["words"] == {"path": [1]}
    assert list(tx.lean(lambda x: x)([1])) == [1] and not tx.KEPT
    assert packing.coder_of(PACKING_TOKENIZER) is packing.coder_of(PACKING_TOKENIZER)
    tx.forget(packing.__name__)
    assert list(tx.KEPT) == [packing.__name__]
    tx.forget()
    assert not tx.KEPT


def test_workers_of_one_kind(spark, folder):
    """Toxicity sends its labelled rows without Python workers besides those of the operators, and these don't load pandas."""
    store = spark._jsparkSession.sharedState().statusStore()
    plans = lambda: [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())]
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    n = len(plans())
    toxicity.train(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = plans()[n:]
    assert found and not any("ExistingRDD" in p for p in found)
    code = "import sys, tarn.llm.toxicity, tarn.llm.ngram_join, tarn.llm.packing, tarn.llm.decontaminate; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": os.path.dirname(corpus_pipeline.__file__)}).returncode == 0
