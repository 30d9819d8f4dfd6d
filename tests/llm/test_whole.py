"""Whole jobs: cases in which an operator once did less than asked."""

import inspect
import zlib

import numpy as np
import pandas as pd

from cloudloom.llm import lm


def lexicon(firsts: int) -> lm.Lexicon:
    """Words 0.. of as many first subwords, the more frequent the smaller."""
    at = np.arange(firsts)
    words = pd.DataFrame({"key": at + 1, "first": at, "n": 1000 - at})
    ends = pd.DataFrame({"first": [firsts], "n": [50], "single": [0]})
    return lm.Lexicon(words, pd.concat([words[["first", "n"]].assign(single=0), ends]), pd.DataFrame({"key": at, "n": 1}), firsts)


def test_op7_frequent_first_subwords_have_classes_of_their_own():
    lex = lexicon(400)
    own = lex.first_class[lex.first_class > 0]
    assert len(own) == len(set(own.tolist())) == 255
    for f in (lm.fit, lm.score):
        assert inspect.signature(f).parameters["words"].default >= 1 << 20


def test_op7_long_words_cost_all_their_subwords():
    from cloudloom.llm import attention, queries

    lex, path = lexicon(400), queries.tokenizer("byte_bpe_50k.json")
    lex.vocabulary = lm._tokenizer(path).get_vocab_size()
    size = lex.vocabulary + 2
    wide = {k: np.zeros(size, np.int64) for k in ("first_index", "first_class", "later_index", "later_class")}
    wide |= {k: np.full(size, -1.0) for k in ("first_share", "later_share", "escape", "share")}
    wide["escape"] = np.full(size, 0.5)
    lex.__dict__.update(wide)
    scorer = lm.Scorer({
        "lexicon": lex, "path": path, "stream": attention.initial(lm.STREAM_INPUTS, np.ones(lm.STREAM_CLASSES), lm.CONTEXT, lm.STRIDE),
        "spelling": attention.initial(lm.SPELL_INPUTS, np.ones(lm.SPELL_CLASSES), lm.SPELL_CONTEXT, lm.SPELL_STRIDE),
    })
    rng = np.random.default_rng(1)
    blob = "".join(chr(97 + k) for k in rng.integers(0, 26, 20_000)).encode()
    import pyarrow as pa

    score = lambda *texts: scorer.score(pa.array(texts, pa.binary()))[0]
    one, half = score(blob, blob[:10_000])
    assert one < 1.8 * half < -10_000
    alone, twice = score(b"x " + blob, b"x " + blob + b" x " + blob)
    assert twice - alone > alone / 2  # the copying head still names the second one


def test_op7_learns_from_every_row(spark, monkeypatch):
    from cloudloom.llm import queries

    path, rounds = queries.tokenizer("byte_bpe_50k.json"), []
    monkeypatch.setattr(lm, "START", 400)
    monkeypatch.setattr(lm, "TASK", 1500)
    plain = lm._train_round

    def spy(docs, *args, **kwargs):
        if args[1] != "stream":
            return plain(docs, *args, **kwargs)
        rows = docs.repartition(args[2], *[c for c in ("deal",) if c in docs.columns]).selectExpr("spark_partition_id() p", "cast(text as string) text").collect()
        rounds.append([(r.p, r.text) for r in rows])
        return plain(docs, *args, **kwargs)

    monkeypatch.setattr(lm, "_train_round", spy)
    texts = ["the same text again"] * 300 + [f"stone bridge at noon {k}" for k in range(700)]
    lm.fit(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string"), path)
    assert sorted(t for _, t in rounds[-1]) == sorted(texts)
    assert len({p for p, t in rounds[-1] if t == texts[0]}) > 1  # copies lie in many tasks
    assert len(rounds[0]) < 300


def test_op7_learning_depends_on_the_text_of_every_row(spark):
    from cloudloom.llm import queries

    path = queries.tokenizer("byte_bpe_50k.json")
    texts = [f"rain falls over the stone bridge number {k}" for k in range(40)]
    fitted = lambda rows: lm.fit(spark.createDataFrame([(t,) for t in rows], "text string"), path)[0]["stream"]["Wq"]
    whole = fitted(texts)
    assert np.array_equal(whole, fitted(texts))
    assert not np.array_equal(whole, fitted([*texts[:-1], " ".join(reversed(texts[-1].split()))]))


def test_op10_near_copies_without_an_id(spark):
    from collections import Counter

    from cloudloom.llm import jaccard
    from tests.llm.test_llm import brute_components

    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (0, 30)]
    ends = [" ".join(base[4:]), " ".join(base), " ".join(base + [f"v{k}" for k in range(14)])]  # the second bridges the others
    lone = [" ".join(f"n{j}" for j in range(40)), " ".join(f"n{j}" for j in range(1, 40))]
    rows = [(7, ends[0] + " a b c d"), (None, ends[1]), (9, ends[2]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, lone[0]), (None, lone[1])]
    rows += [(100 + k, f"single {k} with words of its own {k * k} here") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    plain = {k: i for k, (i, _) in enumerate(rows)}
    far = 1 << 40  # ids for the rows without one, larger than all others, for the comparison by brute force
    want = Counter((plain[k] if i is None else i, n, None if c is not None and c >= far else c) for k, (i, n, c) in enumerate(_in_order(brute_components, rows, far)))
    assert got == want
    by = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).where("doc_id in (7, 9)").collect()}
    apart = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df.where("doc_id is not null")).where("doc_id in (7, 9)").collect()}
    assert by[7] == by[9] and apart[7] != apart[9]


def _in_order(brute, rows, far):
    """(id, n, component) of each row, in their order."""
    own = [(far + k if i is None else i, t) for k, (i, t) in enumerate(rows)]
    found = {i: (n, c) for i, n, c in brute(own)}
    return [(rows[k][0], *found[i]) for k, (i, _) in enumerate(own)]


def test_pipeline_decides_row_by_row(spark, tmp_path):
    import corpus_pipeline
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.language_id(spark, docs, SMALL).orderBy("doc_id").limit(2).collect()
    extra = [r.asDict() | change for r, change in ((good[0], {"doc_id": None}), (good[1], {"text": "12345"}))]
    path = str(tmp_path / "docs")
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(path)
    mixed = spark.read.parquet(path)
    out = corpus_pipeline.language_id(spark, mixed, SMALL)
    assert [r.text for r in out.where("doc_id is null").collect()] == [good[0].text]
    assert [r.text for r in out.where(f"doc_id = {good[1].doc_id}").collect()] == [good[1].text]
    two = str(tmp_path / "two")
    spark.createDataFrame([(None, "one two three four five six"), (None, "one two three four five six"), (5, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g")], "doc_id bigint, text string").write.parquet(two)
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(two), SMALL)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("4", "a b c d e f g"), ("None", "one two three four five six")]


def test_op7_padding_before_a_text_keeps_the_cheap_exponentials(monkeypatch):
    from cloudloom.llm import attention

    lengths, flat = np.array([3, 9]), np.arange(12) % 9
    ids, place = attention.windows(lengths, flat, 9, 3, 4)
    m = attention.initial(9, np.ones(5), 3, 4, width=4, hidden=6)
    target, weight = np.zeros(len(ids) * 4, np.int64), np.zeros(len(ids) * 4)
    target[place], weight[place] = flat % 5, 1
    apart = np.concatenate([attention.log_probabilities(m, ids[:1], target[:4], 3), attention.log_probabilities(m, ids[1:], target[4:], 3)])
    flags, plain = [], attention._exponentials
    monkeypatch.setattr(attention, "_exponentials", lambda logits, bounded: flags.append(bounded) or plain(logits, bounded))
    p = attention.log_probabilities(m, ids, target, 3)
    attention.gradients(m, ids, target, weight, 3)
    assert flags and all(flags)
    monkeypatch.setattr(attention, "_bounded", lambda *a: False)  # with the row's maximum taken off
    assert np.abs(attention.log_probabilities(m, ids, target, 3) - p)[place].max() < 1e-5 and np.abs(apart - p)[place].max() < 1e-5


def _written(spark):
    import os

    from cloudloom.llm.common import shared_folder

    return {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("llm-")}


def test_op10_tables_and_shuffle_files_go_when_read(spark):
    import time

    from cloudloom.llm import common, jaccard

    base = [f"w{k}" for k in range(60)]
    rows = [(n, " ".join(base[:n] + ["other"] + base[n + 1 :])) for n in range(40)] + [(100 + n, f"single {n} with words of its own {n * n}") for n in range(20)]
    df, before = spark.createDataFrame(rows, "doc_id bigint, text string"), _written(spark)
    found = jaccard.jaccard_components(df)
    assert len(_written(spark) - before) <= 2  # the described rows and the last round of components
    assert {r.component_id for r in found.where("doc_id < 100").collect()} == {0} and found.count() == 60  # read twice
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files, setting = disk.getAllFiles().size(), spark.conf.get(common.CLEANUP)
    assert common.materialise(spark.range(1000).repartition(5).groupBy("id").count()).count() == 1000
    for _ in range(50):
        if disk.getAllFiles().size() <= files + 4:  # the count's own
            break
        time.sleep(0.1)
    else:
        raise AssertionError("shuffle files stayed")
    assert spark.conf.get(common.CLEANUP) == setting


def test_op10_packed_entries_come_back():
    from cloudloom.llm import jaccard

    e = np.empty(300, jaccard._ENTRY)
    e["token"], e["node"], e["n"], e["rank"] = np.arange(300) * 7919 << 40, -np.arange(300) ** 5, np.arange(300) * 1000, np.arange(300)
    assert set(jaccard._unpacked([jaccard._packed(e[:1]), jaccard._packed(e[1:200]), jaccard._packed(e[200:])]).tolist()) == set(e.tolist())
    assert len(zlib.compress(jaccard._packed(e))) < len(zlib.compress(e.tobytes()))


def test_pipeline_duplicates_go_without_a_shuffle_of_whole_rows(spark):
    import corpus_pipeline
    from tests.conftest import SMALL

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(k, f"words of row {k // 2} and {k // 2 * k // 2} more of them") for k in range(30)]
        out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert len(_written(spark) - before) <= 2  # the numbered rows and the numbers of those that go
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, t in rows if t not in {u for _, u in rows[:k]})
