"""Near duplicates by sketches, ranked search and the Merkle manifest against plain Python, odd rows included."""

import hashlib
import math
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudloom.llm import jaccard, merkle, minhash, queries, ranking
from cloudloom.llm.jaccard import Shingler
from tests.conftest import SMALL

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank int, tree string, row bigint"


def odd_docs(spark):
    """Nulls in each column, repeated rows and ids, empty and long texts, and columns named like those of the operators."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(40_000))
    near = [f"alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi {w} tau" for w in ("omicron", "pi", "rho")]
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "b", None), (3, near[0], "fr", None, 10), (4, near[1], "fr", "a", 10), (5, near[1].upper(), None, "a", 10), (5, near[2], "fr", "a", 11), (5, near[2], "fr", "a", 11)]
    rows += [(None, near[0], "en", "a", 3), (None, None, None, None, None), (7, "", "en", "a", 0), (8, None, "en", "a", 0), (9, " \t ", "en", "a", 3), (10, "one", "de", "a", 3), (11, "ONE", "de", "a", 3), (12, "Ünter ünter", "=", "-", 4), (-7, "one two", "", "", -1)]
    return spark.createDataFrame([(*r, 0.5, 1, "=en", 0) for r in rows], ODD)


# ---------------------------------------------------------------- near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}


def components(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == group[k] and rows[i][0] is not None]
        c = (min(ids) if ids else None) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return sorted(out, key=repr)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark):
    """A chain of texts, a group of many near copies and texts that share one passage: no link is lost, none invented."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, base = [], word(120)
    for k in range(150):  # each differs from the first in one to three words, and so in pairs below and above the limit
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 4)):
            own[at] = f"x{k}-{at}"
        rows.append(" ".join(own))
    chain = word(100)
    for k in range(30):
        chain = chain[3:] + word(3)
        rows.append(" ".join(chain))
    passage = word(60)
    rows += [" ".join(passage + word(40)) for _ in range(60)]
    ids = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(ids, "doc_id bigint, text string")).collect()), key=repr)
    assert got == components(ids)


@pytest.mark.parametrize("t", [8, 64, 640])
def test_every_bin_is_filled(t):
    rng = np.random.default_rng(t)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 3, 50, 5000)]
    found = minhash.sketches(sets, t)
    assert (found != minhash._EMPTY).all() and (found >> np.uint64(32) < 2 * t).all()
    assert (found == np.concatenate([minhash.sketches([s], t, at_once=10) for s in sets])).all()
    assert (found[0] & np.uint64(0xFFFFFFFF) != 0).all()


def test_bins_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a, b = [], []
    for _ in range(100):
        x = rng.integers(0, 2**63, 110).astype(np.uint64)
        a.append(np.sort(x[:100]))
        b.append(np.sort(x[10:]))
    same = (minhash.sketches(a, 640) == minhash.sketches(b, 640)).mean(axis=1)
    assert abs(same.mean() - 90 / 110) < 0.01 and same.std() < (90 / 110 * 20 / 110 / 640) ** 0.5
    assert len(Shingler(2)(b"A b a b c")) == 3


# ---------------------------------------------------------------- ranked search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_ranked_search_of_odd_rows(spark, limit):
    docs = odd_docs(spark)
    items = [("a", "alpha BETA, gamma one"), ("a", "tau"), ("b", "Ünter word1x1 word1x1 alpha beta gamma"), ("c", None), (None, "one"), ("d", "?!"), ("e", "absent"), ("f", "one two pi alpha beta gamma")]
    bench = spark.createDataFrame([(*x, 3) for x in items], "item_id string, text string, doc_id bigint")
    got = sorted((tuple(r) for r in ranking.search(docs, bench, 4, limit).collect()), key=repr)
    assert got == ranked([(r["doc_id"], r["text"]) for r in docs.collect()], items, 4)
    assert ranking.search(docs.limit(0), bench).count() == 0 and ranking.search(docs, bench.limit(0)).count() == 0


def test_ranked_search_picks_the_best_out_of_many_hits(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 30).clip(0, 40))) for i in range(600)]
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 40, 6))) for i in range(25)]
    monkeypatch.setattr(ranking, "HITS", 300)
    monkeypatch.setattr(ranking, "CELLS", 3000)
    got = ranking.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(docs, items, 10)


def test_shared_sums_are_the_items_sums():
    rng = np.random.default_rng(3)
    for _ in range(100):
        items = [sorted(set(rng.zipf(1.5, rng.integers(1, 30)).clip(0, 40).tolist())) for _ in range(rng.integers(0, 30))]
        plan, columns = ranking.mine(items, 41), rng.integers(0, 9, (41, 7))
        assert all((got == columns[own].sum(axis=0)).all() for got, own in zip(plan.evaluate(columns), items))
        assert plan.additions() <= sum(max(0, len(own) - 1) for own in items)
    shared = [list(range(20)) + [20 + i] for i in range(10)]
    assert ranking.mine(shared, 30).additions() == 19 + 10


# ---------------------------------------------------------------- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level, proofs):
    """Root of a list of hashes; proofs[i] gets leaf i's (sibling, left) pairs."""
    at = list(range(len(level)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            if i ^ 1 < len(level):
                proofs[leaf].append((level[i ^ 1], i & 1))
            else:
                proofs[leaf].append(None)
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0]


def fold(h, proof):
    for p in proof:
        h = sha(h) if p is None else sha(p[0], h) if p[1] else sha(h, p[0])
    return h


def plain_manifest(rows):
    trees = {}
    for d, s, lang, n, t in rows:
        leaf = sha(*map(field, (d, s, lang, n, t)))
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        trees.setdefault(lang, []).append((d, leaf, sha(*map(field, (d, s, lang, n + 1, t))) if hit else leaf))
    roots, found = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(trees[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        proofs = [[] for _ in own]
        roots.append(climb([x[1] for x in own], proofs))
        found.append((own, proofs))
    upper = [[] for _ in roots]
    root = climb(roots, upper)
    out = []
    for (own, proofs), sub, up in zip(found, roots, upper):
        for (d, leaf, bad), p in zip(own, proofs):
            got = fold(bad, p + up)
            out.append((d, leaf, sub, root, sha(*(x[0] for x in p + up if x)), got, got == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stride, climbers", [(12, 65_536), (2, 3)])
def test_manifest_of_odd_rows(spark, monkeypatch, stride, climbers):
    """Also in narrow blocks, so that trees take several stages and nodes are stored in copies."""
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "WIDTH", 1 << stride)
    monkeypatch.setattr(merkle, "CLIMBERS", climbers)
    docs = odd_docs(spark).unionByName(spark.range(100, 190).selectExpr("id doc_id", "'t' text", "if(id % 3 = 0, 'en', concat('l', id % 7)) lang", "'s' source", "id n_chars", "0d score", "1 rank", "'x' tree", "2L row"))
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert got == plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_of_no_rows(spark):
    docs = odd_docs(spark)
    one = docs.where("doc_id = 10")
    assert [tuple(r) for r in merkle.manifest(one).collect()] == plain_manifest([tuple(r) for r in one.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert merkle.manifest(docs.limit(0)).collect() == []
    assert merkle.manifest(docs.limit(0)).columns == merkle.manifest(one).columns


def test_settings_are_as_before(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    queries.op13_merkle_manifest(spark, SMALL)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# ---------------------------------------------------------------- samples, workers, rows carried through, licenses


def test_a_rate_far_below_a_millionth_still_draws(spark):
    """As where a table of 1e10 rows gives a sample of 5,000: of 40 million rows about 20 are drawn."""
    from cloudloom.llm.common import drawn

    assert 5 < drawn(spark.range(40_000_000), "id", 5_000 / 10_000_000_000).count() < 45
    assert drawn(spark.range(1_000), "id", 6_000 / 1_000).count() == 1_000


def test_each_model_scores_by_itself_in_reused_workers(spark):
    """Two scorings of one session, planned before either runs, don't meet each other's model."""
    from cloudloom.llm import lm

    docs = spark.createDataFrame([(1, "a b c a b c"), (2, "x y z")], "doc_id bigint, text string")
    other = spark.createDataFrame([(k, "x y z x y z") for k in range(30)], "doc_id bigint, text string")
    path = queries.tokenizer("byte_bpe_50k.json")
    alone = {r.doc_id: r.score for r in lm.score(docs, other, path).collect()}
    between = {r.doc_id: r.score for r in lm.score(docs, docs, path).collect()}
    again = {r.doc_id: r.score for r in lm.score(docs, other, path).collect()}
    assert alone == pytest.approx(again) and abs(alone[2] - between[2]) > 0.1


def test_row_stages_carry_whole_rows_through(spark):
    """Nulls, repeated rows, nested and oddly named columns come back as they were, but for the rows that go."""
    import corpus_pipeline

    text = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion tonight"
    rows = [(1, text, "en", {"k": [1, None]}, 1), (1, text, "en", {"k": [1, None]}, 1), (None, text, None, None, None), (4, None, "en", {}, 2), (5, "", "en", None, 3), (6, text + " indeed", "en", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `a.b c` map<string,array<int>>, doc int")
    first = corpus_pipeline.language_id(spark, docs, SMALL)
    assert first.schema.names == docs.schema.names
    assert sorted(map(repr, first.collect())) == sorted(repr(r) for r in docs.collect() if r.text)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SMALL)
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.collect()))
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.text and not r.text.endswith("indeed"))[:1] == [(False, 1)]


@pytest.mark.parametrize("name", ["MIT-text", "BSD-2-text", "ISC-text", "GPL", "MIT"])
def test_a_template_is_found_whatever_place_words_are_put_in(name):
    from cloudloom.llm import licenses

    scanner = licenses.Scanner({name: licenses.TEMPLATES[name]}, 6, 0.8)
    words = licenses.TEMPLATES[name].split()
    before = [f"lead{i}" for i in range(40)]
    for more in (1, 5, 12, 20, 30, len(words) // 2):
        if more > len(words) // 2:
            continue
        for at in range(1, len(words)):
            text = before + words[:at] + [f"in{i}" for i in range(more)] + words[at:] + before
            got = scanner(" ".join(text).encode())
            assert [m[0] for m in got] == [name] and got[0][2] >= 0.8, (name, more, at)


def test_license_scan_against_alignment_on_every_diagonal(spark):
    """Random texts of pieces of templates: what covers 0.8 of a template in one go is found, and nothing else."""
    import random

    from cloudloom.llm import licenses

    rng, names = random.Random(5), ["MIT", "ISC", "GPL", "BSD-2-text"]
    scanner = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names}, 6, 0.8)

    def subsequence(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left, row = row, [0]
            for j, y in enumerate(b):
                row.append(left[j] + 1 if x == y else max(row[j], left[j + 1]))
        return row[-1]

    for case in range(40):
        name = rng.choice(names)
        words = licenses.words_of(licenses.TEMPLATES[name].encode())
        cut = [w for w in words if rng.random() < rng.choice((1.0, 0.97, 0.55))]
        text = [b"noise%d" % rng.randrange(99) for _ in range(50)] + cut + [b"noise%d" % rng.randrange(99) for _ in range(50)]
        whole = {n: subsequence(t, text) / len(t) for n, t in scanner.words.items()}
        got = {m[0]: m[2] for m in scanner(b" ".join(text))}
        assert set(got) <= {n for n, c in whole.items() if c >= 0.8}, case
        if len(cut) >= 0.93 * len(words):
            assert name in got and got[name] <= whole[name], case


def test_few_groups_shuffle_the_sets_once(spark):
    """Sets go straight to their groups when the groups' rows can be broadcast; a band has one hash beside its key."""
    tokens = np.arange(10, dtype="<u8")
    sets = spark.createDataFrame([(1, tokens.tobytes()), (2, tokens[:9].tobytes()), (3, tokens[5:].tobytes())], "node bigint, tokens binary")
    members = spark.createDataFrame([(1, 0, 2), (1, 0, 3)], "a bigint, part bigint, node bigint")
    ask = spark.createDataFrame([(1, 0, 1)], "a bigint, part bigint, node bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = minhash._search(members, ask, ["a", "part"], sets, 80, among=True)
        assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    kept = []
    bands = spark.createDataFrame([(1, 9, [5, 6]), (2, 9, [5, 6]), (3, 9, [7, 8]), (4, 9, [8, 5])], "node bigint, n bigint, bands array<bigint>")
    lists = minhash._lists(bands, lambda df: kept.append(df) or df)
    assert sorted((r.list, r.node) for r in lists.collect()) == [(5, 1), (5, 2), (5, 4), (6, 1), (6, 2), (8, 3), (8, 4)]
    assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1


def test_op11_no_join_multiplies_a_nodes_lists(spark):
    from cloudloom.llm.minhash import _blocks, _dealt

    lists = spark.createDataFrame([(k, n, 100) for k in range(3) for n in range(40 + k)], "list bigint, node bigint, n bigint")
    spread, salted = _dealt(lists)
    members = salted.withColumn("group", (lists["node"] == 0).cast("bigint"))
    asks, blocks = _blocks(members, spread, 80)
    joins = [line for line in asks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("(node#" in line for line in joins)
    assert {(r.node, r.home) for r in blocks.collect()} == {(n, 2) for n in range(42)}
    assert {(r.node, r.home) for r in asks.collect()} == {(0, 2)}


def test_jaccard_tasks_hand_memory_back(spark, tmp_path, monkeypatch):
    """A Python worker lives on after its task, and what each kind of task of the join leaves in it adds up (pipeline, check_h)."""
    texts = [f"{' '.join(f'w{k}' for k in range(40))} {tail}" for tail in ("a", "b", "c")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "cast(text as binary) text").coalesce(1)
    monkeypatch.setattr(jaccard, "release_memory", lambda: tempfile.mkstemp(dir=tmp_path))
    sets = jaccard._sets(docs, 5).cache()
    nodes = [r.node for r in sets.collect()]
    pairs = spark.createDataFrame([(nodes[0], n) for n in nodes[1:]], "a bigint, b bigint")
    blocks = sets.selectExpr("node", "1L home", "1L band", "1L chunk")
    first = jaccard._first_shingles(docs, spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64))), 5, 75, 2)
    done = len(list(tmp_path.iterdir()))
    for step in (first, jaccard._short_lists(first, 2, 75), jaccard._verify(pairs, sets, 75), jaccard._search_blocks(blocks, blocks, sets, 75)):
        assert step.collect()
        assert done < (done := len(list(tmp_path.iterdir())))
