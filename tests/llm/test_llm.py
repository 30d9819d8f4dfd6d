"""Each operator against brute force on small fixtures, and its defined results for odd rows."""

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudloom.llm import chat, decontamination, jaccard, language, licenses, lm, packing, quality, queries, tokencount, topk

WORDS = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "Ünder", "a", "stone", "bridge", "at", "noon", "élan", "while", "rain", "falls"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Plain texts, near and exact copies, a null, empty, blank, one-word and very long texts."""
    rng = random.Random(4)
    base = [prose(rng, n) for n in (5, 12, 40, 40, 60, 200)]
    near = []
    for t in base[2:]:
        for _ in range(4):
            w = t.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            near.append(" ".join(w))
    return [*base, *near, base[3], base[3].upper(), None, "", " \n\t ", "word", "word", prose(rng, 30_000), "<|im_end|> odd \x1c text here", "12 34 !!"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else None, "src", 7, "x") for k, t in enumerate(texts)] + [(None, texts[2], "en", "src", 1, "y"), (3, texts[3], "en", "src", 1, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, node bigint, kind string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("1 = 0")


def test_op1_round_trip_and_layouts(spark):
    probe = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| <"
    records = [
        {"turns": [{"role": "user", "text": probe}, {"role": "assistant", "text": probe}]},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}, {"role": "assistant", "content": "é\n"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "id": 3},
        {"instruction": "do", "input": "this", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "response": "r", "system": "s"},
        {"question": "q", "context": "k", "answer": "a"},
        {"unknown": 1},
    ]
    want = [
        [("user", probe), ("assistant", probe)], [("system", "s"), ("user", ""), ("assistant", "é\n")], [("user", "h"), ("assistant", "g")],
        [("user", "do\n\nthis"), ("assistant", "done")], [("user", "p"), ("assistant", "c")], [("system", "s"), ("user", "p"), ("assistant", "r")], [("user", "k\n\nq"), ("assistant", "a")], [],
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(98, None), (99, "{broken")], "id bigint, record string")
    got = {r.id: r for r in chat.format_records(df, "id", "record").collect()}
    for k, turns in enumerate(want):
        assert chat.parse(got[k].formatted) == turns
        loss = "".join(chat.unescape(got[k].formatted[s["start"] : s["end"]]) for s in got[k].loss_spans)
        assert loss == "".join(t for r, t in turns if r == "assistant")
    assert got[7].layout is None and got[98].layout is None and got[99].formatted == ""
    assert len({got[k].fingerprint for k in range(8)}) == 8
    assert chat.field_paths({"a": [{"b": 1}, {"c": []}], "d": {}}) == {"a[].b", "a[].c[]", "d"}


def test_op1_odd_roles():
    turns = [("a\\nb\nc<|", "t"), ("", "")]
    assert chat.parse(chat.render(turns)[0]) == turns


def test_op1_query_counts_all_conversations(spark, duck):
    from tests.conftest import SMALL

    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, SMALL).collect()}
    rows = duck.sql("select conv_id, role, coalesce(text, '') t from conversations order by conv_id, turn").fetchall()
    for conv, own in itertools.groupby(rows, lambda r: r[0]):
        own = [(r, t) for _, r, t in own]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_chars == sum(len(t) for r, t in own if r == "assistant")
    assert got[-1].n_turns == 2 and len(got) == len({r[0] for r in rows}) + 1


def test_op2_accuracy_and_odd_texts(spark, docs, nothing):
    from tests.conftest import SMALL

    rows = queries.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    model = language.fit(docs.selectExpr("cast(doc_id as string) key", "text", "lang"))
    got = [r for r in language.predict(docs, model).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    ids = {t: k for k, t in enumerate(r.text for r in docs.orderBy("doc_id").where("doc_id is not null").collect())}
    assert by[[r.doc_id for r in docs.where("text is null").collect()][0]].lang_pred == "und" and ids
    assert {r.lang_pred for r in got if r.doc_id in [x.doc_id for x in docs.where("text = '12 34 !!'").collect()]} == {"und"}
    empty = language.fit(nothing.selectExpr("cast(doc_id as string) key", "text", "lang"))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"} and language.predict(nothing, empty).count() == 0


def brute_tokens(word, pieces, unknown):
    full = tokencount.MARK + word
    best = [(0.0, 0)] + [None] * len(full)
    for e in range(1, len(full) + 1):
        c = [(best[e - 1][0] + unknown, best[e - 1][1] + len(full[e - 1].encode()))]
        c += [(best[s][0] + pieces[full[s:e]], best[s][1] + 1) for s in range(e) if full[s:e] in pieces]
        best[e] = max(c, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_op3_equals_a_plain_search(docs, nothing):
    pieces = tokencount.unigram_pieces(queries.tokenizer("piece_bpe_32k.model"))
    counter = tokencount.TrieCounter(pieces, limit=50)
    words = WORDS + ["Anblewh", "erth", "日本語", "xqzj", "thethe"]
    assert counter.count([[w] for w in words]) == [brute_tokens(w, pieces, counter.unknown) for w in words]
    words += ["thethe" * 9, "x" * 70, "日本" * 5, "ab", "abc", "abcd", "a😀b"]
    assert counter.count([words]) == [sum(brute_tokens(w, pieces, counter.unknown) for w in words)]
    got = Counter((r.doc_id, r.n_chars, r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs, queries.tokenizer("piece_bpe_32k.model")).collect())
    known: dict = {}
    for d in docs.collect():
        t = d.text or ""
        for w in set(t.split()) - known.keys():
            known[w] = brute_tokens(w, pieces, counter.unknown)
        got[d.doc_id, len(t), len(t.split()), sum(known[w] for w in t.split())] -= 1
    assert not any(got.values())
    assert tokencount.count_tokens(nothing, queries.tokenizer("piece_bpe_32k.model")).count() == 0


def test_op4_pieces_and_places(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64, keep_ids=True).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    want = Counter()
    for d in docs.collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 64)):
            want[(d.doc_id, p, s, tuple(ids[s : s + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert packing.pack(nothing, path, 64).count() == 0


def test_op4_bins_are_near_the_bound():
    rng = random.Random(1)
    for capacity, top in ((100, 100), (64, 20), (4096, 4000), (10, 7), (100, 60)):
        h = Counter(rng.randint(1, top) for _ in range(400))
        bins = packing.complete_bins(dict(h), capacity)
        used = Counter()
        for pattern, times in bins:
            assert sum(x * n for x, n in pattern.items()) <= capacity
            for x, n in pattern.items():
                used[x] += n * times
        assert used == h
        plain = sum(t for _, t in packing.best_fit(h, capacity))
        assert sum(t for _, t in bins) <= min(plain, 1.01 * packing.lower_bound(h, capacity) + 1)
    h = Counter(rng.randint(1100, 1600) for _ in range(3000))  # three fit a bin at most
    assert sum(t for _, t in packing.complete_bins(h, 4096)) == 1000


def test_op4_fillings_are_the_undominated_ones():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(60):
        own = Counter(rng.randint(3, 30) for _ in range(9))
        room = rng.randint(10, 50)
        counts = np.zeros(61, np.int64)
        counts[list(own)] = list(own.values())
        got = [tuple(sorted(f)) for f in packing.fillings(counts, room, packing._Budget(10**6))]
        every = {tuple(sorted(c)) for n in range(10) for c in combinations(own.elements(), n) if sum(c) <= room}
        assert len(got) == len(set(got)) and set(got) <= every
        best = max(map(sum, every))
        if room < 3 * max((x for x in own if x <= room), default=0):
            assert max(map(sum, got)) == best  # a filling of the least waste is always among them
        assert own[room] == 0 or got == [(room,)]


def test_op4_chunks_are_encoded_as_in_whole_texts():
    import pyarrow as pa

    enc = packing.ChunkEncoder(queries.tokenizer("word_bpe_49k.json"))
    odd = ["It's a dog's. (word) \"x\" a.b.c don't,we'll,'re.'s", "İ, İstanbul. x", "<|endoftext|> a", "Å. é. é, ́,á", "", "  ", "\x1c a\x1db", "１２ x１. ab12,c3", "ΣΑΣ. Ǆ, ﬁ. ß.", "日本語。テスト, x", "a'.s 'tis ,'s x.'s", "Å, Ⅷ. ª.", "x" * 5000 + ","]
    ids, bounds = enc.encode(pa.array([t.encode() for t in odd], pa.binary()))
    for k, t in enumerate(odd):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    assert packing.complete_bins({}, 10) == [] and sum(t for _, t in packing.complete_bins({6: 3, 4: 3}, 10)) == 3


def test_op5_equals_brute_force(spark, docs, texts, nothing):
    items = [(1, texts[4]), (2, "Quick, brown"), (3, None), (4, "..."), (None, "fox jumps over"), (12, " ".join(texts[5].split()[20:33])), (12, "zzz zzz")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = [(str(i), w) for i, t in items if t and i is not None for w in decontamination.windows_of(t.encode(), 10)]
    for limit in (8_000_000, 150):
        got = decontamination.scan(docs, bench, max_benchmark_bytes=limit).collect()
        assert len(got) == docs.count()
        plain = {r.doc_id: r for r in got}
        for k, t in enumerate(texts):
            words = decontamination.words_of((t or "").encode())
            hit, found = set(), set()
            for i, w in windows:
                w = w.split(b" ")
                for s in range(len(words) - len(w) + 1):
                    if words[s : s + len(w)] == w:
                        hit.update(range(s, s + len(w)))
                        found.add(i)
            r = plain[k]
            assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(words), len(hit), sorted(found))
            for s in r.spans:
                assert decontamination.words_of(t[s["start"] : s["end"]].encode())
    none = decontamination.scan(docs, bench.where("1 = 0")).collect()
    assert all(r.n_hit == 0 for r in none) and decontamination.scan(nothing, bench).count() == 0


def test_op6_finds_templates_with_small_changes(spark, docs, nothing):
    mit, plain = licenses.TEMPLATES["MIT"], prose(random.Random(2), 300)
    changed = mit.replace("free of charge", "without charge").replace("publish, ", "")
    rows = [(1, f"{plain} {mit} {plain}"), (2, f"é {plain} {changed}"), (3, plain), (4, "Hi. All rights reserved. Bye. All RIGHTS reserved"), (5, None), (6, " ".join(mit.split()[::-1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.matches for r in licenses.scan(df).collect()}
    assert [(m["template"], m["coverage"]) for m in got[1]] == [("MIT", 1.0)]
    m = got[1][0]
    assert rows[0][1][m["start"] : m["end"]] == mit.rstrip(":")
    assert [m["template"] for m in got[2]] == ["MIT"] and 0.9 < got[2][0]["coverage"] < 1
    assert rows[1][1][got[2][0]["start"] :].startswith("Permission") and got[3] == got[5] == got[6] == []
    assert [m["template"] for m in got[4]] == ["all-rights-reserved"] * 2
    w = licenses.TEMPLATES["MIT"].split()
    put_in = " ".join([*w[:35], *["extra"] * 10, *w[35:]])
    again = " ".join(["the above copyright notice"] * 400)
    more = spark.createDataFrame([(1, f"{plain} {put_in} {plain}"), (2, again), (3, f"{mit} {mit}"), (4, plain + licenses.TEMPLATES["BSD-2-text"])], "doc_id bigint, text string")
    got = {r.doc_id: [(m["template"], m["matched"]) for m in r.matches] for r in licenses.scan(more).collect()}
    n = len(licenses.words_of(mit.encode()))
    assert got[1] == [("MIT", n)] and got[2] == [] and got[3] == [("MIT", n)] * 2
    assert [n for n, _ in got[4]] == ["BSD", "BSD-2-text"]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_op7_counts_and_model(spark, docs, nothing):
    import math

    path = queries.tokenizer("byte_bpe_50k.json")
    train = docs.where("doc_id % 5 <> 0")
    got = lm.score(docs, train, path).collect()
    c = Counter(w for r in train.collect() for w in [*(r.text or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    base = Counter()
    for r in docs.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        base[(r.doc_id, len(words), sum(c[w] > 0 for w in words), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == base
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    few = lm.score(docs, train, path, words=5).collect()  # the others meet their counts in the shuffle
    assert Counter((r.doc_id, r.n_known, round(r.base_score, 4)) for r in few) == Counter((a, k, s) for (a, _, k, s), m in base.items() for _ in range(m))
    assert lm.score(nothing, nothing, path).count() == 0 and all(r.n_known == 0 for r in lm.score(docs.limit(3), nothing, path).collect())


def test_op7_gradient_and_windows():
    from cloudloom.llm import attention

    rng = np.random.default_rng(0)
    lengths = np.array([1, 7, 3, 12])
    flat = rng.integers(0, 9, lengths.sum())
    ids, place = attention.windows(lengths, flat, 9, 3, 4)
    assert len(set(place.tolist())) == len(flat)
    for k, (f, p) in enumerate(zip(flat, place)):
        assert ids[p // 4, 3 + p % 4] == f, k
    m = attention.initial(9, np.ones(5), 3, 4, width=4, hidden=6)
    m = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in m.items()}
    target, weight = rng.integers(0, 5, len(ids) * 4), np.zeros(len(ids) * 4)
    weight[place] = 1
    loss, g = attention.gradients(m, ids, target, weight, 3)
    for name in ("E", "Wq", "Wk", "Wv", "R", "A", "B", "c", "W1", "b1", "W2", "b2"):
        at = tuple(int(rng.integers(0, s)) for s in m[name].shape)
        if name == "E" and at[0] == 9:
            at = (0, at[1])
        if name == "b2":
            at = (0, 0)
        eps = 1e-5
        up, down = {k: v.copy() for k, v in m.items()}, {k: v.copy() for k, v in m.items()}
        up[name][at] += eps
        down[name][at] -= eps
        slope = (attention.gradients(up, ids, target, weight, 3)[0] - attention.gradients(down, ids, target, weight, 3)[0]) / (2 * eps)
        assert slope == pytest.approx(g[name][at], abs=2e-5)
    p = attention.log_probabilities({k: v.astype(np.float32) for k, v in m.items()}, ids, target, 3)
    assert -p[place].mean() == pytest.approx(loss, abs=1e-4)
    changed = flat.copy()
    changed[-1] = (changed[-1] + 1) % 9  # the last input can't change what comes before it
    other = attention.log_probabilities({k: v.astype(np.float32) for k, v in m.items()}, attention.windows(lengths, changed, 9, 3, 4)[0], target, 3)
    assert np.allclose(p[place][:-1], other[place][:-1], atol=1e-6)


def test_op7_copying_looks_back_only():
    seq, doc = np.array([1, 2, 3, 1, 2, 3, 1, 2]), np.array([0] * 6 + [1] * 2)
    weight, hit = lm.copying(seq, doc)
    assert hit.tolist() == [False] * 4 + [True, True, False, False] and weight[6] == 0 and weight[4] == pytest.approx(0.1 / 4)


def test_op8_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 8))
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), 1, "r") for i, v in enumerate(x)] + [(900, None, 1, "r"), (901, [None] * 8, 1, "r"), (902, [float("nan")] * 8, 1, "r"), (903, [1.0, 2.0], 1, "r"), (None, [0.1] * 8, 1, "r")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, block string")
    q = np.floor(256 * x).astype(int)
    for limit in (32_768, 40):
        topk.BLOCK_ROWS, old = limit, topk.BLOCK_ROWS
        try:
            got = topk.top_k(df, df.where("vec_id % 7 = 0 or vec_id > 899")).collect()
        finally:
            topk.BLOCK_ROWS = old
        by: dict = {}
        for r in sorted(got, key=lambda r: r.rank):
            by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for i in range(0, 300, 7):
            s = q @ q[i]
            order = [(int(k), int(s[k])) for k in np.lexsort((np.arange(300), -s)) if k != i][:5]
            assert by[i] == order
        assert set(by) == set(range(0, 300, 7))
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(far, far).collect()
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 1")).count() == 2 and topk.top_k(df.where("1 = 0"), df.where("1 = 0")).count() == 0


def test_op9_accuracy_and_identity(spark, docs, nothing):
    from tests.conftest import SMALL

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.op9_quality_classifier(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85 and all(r.predicted == (r.score >= 0.7) for r in rows)
    rng = np.random.default_rng(1)
    m = {"w0": 0.3, "w": rng.normal(size=20), "v": rng.normal(size=(20, 3))}
    ids, x = np.array([2, 5, 9]), np.array([0.5, 1.0, 2.0])
    pairs = sum(m["v"][a] @ m["v"][b] * p * q for (a, p), (b, q) in itertools.combinations(zip(ids, x), 2))
    assert quality.logits(m, ids, x, np.array([0]))[0] == pytest.approx(0.3 + m["w"][ids] @ x + pairs)
    model = quality.fit(nothing.selectExpr("cast(doc_id as string) key", "text", "1 quality"))
    assert quality.score(docs, model).count() == docs.count() and quality.score(nothing, model).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_op10_equals_brute_force(spark, docs, nothing):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = [f"p{k}" for k in range(60)]
    for k in range(150):  # one passage in many texts: most share it, some are little else
        rows.append((1000 + k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 14, 20, 200)))])))
    group = [f"g{k}" for k in range(100)]
    for k in range(120):  # a large group around the limit of the similarity
        w = list(group)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, node int, list int")
    want = brute_components(rows)
    for long in (jaccard.LONG, 4):
        jaccard.LONG, old = long, jaccard.LONG
        try:
            got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
        finally:
            jaccard.LONG = old
        assert got == want
    assert jaccard.jaccard_components(nothing).count() == 0


def test_op10_divide_skip():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    index = jaccard.BlockIndex(sets)
    for q in sets[:20]:
        want = {(k, len(np.intersect1d(q, s))) for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))}
        assert set(jaccard.divide_skip(q, index, 75)) == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert 0 < out.count() <= before.count() and out.join(before, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            kept = {r.doc_id for r in out.collect()}
            assert kept == {c for i, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()]) if i == c}
        before = out
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.best_fit_packing(spark, docs.where("1 = 0"), SMALL).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), SMALL).count() == 0
