"""Odd rows of the operators, the language model's score and the pipeline's stages, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cloudloom.llm import attention, chat, decontamination, language, lm, queries, quality
from tests.llm.test_llm import prose


def test_op1_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, record string, id string"
    rows = [(1, 0, "user", "hi", "r", "i"), (1, 0, "user", "hi", "r", "i"), (1, None, "assistant", "<|im_end|> ok", "r", "i"), (None, 0, None, None, "r", "i"), (2, 5, "assistant", None, "r", "i"), (3, 0, "user", "x" * 200_000, "r", "i")]
    df = spark.createDataFrame(rows, schema)
    read = lambda d: {r.conv_id: r for r in chat.read_back(chat.format_records(chat.records_of_rows(d), "conv_id", "record")).collect()}
    got = read(df)
    assert set(got) == {1, 2, 3, None} and got[1].n_turns == 3 and got[1].loss_chars == len("<|im_end|> ok") and got[None].n_turns == 1
    assert got[2].loss_chars == 0 and got[3].formatted_chars > 200_000 and read(df.where("1 = 0")) == {}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    own = {"en": "the of and rain stone bridge falls", "de": "der und über große brücke regen fällt", "fr": "le et à été pierre où pluie garçon"}
    rows = [(k * 10 + n, " ".join(rng.choice(own[lang].split()) for _ in range(40)), lang) for n, lang in enumerate(own) for k in range(60)]
    return spark.createDataFrame([(str(k), t, lang) for k, t, lang in rows], "key string, text string, lang string"), rows


def brute_language(model, text):
    """The nearest centroid by explicit sums over n-grams."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    counts = np.zeros(language.DIMENSIONS)
    words = b" ".join(text.encode().translate(language._NORMAL).split())
    raw = b" " + words + b" "
    for n in (1, 2, 3):
        for k in range(len(raw) - n + 1):
            h = 0
            for c in raw[k : k + n]:
                h = (h * 257 + c) & 0xFFFFFFFF
            counts[(h * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    x = np.log1p(counts) * model["idf"]
    x /= np.linalg.norm(x)
    best = max(range(len(model["centroids"])), key=lambda k: float(x @ model["centroids"][k]))
    score, lang = float(x @ model["centroids"][best]), model["owner"][best]
    return model["langs"][lang], score, score < model["limits"][lang]


def test_op2_odd_rows_equal_brute_force(spark, spoken):
    train, rows = spoken
    model = language.fit(train)
    texts = [None, "", " \n", "12 34 !!", rows[0][1], rows[0][1], rows[-1][1] * 800, "ЖЖЖ ЩЩЩ ЫЫЫ", "zq xv jk qqq zzz xxx vvv", "die der und regen"]
    docs = spark.createDataFrame([(None if k == 4 else k % 7, t, "?", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, score string")
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4), r.rejected) for r in language.predict(docs, model).collect())
    want = Counter((None if k == 4 else k % 7, lang, round(score, 4), bool(out)) for k, t in enumerate(texts) for lang, score, out in [brute_language(model, t)])
    assert got == want and sum(n for (_, _, _, out), n in got.items() if out) >= 5
    assert language.predict(docs.where("1 = 0"), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(train.where("lang = 'none'"))).collect()} == {"und"}


def brute_quality(model, text):
    """The machine's logit with every pair of features by itself."""
    ids, x = quality.Featuriser()((text or "").encode())
    z = model["w0"] + sum(model["w"][i] * v for i, v in zip(ids, x))
    for a in range(len(ids)):
        for b in range(a):
            z += float(model["v"][ids[a]] @ model["v"][ids[b]]) * x[a] * x[b]
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows = [(str(k), prose(rng, 30) if k % 2 else "$$$ ### " * rng.randint(5, 20) + prose(rng, 3), k % 2) for k in range(240)]
    return spark.createDataFrame(rows, "key string, text string, quality int"), rows


def test_op9_odd_rows_equal_brute_force(spark, graded):
    train, rows = graded
    model = quality.fit(train)
    texts = [None, "", " ", "one", rows[0][1], rows[1][1], rows[1][1], "\n".join([rows[3][1]] * 300)]
    docs = spark.createDataFrame([(None if k == 5 else k, t, 3) for k, t in enumerate(texts)], "doc_id bigint, text string, predicted int")
    got = sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in quality.score(docs, model).collect())
    want = sorted((str(None if k == 5 else k), round(s, 6), int(s >= 0.7)) for k, t in enumerate(texts) for s in [brute_quality(model, t)])
    assert got == want and quality.score(docs.where("1 = 0"), model).count() == 0
    assert {r.predicted for r in quality.score(docs.where("doc_id in (4, 6)"), model).collect()} == {0, 1}


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def brute_class(m, inputs, t, target, context, stride):
    """log P(target class) after the inputs up to t, one key at a time."""
    w = m["Wq"].shape[1]
    q = m["E"][inputs[t]] @ m["Wq"]
    seen = range(max(0, t // stride * stride - context), t + 1)
    p = softmax(np.array([q @ (m["E"][inputs[j]] @ m["Wk"]) / w**0.5 + m["R"][t - j] for j in seen]))
    a = sum(pj * (m["E"][inputs[j]] @ m["Wv"]) for pj, j in zip(p, seen))
    z = np.tanh(m["E"][inputs[t]] @ m["A"] + a @ m["B"] + m["c"])
    members = m["W2"].shape[2]
    g, r = divmod(int(target), members)
    return math.log(softmax(z @ m["W1"] + m["b1"])[g]) + math.log(softmax(z @ m["W2"][g] + m["b2"][g])[r])


def test_op7_score_equals_brute_force(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    rng = random.Random(9)
    own = [prose(rng, rng.randint(3, 60)) for _ in range(40)] + ["unwonted sesquipedalian words", None]
    train = spark.createDataFrame([(t,) for t in own], "text string").coalesce(1)
    seen = Counter(w for t in own for w in (t or "").encode().lower().split())
    model, *_ = lm.fit(train, path, words=12)
    lex = model["lexicon"]
    texts = [prose(rng, 50), "Stone UNWONTED bridge xyzzyqq stone unwonted bridge stone unwonted", "", "noon noon noon noon", "quick  brown\tfox " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.score for r in sorted(lm.score(docs, train, path, words=12).collect(), key=lambda r: r.doc_id)]
    for t, score in zip(texts, got):
        words = t.encode().lower().split()
        firsts = [lm.spell(path, [w])[0][0] for w in words]
        inputs, ends = [int(lex.first_index[f]) for f in [lex.vocabulary, *firsts]], [*firsts, lex.vocabulary]
        total, hits = 0.0, []
        for k, f in enumerate(ends):
            p = brute_class(model["stream"], inputs, k, lex.first_class[f], lm.CONTEXT, lm.STRIDE) + lex.first_share[f]
            if k < len(words):
                key = lm.hash_words([words[k]])
                at = lex.look_up(key)[0]
                rest = p
                if at >= 0:
                    p += lex.within[at]
                    assert lex.within[at] == pytest.approx(lex.share[f] + math.log(seen[words[k]]))
                else:
                    ids = lm.spell(path, [words[k]])[0]
                    p += math.log(max(lex.escape[f], 1e-12))
                    spelled = [int(lex.later_index[i]) for i in ids]
                    for j, nxt in enumerate([*ids[1:], lex.vocabulary + 1]):
                        p += brute_class(model["spelling"], spelled, j, lex.later_class[nxt], lm.SPELL_CONTEXT, lm.SPELL_STRIDE) + lex.later_share[nxt]
            # the copying head: the word after the latest earlier occurrence of the word before
            sequence = [*words, None]
            guess = next((sequence[j + 1] for j in range(k - 2, -1, -1) if sequence[j] == sequence[k - 1]), False) if k else False
            recent = hits[max(0, k - 16) :]
            weight = (sum(h for h in recent if h is not None) + 0.1) / (sum(h is not None for h in recent) + 4) if guess is not False else 0.0
            hit = guess is not False and guess == sequence[k]
            if not hit and k < len(words) and at < 0 and seen[words[k]]:  # seen, but not in the lexicon: its count joins in
                p = rest + lex.share[f] + math.log(seen[words[k]])
            hits.append(None if guess is False else int(hit))
            total += math.log(weight * hit + (1 - weight) * math.exp(p))
        assert score == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_pipeline_stages_equal_brute_force(spark, spoken, graded, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path)
    texts = [t for _, t, _ in spoken[1]] + [t for _, t, _ in graded[1]] + [None, "", "1234", "ЖЖЖ ЩЩЩ"]
    langs = [lang for _, _, lang in spoken[1]] + ["en"] * len(graded[1]) + [None] * 4
    rows = [(None if k % 41 == 7 else k, t, lang, "src", len(t or "")) for k, (t, lang) in enumerate(zip(texts, langs))]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = len(spoken[1])
    spark.createDataFrame([(n + k, q, 0) for k, (_, _, q) in enumerate(graded[1])], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(graded[1][1][1].split()[3:15])
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), [item]
    count = lambda df: Counter(tuple(r) for r in df.collect())

    model = language.fit(queries.language_training_rows(docs))
    kept = cp.language_id(spark, docs, folder)
    assert kept.columns == docs.columns and count(kept) == Counter(r for r in rows if not brute_language(model, r[1])[2])
    model = quality.fit(queries.quality_training_rows(docs, labels))
    assert count(cp.quality_filter(spark, docs, folder)) == Counter(r for r in rows if brute_quality(model, r[1]) >= 0.7)
    windows = {w for t in bench for w in decontamination.windows_of(t.encode(), 10)}
    dirty = lambda t: any(w in windows for w in decontamination.windows_of((t or "").encode(), 10))
    clean = count(cp.benchmark_decontamination(spark, docs, folder))
    assert clean == Counter(r for r in rows if not dirty(r[1])) and sum(clean.values()) < len(rows)
    packed = cp.best_fit_packing(spark, docs, folder).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)
    whole = cp.run(spark, folder)
    assert 0 < whole.count() < len(rows)
