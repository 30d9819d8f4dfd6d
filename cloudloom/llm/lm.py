"""Language-model scoring: causal self-attention over subword ids, trained in numpy on the executors.

P(text) is the product, over its words and one end, of

    P(s | the first subwords of the words before)     s: the word's first subword id; the stream model
    x P(word | s)                                     a word of the training rows: its share of the words that begin with s
                                                      another: the mass of words never seen x the spelling model's
                                                      probability of the subwords that follow s, up to the word's end

mixed with a copying head that attends to the word after the latest earlier occurrence of the word before; its weight
at a place is its success at the 16 places before. Both models are causal self-attention models (attention.py); the
stream model reads a document's first subword ids in overlapping windows, the spelling model the ids of one word. All
counts come from all training documents; the two networks are trained on all windows of all of them, by tasks that start
from the same parameters and whose results are averaged.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import as_text, drawn, hash_words, materialise, parts_of_batch, release_memory, split_words, text_bytes

END = b""  # no word is empty, so the end can share the words' table
CONTEXT, STRIDE = 16, 32
SPELL_CONTEXT, SPELL_STRIDE = 8, 8
STREAM_INPUTS, STREAM_CLASSES = 1024, 256
SPELL_INPUTS, SPELL_CLASSES = 2048, 256


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=2)
def _begins(path: str) -> np.ndarray:
    """Which subword ids begin with a space."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
    return out


def spell(path: str, words: list[bytes]) -> list[list[int]]:
    """The subword ids of each word, as it stands after a space. Byte-level: different words have different ids, and only a word's
    first id begins with a space."""
    tok, begins, out = _tokenizer(path), _begins(path), []
    for at in range(0, len(words), 250):
        part = [w.decode() for w in words[at : at + 250]]
        if any(not w.isascii() and (w.split() != [w]) for w in part):  # white space beyond ASCII inside a word
            out += [tok.encode(" " + w, add_special_tokens=False).ids for w in part]
            continue
        ids = tok.encode(" " + " ".join(part), add_special_tokens=False).ids
        cut = [*np.flatnonzero(begins[ids]).tolist(), len(ids)]
        if len(cut) != len(part) + 1:
            raise ValueError("the tokenizer is not byte-level: words can't be told apart")
        out += [ids[cut[k] : cut[k + 1]] for k in range(len(part))]
    return out


def count_words(train: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """Rows (kind, key, first, n, ids). kind 0: hash and first subword id of each distinct word, its count, and the ids of a rare
    word; kind 1: a later subword id (key), and in how many distinct words it stands, in parts.

    Words are counted by parts of a task, then by Spark, and each is spelled once.
    """

    def count(batches):
        for b in batches:
            for part in parts_of_batch(b, 0, 16_000_000):
                places, words, _ = folded_words(part.column(0))
                n = np.append(np.bincount(places, minlength=len(words)), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
        release_memory()

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                words, n = b.column(0).slice(at, 20_000).to_pylist(), b.column(1).slice(at, 20_000)
                spelled = spell(path, [w for w in words if w])
                filled = iter(spelled)
                first = [next(filled)[0] if w else vocabulary for w in words]
                filled = iter(spelled)
                ids = [np.array(next(filled), "<u4").tobytes() if w else None for w in words]
                rare = pc.if_else(pc.less_equal(n, RARE), pa.array(ids, pa.binary()), pa.scalar(None, pa.binary()))
                later = np.bincount(np.array([i for s in spelled for i in s[1:]], np.int64), minlength=1)
                seen = np.flatnonzero(later)
                kind = np.repeat(np.array([0, 1], np.int32), [len(words), len(seen)])
                keys = np.concatenate([hash_words(words).view(np.int64), seen])
                cols = [kind, keys, np.concatenate([np.array(first), np.zeros(len(seen))]).astype(np.int32), np.concatenate([n.to_numpy(), later[seen]]), pa.concat_arrays([rare, pa.nulls(len(seen), pa.binary())])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "key", "first", "n", "ids"])

    counted = train.select(text_bytes()).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(rows, "kind int, key bigint, first int, n bigint, ids binary")


#: Words of at most so many occurrences meet their counts in a shuffle, at every size of the corpus; the spelling model learns from them.
RARE = 1


def folded_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Places, distinct words and bounds of the texts of a binary column, A-Z folded."""
    return split_words(pc.ascii_lower(as_text(texts)))


class Lexicon:
    """What the executors need besides the networks; every part is bounded by the vocabulary or the word limit."""

    def __init__(self, words: pd.DataFrame, firsts: pd.DataFrame, later: pd.DataFrame, vocabulary: int):
        size = vocabulary + 2
        total, single = np.zeros(size), np.zeros(size)
        total[firsts["first"].to_numpy()] = firsts["n"].to_numpy()
        single[firsts["first"].to_numpy()] = firsts["single"].to_numpy()  # words seen once stand for the mass of those never seen
        self.escape = np.where(total > 0, (single + 0.5) / (total + 1), 1.0)
        self.escape[vocabulary] = 0.0  # the end has no other words
        self.share = np.log(np.maximum(1 - self.escape, 1e-12) / np.maximum(total, 1))  # of a word's every occurrence
        order = np.argsort(words["key"].to_numpy(np.int64).view(np.uint64))
        self.keys = words["key"].to_numpy(np.int64).view(np.uint64)[order]
        self.counts = words["n"].to_numpy(np.int64)[order]
        self.first = first = words["first"].to_numpy()[order].astype(np.int32)
        self.within = self.share[first] + np.log(np.maximum(self.counts, 1))
        self.first_index, self.first_class, self.first_share, self.first_counts = self._classes(total + 1e-3, STREAM_INPUTS, STREAM_CLASSES, vocabulary)
        counts = np.zeros(size)
        counts[later["key"].to_numpy()] = later["n"].to_numpy()
        counts[vocabulary + 1] = max(1.0, float(len(words)))  # a word's end
        self.later_index, self.later_class, self.later_share, self.later_counts = self._classes(counts + 1e-3, SPELL_INPUTS, SPELL_CLASSES, vocabulary + 1)
        self.vocabulary = vocabulary

    @staticmethod
    def _classes(counts: np.ndarray, inputs: int, classes: int, always: int):
        """Frequent ids have inputs and classes of their own, the others share input 0 and class 0."""
        ranked = np.argsort(-counts, kind="stable")
        ranked = np.concatenate([[always], ranked[ranked != always]])
        index, klass = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        index[ranked[: inputs - 1]] = np.arange(1, 1 + len(ranked[: inputs - 1]))
        klass[ranked[: classes - 1]] = np.arange(1, 1 + len(ranked[: classes - 1]))
        rest = counts * (klass == 0)
        return index, klass, np.where(klass > 0, 0.0, np.log(np.maximum(rest, 1e-12) / max(rest.sum(), 1e-12))), np.bincount(klass, counts, classes)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of the word hashes among the frequent words, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def spelling_windows(lex: Lexicon, flat: np.ndarray, lengths: np.ndarray):
    """Windows of words' ids, which lie one after the other, the target classes, weights, places and the targets' shares of their
    classes, in window places."""
    ids, place = attention.windows(lengths, lex.later_index[flat], SPELL_INPUTS, SPELL_CONTEXT, SPELL_STRIDE)
    nxt = np.append(flat[1:], 0)
    nxt[np.cumsum(lengths) - 1] = lex.vocabulary + 1
    target, weight = np.zeros(len(ids) * SPELL_STRIDE, np.int64), np.zeros(len(ids) * SPELL_STRIDE)
    target[place], weight[place] = lex.later_class[nxt], 1
    return ids, target, weight, place, lex.later_share[nxt]


def stream_windows(lex: Lexicon, firsts: np.ndarray, bounds: np.ndarray):
    """The same for documents' first subword ids, document k's from bounds[k] on; each starts from an end and finishes with one.
    Also the documents' lengths, ends included."""
    lengths = np.diff(bounds) + 1
    seen, nxt = np.insert(firsts, bounds[:-1], lex.vocabulary), np.insert(firsts, bounds[1:], lex.vocabulary)
    ids, place = attention.windows(lengths, lex.first_index[seen], STREAM_INPUTS, CONTEXT, STRIDE)
    target, weight = np.zeros(len(ids) * STRIDE, np.int64), np.zeros(len(ids) * STRIDE)
    target[place], weight[place] = lex.first_class[nxt], 1
    return ids, target, weight, place, lex.first_share[nxt], lengths


class Seen:
    """First subword id and log P(word | first) of words by their hashes, in sorted runs whose sizes grow, 20 bytes a word; starts anew
    beyond ``limit`` words."""

    def __init__(self, limit: int = 3_000_000):
        self.limit, self.runs = limit, []

    def find(self, keys: np.ndarray):
        """Which of the hashes are known, and their first ids and log probabilities."""
        known, first, fixed = np.zeros(len(keys), bool), np.zeros(len(keys), np.int32), np.zeros(len(keys))
        for own, f, x in self.runs:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            known |= hit
            first[hit], fixed[hit] = f[at[hit]], x[at[hit]]
        return known, first, fixed

    def add(self, keys: np.ndarray, first: np.ndarray, fixed: np.ndarray) -> None:
        run = keys, first, fixed
        while True:
            order = np.argsort(run[0], kind="stable")
            run = tuple(c[order] for c in run)
            if not self.runs or len(self.runs[-1][0]) > 2 * len(run[0]):
                break
            run = tuple(np.concatenate(c) for c in zip(self.runs.pop(), run))
        if sum(len(r[0]) for r in self.runs) + len(run[0]) > self.limit:
            self.runs.clear()
        self.runs.append(run)


class Words:
    """What is known of distinct words: of the frequent ones from the lexicon; the others are spelled, each once as long as it is
    remembered."""

    def __init__(self, lex: Lexicon, path: str, spelling: dict | None = None, seen: Seen | None = None):
        self.lex, self.path, self.spelling, self.seen = lex, path, spelling, Seen() if seen is None else seen

    def look_up(self, words: list[bytes]):
        """Hashes of the words, their places in the lexicon (or -1), first subword ids, and log P(word | first)."""
        keys = hash_words(words)
        at = self.lex.look_up(keys)
        known = at >= 0
        first, fixed = np.zeros(len(words), np.int32), np.zeros(len(words))
        if known.any():
            first[known], fixed[known] = self.lex.first[at[known]], self.lex.within[at[known]]
        rare = np.flatnonzero(~known)
        if len(rare):
            found, first[rare], fixed[rare] = self.seen.find(keys[rare])
            new = rare[~found]
            if len(new):
                first[new], fixed[new] = self._spelled([words[k] for k in new.tolist()])
                self.seen.add(keys[new], first[new], fixed[new])
        return keys, at, first, fixed

    def _spelled(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        first, fixed = np.zeros(len(new), np.int32), np.zeros(len(new))
        for at in range(0, len(new), 8000):
            part = slice(at, at + 8000)
            spelled = spell(self.path, new[part])
            first[part] = [s[0] for s in spelled]
            if self.spelling is not None:
                lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
                ids, target, _, place, share = spelling_windows(self.lex, np.fromiter(chain.from_iterable(spelled), np.int64, int(lengths.sum())), lengths)
                p = attention.log_probabilities(self.spelling, ids, target, SPELL_CONTEXT, 128)[place] + share
                fixed[part] = np.log(np.maximum(self.lex.escape[first[part]], 1e-12)) + np.add.reduceat(p, np.cumsum(lengths) - lengths)
        return first, fixed


class Scorer:
    """Scores documents in parts; what is known of a word doesn't depend on its place."""

    def __init__(self, model: dict):
        self.lex, self.stream = model["lexicon"], model["stream"]
        self.words = Words(self.lex, model["path"], model["spelling"])

    def score(self, texts: pa.Array):
        """log10 probability of each document, were all words outside the lexicon never seen; tokens without the end; known ones among
        the lexicon's words and the sum of their log10 (count + 1); and of the other words, with bounds: hashes, times, how often
        the copying head didn't name them, and what log P gains there if the word was seen, but for the log of its count."""
        places, words, bounds = folded_words(texts)
        keys, at, first, fixed = self.words.look_up(words)
        n = len(texts)
        firsts = first[places] if len(words) else np.zeros(0, np.int32)
        ids, target, _, place, share, lengths = stream_windows(self.lex, firsts, bounds)
        p = attention.log_probabilities(self.stream, ids, target, CONTEXT)[place].astype(float) + share
        seq = np.insert(places.astype(np.int64), bounds[1:], -1)  # a document's words, then its end
        p += np.where(seq >= 0, fixed[seq] if len(fixed) else 0.0, 0.0)
        weight, hit = copying(seq, np.repeat(np.arange(n), lengths))
        p += np.log1p(-weight)
        p[hit] = np.logaddexp(np.log(weight[hit]), p[hit])
        score = np.add.reduceat(p, np.cumsum(lengths) - lengths) / math.log(10)
        doc = np.repeat(np.arange(n), lengths - 1)
        count = np.where(at >= 0, self.lex.counts[at] if len(self.lex.counts) else 0, -1)[places] if len(words) else np.zeros(0, np.int64)
        known = count >= 0
        logs = np.bincount(doc[known], np.log10(count[known] + 1.0), n).astype(float)
        wide = max(1, len(words))
        pairs, back, times = np.unique(doc[~known] * np.int64(wide) + places[~known], return_inverse=True, return_counts=True)
        free = np.bincount(back, ~hit[seq >= 0][~known], len(pairs)).astype(np.int64)
        owner, which = np.divmod(pairs, wide)
        gain = (self.lex.share[first] - fixed)[which] if len(words) else np.zeros(0)
        cut = np.searchsorted(owner, np.arange(n + 1))
        return score, lengths - 1, np.bincount(doc[known], minlength=n), logs, keys[which].view(np.int64) if len(words) else np.zeros(0, np.int64), times, free, gain, cut


def copying(seq: np.ndarray, doc: np.ndarray, span: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the documents' words: the copying head's weight, and whether it names the word there.

    It looks only at earlier places of the same document: its guess is the word after the latest earlier occurrence of
    the word before, its weight (hits + 0.1) / (guesses + 4) over the ``span`` places before.
    """
    n = len(seq)
    place = np.arange(n)
    key = (doc.astype(np.int64) << 32) + seq + 1  # words are numbered well below 2^32
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    latest = np.full(n, -1)  # the latest earlier place of the same word in the document
    latest[order[same]] = order[np.flatnonzero(same) - 1]
    guess = np.full(n, -1)
    inside = np.concatenate([[False], doc[1:] == doc[:-1]])
    guess[inside] = latest[place[inside] - 1] + 1
    guess[guess == 0] = -1
    made = guess >= 0
    hit = made & (seq[np.maximum(guess, 0)] == seq)
    start = np.flatnonzero(~inside)
    first = np.maximum(np.repeat(start, np.diff(np.append(start, n))), place - span)  # where the span of a place begins
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    hits, guesses = sums(hit), sums(made)
    weight = (hits[place] - hits[first] + 0.1) / (guesses[place] - guesses[first] + 4)
    return np.where(made, weight, 0.0), hit


def _pack(m: dict) -> bytes:
    return b"".join(np.ascontiguousarray(m[k], "<f4").tobytes() for k in sorted(m))


def _unpack(raw: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(raw, "<f4", n, at).reshape(like[k].shape).copy()
        at += 4 * n
    return out


_seen: dict[str, Seen] = {}  # first subword ids that this worker has met, kept from task to task


def _average(batches):
    """Parameters averaged by the number of positions behind them."""
    total, sums = 0.0, 0.0
    for b in batches:
        for n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total += n
            sums = sums + n * np.frombuffer(packed, "<f4").astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sums / total).astype("<f4").tobytes()], pa.binary())], ["n", "m"])


def _train_round(rows: DataFrame, model: dict, name: str, tasks: int, epochs: int, rate: float, expected: float) -> dict:
    """Each task trains the network ``name`` on its share of rows (text or ids, deal) from the same parameters; the results are
    averaged by their positions. ``expected``: about how many positions a task learns from. Only several epochs hold a task's rows."""
    sent = rows.sparkSession.sparkContext.broadcast({k: model[k] for k in ("lexicon", "path", name)})

    def run(batches):
        m = sent.value
        lex = m["lexicon"]
        words = Words(lex, m["path"], seen=_seen.setdefault(m["path"], Seen()))
        trainer = attention.Trainer(m[name], CONTEXT if name == "stream" else SPELL_CONTEXT, rate, 128 if name == "stream" else 256)
        done = 0

        def learn(column: pa.Array) -> int:
            if name == "stream":
                places, distinct, bounds = folded_words(column)
                first = words.look_up(distinct)[2]
                ids, target, weight, *_ = stream_windows(lex, first[places] if len(distinct) else np.zeros(0, np.int32), bounds)
            else:
                lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                ids, target, weight, *_ = spelling_windows(lex, np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), lengths)
            trainer.learn(ids, target, weight, done / max(1.0, expected * epochs))
            return int(weight.sum())

        held: list[pa.Array] = []
        for b in batches:
            for part in parts_of_batch(b, 0, PART):
                done += learn(part.column(0))
                if epochs > 1:
                    held.append(part.column(0))
        for _ in range(epochs - 1):
            for column in held:
                done += learn(column)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([float(done)]), pa.array([_pack(trainer.m)], pa.binary())], ["n", "m"])
        release_memory()

    trained = rows.repartition(tasks, "deal").sortWithinPartitions("deal").mapInArrow(run, "n double, m binary")
    if tasks > 32:  # in two steps, so that the driver gets at most 32 models
        trained = trained.repartition(32).mapInArrow(_average, "n double, m binary")
    got = trained.collect()
    sent.destroy()
    if not got:
        return model
    total = sum(r["n"] for r in got)
    mean = sum(r["n"] * np.frombuffer(r["m"], "<f4").astype(np.float64) for r in got) / total
    return model | {name: _unpack(mean.astype("<f4").tobytes(), model[name])}


#: Positions (words and ends) of the common start, about; of a task of the round over all; bytes of a part.
START, TASK, PART = 500_000, 2_000_000, 2_000_000


def fit(train: DataFrame, path: str, words: int = 1 << 20) -> tuple[dict, DataFrame, int, int]:
    """The model, the exact counts of all training words (key, n), and the number of tokens and of distinct tokens.

    The stream model learns from every training row, the spelling model from every distinct word seen once. For each,
    one task first makes the parameters that all tasks start from, of about START positions; then all rows, these too, are
    dealt by a hash of the row, so that copies of a text are learned from as often as they stand there and lie in many tasks.
    """
    vocabulary = _tokenizer(path).get_vocab_size()
    tallies = materialise(count_words(train, path, vocabulary))
    counts = tallies.where("kind = 0").select("key", "first", "n")
    n_tokens, distinct, rare = tallies.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count("ids")).first()
    top = counts.where((F.col("first") < vocabulary) & (F.col("n") > RARE)).orderBy(F.desc("n"), "key").limit(words).toArrow().to_pandas()  # at most ``words`` rows
    firsts = counts.groupBy("first").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("single")).toArrow().to_pandas()  # at most the tokenizer's vocabulary
    later = tallies.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    lex = Lexicon(top, firsts, later, vocabulary)
    model = {
        "lexicon": lex, "path": path, "stream": attention.initial(STREAM_INPUTS, lex.first_counts, CONTEXT, STRIDE),
        "spelling": attention.initial(SPELL_INPUTS, lex.later_counts, SPELL_CONTEXT, SPELL_STRIDE, seed=6),
    }
    texts = train.select(text_bytes(), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    spelled = tallies.where("ids is not null").select("ids", F.xxhash64("key").alias("deal"))
    for name, rows, n in (("stream", texts, n_tokens), ("spelling", spelled, rare * 5)):  # a word has about five subwords
        begin = drawn(rows, "deal", START / max(1, n))
        model = _train_round(begin, model, name, 1, epochs=4, rate=0.01, expected=min(START, n))
        model = _train_round(rows, model, name, max(1, -(-n // TASK)), epochs=1, rate=0.003, expected=min(TASK, n))
    return model, counts.select("key", "n"), int(n_tokens), int(distinct)


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, train: DataFrame, path: str, words: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    Tokens: the words between ASCII white space, A-Z folded, then one end. Null counts as the empty text: the end
    alone. Rows with a null or repeated doc_id are scored like others, and no other column is read. Without training
    documents N = V = 0 and the untrained model scores.
    """
    model, counts, total, distinct = fit(train, path, words)
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a worker keeps the last scorer by this name

    def run(batches):
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(sent.value)
        scorer = _scorers[name]
        for b in batches:
            for part in parts_of_batch(b, 2, PART):
                score, n, known, logs, keys, times, free, gain, cut = scorer.score(part.column(2))
                others = pa.StructArray.from_arrays([pa.array(keys), pa.array(times), pa.array(free), pa.array(gain, pa.float64())], ["key", "times", "free", "gain"])
                others = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), others)
                cols = [part.column(0), part.column(1), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), others, pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, _SCORED)
        release_memory()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes())
    scored = materialise(source.mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, logs double, others array<struct<key:bigint,times:bigint,free:bigint,gain:double>>, score double"))
    # rare words meet their exact counts in a shuffle, for both scores; the frequent ones and the end are already in
    rare = scored.select("row", F.explode("others").alias("w")).select("row", "w.*")
    met = rare.join(counts, "key").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(F.col("free") * (F.col("gain") + F.ln("n")) / math.log(10)).alias("more_score")
    )
    ends = int(counts.where(F.col("key") == int(hash_words([END]).view(np.int64)[0])).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    per_token = math.log10(total + distinct + 1)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + math.log10(ends + 1)
    return scored.drop("others").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * per_token).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


_SCORED = ["row", "doc_id", "n_tokens", "known", "logs", "others", "score"]
