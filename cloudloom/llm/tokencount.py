"""Token counts by a unigram model: Viterbi scores over a trie of the distinct pre-tokens, once for each shared prefix."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

MARK = "▁"  # begins each pre-token, as the vocabulary's pieces have it


@lru_cache(maxsize=2)
def unigram_pieces(path: str) -> dict[str, float]:
    """Log scores of a piece vocabulary: Zipf's law by the piece's place. Control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = float(np.log(np.sum(1.0 / (np.arange(len(keep)) + 2.7))))
    return {p: -float(np.log(k + 2.7)) - norm for k, p in enumerate(keep)}


class PieceTrie:
    """The vocabulary as a trie in arrays: transitions sorted by (node, character), and the score of the piece that ends at a node."""

    def __init__(self, pieces: dict[str, float]):
        step: dict[tuple[int, int], int] = {}
        score = [-np.inf]
        for piece, p in pieces.items():
            node = 0
            for c in piece:
                node = step.setdefault((node, ord(c)), len(score))
                if node == len(score):
                    score.append(-np.inf)
            score[node] = p
        keys = np.array([(n << 21) + c for n, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.child, self.score = keys[order], np.array(list(step.values()), np.int64)[order] if step else np.zeros(0, np.int64), np.array(score)

    def advance(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, or -1."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        want = (nodes << 21) + characters
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.child[at], -1)


class TrieCounter:
    """Counts of words under the best segmentation into pieces.

    The distinct words are put into a trie, level by level: words that share a prefix share its node. A node's forward score is
    the best over the pieces that end there; the pieces that may still end below it are carried along as places in the
    vocabulary's trie with the score they began at, so each is walked once for a shared prefix. A word's last node holds its
    token count. A character that no piece covers costs ``unknown`` and as many tokens as it has UTF-8 bytes. Equal scores go
    to fewer tokens.
    """

    def __init__(self, pieces: dict[str, float], unknown: float = -25.0, limit: int = 400_000):
        self.trie, self.unknown, self.limit = PieceTrie(pieces), unknown, limit
        self.counts: dict[str, int] = {}

    def learn(self, words) -> None:
        """Store the counts of new words."""
        new = sorted(set(words) - self.counts.keys())
        if len(self.counts) + len(new) > self.limit:
            self.counts.clear()
            new = sorted(set(words))
        if not new:
            return
        length = np.array([len(w) + 1 for w in new], np.int64)
        chars = np.frombuffer((MARK + MARK.join(new)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        start = np.cumsum(length) - length
        done = np.zeros(len(new), np.int64)
        alive, node = np.arange(len(new)), np.zeros(len(new), np.int64)  # words that go on, in order, and their nodes of a level
        score, tokens = np.zeros(1), np.zeros(1, np.int64)
        # of the pieces begun and not ended: their node, place in the vocabulary's trie, and score and tokens where they began
        owner, place, begun, spent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        depth = 0
        while len(alive):
            c = chars[start[alive] + depth]
            fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (c[1:] != c[:-1])])
            child = np.cumsum(fresh) - 1  # sorted words of one prefix lie together
            parent, c = node[fresh], c[fresh]
            # the parent's pieces go on in each child, and one more begins at the parent
            held = np.bincount(owner, minlength=len(score))
            times = held[parent]
            at = np.repeat((np.cumsum(held) - held)[parent] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            kids = np.arange(len(parent))
            owner = np.concatenate([np.repeat(kids, times), kids])
            place = self.trie.advance(np.concatenate([place[at], np.zeros(len(kids), np.int64)]), c[owner])
            begun, spent = np.concatenate([begun[at], score[parent]]), np.concatenate([spent[at], tokens[parent]])
            order = np.argsort(owner, kind="stable")
            order = order[place[order] >= 0]
            owner, place, begun, spent = owner[order], place[order], begun[order], spent[order]
            size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            ends = np.isfinite(self.trie.score[place])
            who = np.concatenate([kids, owner[ends]])
            s = np.concatenate([score[parent] + self.unknown, begun[ends] + self.trie.score[place[ends]]])
            n = np.concatenate([tokens[parent] + size, spent[ends] + 1])
            best = np.lexsort((n, -s, who))
            best = best[np.searchsorted(who[best], kids)]
            score, tokens = s[best], n[best]
            depth += 1
            last = length[alive] == depth
            done[alive[last]] = tokens[child[last]]
            alive, node = alive[~last], child[~last]
        self.counts.update(zip(new, done.tolist()))

    def count(self, texts: list[list[str]]) -> list[int]:
        missing = {w for t in texts for w in t if w not in self.counts}
        if missing:
            if len(self.counts) + len(missing) > self.limit:  # all words of the batch must be there together
                self.counts.clear()
                missing = {w for t in texts for w in t}
            self.learn(missing)
        get = self.counts.__getitem__
        return [sum(map(get, t)) for t in texts]


_counters: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, n_chars, n_words and n_tokens of every whole text; pre-tokens are the words between white space.

    Null counts as the empty text, with no word and no token. Repeated rows and null ids are counted like others;
    columns besides doc_id and text are not read.
    """

    def run(batches):
        if pieces_path not in _counters:
            _counters[pieces_path] = TrieCounter(unigram_pieces(pieces_path))
        counter = _counters[pieces_path]
        for b in batches:
            texts = [r.decode() for r in b.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                words = [t.split() for t in part]
                cols = [pa.array([len(t) for t in part], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(counter.count(words), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *cols], ["doc_id", "n_chars", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id bigint, n_chars bigint, n_words bigint, n_tokens bigint")
