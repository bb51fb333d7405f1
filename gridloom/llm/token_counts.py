"""Unigram token counts by dynamic programming over a trie of pre-tokens.

The tokens of a text are the pieces of its most probable segmentation under a unigram model, of equal ones that with the longest
last piece; characters without a piece cost their UTF-8 bytes (byte fallback).  The pieces are those of a SentencePiece file.  The
only public file is a BPE one, whose scores are merge ranks and no log-probabilities, and tokenizers are never trained here.  So the
model follows from the file by a law: the piece of rank r has a probability in proportion to 1 / (r + ``SHIFT``), Zipf's law in
Mandelbrot's form.  A unigram file brings its own log-probabilities (``stored``).

No piece has a space mark after another character, so texts fall into pre-tokens (space marks, then other characters) that are
segmented apart.  A task inserts each distinct pre-token into a trie.  The best score at a node (its forward score) depends on the
path to it alone, so it is computed once for all pre-tokens that share the prefix, and the count at a pre-token's last node is
stored.  An automaton over the pieces says which of them end at a node.  Documents never move.

Defined results: null and empty texts have no tokens; each row gets its own result, repeated or without identifier; an empty table
gives no rows; other columns are ignored.  A pre-token over ``LONG`` characters is segmented by the same recurrence without the trie.
"""

from __future__ import annotations

import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Trie nodes a task keeps; the length from which a pre-token isn't put into the trie.
NODES, LONG = 1_000_000, 200
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's shift of the ranks.
SHIFT = 2.7

_PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


class Pieces:
    """Pieces of a SentencePiece file, their log-probabilities, and the automaton that finds those which end at a place."""

    def __init__(self, path: str, stored: bool = False):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        ranked = sorted(normal, key=lambda i: (-p.get_score(i), i))
        total = math.fsum(1 / (r + SHIFT) for r in range(1, len(ranked) + 1))
        self.score = {p.id_to_piece(i): p.get_score(i) if stored else -math.log((r + SHIFT) * total) for r, i in enumerate(ranked, 1)}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        if any(SPACE in x.lstrip(SPACE) for x in self.score):
            raise ValueError("a piece goes over a space mark")
        self._link()

    def _link(self) -> None:
        """States are the pieces' prefixes; ``ends`` has the (length, score) of each piece that ends in a state, the longest first."""
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]
        for piece, score in self.score.items():
            at = 0
            for c in piece:
                if c not in self.steps[at]:
                    self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(())
                at = self.steps[at][c]
            self.ends[at] = ((len(piece), score),)
        self.shorter = [0] * len(self.steps)
        queue = deque(self.steps[0].values())
        while queue:
            at = queue.popleft()
            self.ends[at] += self.ends[self.shorter[at]]
            for c, to in self.steps[at].items():
                self.shorter[to] = self.step(self.shorter[at], c)
                queue.append(to)

    def step(self, at: int, c: str) -> int:
        """The state after one more character: the longest suffix that is a prefix of a piece."""
        while c not in self.steps[at]:
            if not at:
                return 0
            at = self.shorter[at]
        return self.steps[at][c]

    @classmethod
    def of(cls, state: dict) -> Pieces:
        """From ``vars`` of another one: what is broadcast holds plain values only."""
        p = cls.__new__(cls)
        vars(p).update(state)
        return p


def pre_tokens(text: str) -> list[str]:
    """A space mark stands before the text and for each space; a line feed has no piece, so it parts pre-tokens too."""
    return _PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))


class Trie:
    """Forward scores and token counts of prefixes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self):
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens, self.state = [0.0], [0], [0]

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        child, best, tokens, state, pieces = self.child, self.best, self.tokens, self.state, self.pieces
        path = [0]
        for k, c in enumerate(word):
            key = (path[-1], c)
            node = child.get(key)
            if node is None:
                at = pieces.step(state[path[-1]], c)
                top, n, size = None, 0, 0
                for size, s in pieces.ends[at]:  # the longest piece first: it wins ties
                    before = path[k + 1 - size]
                    if top is None or best[before] + s > top:
                        top, n = best[before] + s, tokens[before] + 1
                if size != 1:  # no piece of this character alone
                    s = best[path[k]] + pieces.unknown
                    if top is None or s > top:
                        top, n = s, tokens[path[k]] + len(c.encode("utf-8", "surrogatepass"))
                node = child[key] = len(best)
                best.append(top)
                tokens.append(n)
                state.append(at)
            path.append(node)
        return tokens[path[-1]]


class Counts(dict):
    """Terminal counts of the pre-tokens met so far."""

    def __init__(self, pieces: Pieces):
        self.trie, self.alone = Trie(pieces), Trie(pieces)

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            self.alone.clear()
            n = self.alone.count(word)
            self.alone.clear()
            return n
        if len(self.trie.best) > NODES or len(self) > NODES // 2:
            self.trie.clear()
            self.clear()
        n = self[word] = self.trie.count(word)
        return n


def _count(shared):
    def task(batches):
        counts = Counts(Pieces.of(shared.value))
        get = counts.__getitem__
        for batch in batches:
            tokens, words = [], []
            for text in batch.column("text").to_pylist():
                found = pre_tokens(text) if text else []
                words.append(len(found))
                tokens.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=["id", "n_tokens", "n_pretokens"])

    return task


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_pretokens.  ``stored`` takes the file's scores as log-probabilities."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(vars(Pieces(model_path, stored)))  # as large as the file's vocabulary
    return rows.mapInArrow(_count(shared), f"id {kind}, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)
