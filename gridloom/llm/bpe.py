"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Words are counted over all documents; those with the highest counts (``LEXICON`` at most, as many as have a count above a common
bound) are encoded on the driver and compiled into the transducer.  The file goes to the executors with ``SparkContext.addFile`` and
is memory-mapped there.  A task looks up the distinct words it has not met yet all at once, and merges the others exactly: always the
pair of the lowest rank, the leftmost first.  Documents never move.

Encoding follows the tokenizers library for the file's pipeline: special tokens are cut out of the raw text, then NFC, lower case
(character by character), the split into contractions, runs of letters, single numbers and runs of other characters, and byte-level
BPE with a word-end mark.  Decoding joins the tokens by spaces, as the library does for a file without a decoder.

Defined results: a null text counts as empty and has no tokens; each row gets its own result, repeated or without identifier; an
empty table gives no rows; other columns are ignored.  Memory per task is bounded (``CACHED`` words); texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .transducer import Transducer, build

#: Words of the lexicon, words a task remembers, distinct words a task counts before it hands them on.
LEXICON, CACHED, COUNTED = 1 << 16, 300_000, 300_000

_SPACES = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATE = "'s|'t|'re|'ve|'m|'ll|'d|"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + k)
            k += 1
    return out


class Vocabulary:
    """What a word-level BPE file says; small, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for table in (vocab, self.special):
            for t, i in table.items():
                self.tokens[i] = t
        self.inner = [vocab.get(c) for c in byte_chars()]
        self.last = [vocab.get(c + self.suffix) for c in byte_chars()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        names = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if names != ["NFC", "Replace", "Lowercase"] or model.get("unk_token") or spec.get("decoder"):
            raise ValueError("the file has another pipeline than this operator implements")

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From ``vars`` of another one: what is broadcast holds plain values only."""
        v = cls.__new__(cls)
        vars(v).update(state)
        return v


class Splitter:
    """Normalised words of a text."""

    def __init__(self, special: dict[str, int]):
        other = "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) in ("Nl", "No"))
        extra = "".join(c for c in other if not re.match(r"\w", c))  # numbers that Python's \w doesn't know
        self.ascii = re.compile(_LATE + r"[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
        self.plane = re.compile(f"{_LATE}[^\\W\\d_{other}]+|[\\d{other}]|(?:[^\\w{_SPACES}{extra}]|_)+")
        self.full = None
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = {t[0] for t in special}  # a text without any of these characters has no special token

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if max(text) <= "￿":
            return self.plane.findall(text)
        if self.full is None:
            import regex

            self.full = regex.compile(_LATE + r"[\p{L}]+|[\p{N}]|[^" + _SPACES + r"\p{L}\p{N}]+")
        return self.full.findall(text)

    def parts(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if not any(c in text for c in self.marks):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words(text[at:])


def merge(word: str, v: Vocabulary) -> list[int]:
    """Exact BPE of one word."""
    raw = word.encode()
    ids = [v.inner[b] for b in raw[:-1]] + [v.last[raw[-1]]]
    ids = [i for i in ids if i is not None]
    if len(ids) > 400:
        return _merge_long(ids, v.merges)
    none = (1 << 30, 0)
    get = v.merges.get
    near = [get(p, none) for p in zip(ids, ids[1:])]
    while near:
        best = min(near)
        if best is none:
            break
        k = near.index(best)
        ids[k : k + 2] = [best[1]]
        del near[k]
        if k:
            near[k - 1] = get((ids[k - 1], ids[k]), none)
        if k < len(near):
            near[k] = get((ids[k], ids[k + 1]), none)
    return ids


def _merge_long(ids: list[int], merges: dict) -> list[int]:
    """The same with a heap, for words of any length."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*m, k) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
    heap = [(rank, k, new) for rank, new, k in heap]
    heapq.heapify(heap)
    while heap:
        rank, k, new = heapq.heappop(heap)
        j = after[k]
        if ids[k] < 0 or j >= n or merges.get((ids[k], ids[j])) != (rank, new):
            continue
        ids[k], ids[j] = new, -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if m := merges.get((new, ids[after[k]])):
                heapq.heappush(heap, (m[0], k, m[1]))
        if before[k] >= 0 and (m := merges.get((ids[before[k]], new))):
            heapq.heappush(heap, (m[0], before[k], m[1]))
    return [i for i in ids if i >= 0]


def _count(special: dict[str, int]):
    def task(batches):
        splitter, found = Splitter(special), Counter()

        def out():
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    found.update(splitter.parts(text))
            if len(found) >= COUNTED:
                yield out()
                found.clear()
        if found:
            yield out()

    return task


def frequent_words(texts: DataFrame, special: dict[str, int], limit: int = LEXICON) -> list[str]:
    """The words with the highest counts over all texts: as many whole count levels as ``limit`` allows."""
    counts = common.materialise(texts.mapInArrow(_count(special), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 32).cast("int")
    taken, bound = 0, None
    for at, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 32 * 63 levels
        if taken + n > limit:
            break
        taken, bound = taken + n, at
    if bound is None:
        return []
    words = [r.word for r in counts.where(level >= bound).select("word").collect()]  # at most ``limit``
    return [w for w in words if w not in special]


def compile_lexicon(words: list[str], v: Vocabulary) -> bytes:
    words = sorted(words, key=str.encode)
    return build([w.encode() for w in words], [merge(w, v) for w in words])


def publish(spark, data: bytes) -> str:
    """Hand a file to all executors, also those that start later; returns its name for SparkFiles."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    if any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):  # the same file for the same words
        return name
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gridloom-")), name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Texts to ids, with the words met so far."""

    def __init__(self, v: Vocabulary, lexicon: Transducer | None):
        self.v, self.lexicon, self.splitter = v, lexicon, Splitter(v.special)
        self.known: dict[str, bytes] = {}
        self._reset()

    def _reset(self):
        self.known = {t: np.array([i], "<u4").tobytes() for t, i in self.v.special.items()}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHED:
            self._reset()
        places = self.lexicon.places([w.encode() for w in words]) if self.lexicon is not None else [-1] * len(words)
        for w, place in zip(words, places, strict=True):
            self.known[w] = self.lexicon.output(place) if place >= 0 else np.array(merge(w, self.v), "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out, k = [], 0
        while k < len(texts):
            parts, fresh = [], {}
            while k < len(texts) and len(fresh) < CACHED // 4:
                p = self.splitter.parts(texts[k]) if texts[k] else []
                parts.append(p)
                fresh.update(dict.fromkeys(p))
                k += 1
            if new := [w for w in fresh if w not in self.known]:
                self.learn(new)
                if missing := [w for w in fresh if w not in self.known]:  # the memory was cleared
                    self.learn(missing)
            get = self.known.__getitem__
            out += [b"".join(map(get, p)) for p in parts]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode(vocabulary, name: str, digests: bool):
    """The task: id, text to ids and decoded text, or to their digests."""

    def task(batches):
        encoder = Encoder(Vocabulary.of(vocabulary.value), Transducer(SparkFiles.get(name)))
        for batch in batches:
            ids = encoder.encode(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64())]
            if digests:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                columns += [pa.array([sha(i) for i in ids], pa.string()), pa.array([sha(encoder.decode(i).encode()) for i in ids], pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names = ["id", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, lexicon: int = LEXICON) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids; or with ``digests``: id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    v = Vocabulary(vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = publish(spark, compile_lexicon(frequent_words(rows.select("text"), v.special, lexicon), v))
    kind = docs.schema[id_col].dataType.simpleString()
    result = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(_encode(spark.sparkContext.broadcast(vars(v)), name, digests), f"id {kind}, n_tokens long, {result}").withColumnRenamed("id", id_col)


def _decode(vocabulary):
    def task(batches):
        tokens = vocabulary.value["tokens"]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if i is None else " ".join(map(tokens.__getitem__, i)) for i in batch.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return task


def decode_documents(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text.  Null ids give a null text."""
    spark = encoded.sparkSession
    common.bounded_batches(spark)
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decode(spark.sparkContext.broadcast(vars(Vocabulary(vocabulary_path)))), f"id {kind}, text string").withColumnRenamed("id", id_col)
