"""Encoding of a corpus by a public byte-level BPE vocabulary, with a minimal transducer lexicon."""

from __future__ import annotations

import base64
import heapq
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from chronoloom.common import most_frequent, spread, table

#: Fixed value: how byte_bpe_50k cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for counting in the JVM, where \s has to be told about Unicode. Counts only choose the lexicon.
JVM_WORDS = WORDS.replace(r"[^\s", r"[^\s\p{Z}").replace(r"\s+", r"[\s\p{Z}]+")
LONGEST = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a vocabulary in rank form (base64 token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The exact BPE of one word: always the pair of lowest rank, the leftmost of equal ones.

    A heap over a linked list, so that a word of n bytes takes n log n steps.
    """
    if (one := ranks.get(word)) is not None:
        return [one]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends, 0 once it is merged away
    start_before = list(range(-1, n))  # start of the part before the one that starts at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            start_before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := start_before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(words: list[bytes], ranks: dict[bytes, int], path: str) -> None:
    """Writes the minimal acyclic transducer of ``words`` with their ids as outputs.

    Words are added in sorted order; a state is frozen as soon as no later word
    can pass it, and equal frozen states (same finality, arcs and targets)
    become one, so suffixes are shared. An arc's output is the number of
    accepted words that precede it in its state; their sum along a word is the
    word's place in the list of outputs. Arcs are stored sorted by
    (state, byte), to be memory-mapped by every worker.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)); targets come before their sources
    path_nodes: list[list] = [[False, {}]]
    last = b""

    def freeze(down_to: int) -> None:
        for depth in range(len(last), down_to, -1):
            final, arcs = path_nodes.pop()
            key = (final, tuple(arcs.items()))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path_nodes[-1][1][last[depth - 1]] = register[key]

    for w in words:
        same = len(os.path.commonprefix([w, last]))
        freeze(same)
        path_nodes += [[False, {}] for _ in w[same:]]
        path_nodes[-1][0] = True
        last = w
    freeze(0)
    states.append((path_nodes[0][0], tuple(path_nodes[0][1].items())))
    count = np.zeros(len(states), np.int64)
    keys, targets, outs = [], [], []
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, t in sorted(arcs):
            keys.append(s << 8 | byte)
            targets.append(t)
            outs.append(before)
            before += count[t]
        count[s] = before
    ids = [merge(w, ranks) for w in words]
    parts = {
        "key": np.array(keys, np.int64),
        "target": np.array(targets, np.int32),
        "out": np.array(outs, np.int32),
        "final": np.array([f for f, _ in states], np.int8),
        "at": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32),
        "ids": np.array([y for x in ids for y in x], np.int32),
    }
    with open(path, "wb") as f:
        head = np.array([len(states) - 1] + [len(v) for v in parts.values()], np.int64)
        f.write(head.tobytes())
        for v in parts.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 8))


class Lexicon:
    """A compiled lexicon, memory-mapped: workers of one machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:56].view(np.int64)
        self.root, at = int(head[0]), 56
        for name, size, kind in zip(("key", "target", "out", "final", "at", "ids"), head[1:], (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32)):
            nbytes = int(size) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + nbytes].view(kind))
            at += nbytes + -nbytes % 8

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the list of outputs, -1 for words that aren't in it. All words advance together."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8)
        off = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(words) else n
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        state[(n > LONGEST) | (n == 0)] = -1
        live = np.flatnonzero(state >= 0)
        for p in range(LONGEST):
            live = live[n[live] > p]
            if not len(live) or not len(self.key):
                break
            want = state[live] << 8 | buf[off[live] + p]
            pos = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[pos] == want
            state[live] = np.where(hit, self.target[pos], -1)
            place[live] += np.where(hit, self.out[pos], 0)
            live = live[hit]
        ok = (state >= 0) & (len(self.key) > 0)
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, place, -1)


class Encoder:
    """Encodes batches of texts: words of the lexicon by the transducer, all others by exact merging."""

    def __init__(self, lexicon: str, ranks: str):
        self.lex, self.ranks, self.cut = Lexicon(lexicon), read_ranks(ranks), regex.compile(WORDS)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, as of an Arrow list array; null and empty texts have no ids."""
        number: dict[str, int] = {}
        seq: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                seq += [number.setdefault(w, len(number)) for w in self.cut.findall(t)]
            ends.append(len(seq))
        words = [w.encode("utf-8", "replace") for w in number]
        place = self.lex.find(words)
        known = place >= 0
        size, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[known] = self.lex.at[place[known] + 1] - self.lex.at[place[known]]
        first[known] = self.lex.at[place[known]]
        extra: list[int] = []
        base = len(self.lex.ids)
        for i in np.flatnonzero(~known):
            ids = merge(words[i], self.ranks)
            size[i], first[i] = len(ids), base + len(extra)
            extra += ids
        pool = np.concatenate([self.lex.ids, np.array(extra, np.int32)])
        s = np.array(seq, np.int64)
        n = size[s]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = np.arange(total[-1]) - np.repeat(total[:-1] - first[s], n)
        return total[np.array(ends)], pool[flat]


def frequent_words(df: DataFrame, text: str, most: int) -> list[bytes]:
    """The most frequent words of the corpus, at most ``most``; all texts are counted, with map-side partials."""
    counts = (
        df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(JVM_WORDS), F.lit(0))).alias("w"))
        .filter(F.length("w") <= LONGEST)
        .groupBy("w")
        .count()
        .filter("count > 1")
    )
    # read twice, once for the level and once for the words
    top = most_frequent(table(counts, "words"), "count", most)
    return [r.w.encode() for r in top.collect() if 0 < len(r.w.encode()) <= LONGEST]


def encode_corpus(df: DataFrame, *, id: str, text: str, vocabulary: str, lexicon_words: int = 65_536) -> DataFrame:
    """(``id``, ``ids``): each text as token ids of a byte-level BPE vocabulary, without special tokens.

    One row per input row, in no order. Null and empty texts have the empty
    list. Names of special tokens inside a text are ordinary text. Texts of any
    length are encoded whole. Other columns are ignored.

    The ``lexicon_words`` most frequent words of the corpus (a bound on what the
    driver holds; nothing else depends on it) are compiled into a minimal
    acyclic transducer that workers memory-map; words outside it are merged by
    rank, so the result is exact whatever the lexicon.
    """
    spark: SparkSession = df.sparkSession
    texts = spread(df.select(F.col(id).alias("i"), F.col(text).alias("x")))
    words = frequent_words(texts, "x", lexicon_words)
    # Spark serves the two files to every executor, also to ones that start later; they go with the session.
    name = f"lexicon-{uuid.uuid4().hex}"
    own = tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())
    compile_lexicon(words, read_ranks(vocabulary), f"{own}/{name}")
    spark.sparkContext.addFile(f"{own}/{name}")
    spark.sparkContext.addFile(vocabulary)
    ranks_name = os.path.basename(vocabulary)

    def run(batches):
        coder = Encoder(SparkFiles.get(name), SparkFiles.get(ranks_name))
        for b in batches:
            offsets, ids = coder.encode(b.column("x").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("i"), lists], names=["i", "ids"])

    out = texts.mapInArrow(run, StructType([texts.schema["i"], StructField("ids", ArrayType(IntegerType()))]))
    return out.select(F.col("i").alias(id), "ids")
