"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The corpus's most frequent words are compiled, with their token ids, into a
minimal acyclic automaton whose arcs carry additive outputs: the outputs
along a word's path sum to the word's number, which indexes its id list, so
words share prefixes and suffixes.  The automaton is one flat file; Spark
ships it to the executors, whose Python workers memory-map it.  A chunk of
documents is cut into words by vector operations, its distinct words walk
the automaton together, and a word that the automaton does not hold is
merged by the tokenizer's own ranked merges, so the result is exact whatever
words the lexicon has.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import NUMBER, SPACE, byte_classes, hold, run_starts, strings, text_chunks, utf8
from rampart.session import write_table

LEXICON_WORDS = 1 << 16        # words compiled into the automaton
MEMO_WORDS = 1 << 16           # merged words a worker remembers between chunks
MEMO_BYTES = 64                # longer words are not remembered
LONG_WORD = 64                 # symbols from which a word is merged through a heap


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# --- the tokenizer's tables ------------------------------------------------------

def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Merge table and vocabulary of a byte-level BPE with word ends."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        m = d["model"]
        self.suffix = m.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = m["vocab"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.symbols = byte_symbols()
        size = max(max(self.vocab.values()), *self.special.values()) + 1
        names = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = t
        self.names = pa.array(names, pa.string())

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the best-ranked neighbouring pair merges until none is left."""
        parts = [self.symbols[b] for b in word]
        parts[-1] += self.suffix
        if len(parts) >= LONG_WORD:
            return [self.vocab[p] for p in self.merge_long(parts)]
        ranks = self.ranks
        while len(parts) > 1:
            best, pair = None, None
            for p in zip(parts, parts[1:]):
                r = ranks.get(p)
                if r is not None and (best is None or r < best):
                    best, pair = r, p
            if pair is None:
                break
            joined, out, i, n = pair[0] + pair[1], [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == pair[0] and parts[i + 1] == pair[1]:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocab[p] for p in parts]

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges in n log n steps: a heap of (rank, place) over a linked list."""
        ranks, n = self.ranks, len(parts)
        parts = list(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:        # one of the two has merged since
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                m = after[k] if k >= 0 else n
                if k >= 0 and m < n and (parts[k], parts[m]) in ranks:
                    heapq.heappush(heap, (ranks[parts[k], parts[m]], k, parts[k], parts[m]))
        return [p for p in parts if p is not None]


# --- words of a chunk -------------------------------------------------------------

def normalize(texts: pa.Array) -> pa.Array:
    """NFC, then lower case code point by code point; null is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    wide = np.flatnonzero(~pc.string_is_ascii(a).to_numpy(zero_copy_only=False))
    changed = {}
    for i, t in zip(wide, a.take(pa.array(wide)).to_pylist()):
        if not unicodedata.is_normalized("NFC", t):
            changed[int(i)] = unicodedata.normalize("NFC", t)
    if changed:
        a = pa.array([changed.get(i, t) for i, t in enumerate(a.to_pylist())], pa.large_string())
    # the one letter whose full lower case is two code points
    return pc.utf8_lower(pc.replace_substring(a, "İ", "i̇"))


def word_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start mask of the split pattern's pieces, byte classes).

    Pieces are letter runs, single numbers, runs of other signs, and the
    contractions 's 't 're 've 'm 'll 'd where a lone apostrophe begins one.
    White space runs are pieces too; the caller drops them.
    """
    cls = byte_classes(data)
    m = run_starts(cls, off)
    lead = (data & 0xC0) != 0x80
    m[:-1] |= (cls == NUMBER) & lead
    split_contractions(data, off, m, np.ones(len(data), bool))
    return m, cls


def split_contractions(data: np.ndarray, off: np.ndarray, m: np.ndarray, allowed: np.ndarray) -> None:
    """Rejoin a lone apostrophe with the contraction letters after it, in ``m``."""
    n = len(data)
    pos = np.flatnonzero((data == 0x27) & m[:-1] & m[1:] & allowed)
    pos = pos[pos + 1 < n]
    doc = np.zeros(n + 3, bool)
    doc[off] = True
    d = np.concatenate([data, np.zeros(3, np.uint8)])
    pos = pos[~doc[pos + 1]]
    a, b = d[pos + 1], d[pos + 2]
    inside = ~doc[pos + 2]
    one = np.isin(a, list(b"stmd"))
    two = inside & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                    | ((a == ord("l")) & (b == ord("l"))))
    for hit, k in ((one, 1), (two, 2)):
        p = pos[hit]
        m[p + 1] = False
        m[p + 1 + k] = True


def chunk_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of each word in order, words before each document)."""
    off, data = utf8(texts)
    m, cls = word_starts(data, off)
    starts = np.flatnonzero(m[:-1]) if len(data) else np.zeros(0, np.int64)
    kept = cls[starts] != SPACE
    enc = strings(np.r_[starts, len(data)], data).filter(pa.array(kept)).dictionary_encode()
    begin = np.searchsorted(starts[kept], off)
    return enc.dictionary, enc.indices.to_numpy(zero_copy_only=False), begin


# --- the automaton ---------------------------------------------------------------

def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, with number outputs.

    Words are added in order; the states that a new word leaves behind are
    merged with equal ones already kept.  A state's count of words below it
    gives each arc its output: the words that sort before those through it.
    """
    kept: dict[tuple, int] = {}
    arcs: list[tuple] = []           # per kept state: ((label, target), ...)
    final: list[bool] = []
    below: list[int] = []

    def keep(node: list) -> int:
        key = (node[0], tuple(node[1]))
        got = kept.get(key)
        if got is None:
            got = kept[key] = len(arcs)
            arcs.append(key[1])
            final.append(node[0])
            below.append(node[0] + sum(below[t] for _, t in key[1]))
        return got

    path: list[list] = [[False, []]]         # the last word's open states
    labels: list[int] = []
    for w in words:
        same = 0
        while same < len(labels) and same < len(w) and labels[same] == w[same]:
            same += 1
        while len(labels) > same:
            s = keep(path.pop())
            path[-1][1].append((labels.pop(), s))
        for b in w[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        s = keep(path.pop())
        path[-1][1].append((labels.pop(), s))
    root = keep(path[0])
    keys, target, output = [], [], []
    for s, own in enumerate(arcs):
        before = int(final[s])
        for label, t in own:
            keys.append(s << 8 | label)
            target.append(t)
            output.append(before)
            before += below[t]
    return {"key": np.array(keys, np.int64), "target": np.array(target, np.int32),
            "output": np.array(output, np.int32), "final": np.array(final, np.uint8),
            "root": np.array([root], np.int32)}


def write_lexicon(path: str, words: list[bytes], ids: list[list[int]]) -> None:
    """Automaton and id lists as one file: a JSON line of array places, then the arrays."""
    order = sorted(range(len(words)), key=lambda i: words[i])
    arrays = build_automaton([words[i] for i in order])
    lens = np.array([len(ids[i]) for i in order], np.int64)
    arrays["id_start"] = np.r_[0, np.cumsum(lens)]
    arrays["ids"] = np.array([x for i in order for x in ids[i]], np.uint32)
    arrays["longest"] = np.array([max((len(w) for w in words), default=0)], np.int32)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(line.ljust(-(-(len(line) + 1) // 8) * 8 - 1) + b"\n")
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            line = f.readline()
        for k, (kind, n, at) in json.loads(line).items():
            a = np.memmap(path, kind, "r", len(line) + at, (n,)) if n else np.zeros(0, kind)
            setattr(self, k, a)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Word number of each word, -1 where the lexicon lacks it; all words
        advance through the automaton together, one byte a step."""
        off, data = utf8(words)
        size = np.diff(off)
        state = np.full(len(size), self.root[0], np.int64)
        out = np.zeros(len(size), np.int64)
        alive = np.flatnonzero(size <= self.longest[0])
        found = np.full(len(size), -1, np.int64)
        step = 0
        while len(alive):
            done = size[alive] == step
            if done.any():
                d = alive[done]
                hit = self.final[state[d]] == 1
                found[d[hit]] = out[d[hit]]
                alive = alive[~done]
            if not len(alive) or not len(self.key):
                break
            key = state[alive] << 8 | data[off[alive] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.target[at]
            out[alive] += self.output[at]
            step += 1
        return found


# --- Spark operators ---------------------------------------------------------------

def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; chunks are counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, text):
            words, number, _ = chunk_words(normalize(b.column(text)))
            n = np.bincount(number, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, spec: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all documents, at most ``words``, and
    ship the file to the executors; returns its name there.

    Words come in by whole steps of frequency, so that equal counts are
    treated alike.
    """
    counts = write_table(word_counts(docs, text), "words")
    # steps of 1/32 of a doubling: at most about 2,000 rows, whatever the corpus
    step = F.floor(F.log2("n") * 32).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["words"]
        if total > words:
            break
        least = r["step"]
    top = counts.where(step >= least).select("word").collect() if least is not None else []
    bpe = WordBPE(spec)
    forms = sorted(r["word"].encode() for r in top)
    name = f"lexicon-{uuid.uuid4().hex}.fst"
    path = os.path.join(tempfile.mkdtemp(prefix="rampart-lexicon-"), name)
    write_lexicon(path, forms, [bpe.merge(w) for w in forms])
    docs.sparkSession.sparkContext.addFile(path)
    return name


def _worker(spec: str, name: str) -> tuple[WordBPE, Lexicon, dict]:
    return hold(("bpe", name), lambda: (WordBPE(spec), Lexicon(SparkFiles.get(name)), {}))


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + size[i]."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - first, size)


def encode_chunk(texts: pa.Array, bpe: WordBPE, lexicon: Lexicon, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, ids before each document) of texts without special tokens."""
    words, number, begin = chunk_words(normalize(texts))
    found = lexicon.numbers(words)
    missing = np.flatnonzero(found < 0)
    merged: list[list[int]] = []
    for w in words.take(pa.array(missing)).to_pylist():
        ids = memo.get(w)
        if ids is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            raw = w.encode()
            ids = bpe.merge(raw)
            if len(raw) <= MEMO_BYTES:
                memo[w] = ids
        merged.append(ids)
    known = found >= 0
    size = np.zeros(len(words), np.int64)
    start = np.zeros(len(words), np.int64)
    start[known] = lexicon.id_start[found[known]]
    size[known] = lexicon.id_start[found[known] + 1] - start[known]
    size[missing] = [len(x) for x in merged]
    base = len(lexicon.ids)
    start[missing] = base + np.cumsum(size[missing]) - size[missing]
    pool = np.concatenate([lexicon.ids, np.array([x for y in merged for x in y], np.uint32)])
    per = size[number]
    ids = pool[expand(start[number], per)]
    return ids, np.r_[0, np.cumsum(per)][begin]


def encode_texts(texts: pa.Array, bpe: WordBPE, lexicon: Lexicon, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Like ``encode_chunk``; strings of special tokens become their ids.

    A text that holds one is cut there: the pieces between are encoded as
    texts of their own and the special ids put back in place.
    """
    texts = pc.fill_null(texts, "")
    special = sorted(bpe.special, key=len, reverse=True)
    hit = np.zeros(len(texts), bool)
    for s in special:
        hit |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if not hit.any():
        return encode_chunk(texts, bpe, lexicon, memo)
    import re
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    pieces: list[str] = []
    marks: list[list[int]] = []              # per document: piece numbers, special ids as negatives
    for t, h in zip(texts.to_pylist(), hit):
        own = []
        for part in cut.split(t) if h else [t]:
            if part in bpe.special:
                own.append(-1 - bpe.special[part])
            else:
                own.append(len(pieces))
                pieces.append(part)
        marks.append(own)
    ids, at = encode_chunk(pa.array(pieces, pa.string()), bpe, lexicon, memo)
    out = [[ids[at[k]:at[k + 1]] if k >= 0 else np.array([-1 - k], np.uint32) for k in own] for own in marks]
    docs = [np.concatenate(x) for x in out]
    return np.concatenate(docs), np.r_[0, np.cumsum([len(x) for x in docs])]


def decode_ids(ids: np.ndarray, at: np.ndarray, bpe: WordBPE) -> pa.Array:
    """Decoded texts: the tokens' strings joined by spaces (the tokenizer has no decoder step)."""
    names = bpe.names.take(pa.array(ids.astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names), " ")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: Iterable[str] = ("doc_id",),
           words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns of ``keep`` with ``ids`` (binary, little-endian
    unsigned 32-bit token ids) and ``decoded`` (the text decoded from those
    ids).  Null and empty texts give empty ids and an empty string; equal
    rows give equal rows; other columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    keep = list(keep)
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = docs.select(*dict.fromkeys([*keep, text]))
    name = build_lexicon(docs, spec.value, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon, memo = _worker(spec.value, name)
        for b in text_chunks(batches, text):
            ids, at = encode_texts(b.column(text), bpe, lexicon, memo)
            raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [
                None, pa.py_buffer(np.ascontiguousarray(at * 4, np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), raw.cast(pa.binary()), decode_ids(ids, at, bpe).cast(pa.string())],
                [*keep, "ids", "decoded"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
