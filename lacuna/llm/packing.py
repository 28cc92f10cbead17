"""Packing: order-preserving dynamic programming.

Documents, in the order in which they are stored, make one stream of token ids (each ends with END_ID). Windows of at most
`window` tokens are cut from it at boundaries: ends of documents (free), ends of sentences (SENTENCE tokens of penalty), and, inside
sentences longer than GAP tokens only, every GAP tokens (HARD penalty). The cuts minimise padding plus penalties:
    cost[j] = penalty[j] + min over i, pos[j] - pos[i] <= window, of cost[i] + window - (pos[j] - pos[i])
where the minimum slides, so that a monotone queue gives each cost in constant time.

Each scan partition is a stream of its own: nothing is shuffled. The optimum is that of the whole stream: the queue runs on from document to
document, and a cut is settled as soon as the best paths to all places in the queue share it; what lies behind it is forgotten. Paths meet
within some hundred windows, so that a task holds a few million tokens as four-byte ids, however long its stream is.

Ids are those of the tokenizer over the whole text. Words are looked up in a cache per worker (two generations of CACHE words, what isn't
used leaves); a text is cut into words only where the tokenizer's own rules always cut.

Defined results: null and empty texts are one token (END_ID); null ids and repeated rows are packed like others; an empty table
gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

WINDOW, END_ID, CACHE = 4096, 2, 150_000
SENTENCE, HARD, GAP = 8, 64, 256
#: A stream looks for settled cuts when another WAITING tokens have come.
WAITING = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Contractions and special tokens, characters on which white space rules differ, letters whose lower case depends on others.
_UNSAFE = ("'", "<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ")
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as the letters from 256 on.
_BYTES = [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else "" for b in range(256)]
_FREE = iter(range(256, 512))
_BYTES = [c or chr(next(_FREE)) for c in _BYTES]
_KEPT: dict = {}


class Known(dict):
    """Ids (as bytes) by word; a word that is missing is looked up in the generation before, or encoded."""

    def __init__(self, encode, limit: int = CACHE):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """encode(texts) -> arrays of ids, equal to the tokenizer's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Known(self._word)
        self.stops = np.array(sorted({int(np.frombuffer(self._raw(x), np.uint32)[-1]) for x in ".!?"}), np.uint32)

    def _raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of letters is one pre-token: the tokenizer's model takes it as it is, once its bytes are letters of the vocabulary."""
        if not word.isalpha():
            return self._raw(word)
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode())))]).tobytes()

    @staticmethod
    def safe(text: str) -> bool:
        """Whether the text may be cut at white space and between letters, digits and signs: no contractions or special tokens, no
        letters whose lower case or normal form depends on their neighbours."""
        return not any(x in text for x in _UNSAFE) and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        get, words, end = self.known.__getitem__, _WORDS.findall, np.uint32(END_ID).tobytes()
        return [np.frombuffer((b"".join(map(get, words(t.lower()))) if self.safe(t) else self._raw(t)) + end, np.uint32) for t in (t or "" for t in texts)]


def boundaries(ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end within a document, ascending, and the penalties; the last is its end."""
    stop = np.zeros(len(ids), bool)
    for x in stops:
        stop |= ids == x
    stop[-1] = True
    at = np.flatnonzero(stop) + 1
    penalty = np.full(len(at), SENTENCE)
    penalty[-1] = 0
    steps = np.diff(at, prepend=0)
    if steps.max() <= GAP:
        return at, penalty
    hard = np.concatenate([np.arange(p + GAP, q, GAP) for p, q in zip((at - steps)[steps > GAP], at[steps > GAP], strict=True)])
    where, penalty = np.concatenate((at, hard)), np.concatenate((penalty, np.full(len(hard), HARD)))
    order = np.argsort(where, kind="stable")
    return where[order], penalty[order]


class Cutter:
    """The windows of least cost over a stream of places (ascending, gaps of at most `window`). Places go in by add(); settled() gives the ends of
    windows that no later place can change, finished() the rest."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost[i] + pos[i], i, pos[i]), keys ascend
        #: Of the places from number `base`, the last settled one, on: position, and number of the place before on its best path.
        self.pos, self.back, self.base = array("q", [0]), array("q", [0]), 0

    def __len__(self) -> int:
        return len(self.pos)

    def add(self, where: list[int], penalty: list[int]) -> None:
        queue, pos, back, window, j = self.queue, self.pos, self.back, self.window, self.base + len(self.pos)
        for p, pen in zip(where, penalty, strict=True):
            low = p - window
            while queue[0][2] < low:
                queue.popleft()
            key, i, _ = queue[0]
            pos.append(p)
            back.append(i)
            key += pen + window  # cost + position: the padding and the penalties so far
            while queue and queue[-1][0] > key:
                queue.pop()
            queue.append((key, j, p))
            j += 1

    def _forget(self, j: int) -> list[int]:
        """Cuts of the best path up to place j, which becomes the base."""
        cuts, at = [], j
        while at > self.base:
            cuts.append(self.pos[at - self.base])
            at = self.back[at - self.base]
        self.pos, self.back, self.base = self.pos[j - self.base :], self.back[j - self.base :], j
        return cuts[::-1]

    def settled(self) -> list[int]:
        """Cuts that the best paths to all places in the queue share: the paths are followed back, the latest place first, until they have met."""
        marks = bytearray(len(self.pos))
        for _, i, _ in self.queue:
            marks[i - self.base] = 1
        paths, j = len(self.queue), len(marks) - 1
        while j > 0 and (paths > 1 or not marks[j]):
            if marks[j]:
                before = self.back[j] - self.base
                paths -= marks[before]
                marks[before] = 1
            j -= 1
        return self._forget(self.base + j)

    def finished(self) -> list[int]:
        """The rest of the cuts of the best path to the last place."""
        return self._forget(self.base + len(self.pos) - 1)


def best_cuts(where: np.ndarray, penalty: np.ndarray, window: int = WINDOW, waiting: int = 4096) -> list[int]:
    """Ends of the windows of least cost; the last is where[-1]. Gaps in where are at most `window`."""
    cutter, out = Cutter(window), []
    for i in range(0, len(where), waiting):
        cutter.add(where[i : i + waiting].tolist(), penalty[i : i + waiting].tolist())
        out += cutter.settled()
    return out + cutter.finished()


class Stream:
    """Documents in, pieces out: (doc_id, start, doc_tokens, sequence, offset, ids)."""

    def __init__(self, stops: np.ndarray, window: int = WINDOW):
        self.stops, self.cutter = stops, Cutter(window)
        self.waiting: deque[tuple] = deque()  # (doc_id, ids, place of its first id in the stream)
        self.tokens = self.sequence = self.begin = 0
        self.look_at = WAITING

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        where, penalty = boundaries(ids, self.stops)
        self.cutter.add((where + self.tokens).tolist(), penalty.tolist())
        self.waiting.append((key, ids, self.tokens))
        self.tokens += len(ids)
        if self.tokens < self.look_at:
            return []
        self.look_at = self.tokens + WAITING
        return self._cut(self.cutter.settled())

    def finish(self) -> list[tuple]:
        return self._cut(self.cutter.finished()) if self.waiting else []

    def _cut(self, cuts: list[int]) -> list[tuple]:
        out = []
        for cut in cuts:
            at = self.begin
            while at < cut:
                key, ids, first = self.waiting[0]
                stop = min(cut, first + len(ids))
                out.append((key, at - first, len(ids), self.sequence, at - self.begin, ids[at - first : stop - first].tobytes()))
                if stop == first + len(ids):
                    self.waiting.popleft()
                at = stop
            self.begin, self.sequence = cut, self.sequence + 1
        return out


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """One row per piece, with its ids (packed little-endian unsigned 32-bit). docs may have the columns file_name and row_index; rows
    of another file then start another stream. sequence_id holds the partition in its upper bits and ascends in order."""
    named = "file_name" in docs.columns
    names = ("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids", "stream")

    def make(batches):
        from pyspark import TaskContext

        if _KEPT.get("path") != tokenizer:
            _KEPT.update(path=tokenizer, encoder=Encoder(tokenizer))
        encoder, base, stream, at = _KEPT["encoder"], TaskContext.get().partitionId() << 33, None, None

        def rows(pieces):
            columns = list(zip(*((k, s, d, base + q, o, b, at) for k, s, d, q, o, b in pieces), strict=True)) or [()] * len(names)
            return dict(zip(names, map(list, columns), strict=True))

        for x in batches:
            out = []
            for key, file, text in zip(x["doc_id"].to_pylist(), x["file_name"].to_pylist() if named else [""] * len(x["t"]), x["t"], strict=True):
                if stream is None or file != at:
                    if stream:
                        yield rows(out + stream.finish())
                        out = []
                    done = stream.sequence if stream else 0
                    at, stream = file, Stream(encoder.stops, window)
                    stream.sequence = done
                out += stream.add(key, encoder.encode([text.as_py()])[0])
            if out:
                yield rows(out)
        if stream:
            yield rows(stream.finish())

    make.whole = True
    rows = docs.select("doc_id", F.col(text).alias("t"), *(["file_name"] if named else []))
    return map_arrow(rows, make, "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary, stream string")


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
