"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text's spaces become marks, and it is cut into marked words at places that no piece of the vocabulary crosses. The
distinct words of a batch are sorted, which lays out their trie depth-first: going from one word to the next keeps the
forward states of their common prefix and computes the rest.

The forward state of a prefix is its best segmentation's value and last piece:
- unigram models: the largest sum of scores (Viterbi), unknown characters at the least score less 10;
- BPE models: a segmentation is the one that merging gives just if each two neighbouring pieces, joined and encoded, come
  apart into themselves, and each prefix has exactly one; so the state is the last piece of that segmentation. The same
  walk keeps Viterbi's state of the vocabulary's scores beside it, so both segmentations come out.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes, about, of the words that a task remembers with their pieces; when there are more, it starts anew.
REMEMBERED = 160 << 20
#: Characters of texts whose words are sorted together, and go back to Spark together.
BATCH_CHARS = 700_000
#: Neighbouring pieces of which a worker remembers whether they come apart; when there are more, it starts anew.
FITS = 200_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers and values."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, b[i : i + n]
            i += n


class Model:
    """A SentencePiece model of type unigram or BPE without text normalisation."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        scores, kinds, self.kind, self.prefix, charsmap, extra = [], [], _UNIGRAM, True, b"", True
        for number, value in _fields(blob):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                scores.append(float(np.frombuffer(got[2], np.float32)[0]) if 2 in got else 0.0)
                kinds.append(got.get(3, _NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                charsmap, self.prefix, extra = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if charsmap or extra or self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models that keep texts as they are")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (_NORMAL, _USER)}
        self.scores = scores
        self.score_of = {p: scores[i] for p, i in self.ids.items()}
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((scores[i] for i in self.ids.values()), default=0.0)
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[1] == MARK and b[0] != MARK for b in inner):
            raise ValueError("a piece goes on after a mark")
        # A word ends where letters meet a sign that no piece has behind a letter, before marks, and around a line's end.
        letter = re.compile(f"[{_LETTERS}]").match
        safe = {chr(c) for c in range(128)} - {b[1] for b in inner if letter(b[0])}
        safe = "".join(re.escape(c) for c in sorted(safe) if not letter(c) and c != "\n")
        lone = "" if any("\n" in b for b in inner) else "\n"
        other = f" {MARK}{lone}{_LETTERS}"
        self.words = re.compile(f"\n|[ {MARK}]*[^{other}]*(?:[{_LETTERS}]+[^{other}{safe}][^{other}]*)*[{_LETTERS}]*" if lone else f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
        self.size = [len(p) for p in self.pieces]
        self.spelling = [bytes((self.of_byte[i],)) if i in self.of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelling[self.unknown] = " ⁇ ".encode()
        # pieces that can end a segmentation: under BPE those that merging their characters gives
        lone_chars = {c for p in self.ids for c in p} <= set(self.ids)
        if self.kind == _BPE and not lone_chars:
            raise ValueError("a BPE model with characters that are no pieces")
        self.reach = {p: i for p, i in self.ids.items() if self.kind == _UNIGRAM or len(p) == 1 or self.merge(p) == [p]}
        # the lengths of the pieces that end with each three characters, or are two of them, or one, longest first
        ends: dict[str, set[int]] = {}
        for p in self.reach:
            ends.setdefault(p[-3:], set()).add(len(p))
        for c, ls in ends.items():
            ls.update(n for n in (1, 2) if c[-n:] in self.reach)
        self.ends = {c: tuple(sorted(ls, reverse=True)) for c, ls in ends.items()}

        self.known_fits: dict[int, bool] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text, with their spaces in front, which joined are the text; no piece crosses their borders."""
        if not text:
            return []
        found = self.words.findall(" " + text if self.prefix else text)
        if not found[-1]:  # the pattern also matches at the end
            found.pop()
        return found

    def endings(self, word: str, end: int) -> tuple[int, ...]:
        """The lengths that a piece may have which ends there in a word, longest first."""
        of = self.ends
        return (of.get(word[end - 3 : end]) if end > 2 else None) or (of.get(word[end - 2 : end]) if end > 1 else None) or of.get(word[end - 1], ())

    def merge(self, s: str) -> list[str]:
        """BPE as defined: the neighbours whose union scores highest are joined, the leftmost of equals first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces, joined and merged, come apart into themselves: whether no merge crosses their border."""
        if len(self.known_fits) >= FITS:
            self.known_fits.clear()
        known = self.known_fits[a << 20 | b] = not self._crosses(self.pieces[a], self.pieces[b])
        return known

    def _crosses(self, x: str, y: str) -> bool:
        parts, border, score = list(x + y), len(x) - 1, self.score_of.get
        found = [score(a + b) for a, b in zip(parts, parts[1:])]  # of each pair of neighbours, null if they don't merge
        while found[border] is not None or any(f is not None for f in found):
            at = max((i for i, f in enumerate(found) if f is not None), key=lambda i: (found[i], -i))
            if at == border:
                return True
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            border -= at < border
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1])
        return False

    def walk(self, words: list[str], both: bool = True) -> Iterator[Word]:
        """Each of the sorted words' segmentations: the trie depth-first, forward states kept for common prefixes.

        The states of a prefix: the last piece of its own segmentation, under BPE; the last piece of its likeliest one and that
        one's sum of scores. A last piece is -1 for a character that is none. Without `both`, BPE models keep the first only, and the
        likeliest segmentation is told as empty.
        """
        before, bpe = "", self.kind == _BPE
        last: list[int] = [0]
        likely: list[int] = [0]
        value = [0.0]
        for word in words:
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], likely[same + 1 :], value[same + 1 :]
            if bpe and not both:
                self._merged(word, same + 1, last)
                before = word
                yield self._back(word, last), b"", 0.0
                continue
            if bpe:
                self._both(word, same + 1, last, likely, value)
            else:
                self._likeliest(word, same + 1, likely, value)
            before = word
            best = self._back(word, likely)
            own = self._back(word, last) if bpe and last != likely else best
            yield own, (own if own == best else best), value[-1]

    def _back(self, word: str, last: list[int]) -> bytes:
        """The ids, as 32-bit numbers, that a word's last pieces lead back to."""
        out: list[int] = []
        end, size = len(word), self.size
        while end:
            k = last[end]
            if k >= 0:
                out.append(k)
                end -= size[k]
            else:
                end -= 1
                out.extend(reversed(self._spelt(word[end])))
        out.reverse()
        return array("i", out).tobytes()

    def _spelt(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _merged(self, word: str, begin: int, last: list[int]) -> None:
        """Further prefixes' last pieces under merging, as in _both()."""
        reach, known = self.reach, self.known_fits
        for end in range(begin, len(word) + 1):
            found = -1
            for n in self.endings(word, end):
                if n > end or (k := reach.get(word[end - n : end])) is None:
                    continue
                if n < end and (a := last[end - n]) >= 0:
                    fits = known.get(a << 20 | k)
                    if not (self.fits(a, k) if fits is None else fits):
                        continue
                found = k
                break
            last.append(found)

    def _both(self, word: str, begin: int, last: list[int], likely: list[int], value: list[float]) -> None:
        """Further prefixes' states. Under merging the last piece is the longest that comes apart from what is before it; Viterbi
        takes the largest sum of scores, the shortest last piece of equals."""
        reach, ends, known, scores = self.reach, self.ends, self.known_fits, self.scores
        for end in range(begin, len(word) + 1):
            found = which = -1
            best = 0.0
            for n in (ends.get(word[end - 3 : end]) if end > 2 else None) or (ends.get(word[end - 2 : end]) if end > 1 else None) or ends.get(word[end - 1], ()):
                if n > end or (k := reach.get(word[end - n : end])) is None:
                    continue
                if which < 0 or value[end - n] + scores[k] >= best:
                    best, which = value[end - n] + scores[k], k
                if found < 0:
                    if n < end and (a := last[end - n]) >= 0:  # no piece holds a character that is none
                        fits = known.get(a << 20 | k)
                        if not (self.fits(a, k) if fits is None else fits):
                            continue
                    found = k
            last.append(found)
            likely.append(which)
            value.append(best if which >= 0 else value[end - 1] + self.least - 10.0)

    def _likeliest(self, word: str, begin: int, last: list[int], value: list[float]) -> None:
        """Viterbi: each further prefix's largest sum of scores, and the last piece of it; the first found of equals."""
        for end in range(begin, len(word) + 1):
            which, best = -1, value[end - 1] + self.least - 10.0
            for n in reversed(self.endings(word, end)):
                if n <= end and (k := self.ids.get(word[end - n : end])) is not None and (n == 1 or value[end - n] + self.scores[k] > best):
                    best, which = value[end - n] + self.scores[k], k
            last.append(which)
            value.append(best)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the one put in front goes, byte pieces are read as UTF-8."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


#: Of a marked word: the ids of its segmentation, those of its likeliest one (the same for unigram models), and that one's sum of scores.
Word = tuple[bytes, bytes, float]
_IDS, _LIKELY, _SCORE = map(itemgetter, range(3))


@contextmanager
def _no_collector() -> Iterator[None]:
    """Without the search for reference cycles, which would look through all words again and again and find none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _give_back() -> None:
    """Freed memory goes back to the system: workers live on between tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@cache
def _model(blob: bytes) -> Model:
    """A worker's model; what it learns of neighbours is bounded by FITS."""
    return Model(blob)


class Memo:
    """Segmentations of words that a task remembers from batch to batch."""

    def __init__(self, model: Model, limit: int = REMEMBERED, both: bool = True):
        self.model, self.limit, self.held, self.both = model, limit, 0, both
        self.words: dict[str, Word] = {}

    def forget(self) -> None:
        self.words.clear()
        self.held = 0

    def segment(self, texts: list[str]) -> list[list[Word]]:
        """The segmentations of each text's words, in order."""
        if self.held > self.limit:
            self.forget()
        cut = [self.model.split(t) for t in texts]
        new = sorted((w.replace(" ", MARK), w) for w in set(chain.from_iterable(cut)).difference(self.words))
        for (_, w), found in zip(new, self.model.walk([marked for marked, _ in new], self.both)):
            self.words[w] = found
            self.held += len(w) + 2 * len(found[0]) + 320  # with what the objects and the table take
        return [list(map(self.words.__getitem__, ws)) for ws in cut]


def _numbers(ids: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.int32)


def encode_batch(model: Model, texts: list[str], memo: Memo | None = None) -> list[np.ndarray]:
    return [_numbers(map(_IDS, ws)) for ws in (memo or Memo(model, both=False)).segment(texts)]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batches(col: pa.Array) -> Iterator[pa.Array]:
    """A column of texts, some rows at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, side="right")))
        yield col.slice(at, until - at)
        at = until


def _lists(col: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    """The ids as an array of lists, null where the text is."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(col))


def encode(docs: DataFrame, blob: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with one more column, an array of piece ids; blob is the model file's content.

    A null text has null ids, an empty one none. Texts of any length are encoded whole. Rows are neither moved nor
    dropped, repeated ones stay; a column that is already called `ids` is replaced; an empty table stays empty.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(blob)  # half a megabyte

    @F.arrow_udf("array<int>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(_model(broadcast.value), both=False)
        with _no_collector():
            for col in parts:
                for some in _batches(col):
                    yield _lists(some, encode_batch(memo.model, [t or "" for t in some.to_pylist()], memo))
        memo.forget()
        _give_back()

    return docs.withColumn(ids, of(F.col(text).cast("string")))


def decode(rows: DataFrame, blob: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text that their ids spell. Null ids give null, no ids an empty text."""
    broadcast = rows.sparkSession.sparkContext.broadcast(blob)

    @F.arrow_udf("string")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in parts:
            model = _model(broadcast.value)
            yield pa.array([model.decode(x.as_py()) if x.is_valid else None for x in col], pa.string())

    return rows.withColumn(text, of(F.col(ids)))


def encode_checked(
    docs: DataFrame, blob: bytes, text: str = "text", out: str = "coded", likely: bool = True, remembered: int = REMEMBERED
) -> DataFrame:
    """docs with a struct: ids, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_chars, decoded_sha256, round_trip, and of
    the likeliest segmentation n_likely (its ids), likely_sha256 and likely_score (its sum of scores, 4 places); null unless `likely`.

    encode() and decode() in one pass through Python, without sending the decoded text back. A null text has null fields; an empty
    one no ids, which decode to it. Repeated rows stay, an empty table stays empty, and a column of the name `out` is replaced.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(blob)
    kinds = {
        "ids_sha256": pa.string(), "decoded_chars": pa.int64(), "decoded_sha256": pa.string(), "round_trip": pa.bool_(),
        "n_likely": pa.int64(), "likely_sha256": pa.string(), "likely_score": pa.float64(),
    }
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @F.arrow_udf(
        "struct<ids:array<int>,ids_sha256:string,decoded_chars:long,decoded_sha256:string,round_trip:boolean,n_likely:long,likely_sha256:string,likely_score:double>"
    )
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(broadcast.value)
        memo = Memo(model, remembered, likely)
        with _no_collector():
            for col in parts:
                for some in _batches(col):
                    texts = some.to_pylist()
                    ids: list[np.ndarray] = []
                    told: list[tuple] = []
                    for t, words in zip(texts, memo.segment([t or "" for t in texts])):
                        x = _numbers(map(_IDS, words))
                        ids.append(x)
                        if t is None:
                            told.append((None,) * len(kinds))
                            continue
                        best = b"".join(map(_LIKELY, words))
                        back = model.decode(x.tolist())
                        told.append(
                            (sha(x), len(back), sha(back.encode("utf-8", "surrogatepass")), back == t)
                            + ((len(best) // 4, sha(best), round(sum(map(_SCORE, words)), 4)) if likely else (None, None, None))
                        )
                    rest = [pa.array([r[k] for r in told], kind) for k, kind in enumerate(kinds.values())]
                    yield pa.StructArray.from_arrays([_lists(some, ids), *rest], names=["ids", *kinds])
        memo.forget()
        _give_back()

    return docs.withColumn(out, of(F.col(text).cast("string")))
