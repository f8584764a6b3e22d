"""Text that was decoded with the wrong character encoding: finding it and restoring what can be restored.

Smoothed character n-gram models are trained on clean records. Every candidate chain (the encoding that was used by
mistake and the true one, also after text was misread as UTF-8 before) is undone on every word beyond ASCII, each outcome
is scored, and the likeliest is accepted if it beats the word as it stands by a margin validated on all clean records.

Whether a word is garbled depends on the word alone. So the corpus is reduced to its different words in the JVM, each is
judged once, in array batches, and verdicts are joined back to the records that hold the word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import durable

# Single-byte encodings in common use for languages of Latin, Greek and Cyrillic letters.
ENCODINGS = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp737", "cp850", "cp866", "mac_roman", "koi8-r",
    "iso8859-2", "iso8859-5", "iso8859-7", "mac_cyrillic",
)
#: A character of the text as it stands is no stronger evidence than one of this probability: a clean text may hold a sign
#: no other text holds. A reading has no such grace.
FLOOR, FLOOR_OF_READING = 1e-7, 1e-15
#: Triples of characters a model holds at most, 24 bytes each in a table of eight times as many places. Alphabets have some
#: hundred thousand; beyond the bound the rarest are left to the shorter contexts, as in any pruned n-gram model.
MAX_TRIPLES = 1 << 21
#: Shares of the frequency of a character alone, after one and after two others.
WEIGHTS = (0.08, 0.27, 0.65)
LOST = "\ufffd"
_SPACE_OR_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\xad]")
_HIGH = 0x110000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _table(encoding: str) -> list[str]:
    """The character of each byte; bytes the encoding leaves open stand for the control of the same number."""
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


DECODE = {e: _table(e) for e in ENCODINGS}
ENCODE = {e: {ch: b for b, ch in reversed(list(enumerate(t)))} for e, t in DECODE.items()}


def undo(text: str, wrong: str, true: str) -> str | None:
    """``text`` as it reads if it was ``true`` decoded as ``wrong``; ``None`` if it can't have been."""
    try:
        raw = bytes(ENCODE[wrong][ch] for ch in text)
    except KeyError:
        return None
    if true == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = DECODE[true]
    outcome = "".join(table[b] for b in raw)
    # Any bytes are some text in a single-byte encoding; one with spaces or controls inside a word is not what was written.
    return None if _SPACE_OR_CONTROL.search(outcome) else outcome


def undo_utf8_places(text: str, wrong: str) -> str | None:
    """``text`` with every place undone that is a UTF-8 sequence decoded as ``wrong``; ``None`` if there is none."""
    words = Words.of([text])
    found = words.undo_utf8(wrong)
    return None if found is None else found.text(0)


def read(text: str, chain: str) -> str | None:
    """``text`` undone by a chain such as ``cp1252>utf-8`` or ``cp1252>utf-8>cp850>utf-8``; ``None`` if it can't be."""
    names = chain.split(">")
    for wrong, true in zip(names[::2], names[1::2]):
        if text is not None:
            text = undo_utf8_places(text, wrong) if true == "utf-8" else undo(text, wrong, true)
    return text


def chain_name(*steps: tuple[str, str]) -> str:
    return ">".join(name for step in steps for name in step)


SINGLE: tuple[tuple[str, str], ...] = tuple((w, "utf-8") for w in ENCODINGS) + tuple((w, t) for w in ENCODINGS for t in ENCODINGS if w != t)
#: Every chain that is tried: each single one, and each of them again on a text that was misread as UTF-8.
CHAINS: tuple[str, ...] = tuple(chain_name(s) for s in SINGLE) + tuple(chain_name((w, "utf-8"), s) for w in ENCODINGS for s in SINGLE)


def _bytes_of(encoding: str) -> np.ndarray:
    """The byte of each character of the basic plane in an encoding; -1 where it has none."""
    out = np.full(1 << 16, -1, dtype=np.int16)
    for ch, b in ENCODE[encoding].items():
        out[ord(ch)] = b
    return out


def _shown_as(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points: digits are one symbol, white space and the no-break spaces are a space."""
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    return np.where(((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x202F), 32, codes).astype(np.uint32)


_BYTES = {e: _bytes_of(e) for e in ENCODINGS}
_CODES = {e: np.array([ord(ch) for ch in t], dtype=np.uint32) for e, t in DECODE.items()}
_SYMBOLS = {e: _shown_as(c) for e, c in _CODES.items()}
_MARKS = {e: (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (c.astype(np.uint64) << np.uint64(29)) for e, c in _CODES.items()}
_UNFIT = {e: np.array([bool(_SPACE_OR_CONTROL.match(ch)) and ord(ch) > 127 for ch in t]) for e, t in DECODE.items()}


@dataclass
class Words:
    """Many words in one array of code points, each after two spaces and before one: the contexts its ends are scored in."""

    codes: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(words: Sequence[str]) -> Words:
        return Words.joined([f"  {w} " for w in words])

    @staticmethod
    def joined(parts: Sequence[str]) -> Words:
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return Words(flat, _begins(np.array([len(w) for w in parts], dtype=np.int64)) if len(parts) else np.zeros(0, dtype=np.int64))

    def __len__(self) -> int:
        return len(self.starts)

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.codes)))

    def text(self, i: int) -> str:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.codes)
        return self.codes[self.starts[i] + 2 : end - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def take(self, chosen: np.ndarray) -> Words:
        """The words at the given places, in their order."""
        lengths = self.lengths()
        kept = np.zeros(len(self.starts), dtype=bool)
        kept[chosen] = True
        return self if kept.all() else Words(self.codes[np.repeat(kept, lengths)], _begins(lengths[kept]) if kept.any() else np.zeros(0, dtype=np.int64))

    def marks(self, values: np.ndarray) -> np.ndarray:
        """A 64-bit mark of the values of each word, in their order."""
        place = np.arange(len(values), dtype=np.uint64) - np.repeat(self.starts, self.lengths()).astype(np.uint64)
        return np.add.reduceat(values * (place * _SPREAD | np.uint64(1)), self.starts)

    def any_in(self, flags: np.ndarray) -> np.ndarray:
        """For each word whether a flag is set in it."""
        return np.logical_or.reduceat(flags, self.starts) if len(self.starts) else np.zeros(0, dtype=bool)

    def bytes_in(self, wrong: str) -> np.ndarray:
        return np.where(self.codes < 1 << 16, _BYTES[wrong][self.codes & 0xFFFF], -1)

    def undo_utf8(self, wrong: str, hit_words: list | None = None) -> Words | None:
        """The words with a UTF-8 sequence decoded as ``wrong``, all such sequences undone; ``None`` if no word has one.

        Their places go to ``hit_words`` if it is given.
        """
        b = self.bytes_in(wrong).astype(np.int32)
        n = len(b)
        ahead = np.full((3, n), -1, dtype=np.int32)
        for k in (1, 2, 3):
            ahead[k - 1, : n - k] = b[k:]
        cont = (ahead >= 0x80) & (ahead <= 0xBF)
        one = (b >= 0xC2) & (b <= 0xDF) & cont[0]
        if not one.any() and not ((b >= 0xE0) & (b <= 0xF4) & cont[0]).any():
            return None
        two = (b >= 0xE0) & (b <= 0xEF) & cont[0] & cont[1]
        three = (b >= 0xF0) & (b <= 0xF4) & cont[0] & cont[1] & cont[2]
        value2 = ((b & 0x0F) << 12) | ((ahead[0] & 0x3F) << 6) | (ahead[1] & 0x3F)
        value3 = ((b & 0x07) << 18) | ((ahead[0] & 0x3F) << 12) | ((ahead[1] & 0x3F) << 6) | (ahead[2] & 0x3F)
        two &= (value2 >= 0x800) & ((value2 < 0xD800) | (value2 > 0xDFFF))
        three &= (value3 >= 0x10000) & (value3 < _HIGH)
        starts_here = one | two | three
        if not starts_here.any():
            return None
        codes = np.where(one, ((b & 0x1F) << 6) | (ahead[0] & 0x3F), np.where(two, value2, np.where(three, value3, self.codes))).astype(np.uint32)
        drop = np.zeros(n + 3, dtype=bool)
        for k, which in ((1, starts_here), (2, two | three), (3, three)):
            drop[k : n + k] |= which
        hit = self.any_in(starts_here)
        if hit_words is not None:
            hit_words.append(np.flatnonzero(hit))
        keep = np.repeat(hit, self.lengths()) & ~drop[:n]
        sizes = np.add.reduceat(keep.astype(np.int64), self.starts)[hit]
        return Words(codes[keep], _begins(sizes))


class Table:
    """Exact n-grams (an integer each) with two numbers, by open addressing in arrays: a look-up costs a few array steps."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(8, (8 * len(grams)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, dtype=np.uint64), np.zeros((size, 2), dtype=np.float32)
        wanted, left, step = grams.astype(np.uint64) + np.uint64(1), np.arange(len(grams)), 0
        while len(left):
            at = (self._home(wanted[left]) + step) & (size - 1)
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = wanted[left[won]], values[left[won]]
            left, step = np.delete(left, won), step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The two numbers of each n-gram, zeros for those that are not held."""
        wanted = grams + np.uint64(1)
        at = self._home(wanted)
        held = self.keys[at]
        out = self.values[at]
        miss = held != wanted
        out[miss] = 0
        left = np.flatnonzero(miss & (held != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == wanted[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (held != 0)
            left, at = left[more], at[more]
        return out


class Model:
    """Interpolated probability of a character after two others: fixed shares of its own frequency and of that after one and two.

    Fixed shares, since the texts are of many languages: a triple that a frequent context has never shown may be common in
    a language that few of the texts are in.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        """From triples of characters, three code points of 21 bits each in an integer, and their counts."""
        # A text is judged as if it alone had not taught: otherwise a garble of one text would be sure of its own rare pieces.
        grams, n = grams.astype(np.int64), n.astype(np.float64) - 1
        grams, n = grams[n > 0], n[n > 0]

        def shares(held: np.ndarray, counts: np.ndarray) -> np.ndarray:
            """The share of each n-gram in those of its context."""
            contexts, place = np.unique(held >> 21, return_inverse=True)
            return counts / np.bincount(place, counts, len(contexts))[place] if len(held) else counts

        self.three = Table(grams, np.stack([WEIGHTS[2] * shares(grams, n), n], axis=1))
        pairs, place = np.unique(grams & ((1 << 42) - 1), return_inverse=True)
        counts = np.bincount(place, n, len(pairs))
        self.two = Table(pairs, np.stack([WEIGHTS[1] * shares(pairs, counts), counts], axis=1))
        one = np.bincount(grams & ((1 << 21) - 1), n, _HIGH)
        self.one = (WEIGHTS[0] * one / max(1.0, one.sum())).astype(np.float32)

    def scores(self, s: np.ndarray, starts: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray]:
        """``(log probability of each symbol, count of the rarest triple of each word)`` of a flat array of words.

        The two symbols a word begins with are given and come out as 0.
        """
        wide = s.astype(np.uint64)
        grams = (wide[:-1] << np.uint64(21)) | wide[1:]
        triple = self.three((wide[:-2] << np.uint64(42)) | grams[1:])
        p = np.zeros(len(s), dtype=np.float32)
        p[2:] = np.log(np.maximum(triple[:, 0] + self.two(grams[1:])[:, 0] + self.one[s[2:]], np.float32(floor)))
        count = np.empty(len(s), dtype=np.float32)
        count[2:] = triple[:, 1]
        for at in (starts, starts + 1):
            p[at], count[at] = 0, np.inf
        return p, np.minimum.reduceat(count, starts)


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def readings(words: Words, nested: bool = True) -> Iterator[tuple[tuple[tuple[str, str], ...], np.ndarray, np.ndarray, np.ndarray]]:
    """``(chain, places of the words it can have made, their outcomes as flat symbols, starts)`` of every chain.

    An outcome that an earlier chain gave too is not given again, as far as both share the wrong or the true encoding.
    """
    if not len(words):
        return
    tried: list[np.ndarray] = []
    singles = []
    for wrong in ENCODINGS:
        b = words.bytes_in(wrong)
        fresh = ~words.any_in(b < 0)
        marks = words.marks(b.astype(np.uint64))
        for other in tried:
            fresh &= marks != other
        tried.append(np.where(fresh, marks, np.uint64(0)))
        singles.append((wrong, np.flatnonzero(fresh)))
    for wrong in ENCODINGS:
        held: list[np.ndarray] = []
        once = words.undo_utf8(wrong, held)
        if once is not None:
            yield ((wrong, "utf-8"),), held[0], _shown_as(once.codes), once.starts
            beyond = np.flatnonzero(once.any_in(once.codes > 127))
            if nested and len(beyond):
                for chain, at, symbols, starts in readings(once.take(beyond), False):
                    yield ((wrong, "utf-8"), *chain), held[0][beyond[at]], symbols, starts
    for wrong, fit in singles:
        if not len(fit):
            continue
        some = words.take(fit)
        raw, lengths = some.bytes_in(wrong).astype(np.uint8), some.lengths()
        given = [some.marks(_MARKS[wrong][raw])]
        for true in ENCODINGS:
            if true == wrong:
                continue
            marks = some.marks(_MARKS[true][raw])
            fresh = ~some.any_in(_UNFIT[true][raw])
            for other in given:
                fresh &= marks != other
            given.append(marks)
            if fresh.any():
                yield ((wrong, true),), fit[fresh], _SYMBOLS[true][raw[np.repeat(fresh, lengths)]], _begins(lengths[fresh])


def judge(model: Model, words: Sequence[str], least: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """``(gain, chain)`` of the likeliest reading of each word; gain 0 where none gains more than ``least``.

    Every chain is scored for every word that could gain that much. What a chain can change are the characters beyond
    ASCII and the two after each, and no outcome is likelier than certain: so a word in which those lose no more than
    ``least`` can't gain it by any chain. A lone character may always be a correct letter of some language and is never
    evidence; it is restored where its text holds evidence for a chain.
    """
    return judge_windows(model, [window(w) for w in words], least)


def judge_windows(model: Model, windows: Sequence[str], least: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """As ``judge``, for what ``window`` gives."""
    gains, chains = np.zeros(len(windows), dtype=np.float32), [""] * len(windows)
    if not len(windows):
        return gains, chains
    every = Words.joined(windows)
    p, rarest = model.scores(_shown_as(every.codes), every.starts)
    could = np.flatnonzero((-np.add.reduceat(p, every.starts) > least) & ~np.array([_LONE.fullmatch(w) is not None for w in windows]))
    if not len(could):
        return gains, chains
    base, rarest = np.add.reduceat(p, every.starts)[could], rarest[could]
    best, which, seen = np.full(len(could), np.float32(least)), np.full(len(could), -1), []
    for chain, at, symbols, starts in readings(every.take(could)):
        p, attested = model.scores(symbols, starts, FLOOR_OF_READING)
        gain = np.add.reduceat(p, starts) - base[at]
        # What was written is the more common spelling: garble comes from a part of the texts that hold its original.
        better = (gain > best[at]) & (2 * (attested + 1) >= rarest[at])
        if better.any():
            best[at[better]] = gain[better]
            which[at[better]] = len(seen)
        seen.append(chain)
    for i in np.flatnonzero(which >= 0):
        gains[could[i]], chains[could[i]] = best[i], chain_name(*seen[which[i]])
    return gains, chains


#: What of a word between spaces a chain can change the likelihood of: from two symbols before its first character
#: beyond ASCII to two after its last.
_WINDOW = "(?s)[\\x00-\\x7f]{2}[^\\x00-\\x7f](?:.*[^\\x00-\\x7f])?.{0,2}"
_CUT = re.compile(_WINDOW)
_LONE = re.compile("(?s)  . ")


def window(word: str) -> str:
    """The stretch of a word with characters beyond ASCII in which readings differ, with its context."""
    return _CUT.search(f"  {word} ")[0]


#: Encodings as which UTF-8 is misread so often that a run which could be that keeps a record out of the training.
_TELLTALE = frozenset(("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"))
#: In the others of ENCODINGS a short word in capitals can be one by chance ("ТВ" in iso8859-5): there one character
#: alone counts only beside a Latin letter.
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_BROKEN = re.compile("[\x80-\x9f" + LOST + "]")
#: What misread UTF-8 of these languages stands for: letters of Latin, Greek and Russian, and printed punctuation.
_EXPECTED = re.compile("[\u00a0-\u017f\u0370-\u03ff\u0400-\u045f\u2010-\u2044\u20ac\u2116\u2122]+")


def plainly_clean(text: str, encodings: Sequence[str] = ENCODINGS) -> bool:
    """No character is lost, no control of the C1 block occurs and no run reads as misread UTF-8: fit for training."""
    if _BROKEN.search(text):
        return False
    for m in _RUN.finditer(text):
        beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        glued = any(ch.isalpha() for ch in beside)
        for e in encodings:
            r = undo(m[0], e, "utf-8")
            if r is not None and _EXPECTED.fullmatch(r) and (e in _TELLTALE or glued or len(r) > 1):
                return False
    return True


def screened(words: Sequence[str]) -> np.ndarray:
    """For each word whether it is not plainly clean; only words with a UTF-8 sequence in some encoding are looked at one by one."""
    out = np.array([bool(_BROKEN.search(w)) for w in words], dtype=bool)
    every = Words.of(words)
    for e in ENCODINGS:
        held: list[np.ndarray] = []
        if every.undo_utf8(e, held) is not None:
            for i in held[0]:
                out[i] = out[i] or not plainly_clean(words[i], (e,))
    return out


# Spark side. A word is an unbroken run of characters other than these four.
_GAP = "[ \\t\\r\\n]+"
_ODD_WORD = "(?<![^ \\t\\r\\n])[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x21-\\x7f]*+[^\\x00-\\x7f][^ \\t\\r\\n]*"


def _words(text: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.split(text, _GAP))


def _odd_words(text: Column) -> Column:
    """The different words of a text with a character beyond ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_ODD_WORD), 0))


def _beyond_ascii(column: Column) -> Column:
    return column.rlike("[^\\x00-\\x7f]")


def _tasks(df: DataFrame) -> int:
    """Tasks for steps that spend long on each row; stated, since the adaptive plan would go by the few bytes."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_TRIPLE_SCHEMA = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def triples(words: DataFrame) -> DataFrame:
    """``(gram, n)`` of the triples of characters of ``(word, n)``: three code points of 21 bits, and how often they follow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Words.of(batch.column(0).to_pylist())
            if not len(some):
                continue
            s = _shown_as(some.codes).astype(np.int64)
            gram = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
            inner = np.ones(len(s), dtype=bool)
            inner[some.starts] = inner[some.starts + 1] = False
            n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), some.lengths())
            kinds, place = np.unique(gram[inner[2:]], return_inverse=True)
            sums = np.bincount(place, n[2:][inner[2:]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(sums)], _TRIPLE_SCHEMA.names)

    return words.select("word", "n").mapInArrow(cut, _TRIPLE_SCHEMA).groupBy("gram").agg(F.sum("n").alias("n"))


def train(words: DataFrame, max_triples: int = MAX_TRIPLES) -> Model:
    """A model of ``(word, n)``, ``n`` being the number of different clean texts with the word; words with n < 1 teach nothing.

    What reaches the driver are the counts of at most ``max_triples`` triples of characters, whatever the corpus. A triple
    that occurs once teaches nothing, as one text is left out of every count.
    """
    counted = triples(words.filter("n > 0")).filter("n > 1").orderBy(F.desc("n"), "gram").limit(max_triples).toPandas()
    return Model(counted["gram"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64))


def judged(words: DataFrame, model: Model, least: float) -> DataFrame:
    """``(word, gain, chain)`` of the words of which a reading gains more than ``least``. Equal windows are judged once."""
    held = words.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("window", T.StringType()), T.StructField("gain", T.DoubleType()), T.StructField("chain", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            gains, chains = judge_windows(held.value, found, least)
            at = np.flatnonzero(gains > least)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in at]), pa.array(gains[at].astype(np.float64)), pa.array([chains[i] for i in at])], out.names)

    cut = words.select("word", F.regexp_extract(F.concat(F.lit("  "), "word", F.lit(" ")), _WINDOW, 0).alias("window"))
    return cut.join(cut.select("window").distinct().repartition(_tasks(words)).mapInArrow(score, out), "window").select("word", "gain", "chain")


def margin_of(clean: dict[float, int], garbled: dict[float, int], clean_weight: float = 20.0, prior: float = 1.0) -> float:
    """The margin that errs least on validated gains, each with its number of records: clean ones and ones garbled in a place.

    A clean record above it costs ``clean_weight`` missed garbled ones. To both come pseudo-records of weight ``prior`` in
    all, spread evenly over gains from 0 to 10 (clean) and from 10 to 20 (garbled): they decide only where nothing else
    does, as in an empty table. The middle of the best range is taken. A record that counts as clean but gains more than a
    quarter of the garbled ones do is garbled in truth and is left out.
    """
    steps = np.arange(0.25, 10.0, 0.5)

    def shares(records: dict[float, int], shift: float) -> tuple[np.ndarray, np.ndarray]:
        """Gains in order and the shares of the records up to each, after none at first."""
        gains = np.concatenate([np.array(list(records), dtype=np.float64), steps + shift])
        n = np.concatenate([np.array(list(records.values()), dtype=np.float64), np.full(len(steps), prior / len(steps))])
        order = np.argsort(gains, kind="stable")
        return gains[order], np.concatenate([[0.0], np.cumsum(n[order]) / n.sum()])

    if garbled:
        most, upto = sum(garbled.values()) / 4, 0
        for sure in sorted(garbled):
            upto += garbled[sure]
            if upto >= most:
                break
        clean = {g: n for g, n in clean.items() if g <= sure}
    (low, low_upto), (high, high_upto) = shares(clean, 0.0), shares(garbled, 10.0)
    edges = np.unique(np.concatenate([low, high, [0.0]]))
    cost = clean_weight * (1 - low_upto[np.searchsorted(low, edges, "right")]) + high_upto[np.searchsorted(high, edges, "right")]
    at = int(np.argmin(np.round(cost, 12)))
    return float((edges[at] + edges[min(at + 1, len(edges) - 1)]) / 2)


def garble(text: str, chain: str) -> str | None:
    """``text`` as it looks after a chain of wrong decodings; ``None`` if the text can't be written in its encodings."""
    names = chain.split(">")
    for wrong, true in reversed(list(zip(names[::2], names[1::2]))):
        try:
            raw = text.encode("utf-8") if true == "utf-8" else bytes(ENCODE[true][ch] for ch in text)
        except (KeyError, UnicodeEncodeError):
            return None
        text = "".join(DECODE[wrong][b] for b in raw)
    return text


def garbled_gains(texts: DataFrame, model: Model, least: float, places: int = 3) -> DataFrame:
    """``(tid, gain)`` of texts ``(tid, words)``, words between spaces: the largest gain of up to ``places`` words that a chain garbled.

    The chain and the words follow from ``tid``. A text none of whose words the chain can garble gives no row.
    """
    held = texts.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("tid", T.LongType()), T.StructField("gain", T.DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples: list[tuple[int, list[str]]] = []
            for tid, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chain = chain_name(SINGLE[tid % len(SINGLE)])
                broken: list[str] = []
                for w in sorted(words.split(" "), key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass"), tid & 0xFFFFFFFF), w)):
                    b = garble(w, chain)
                    if b is not None and b != w and not any(ch.isspace() for ch in b):
                        broken.append(window(b) if not b.isascii() else "")
                        if len(broken) == places:
                            break
                if broken:
                    samples.append((tid, broken))
            kinds = sorted({w for _, broken in samples for w in broken if w})
            gain_of = dict(zip(kinds, judge_windows(held.value, kinds, least)[0].tolist()))
            if samples:
                gains = [max(gain_of.get(w, 0.0) for w in broken) for _, broken in samples]
                yield pa.RecordBatch.from_arrays([pa.array([tid for tid, _ in samples], pa.int64()), pa.array(gains, pa.float64())], schema.names)

    return texts.select("tid", "words").mapInArrow(measure, schema)


#: Gains are counted to the hundredth and none beyond this, so that their histogram stays small for any corpus.
MOST_GAIN = 1000.0


def histogram(gains: DataFrame) -> dict[float, int]:
    """How many rows have each ``gain``; at most 100,001 different ones reach the driver."""
    binned = F.round(F.least("gain", F.lit(MOST_GAIN)), 2)
    return {r.gain: r.n for r in gains.groupBy(binned.alias("gain")).agg(F.count("*").alias("n")).collect()}


@dataclass
class Learned:
    """What a corpus teaches: the model, the margin, the words that read better otherwise, ``(word, gain, chain)``, and the
    texts that hold one, ``(tid, tid2, gain)`` with the largest gain of their words."""

    model: Model
    margin: float
    garbled: DataFrame
    holders: DataFrame


_TEXT_ID = ("tid", "tid2")


def text_id(text: Column) -> list[Column]:
    """128 bits that stand for a text, as ``tid`` and ``tid2``."""
    return [F.xxhash64(text, F.lit(7)).alias("tid"), F.xxhash64(F.lit(13), text).alias("tid2")]


def learn(rows: DataFrame, text: str, doubt: float = 2.0, surely: float = 12.0, least: float = 5.0, max_triples: int = MAX_TRIPLES) -> Learned:
    """Trains on the clean texts of ``rows``, validates the margin on all of them and judges every word.

    First every word that is plainly clean teaches a model; each word is counted once in every different text, so neither
    a long record nor copies of one can teach the model its own garble. Texts with a word that isn't plainly clean, or
    that a reading betters by more than ``doubt``, are then taken out whole, and the model is made anew from the rest.

    Every different text with a character beyond ASCII validates the margin, as it is and garbled in a place, save those
    with a word that is not plainly clean or bettered by more than ``surely``: wide enough that texts with rare but correct
    words stay among them. No text is held out for it, since the model leaves one text out of every count. Gains up to
    ``least`` count as none: no margin lies there but where hardly any text is garbled.
    """

    def counted(texts: DataFrame) -> DataFrame:
        return texts.select(F.explode(_words(F.col(text))).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))

    vocabulary = durable(counted(rows.select(text).distinct()).withColumn("odd", _beyond_ascii(F.col("word"))))
    plain = vocabulary.filter("NOT odd")
    odd = vocabulary.filter("odd")
    # Words that are not plainly clean teach nothing in the first model either.
    screen = durable(_screen(odd))
    first = train(plain.select("word", "n").unionByName(screen.filter("NOT dirty").select("word", "n")), max_triples)
    doubted = judged(screen.filter("NOT dirty"), first, doubt).select("word", "gain")
    doubted = durable(doubted.unionByName(screen.filter("dirty").select("word", F.lit(float("inf")).alias("gain"))))
    held = rows.filter(_beyond_ascii(F.col(text))).select(*text_id(F.col(text)), F.array_join(_odd_words(F.col(text)), " ").alias("words"))
    held = durable(held.groupBy(*_TEXT_ID).agg(F.first("words").alias("words")).withColumn("no", F.monotonically_increasing_id()))

    def holders_of(words: DataFrame) -> DataFrame:
        """The texts with one of ``(word, gain)`` and the largest gain of their words."""
        pairs = held.select("no", F.explode(F.split("words", " ")).alias("word"))  # numbers, since random ids don't compress
        found = pairs.join(words.select("word", "gain"), "word").groupBy("no").agg(F.max("gain").alias("gain"))
        return durable(found.join(held.select("no", *_TEXT_ID), "no").drop("no"))

    unclean = holders_of(doubted)
    taken = counted(rows.select(text, *text_id(F.col(text))).join(unclean, [*_TEXT_ID], "left_semi").select(text).distinct())
    left = vocabulary.join(taken.select("word", F.col("n").alias("_m")), "word", "left").select("word", (F.col("n") - F.coalesce("_m", F.lit(0))).alias("n"))
    model = train(left, max_triples)

    def bettered(by: float) -> tuple[DataFrame, DataFrame]:
        words = durable(judged(odd, model, by))
        return words, holders_of(words)

    words, holders = bettered(least)
    clean = held.repartition(_tasks(held), "tid").join(unclean.filter(F.col("gain") > surely).select("tid"), "tid", "left_anti")
    gains = held.select("tid").join(unclean.filter(F.col("gain") > surely).select("tid"), "tid", "left_anti").join(holders.select("tid", "gain"), "tid", "left")
    margin = margin_of(histogram(gains.select(F.coalesce("gain", F.lit(0.0)).alias("gain"))), histogram(garbled_gains(clean, model, least)))
    if margin < least:
        words, holders = bettered(margin)
    return Learned(model, margin, words.filter(F.col("gain") > margin), holders.filter(F.col("gain") > margin))


def _screen(words: DataFrame) -> DataFrame:
    """``(word, n, dirty)``: whether a word is not plainly clean."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("dirty", T.BooleanType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(screened(batch.column(0).to_pylist()))], schema.names)

    return words.select("word", "n").mapInArrow(look, schema)


def garbled_keys(df: DataFrame, key: str = "doc_id", text: str = "text", learned: Learned | None = None) -> DataFrame:
    """``(key, gain)`` of every garbled record, once: the largest gain of its words, infinite where characters are lost.

    Null and empty texts are not garbled; other columns are ignored. An empty table gives no rows. Null keys are one key.
    ``learned`` is what the same records taught.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text IS NOT NULL AND _text <> ''")
    learned = learned or learn(rows, "_text")
    odd = rows.filter(_beyond_ascii(F.col("_text")))
    by_text = odd.select("_key", *text_id(F.col("_text"))).join(learned.holders, [*_TEXT_ID]).select("_key", "gain")
    lost = odd.filter(F.col("_text").contains(LOST)).select("_key", F.lit(float("inf")).alias("gain"))
    return by_text.unionByName(lost).groupBy("_key").agg(F.max("gain").alias("gain")).withColumnRenamed("_key", key)


def restored_text(model: Model, margin: float, text: str, verdicts: dict[str, tuple[float, str]]) -> tuple[int, str, str]:
    """``(words restored, chains, text)`` of a garbled text, given ``word -> (gain, chain)`` of its words.

    Words that gain more than the margin name the chains; weaker words that read better by one of these are restored too.
    A text usually went through one chain: where that also betters a word, it is taken over one that fits the word alone.
    """
    totals: dict[str, float] = {}
    for m in _WORD.finditer(text):
        gain, chain = verdicts.get(m[0], (0.0, ""))
        if gain > margin:
            totals[chain] = totals.get(chain, 0.0) + gain
    main = max(totals, key=lambda c: (totals[c], c), default="")
    done, at, n = [], 0, 0
    for m in _WORD.finditer(text):
        gain, chain = verdicts.get(m[0], (0.0, ""))
        if not gain:
            continue
        outcome = read(m[0], main) if main else None
        if outcome is None or not _likelier(model, outcome, m[0]):
            outcome = read(m[0], chain) if chain in totals else None
        if outcome is not None:
            done += [text[at : m.start()], outcome]
            at, n = m.end(), n + 1
    done.append(text[at:])
    return n, ",".join(sorted(totals, key=lambda c: (-totals[c], c))), "".join(done)


_WORD = re.compile(r"[^ \t\r\n]+")


def _likelier(model: Model, a: str, b: str) -> bool:
    both = Words.of([a, b])
    p, _ = model.scores(_shown_as(both.codes), both.starts)
    return bool(np.add.reduceat(p, both.starts)[0] > np.add.reduceat(p, both.starts)[1])


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, gain, n_words, chains, lossless, restored)`` of every garbled record.

    ``lossless`` is false where characters are lost for good; the rest of such a text is restored all the same. The models
    and the margin are those of ``learn``; detection and restoration cover every record and its whole text, and only
    garbled records reach the restoring step.

    Null and empty texts are not garbled; repeated rows come back as often as they occur; other columns are ignored. An
    empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text IS NOT NULL AND _text <> ''")
    learned = learn(rows, "_text")
    margin = learned.margin
    found = durable(garbled_keys(rows, "_key", "_text", learned))
    held = df.sparkSession.sparkContext.broadcast(learned.model)
    out = T.StructType(
        [rows.schema["_key"]] + [T.StructField(n, t) for n, t in (("gain", T.DoubleType()), ("n_words", T.IntegerType()), ("chains", T.StringType()), ("lossless", T.BooleanType()), ("restored", T.StringType()))]
    )

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = sorted({w for t in texts for w in _WORD.findall(t) if not w.isascii()})
            verdicts = {w: (float(g), c) for w, g, c in zip(words, *judge(held.value, words)) if g > 0}
            made = []
            for k, one in zip(batch.column(0).to_pylist(), texts):
                n, chains, restored = restored_text(held.value, margin, one, verdicts)
                gain = max((verdicts[w][0] for w in _WORD.findall(one) if w in verdicts), default=0.0)
                if gain > margin or LOST in one:
                    made.append((k, float("inf") if LOST in one else gain, n, chains, LOST not in one, restored))
            if made:
                kinds = [batch.schema.field(0).type, pa.float64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], out.names)

    same = F.col("_key").eqNullSafe(F.col("_found"))
    return rows.join(found.select(F.col("_key").alias("_found")), same, "left_semi").mapInArrow(restore, out).withColumnRenamed("_key", key)
