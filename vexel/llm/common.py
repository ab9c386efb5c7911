"""What the training-data operators share: scratch tables, text kernels and a cached tokenizer."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import cut, scratch_dir

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


written = cut


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table of few row groups is dealt out, row by row, where a
    Python worker is to do much with each row. Plans that shuffle anyway, and wider tables, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose binary or string column holds about most_bytes at most (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    off = offsets(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + most_bytes, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column (nulls are empty)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows after another, offsets from 0)."""
    off = offsets(col)
    data = col.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII signs but letters and digits.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[128:] = NOT_LETTERS[48:58] = NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64 and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a batch of texts, found and hashed for all rows at once.

    first[i] : first[i + 1] are the words of row i; start and end are their places in data. space: the bytes that
    part words (ASCII white space, or NOT_LETTERS)."""

    def __init__(self, col: pa.Array, lower: bool = True, space: np.ndarray = _SPACE):
        raw, off = raw_bytes(col)
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        word = ~space[raw]
        # a word also ends where its row ends
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self._sums = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            p, _ = _powers(len(self.data) + 1)
            with np.errstate(over="ignore"):
                self._sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[: len(self.data)], out=self._sums[1:])
        return self._sums

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes."""
        sums = self._prefix()
        _, inverse = _powers(len(self.data) + 1)
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[self.start]) * inverse[self.start])


#: Bytes that a tokenizer's memory of chunks may take in a Python worker, of which an executor has one a core: keys, their
#: numbers and places in the dicts (OVERHEAD), and ids. LONGEST: characters from which on a chunk isn't remembered.
ENCODER_BYTES = 128 << 20
OVERHEAD = 150
LONGEST = 256
#: Chunks that go through the library in one text.
_TOGETHER = 64
#: White space as the Unicode property has it.
_WS = " \t-\r\x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: What a text must not hold for its spaces to be cuts: a space before other white space or the end, or white space
#: beyond ASCII.
_BEFORE = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
_BEYOND = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What a vocabulary does to a text for which folded() keeps the ids: white space and cases are alike, and letters, digits
#: and runs of signs are parted before merges.
_FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTING = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Latin-1 in lower case with spaces for ASCII white space, and its classes: space, letter or digit (a), other (p).
_FOLD = bytes(32 if _SPACE[i] else ord(chr(i).lower()) for i in range(256))
_CLASS = bytes(32 if _SPACE[i] else ord("a") if not NOT_LETTERS[i] and i < 128 or i >= 192 and i not in (215, 247) else ord("p") for i in range(256))
_ENDS = [(x + b" ", b" " + x + b" ") for x in (b",", b".", b";", b":", b"!", b"?")]


def folds(tokenizer) -> bool:
    """Whether a vocabulary gives a text and its folded() the same ids."""
    normalizer, parts = (x and json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    return normalizer == _FOLDING and parts is not None and parts.get("pretokenizers", [None])[0] == _PARTING


def folded(text: str) -> str:
    """The text with fewer distinct chunks between spaces. In Latin-1 nothing composes, so lower case comes first as
    well as last, and a sign before a space is parted from its word, unless the text has runs of signs there, which are
    one piece. Elsewhere lines are parted only; so they are where lower case could make a special token."""
    try:
        raw = text.encode("latin-1") if "<|" not in text else None
    except UnicodeEncodeError:
        raw = None
    if raw is None:
        return text.replace("\n", " ")
    runs = b"pp " in raw.translate(_CLASS)
    raw = raw.translate(_FOLD)
    for sign, parted in () if runs else _ENDS:
        raw = raw.replace(sign, parted)
    return raw.decode("latin-1")


#: The byte-level pattern's pieces of a text in Latin-1, where letters, digits and white space are few enough to be named.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}\u0100-\U0010ffff]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_pieces(tokenizer) -> bool:
    """Whether a vocabulary merges bytes within the pieces of the byte-level pattern and changes no text before."""
    parts = tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__())
    return tokenizer.normalizer is None and parts == _BYTES


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Pending:
    """Chunks that have a number but no ids yet, and how many have numbers."""

    def __init__(self):
        self.count, self.chunks = 0, []


class _Numbers(dict):
    """Numbers for chunks of text in order of first use, shared by the dicts of one encoder. lead stands before each
    key in the text. Long chunks get a number each time."""

    def __init__(self, pending: _Pending, lead: str = ""):
        super().__init__()
        self.pending, self.lead = pending, lead

    def __missing__(self, key: str) -> int:
        p = self.pending
        n = p.count
        if len(key) < LONGEST:
            self[key] = n
        p.count += 1
        p.chunks.append(self.lead + key)
        return n


class CachedEncoder:
    """Token ids of whole texts by the tokenizers library, which encodes each distinct chunk once.

    A text is cut only where its ids cannot depend on what stands across the cut. keep_spaces: the vocabulary
    keeps white space (byte-level): a text in Latin-1 is cut into the pieces of the vocabulary's pattern, which needn't
    look for them again; elsewhere cuts stand before a space, never inside a run of white space that the pattern may
    hold together. Otherwise white space is dropped and each space is a cut, of the folded text if the vocabulary folds.
    A text that contains the string of a special token is encoded whole. most: bytes of remembered chunks; when they are
    more, the later ones are forgotten, as common chunks come early."""

    def __init__(self, path: str, keep_spaces: bool, most: int = ENCODER_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.between = next(iter(special.items()), None)
        self.keep, self.most = keep_spaces, most
        self.folds = not keep_spaces and folds(self.tokenizer)
        self.whole = None
        if keep_spaces and byte_pieces(self.tokenizer) and all("<|" in t for t in special):
            from tokenizers.pre_tokenizers import ByteLevel

            # the same vocabulary for what is one piece already
            self.whole = Tokenizer.from_file(path)
            self.whole.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pending = _Pending()
        self.numbers, self.spaced = _Numbers(self.pending), _Numbers(self.pending, " ")
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.bytes = 0

    def _forget(self) -> None:
        """Forgets the later half of the chunks until the others take half of the bytes at most."""
        keep = self.pending.count
        while self.bytes > self.most // 2 and keep:
            keep //= 2
            for d in (self.numbers, self.spaced):
                for key in [k for k, n in d.items() if n >= keep]:
                    del d[key]
            self.bytes = 4 * int(self.bounds[keep]) + sum(OVERHEAD + sys.getsizeof(k) for d in (self.numbers, self.spaced) for k in d)
        for d in (self.numbers, self.spaced):
            # a dict gives memory back only when it is made anew
            left = dict(d)
            d.clear()
            d.update(left)
        self.pending.count = keep
        self.bounds = self.bounds[: keep + 1].copy()
        self.flat = self.flat[: int(self.bounds[-1])].copy()

    def _learn(self) -> None:
        new, self.pending.chunks = self.pending.chunks, []
        if not new:
            return
        ids, lengths = self._encoded(new)
        at = int(self.bounds[-1])
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(max(len(self.flat) // 2, len(ids)), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        self.bounds = np.concatenate([self.bounds, at + np.cumsum(lengths)])
        self.bytes += sum(map(sys.getsizeof, new)) + OVERHEAD * len(new) + 4 * len(ids)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, their counts). Chunks that are one piece go without the pattern."""
        if self.whole is None:
            return self._through(self.tokenizer, new)
        one = np.fromiter((_PIECE.fullmatch(x) is not None for x in new), bool, len(new))
        if one.all():
            return self._through(self.whole, new)
        lengths = np.zeros(len(new), np.int64)
        some, lengths[one] = self._through(self.whole, [x for x, o in zip(new, one) if o])
        rest, lengths[~one] = self._through(self.tokenizer, [x for x, o in zip(new, one) if not o])
        ids, whose = np.zeros(len(some) + len(rest), np.uint32), np.repeat(one, lengths)
        ids[whose], ids[~whose] = some, rest
        return ids, lengths

    def _through(self, tokenizer, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, their counts). Chunks go through the library in long texts, with a special token
        between two: the library encodes what stands on its either side apart."""
        if self.between is None or any("<|" in x and self.special.search(x) for x in new):
            found = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths
        mark, mark_id = self.between
        texts = [mark.join(new[i : i + _TOGETHER]) + mark for i in range(0, len(new), _TOGETHER)]
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))
        marks = np.flatnonzero(ids == mark_id)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _chunks(self, text: str, which: list[int]) -> None:
        """Adds the numbers of a text's chunks to a list."""
        if self.special and "<|" in text and self.special.search(text):
            which.append(self.numbers[text])
        elif not self.keep:
            which.extend(map(self.numbers.__getitem__, (folded(text) if self.folds else text).split(" ")))
        elif self.whole is not None and is_latin(text):
            which.extend(map(self.numbers.__getitem__, _PIECE.findall(text)))
        elif any(x in text for x in _BEFORE) or text.endswith(" ") or any(x in text for x in _BEYOND):
            which.extend(map(self.numbers.__getitem__, _CHUNK.findall(text)))
        else:
            first, *rest = text.split(" ")
            which.append(self.numbers[first])
            which.extend(map(self.spaced.__getitem__, rest))

    def _which(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all chunks after another, chunks of each text)."""
        if self.bytes > self.most:
            self._forget()
        which: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                self._chunks(t, which)
            ends[i + 1] = len(which)
        self._learn()
        return np.array(which, np.int64), np.diff(ends)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        which, counts = self._which(texts)
        sums = np.concatenate([[0], np.cumsum(self.bounds[which + 1] - self.bounds[which])])
        return np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after another, offsets of the texts in them); null is empty."""
        which, counts = self._which(texts)
        begin, size = self.bounds[which], self.bounds[which + 1] - self.bounds[which]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - sums[:-1], size) + np.arange(sums[-1])]
        off = sums[np.concatenate([[0], np.cumsum(counts)])]
        if end_id is not None:
            ids = np.insert(ids, off[1:], np.uint32(end_id))
            off = off + np.arange(len(off))
        return ids, off


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, keep_spaces: bool, most: int = ENCODER_BYTES) -> CachedEncoder:
    """This worker's encoder: the file is read and chunks are remembered once a process."""
    key = (path, keep_spaces, most)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(path, keep_spaces, most)
    return _ENCODERS[key]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
