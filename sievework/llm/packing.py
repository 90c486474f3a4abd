"""Packing tokenised documents into fixed-length sequences by bounded-space online best-fit.

Each partition keeps a fixed number of open windows. A document's tokens are cut into full windows and a rest; the rest
goes into the open window that it leaves the least room in; where none fits and all are in use, the fullest is emitted
and a new one opened. The pieces of the windows still open at the end of a partition are merged in groups of
partitions by best-fit decreasing. Tokens are taken word by word from a cache bounded in bytes: white space ends every
token of the vocabulary's pre-tokeniser, so a text's ids are those of its words in turn. This holds for one normalizer and
pre-tokeniser only; a file with others tokenises whole texts.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as often as they occur; an empty
table gives no pieces; a text longer than a window spans several; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut

LENGTH, END_ID, WINDOWS, MERGED = 4096, 2, 64, 16
#: Bytes of words and ids that a worker remembers, and the longest word remembered.
CACHE_BYTES, CACHE_CHARS = 24 << 20, 48
#: Characters of text whose words are taken at once: bounds memory on very long texts.
CHUNK = 3_000_000
#: Texts of these characters only are lower-cased and split here; for all others the tokenizer does the whole text.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*")
# The normalizer and the pre-tokenizer of the vocabulary file whose words may be taken one by one.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRETOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PRETOKEN_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's pre-tokens, as its file gives them, over the plain characters.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")


def _byte_signs() -> dict[int, int]:
    """The sign that a byte-level vocabulary writes for each byte: printable ones stand for themselves."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


SIGNS = _byte_signs()


class WordCoder:
    """Ids of texts. The distinct words of many texts are looked up together, in columns of bounded size; new ones are merged
    by the vocabulary's model. A tokenizer that parts words otherwise takes whole texts."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.limit, self.now = self.tokenizer.model, cache_bytes, 0
        told = json.loads(self.tokenizer.to_str())
        self.by_word = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRETOKENIZER and told["model"]["type"] == "BPE"
        #: The words known, their ids one after another, where each word's start, how many they are, and when last asked for.
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size, self.asked = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit."""
        chunk, size = [], 0
        for text in texts:
            plain = self.by_word and PLAIN.fullmatch(text or "")
            if plain and size + len(text or "") <= CHUNK:
                chunk.append(text or "")
                size += len(text or "")
                continue
            yield from self._taken(chunk)
            chunk, size = [], 0
            if not plain:
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
            elif len(text) <= CHUNK:
                chunk, size = [text], len(text)
            else:
                yield b"".join(b"".join(self._taken([part])) for part in _parts(text))
        yield from self._taken(chunk)

    def _taken(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of plain texts, all their words at once."""
        if not texts:
            return
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        found = split.flatten().dictionary_encode()
        place = self._placed(found.dictionary)
        at = found.indices.to_numpy()
        counts, starts = self.size[place][at], self.start[place][at]
        ends = np.cumsum(counts, dtype=np.int32)
        ids = self.ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        self._forget()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 if it is not known."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)

    def _placed(self, words: pa.Array) -> np.ndarray:
        """The place of each of these distinct words; new ones are merged and added."""
        place = self._known(words).copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = words.take(pa.array(new)).to_pylist()
            tokens = [[w] if w.isalpha() else PRETOKEN.findall(w) for w in fresh]
            parts = list(dict.fromkeys(t for ts in tokens for t in ts))
            old = self._known(pa.array(parts, pa.string())).tolist()
            coded = {t: self._token(t) if i < 0 else self.ids[self.start[i] : self.start[i] + self.size[i]].tobytes() for t, i in zip(parts, old, strict=True)}
            whole = [coded[ts[0]] if len(ts) == 1 else b"".join([coded[t] for t in ts]) for ts in tokens]
            held = set(fresh)
            more = [t for t, i in zip(parts, old, strict=True) if i < 0 and t not in held]
            place[new] = len(self.words) + np.arange(len(fresh))
            self._add(fresh + more, whole + [coded[t] for t in more])
        self.now += 1
        self.asked[place] = self.now
        return place

    def _add(self, words: list[str], coded: list[bytes]) -> None:
        size = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size, dtype=np.int32) - size])
        self.ids, self.size = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")]), np.concatenate([self.size, size])
        self.asked = np.concatenate([self.asked, np.full(len(words), self.now + 1, np.int32)])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])

    def held(self) -> int:
        """Bytes remembered."""
        return self.words.nbytes + self.ids.nbytes + self.start.nbytes + self.size.nbytes + self.asked.nbytes

    def _forget(self) -> None:
        """Beyond the limit, keep what was asked for last, up to half the limit; never words longer than those remembered."""
        if self.held() <= self.limit:
            return
        chars = pc.utf8_length(self.words).to_numpy()
        order = np.argsort(-self.asked, kind="stable")
        order = order[chars[order] <= CACHE_CHARS]
        order = order[np.cumsum(4 * chars[order] + 4 * self.size[order] + 16) <= self.limit // 2]
        size = self.size[order]
        at = np.cumsum(size, dtype=np.int32) - size
        self.ids = self.ids[np.repeat(self.start[order] - at, size) + np.arange(size.sum(), dtype=np.int32)]
        self.words, self.start, self.size, self.asked = self.words.take(pa.array(order)), at, size, self.asked[order]

    def _token(self, token: str) -> bytes:
        signs = token if token.isascii() else token.encode().decode("latin-1").translate(SIGNS)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end at white space."""
    at = 0
    while at < len(text):
        blank = re.compile(r"[\t\n\r ]").search(text, at + CHUNK)
        stop = blank.end() if blank else len(text)
        yield text[at:stop]
        at = stop


_coders: dict[str, WordCoder] = {}


def token_bytes(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path].encode(texts)


class OpenWindows:
    """A bounded set of windows, ordered by the room they have left."""

    def __init__(self, most: int, length: int) -> None:
        self.most, self.length, self.room, self.content = most, length, [], []

    def place(self, size: int, piece: tuple) -> list[tuple] | None:
        """Put a piece in; returns the pieces of a window that this emits, if any."""
        at, out = bisect.bisect_left(self.room, size), None
        if at < len(self.room):
            left, pieces = self.room.pop(at) - size, self.content.pop(at)
            pieces.append(piece)
        else:
            if len(self.room) == self.most:
                self.room.pop(0)
                out = self.content.pop(0)
            left, pieces = self.length - size, [piece]
        if not left and out is None:
            return pieces
        at = bisect.bisect_left(self.room, left)
        self.room.insert(at, left)
        self.content.insert(at, pieces)
        return out


SCHEMA = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, open boolean, ids binary"


def _pack_partition(path: str, length: int, windows: int, end: bytes, with_ids: bool):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shown, rows = TaskContext.get().partitionId(), 0, []
        held = OpenWindows(windows, length)

        def emit(pieces: list[tuple], still_open: bool) -> None:
            nonlocal shown
            offset = 0
            for p in pieces:
                rows.append((*p[:5], (part << 32) + shown, offset, part, still_open, p[5]))
                offset += p[2]
            shown += 1

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        keys: deque[int | None] = deque()

        def texts() -> Iterator[str | None]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    keys.append(key)
                    yield text.as_py()

        for coded in token_bytes(texts(), path):
            key = keys.popleft()
            ids = coded + end
            total = len(ids) // 4
            for start in range(0, total, length):
                own = ids[4 * start : 4 * (start + length)]
                piece = (key, start, len(own) // 4, zlib.crc32(own), total, own if with_ids else None)
                done = [piece] if piece[2] == length else held.place(piece[2], piece)
                if done:
                    emit(done, False)
                if len(rows) >= 2000:
                    yield flushed()
        for pieces in held.content:
            emit(pieces, True)
        yield flushed()

    return packed


def _merge(length: int):
    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Best-fit decreasing over the left pieces of a group of partitions."""
        frame = frame.sort_values(["length", "key", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        room: list[tuple[int, int]] = []
        sequence, offset, used = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), 0
        for i, size in enumerate(frame["length"].tolist()):
            at = bisect.bisect_left(room, (size, -1))
            left, n = room.pop(at) if at < len(room) else (length, used)
            used = max(used, n + 1)
            sequence[i], offset[i] = n, length - left
            if left > size:
                bisect.insort(room, (left - size, n))
        frame["sequence_id"], frame["offset"] = (1 << 62) + (int(key[0]) << 32) + sequence, offset
        return frame

    return merged


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids.

    tokenizer: path of a tokenizers file, readable on every machine.
    """
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    pieces = cut(rows.mapInArrow(_pack_partition(tokenizer, length, windows, end, with_ids), SCHEMA), "pieces")
    left = pieces.where("open").withColumn("lot", F.floor(F.col("part") / MERGED).cast("long"))
    merged = left.groupBy("lot").applyInPandas(_merge(length), left.schema).drop("lot")
    out = pieces.where("not open").unionByName(merged).drop("part", "open").withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")


def op7_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
