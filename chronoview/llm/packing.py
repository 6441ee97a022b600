"""Best-fit packing of tokenised documents by linear grouping.

1. Every document is tokenised in Arrow batches and cut into pieces of at most ``capacity``.
2. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. The
   large lengths are split into groups of equal cardinality and rounded up to their group's
   longest. Configurations of these few sizes that fill a sequence best are chosen one after
   the other, each as often as the counts allow.
3. Real lengths take the places of rounded ones, which opens room; small pieces go into the
   fullest sequence that still holds them, longest first.
4. The plan consists of runs: "pieces ``first`` to ``first + n`` of this length go to the
   sequences from ``bin`` on, at this offset". Their number depends on the capacity, not on
   the corpus. Every piece gets its number among the pieces of its length and finds its run.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.llm.common import byte_slices
from chronoview.operators.ranking import ranked
from chronoview.session import staged

CAPACITY = 2048
GROUPS = 256
SMALL_PART = 8
END_ID = 0
BATCH_BYTES = 4 << 20
REMEMBERED = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces of one length are numbered in so many buckets.
BUCKETS = 256


# Marks the tokenizer always parts from a letter or digit before them and from a
# letter after them (none occurs in a special token, none is an apostrophe).
MARKS = b".,;:!?*#$%&()"
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[list(b"0123456789")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
# Texts left as they are: special strings keep their case, and a mark that combines with a
# letter may compose with its small form only.
AS_THEY_ARE = "<\\||[\u0300-\u036f]"


def part_marks(texts: pa.Array) -> pa.Array:
    """Lower A-Z and put a space between letters or digits and marks, where the tokenizer cuts
    anyway: fewer distinct words are left to encode, and the ids stay the same."""
    _, offsets, buffer = texts.buffers()
    if buffer is None:
        return texts
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(buffer, np.uint8)[bounds[0]:bounds[-1]]]
    bounds -= bounds[0]
    mark, letter = _IS_MARK[data], _IS_LETTER[data]
    before = letter | _IS_DIGIT[data]
    # Two-byte letters from 0xC3 0x80 on, without the signs for times and divided by.
    before[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at = np.flatnonzero((before[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    spread = np.insert(data, at, 0x20)
    moved = (bounds + np.searchsorted(at, bounds, "left")).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(spread))


def stays_letters(word: str) -> bool:
    """Whether a word is letters alone, also once composed (NFC) and in small letters.

    Some letters become letter and mark there, which the tokenizer parts.
    """
    return word.isalpha() and (
        word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, word by word.

    The tokenizer splits at white space first, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode words not met before; words of letters alone are one unit of the tokenizer
        each and go together in one string. Where it counts other units, its tables of letters
        differ from Python's, and the words go one by one."""
        plain, others = [], []
        for word in new:
            (plain if stays_letters(word) else others).append(word)
        for start in range(0, len(plain), 1000):
            words = plain[start:start + 1000]
            found = self.model.encode(" ".join(words), add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64))
            if len(sizes) != len(words):
                others += words
                continue
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(sizes)
            raw = ids.tobytes()
            begin = 0
            for word, end in zip(words, (ends * 4).tolist()):
                self.known[word] = raw[begin:end]
                begin = end
        if others:
            for word, found in zip(others, self.model.encode_batch_fast(
                    others, add_special_tokens=False)):
                self.known[word] = array("I", found.ids).tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        self._learn([w for w in words if w not in known])
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin (n + 1)."""
        as_they_are = pc.match_substring_regex(texts, AS_THEY_ARE)
        if pc.any(as_they_are).as_py():
            texts = pc.if_else(as_they_are, texts, part_marks(texts))
        else:
            texts = part_marks(texts)
        split = pc.ascii_split_whitespace(texts)
        flat = pc.dictionary_encode(split.flatten())
        ids = self.word_ids(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = flat.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        pool = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        per_word = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        if not len(codes):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        source = np.arange(ends[-1]) + np.repeat(begin[codes] - ends[:-1], per_word)
        return pool[source], ends[bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def parts_at_gaps(text: str, limit: int) -> Iterator[str]:
    """Parts of about ``limit`` characters, cut at a space or line end."""
    start = 0
    while len(text) - start > limit:
        found = [at for at in (text.find(" ", start + limit), text.find("\n", start + limit))
                 if at >= 0]
        if not found:
            break
        yield text[start:min(found)]
        start = min(found)
    yield text[start:]


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text has the end id alone."""
    def cut(doc_id, chunks: Iterator[np.ndarray]) -> Iterator[tuple]:
        held, start, number = np.zeros(0, "<u4"), 0, 0
        for ids in chunks:
            held = np.concatenate([held, ids]) if len(held) else ids
            while len(held) >= capacity:
                # Only the end id may complete a document, so a full piece can be let go.
                yield doc_id, number, start, capacity, zlib.crc32(held[:capacity].tobytes())
                held, start, number = held[capacity:], start + capacity, number + 1
        if len(held):
            yield doc_id, number, start, len(held), zlib.crc32(held.tobytes())

    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer_path)
        for part in byte_slices(batches, "text", BATCH_BYTES):
            texts = pc.fill_null(part.column("text"), "")
            names = part.column("doc_id").to_pylist()
            if len(texts) == 1 and len(texts[0].as_py()) > BATCH_BYTES:
                pieces = parts_at_gaps(texts[0].as_py(), BATCH_BYTES)
                chunks = (model.encode(pa.array([p]))[0] for p in pieces)
                rows = list(cut(names[0], (*(c for c in chunks), end)))
            else:
                ids, bounds = model.encode(texts)
                rows = [row for i, name in enumerate(names)
                        for row in cut(name, (ids[bounds[i]:bounds[i + 1]], end))]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Plan:
    """Packs a histogram of lengths; remembers which run of pieces goes where."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY,
                 groups: int = GROUPS):
        self.capacity = capacity
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first, n, bin, offset
        self.next_of = dict.fromkeys(histogram, 0)
        self.room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (bin, n)
        self.rooms: list[int] = []
        small = capacity // SMALL_PART
        self._pack_large({k: n for k, n in histogram.items() if k > small}, groups)
        self._pack_small({k: n for k, n in histogram.items() if k <= small})

    def _take(self, length: int, n: int, first_bin: int, offset: int) -> None:
        self.runs.append((length, self.next_of[length], n, first_bin, offset))
        self.next_of[length] += n

    def _free(self, room: int, first_bin: int, n: int) -> None:
        if room not in self.room:
            bisect.insort(self.rooms, room)
        self.room.setdefault(room, []).append((first_bin, n))

    @staticmethod
    def group(histogram: dict[int, int], groups: int) -> list[tuple[int, deque]]:
        """Groups of equal cardinality, longest first: (rounded length, its [length, n] runs)."""
        total = sum(histogram.values())
        share = max(1, -(-total // groups))
        found: list[tuple[int, deque]] = []
        space = 0
        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                if not space:
                    # A length that spans whole groups needs no rounding: one group holds it.
                    found.append((length, deque()))
                    space = max(share, left - left % share)
                n = min(left, space)
                found[-1][1].append([length, n])
                left, space = left - n, space - n
        return found

    def configuration(self, sizes: list[int], counts: list[int]) -> dict[int, int]:
        """The largest size left plus whichever others fill the sequence best.

        ``reach[t]`` is the best sum of at most t; large sizes are offered first, so that a
        fill uses few pieces.
        """
        head = next(i for i, n in enumerate(counts) if n)
        chosen = {head: 1}
        room = self.capacity - sizes[head]
        open_sizes = [i for i, n in enumerate(counts)
                      if sizes[i] <= room and n - chosen.get(i, 0) > 0]
        # by[t]: the last size of a fill of exactly t, or -1.
        by = np.full(room + 1, -1, np.int64)
        by[0] = len(sizes)
        for i in open_sizes:
            uses = min(counts[i] - chosen.get(i, 0), room // sizes[i])
            before = by.copy()
            shifted = before
            for _ in range(uses):
                moved = np.full(room + 1, -1, np.int64)
                moved[sizes[i]:] = shifted[:room + 1 - sizes[i]]
                new = (moved >= 0) & (by < 0)
                if not new.any():
                    break
                by[new] = i
                shifted = np.where(new, i, -1)
            if by[room] >= 0:
                break
        fill = int(np.flatnonzero(by >= 0)[-1])
        while fill:
            i = int(by[fill])
            chosen[i] = chosen.get(i, 0) + 1
            fill -= sizes[i]
        return chosen

    def _pack_large(self, histogram: dict[int, int], groups: int) -> None:
        grouped = self.group(histogram, groups)
        # Groups that were rounded to one size are one size for the configurations.
        sizes: list[int] = []
        queues: list[deque] = []
        for size, queue in grouped:
            if sizes and sizes[-1] == size:
                queues[-1].extend(queue)
            else:
                sizes.append(size)
                queues.append(queue)
        counts = [sum(n for _, n in q) for q in queues]
        while any(counts):
            chosen = self.configuration(sizes, counts)
            times = min(counts[i] // uses for i, uses in chosen.items())
            runs = [(self.bins, times, 0)]  # first bin, bins, used tokens
            self.bins += times
            for i, uses in chosen.items():
                counts[i] -= uses * times
                for _ in range(uses):
                    runs = self._substitute(runs, queues[i])
            for first, n, used in runs:
                self._free(self.capacity - used, first, n)

    def _substitute(self, runs: list, queue: deque) -> list:
        """Put one real piece of the queue into every sequence of the runs."""
        after = []
        for first, n, used in runs:
            while n:
                length, held = queue[0]
                m = min(n, held)
                self._take(length, m, first, used)
                after.append((first, m, used + length))
                first, n = first + m, n - m
                if m == held:
                    queue.popleft()
                else:
                    queue[0][1] -= m
        return after

    def _pack_small(self, histogram: dict[int, int]) -> None:
        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    left -= self._open(length, left)
                    continue
                room = self.rooms[at]
                first, n = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room], self.rooms[at]
                # Best fit fills one sequence as far as the length goes, then the next one.
                each = room // length
                if left >= each:
                    m, uses = min(n, left // each), each
                else:
                    m, uses = 1, left
                for k in range(uses):
                    self._take(length, m, first, self.capacity - room + k * length)
                left -= m * uses
                self._free(room - uses * length, first, m)
                if n > m:
                    self._free(room, first + m, n - m)

    def _open(self, length: int, left: int) -> int:
        each = self.capacity // length
        m, uses = (left // each, each) if left >= each else (1, left)
        for k in range(uses):
            self._take(length, m, self.bins, k * length)
        self._free(self.capacity - uses * length, self.bins, m)
        self.bins += m
        return m * uses


def numbered(pieces: DataFrame) -> DataFrame:
    """Add ``_number``: from 0, among the pieces of one length; no length sits in one task."""
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS))
    return ranked(pieces, ["length"], order, bucket, "_number").withColumn(
        "_number", F.col("_number") - 1)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed once each. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = staged(document_pieces(docs, tokenizer_path, capacity), "pack-pieces")
    histogram = {row.length: row.n for row in
                 pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity, groups)
    runs = sorted(plan.runs)
    table = np.array(runs, np.int64).reshape(-1, 5)
    lengths = table[:, 0]
    span = np.int64(max([1, *histogram.values()]) + 1)
    keys = lengths * span + table[:, 1]  # runs of one length are in order of their first piece
    shared = spark.sparkContext.broadcast((keys, table, span))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, span = shared.value
        for batch in batches:
            number = batch.column("_number").to_numpy()
            wanted = batch.column("length").to_numpy() * span + number
            run = table[np.searchsorted(keys, wanted, "right") - 1]
            kept = batch.drop_columns(["_number"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(run[:, 3] + number - run[:, 1]), pa.array(run[:, 4])],
                names=[*kept.schema.names, "sequence_id", "offset"])

    return numbered(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("_number").cast("long")
    ).mapInArrow(place, PIECES + ", sequence_id long, offset long")
