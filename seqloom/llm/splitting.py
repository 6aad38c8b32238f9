"""Oversized texts into pieces at natural boundaries, by byte ranges.

A text is read in ranges of a bounded number of bytes, each in its own task, with a halo on either side. The edges of a
range move to the next place at which tokens don't depend on each other, which the workers of both ranges find alone.
A worker detects the boundaries in its range with their kinds and token offsets. Where a piece that begins at a boundary
ends is decided by the next ``limit`` tokens alone, so the worker also notes, for every boundary at which a piece may
enter its range, the pieces up to the one that leaves it: a table of offsets without text. The tables of a text are
stitched in order: sums of the token counts give the offsets in the whole text, and each range is entered where the one
before was left. Pieces are then cut out of the bytes by offset. The result doesn't depend on the size of the ranges.

No worker of ``split_files`` holds more of a text than a range and its halos. In a table a text is one value, so the task
that reads the row holds it once, cuts it into ranges in one pass and passes these on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import VOCABULARY, Held, Tokenizer, edge, first_edge, forced, tokenizer

#: Bytes of a range of a text in a table, and of a file.
RANGE, FILE_RANGE = 65_536, 1_048_576
#: Bytes of short texts that are cut together.
TOGETHER = 262_144
#: Kinds of boundaries, the best last.
CHARACTER, WORD, SENTENCE, PARAGRAPH = range(4)
KINDS = ("character", "word", "sentence", "paragraph")
END = -1

#: Marks that end a sentence before a space or anywhere, and what may close behind them.
_END = re.compile("[.!?…。！？][\"')\\]»”’」』）]*$")
_END_ANYWHERE = re.compile("[。！？][」』）”’]*$")
_CLOSING = re.compile("[\"')\\]»”’」』）]+$")
#: White space as the tokenizer's pattern knows it, by code points.
_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE_BYTE = np.isin(np.arange(256), [c for c in _SPACES if c < 128])
_BYTES = [int.from_bytes(chr(c).encode(), "big") for c in _SPACES if c >= 128]


@lru_cache(maxsize=4)
def _flags(vocabulary: str) -> dict[str, np.ndarray]:
    """What each token id says about boundaries around it; the last id is what stands between texts."""
    tok = tokenizer(vocabulary)
    n = tok.widths.size + 1
    flags = {name: np.zeros(n, bool) for name in ("only_space", "ends", "anywhere", "closing")}
    flags["lines"], flags["widths"] = np.zeros(n, np.int8), np.r_[tok.widths, len(GAP)]
    for i, raw in tok.bytes.items():
        text = raw.decode("utf-8", "replace")
        flags["only_space"][i], flags["closing"][i] = text.isspace(), bool(_CLOSING.fullmatch(text))
        flags["ends"][i], flags["anywhere"][i] = bool(_END.search(text)), bool(_END_ANYWHERE.search(text))
        flags["lines"][i] = min(text.count("\n"), 9)
    return flags


#: What stands between texts that are cut together.
GAP = b"\0\0\0\0"


def _spaces(one: np.ndarray, two: tuple[np.ndarray, ...], three: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether these bytes are a character of white space, as one, two or three of them."""
    found = _ONE_BYTE[one]
    for parts, lead in ((two, two[0] == 0xC2), (three, (three[0] >= 0xE1) & (three[0] <= 0xE3))):
        k = np.flatnonzero(lead)
        code = parts[0][k]
        for b in parts[1:]:
            code = code << 8 | b[k]
        found[k] |= np.isin(code, _BYTES)
    return found


class Stream:
    """The tokens of texts side by side, and for every place between two tokens where a piece that begins there ends.

    Places count tokens over all texts, each of which has one more behind it. A boundary lies before the white space
    behind a word, so that both sides keep their tokens when they stand alone; it ends a paragraph if a blank line
    follows, or one line end after a sentence.
    """

    def __init__(self, texts: list[tuple[bytes, np.ndarray]], vocabulary: str, limit: int, overlap: int):
        flags = _flags(vocabulary)
        gap = np.array([flags["lines"].size - 1])
        ids = np.concatenate([part for _, own in texts for part in (own, gap)]).astype(np.int64)
        self.data = b"".join(part for data, _ in texts for part in (data, GAP))
        sizes = np.array([own.size + 1 for _, own in texts])
        self.begins = np.r_[0, np.cumsum(sizes)[:-1]]
        self.stops = self.begins + sizes - 1
        self.limit, self.overlap = limit, overlap
        self.ends = np.r_[0, np.cumsum(flags["widths"][ids])]
        self._places(ids, flags)
        self._next(np.repeat(self.begins, sizes), np.repeat(self.stops, sizes))

    def _places(self, ids: np.ndarray, flags: dict[str, np.ndarray]) -> None:
        """Which places a piece's text may begin or end at, and the kinds of boundaries; of the place before each token."""
        at = self.ends[:-1]
        wide = np.frombuffer(GAP + self.data + GAP, np.uint8).astype(np.int64)
        byte = lambda k: wide[at + len(GAP) + k]
        now, then, was, was2, was3 = byte(0), byte(1), byte(-1), byte(-2), byte(-3)
        space_before = _spaces(was, (was2, was), (was3, was2, was))
        space_behind = _spaces(now, (now, then), (now, then, byte(2)))
        letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122)
        # A text that began or ended here would be tokenized otherwise: in a character, in or at a clitic.
        short = np.isin(now, list(b"stmdrvle")) & ((was == 39) | ((was2 == 39) & letter(was)))
        clitic = (now == 39) & np.isin(then, list(b"stmdrvl")) & ~(letter(was) | ((was >= 48) & (was <= 57)))
        self.whole = (now & 0xC0) != 0x80
        self.starts = self.whole & ~short & ~clitic
        self.starts[self.begins] = True
        self.cuts = self.starts & (~space_before | space_behind)
        ends, anywhere, closing = flags["ends"][ids], flags["anywhere"][ids], flags["closing"][ids]
        for flag in (ends, anywhere):
            flag[1:] |= closing[1:] & flag[:-1]
        lines, blank = flags["lines"][ids], flags["only_space"][ids]
        ahead, empty = np.r_[lines, 0, 0], np.r_[blank, False, False]
        breaks = ahead[:-2] + empty[:-2] * (ahead[1:-1] + empty[1:-1] * ahead[2:])
        gap = space_behind & ~space_before
        ended, ended_anywhere = np.r_[False, ends[:-1]], np.r_[False, anywhere[:-1]]
        kind = np.where(gap, WORD, CHARACTER).astype(np.int8)
        kind[(gap & ended) | (ended_anywhere & ~closing)] = SENTENCE
        kind[gap & ((breaks > 1) | ((breaks > 0) & ended))] = PARAGRAPH
        kind[~self.cuts] = CHARACTER
        self.kinds = kind

    def _next(self, low: np.ndarray, high: np.ndarray) -> None:
        """Where the text of a piece that begins at a place begins (``tail``), where the piece ends, and its kind of end."""
        n = self.ends.size - 1
        place = np.arange(n)

        def last(where: np.ndarray) -> np.ndarray:
            return np.maximum.accumulate(np.where(where, place, -1))

        self.tail = last(self.starts)[np.maximum(place - self.overlap, low)]
        most = np.minimum(self.tail + self.limit, high)
        paragraph, sentence, word = (last(self.cuts & (self.kinds >= k))[most] for k in (PARAGRAPH, SENTENCE, WORD))
        half = place + np.maximum(1, (most - place) // 2)
        stop = last(self.cuts)[most]
        stop = np.where(stop > place, stop, last(self.whole)[most])
        stop = np.where(word >= np.maximum(place + 1, low + self.overlap), word, stop)
        stop = np.where(sentence >= half, sentence, stop)
        stop = np.where(paragraph >= half, paragraph, stop)
        at_end = high <= self.tail + self.limit
        self.next = np.where(at_end, high, stop)
        self.end_kinds = np.where(at_end, END, self.kinds[self.next])

    def correct(self, tok: Tokenizer, split_at: list[int], first: int, behind: int) -> dict[int, int]:
        """Ends pieces earlier whose text holds a place (byte) at which a run was tokenized in two parts, if it has more tokens
        for that; gives the tokens of these pieces."""
        counts: dict[int, int] = {}
        for cut in np.searchsorted(self.ends, split_at).tolist():
            for s in range(max(first, cut - self.limit), min(behind, cut + self.overlap + 8)):
                t, c = int(self.tail[s]), int(self.next[s])
                if not t < cut < c:
                    continue
                while (many := tok.count(self.text(t, c))) > self.limit:
                    c -= 1
                    while not self.whole[c]:
                        c -= 1
                    self.end_kinds[s] = self.kinds[c]
                self.next[s] = c
                counts[s] = many
        return counts

    def text(self, begin: int, end: int) -> str:
        return self.data[int(self.ends[begin]) : int(self.ends[end])].decode()

    def chain(self, entries: np.ndarray, stop: np.ndarray | int) -> list[np.ndarray]:
        """The places reached from the entries (each below its ``stop``), step by step; one array of all a step."""
        steps = []
        stop = np.broadcast_to(stop, entries.shape)
        while entries.size:
            steps.append(entries)
            entries = self.next[entries]
            on = entries < stop
            entries, stop = entries[on], stop[on]
        return steps


PIECES = (
    "doc_id bigint, piece_no int, token_start bigint, token_end bigint, n_tokens int, n_repeated int, repeated_chars int, end_kind string, text string"
)
_KEY = [("doc_id", pa.int64()), ("mark", pa.int64()), ("range_no", pa.int32())]


def _batch(fields, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


# Texts of one range


def _cut_whole(batches: Iterator[pa.RecordBatch], vocabulary: str, limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(vocabulary)
    for batch in batches:
        held, size = [], 0
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc in enumerate(docs):
            text = texts[i].as_py()
            ids = tok.ids(text)
            if ids.size > limit:
                held.append((doc, text.encode(), ids))
                size += len(held[-1][1])
            if held and (size >= TOGETHER or i + 1 == len(docs)):
                yield _whole_pieces(held, tok, vocabulary, limit, overlap)
                held, size = [], 0


_WHOLE = [
    ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("n_tokens", pa.int32()),
    ("n_repeated", pa.int32()), ("repeated_chars", pa.int32()), ("end_kind", pa.string()), ("text", pa.string()),
]


def _whole_pieces(held: list, tok: Tokenizer, vocabulary: str, limit: int, overlap: int) -> pa.RecordBatch:
    stream = Stream([(data, ids) for _, data, ids in held], vocabulary, limit, overlap)
    counts: dict[int, int] = {}
    for (_, data, _), begin, stop in zip(held, stream.begins.tolist(), stream.stops.tolist()):
        if split_at := forced(Held(data), 0, len(data)):
            counts |= stream.correct(tok, [int(stream.ends[begin]) + x for x in split_at], begin, stop)
    steps = stream.chain(stream.begins, stream.stops)
    s = np.sort(np.concatenate(steps))
    of = np.searchsorted(stream.begins, s, "right") - 1
    no = np.arange(s.size) - np.searchsorted(of, of)
    tail, c = stream.tail[s], stream.next[s]
    n = [counts.get(k, m) for k, m in zip(s.tolist(), (c - tail).tolist())] if counts else c - tail
    a, b, m = (stream.ends[x].tolist() for x in (tail, c, s))
    data = stream.data
    kinds = [KINDS[k] if k >= 0 else "end" for k in stream.end_kinds[s].tolist()]
    base = stream.begins[of]
    repeated = [len(data[x:y].decode()) for x, y in zip(a, m)]
    texts = [data[x:y] for x, y in zip(a, b)]
    return _batch(_WHOLE, ([held[k][0] for k in of], no, s - base, c - base, n, s - tail, repeated, kinds, texts))


# Texts of several ranges


def _extent(text: Held, no: int, size: int, tok: Tokenizer, limit: int, overlap: int) -> tuple[int, int, int, int, list[int]]:
    """Of a range: where its halo begins, where it begins and ends, where the halo behind ends, and the split runs in these."""
    begin, end = edge(text, no * size), edge(text, (no + 1) * size)
    back = (overlap + 8) * tok.widest
    first = begin - back - 256
    while (low := edge(text, first)) > begin - back and first > 0:
        first -= back
    high = edge(text, end + (limit + 8) * tok.widest)
    return low, begin, end, high, forced(text, low, high)


def _ids_behind(tok: Tokenizer, data: bytes, begin: int, splits: list[int], wanted: int) -> np.ndarray:
    """Ids from ``begin`` on, until there are so many or the data ends."""
    found, n, step, text = [], 0, 4 * wanted, Held(data)
    while begin < len(data) and n < wanted:
        stop = first_edge(text, begin + step, len(data)) or len(data)
        found.append(tok.ids_between(data[begin:stop], [x - begin for x in splits if begin < x < stop]))
        n += found[-1].size
        begin, step = stop, 2 * step
    return np.concatenate(found) if found else np.zeros(0, np.int64)


#: A range's table: its tokens, and for each place that may be reached where the piece ends, the tokens that its text begins
#: before it, all its tokens, the kind of its end, and the bytes (in the slice, or in the file) of tail, place and end.
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_SPOTS, _BYTE_SPOTS = ("at", "stop", "repeated", "n_tokens", "kind"), ("tail_byte", "at_byte", "stop_byte")
_TABLE = [*_KEY, ("n", pa.int64()), *[(c, _INTS) for c in _SPOTS], *[(c, _LONGS) for c in _BYTE_SPOTS]]
TABLE = "doc_id bigint, mark bigint, range_no int, n bigint, " + ", ".join([f"{c} array<int>" for c in _SPOTS] + [f"{c} array<bigint>" for c in _BYTE_SPOTS])


def _tabulated(
    data: bytes, begin: int, end: int, is_first: bool, splits: list[int], vocabulary: str, limit: int, overlap: int, offset: int = 0
) -> tuple:
    """The table of a range whose slice of the text is ``data``, from ``begin`` to ``end`` in it; the slice is at ``offset``."""
    tok = tokenizer(vocabulary)
    if begin == end:
        return (0, *[[]] * 8)
    before = tok.ids_between(data[:begin], [x for x in splits if x < begin]) if begin else np.zeros(0, np.int64)
    own = tok.ids_between(data[begin:end], [x - begin for x in splits if begin < x < end])
    behind = _ids_behind(tok, data, end, splits, limit + 8)
    stream = Stream([(data, np.concatenate([before, own, behind]))], vocabulary, limit, overlap)
    first, stop = before.size, before.size + own.size
    counts = stream.correct(tok, splits, first, stop) if splits else {}
    entries = np.array([first]) if is_first else first + np.flatnonzero(stream.whole[first : min(stop, first + limit)])
    reached = np.unique(np.concatenate(stream.chain(entries, stop)))
    to, tail = stream.next[reached], stream.tail[reached]
    n = [counts.get(k, m) for k, m in zip(reached.tolist(), (to - tail).tolist())]
    spots = (reached - first, to - first, reached - tail, n, stream.end_kinds[reached])
    return (own.size, *(np.asarray(x, np.int32) for x in spots), *(stream.ends[x] + offset for x in (tail, reached, to)))


_PIECE = ("piece_no", "token_start", "token_end", "n_tokens", "n_repeated", "kind", *_BYTE_SPOTS)
_STITCHED = [*_KEY, ("pieces", pa.list_(pa.struct([(c, pa.int64()) for c in _PIECE])))]
STITCHED = f"doc_id bigint, mark bigint, range_no int, pieces array<struct<{', '.join(f'{c}: bigint' for c in _PIECE)}>>"


def _stitched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Tables sorted by text and range to the pieces of each range. Holds back ranges only until a text has more than ``limit`` tokens."""
    key, seen, base, entry, number, held = None, -1, 0, 0, 0, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = (row["doc_id"], row["mark"])
            if own != key:
                key, seen, base, entry, number, held = own, -1, 0, 0, 0, []
            if row["range_no"] == seen:  # a copy of the text
                continue
            seen, pieces = row["range_no"], []
            spot = {a: k for k, a in enumerate(row["at"])}
            while entry < base + row["n"]:
                k = spot[entry - base]
                stop = base + row["stop"][k]
                pieces.append({"piece_no": number, "token_start": entry, "token_end": stop, "n_repeated": row["repeated"][k], **{c: row[c][k] for c in ("n_tokens", "kind", *_BYTE_SPOTS)}})
                entry, number = stop, number + 1
            base += row["n"]
            held.append((*own, row["range_no"], pieces))
            if base > limit:
                out += held
                held = []
        yield _batch(_STITCHED, list(zip(*out)) if out else [[]] * 4)


def _check(limit: int, overlap: int) -> None:
    if not 0 <= 2 * overlap < limit or limit < 16:
        raise ValueError("the limit must be at least 16, the overlap less than half of it")


def _stitch(table: DataFrame, limit: int) -> DataFrame:
    """A text's tables meet in order in one partition; they are read as a stream, a few per cent of the text."""
    ordered = table.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "range_no")
    return ordered.mapInArrow(lambda batches: _stitched(batches, limit), STITCHED)


def _kind_name(kind: Column) -> Column:
    return F.when(kind == END, "end").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), kind + 1))


def split_texts(
    df: DataFrame, doc_id: str, text: str, limit: int, overlap: int, vocabulary: str = VOCABULARY, range_bytes: int = RANGE
) -> DataFrame:
    """Pieces of at most ``limit`` tokens of every text that has more than ``limit``.

    Args:
        df: columns other than ``doc_id`` (bigint) and ``text`` are ignored, whatever their names.
        overlap: each piece begins with the last ``overlap`` tokens of the one before, a few more where that would
            split a character or a clitic, so that the piece's tokens are those of the text. Must be less than half the limit.
        range_bytes: bytes of a range; texts of up to this size are cut where they are read. The pieces are the same for
            any size.

    Returns:
        ``doc_id``, ``piece_no`` (from 0, in order), ``token_start`` and ``token_end`` (the tokens that the piece adds, as
        offsets in the text), ``n_tokens`` (of the piece's own text), ``n_repeated`` and ``repeated_chars`` (what
        it repeats), ``end_kind`` ('paragraph', 'sentence', 'word', 'character', or 'end' for the last one) and ``text``.
        Pieces without their repeated parts, in order, are the text. A paragraph's or sentence's end is taken if the
        piece then adds at least half of what it may, else a word's end, else a character's. Null, empty and short texts,
        and rows with a null id, give no piece. Rows with equal ids are split each on its own, copies as well.
    """
    _check(limit, overlap)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    # A token has at least one byte.
    rows = rows.where(F.octet_length("text") > limit)
    small = rows.where(F.octet_length("text") <= range_bytes)
    done = small.mapInArrow(lambda batches: _cut_whole(batches, vocabulary, limit, overlap), PIECES)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            for doc, mark, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held = Held(memoryview(data.as_buffer()))
                for no in range(-(-held.size // range_bytes)):
                    low, begin, end, high, splits = _extent(held, no, range_bytes, tok, limit, overlap)
                    # The limits stand before the bytes: all that is known of a range is one value.
                    head = np.array([3 + len(splits), begin - low, end - low, *(x - low for x in splits)], np.int32).tobytes()
                    yield _batch(_SLICE, [[doc], [mark], [no], [head + held.get(low, high)]])

    large = rows.where(F.octet_length("text") > range_bytes).select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("data"))
    spread = large.mapInArrow(slices, SLICE).repartition("doc_id", "mark", "range_no")

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, no, data in zip(*[c.to_pylist() for c in batch.columns]):
                n, begin, end, *splits = np.frombuffer(data, np.int32, int(np.frombuffer(data, np.int32, 1)[0])).tolist()
                made = _tabulated(data[4 * n :], begin, end, no == 0, splits, vocabulary, limit, overlap, 4 * n)
                yield _batch(_TABLE, [[x] for x in (doc, mark, no, *made)])

    pieces = _stitch(spread.mapInArrow(tabulate, TABLE), limit)
    # The slices stay in the partitions in which they were tabulated.
    met = spread.join(pieces, ["doc_id", "mark", "range_no"]).select("doc_id", "data", F.explode("pieces").alias("p"))
    part = lambda a, b: F.substring("data", (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")).cast("string")
    number = lambda c: F.col(f"p.{c}").cast("int").alias(c)
    cut = met.select(
        "doc_id", number("piece_no"), "p.token_start", "p.token_end", number("n_tokens"), number("n_repeated"),
        F.length(part("p.tail_byte", "p.at_byte")).alias("repeated_chars"), _kind_name(F.col("p.kind").cast("int")).alias("end_kind"),
        part("p.tail_byte", "p.stop_byte").alias("text"),
    )
    return done.unionByName(cut)


_SLICE = [*_KEY, ("data", pa.binary())]
SLICE = "doc_id bigint, mark bigint, range_no int, data binary"


class File(Held):
    """A text in a file, of which stretches are read."""

    def __init__(self, path: str):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = where.open_input_file(inner)
        self.size = self.file.size()
        self.low, self.block = 0, b""

    def get(self, begin: int, end: int) -> bytes:
        begin, end = max(0, begin), min(end, self.size)
        if begin < self.low or end > self.low + len(self.block):
            if end - begin > 65_536:
                return self.file.read_at(end - begin, begin)
            self.low = max(0, begin - 4096)
            self.block = self.file.read_at(min(131_072, self.size - self.low), self.low)
        return self.block[begin - self.low : end - self.low]

    def close(self) -> None:
        self.file.close()


def split_files(files: DataFrame, limit: int, overlap: int, vocabulary: str = VOCABULARY, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Pieces of text files of any size, as ``split_texts`` gives them of their texts.

    Args:
        files: ``doc_id`` (bigint, unique) and ``path`` (a path or address that every executor can open); other columns are
            ignored. Rows with a null take no part. Files are UTF-8 text; a line end stays as it is.

    Workers read their range and halos of a file by offset, twice: to find boundaries, and to emit pieces.
    """
    _check(limit, overlap)
    keyed = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path")).where("doc_id is not null and path is not null")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, path in zip(*[c.to_pylist() for c in batch.columns]):
                file = File(path)
                numbers = list(range(-(-file.size // range_bytes))) if file.size > limit else []
                file.close()
                n = len(numbers)
                yield _batch([*_KEY, ("path", pa.string())], [[doc] * n, [0] * n, numbers, [path] * n])

    spread = keyed.mapInArrow(ranges, "doc_id bigint, mark bigint, range_no int, path string").repartition("doc_id", "range_no")

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            for doc, mark, no, path in zip(*[c.to_pylist() for c in batch.columns]):
                file = File(path)
                low, begin, end, high, splits = _extent(file, no, range_bytes, tok, limit, overlap)
                made = _tabulated(file.get(low, high), begin - low, end - low, no == 0, [x - low for x in splits], vocabulary, limit, overlap, low)
                file.close()
                yield _batch(_TABLE, [[x] for x in (doc, mark, no, *made)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, path, pieces in zip(*[c.to_pylist() for c in batch.columns]):
                if not pieces:
                    continue
                file = File(path)
                low, high = pieces[0]["tail_byte"], pieces[-1]["stop_byte"]
                data = file.get(low, high)
                file.close()
                rows = []
                for p in pieces:
                    a, m, b = (p[c] - low for c in ("tail_byte", "at_byte", "stop_byte"))
                    kind = KINDS[p["kind"]] if p["kind"] >= 0 else "end"
                    rows.append((doc, p["piece_no"], p["token_start"], p["token_end"], p["n_tokens"], p["n_repeated"], len(data[a:m].decode()), kind, data[a:b]))
                yield _batch(_WHOLE, list(zip(*rows)))

    pieces = _stitch(spread.mapInArrow(tabulate, TABLE), limit)
    return spread.join(pieces, ["doc_id", "mark", "range_no"]).select("doc_id", "path", "pieces").mapInArrow(emit, PIECES)
