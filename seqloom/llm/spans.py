"""Long exact spans shared between records, found from difference-cover anchors.

A difference cover D of a period v holds, for any two positions i and j, an offset below v that brings both onto D.
So two equal stretches of at least ``v - 1 + w`` letters hold an equal window of w letters that begins on a cover
position in either of them. Only windows at cover positions (5 in 21) are compared across records; a window found in
two records is an anchor.

Each anchor is then extended: its occurrences meet with the letters on either side, equal surroundings are one with the
least and the greatest of their records, and the others are compared letter by letter, outwards, which splits them into
classes with equal extensions to the left and to the right. A span over the anchor is shared if a class of both, left and
right, holds two records. What remains of an occurrence is the runs of its spans; pairs are never made, and the runs of a
sequence are merged.

Windows are coded with two bits a letter, so equal codes are equal letters. Equal codes meet in sorted partitions that are
read as streams; a code is settled as soon as a second record shows it. Codes so frequent that they would fill a task are
settled beforehand by two witnesses; anchors with very many different surroundings are split by their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import shared_checkpoint

#: A perfect difference cover modulo 21, and the window it leaves in a span of 40 letters.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Codes looked at together for heavy ones; those that make up one in HEAVY of them are noted.
CHUNK, HEAVY = 1 << 20, 2_000
#: The most codes that are settled beforehand.
MOST_HEAVY = 20_000

_CODE = np.full(256, 255, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_letters)] = _i
_FOUND = pa.schema([("code", pa.int64()), ("id", pa.string()), ("seq", pa.int64()), ("pos", pa.int32()), ("settled", pa.bool_())])
FOUND = "code bigint, id string, seq bigint, pos int, settled boolean"
AROUND = "id string, part string, no int, pos int, code bigint, left binary, right binary"
#: Different surroundings of one anchor that a task compares at once.
GROUP_ROWS = 200_000


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """The 2-bit code of every window of at most 31 letters, by doubling."""
    out, size = np.zeros(codes.size + 1, np.int64), 0
    power = codes.astype(np.int64)
    span = 1
    need = width
    while need:
        if need & 1:
            n = codes.size - size - span + 1
            if n <= 0:
                return np.zeros(0, np.int64)
            out = (out[:n] << (2 * span)) | power[size : size + n]
            size += span
        need >>= 1
        if need:
            if power.size <= span:
                return np.zeros(0, np.int64)
            power = (power[:-span] << (2 * span)) | power[span:]
            span *= 2
    return out


class Letters:
    """The sequences of a batch side by side, each followed by a foreign letter."""

    def __init__(self, texts: list[str]):
        data = "\n".join([*texts, ""]).encode("latin-1", "replace")
        codes = _CODE[np.frombuffer(data, np.uint8)]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begins = np.r_[0, np.cumsum(self.sizes)]
        self.codes = codes & 3
        self.bad = np.r_[0, np.cumsum(codes == 255)].astype(np.int32)

    def clean(self, at: np.ndarray, width: int) -> np.ndarray:
        """Those of the places at which a window of that width lies in one sequence and holds A, C, G, T only."""
        at = at[at + width <= self.codes.size]
        return at[self.bad[at + width] == self.bad[at]]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the sequence and the position in it."""
        row = np.searchsorted(self.begins, at, side="right") - 1
        return row, at - self.begins[row]


def anchors(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The clean windows that begin on a cover position of their sequence: code, number of the sequence, position."""
    own = Letters(texts)
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True
    inside = np.arange(own.codes.size) - np.repeat(own.begins[:-1], own.sizes)
    at = own.clean(np.flatnonzero(on_cover[inside % PERIOD]), width)
    return window_codes(own.codes, width)[at], *own.place(at)


def surroundings(texts: list[str], row: np.ndarray, near: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows at ``near`` in the texts ``row``: code, and the ``reach`` letters to the left (nearest first) and right,
    as 0 to 3; 4 from the first other letter or the text's end on."""
    own = Letters(texts)
    # A foreign letter stands between texts.
    codes = np.where(np.diff(own.bad) > 0, 4, own.codes).astype(np.uint8)
    wide = np.r_[np.full(reach, 4, np.uint8), codes, np.full(reach, 4, np.uint8)]
    at, step = own.begins[row] + near, np.arange(reach)
    left = wide[at[:, None] + (reach - 1 - step)]
    right = wide[at[:, None] + (reach + width + step)]
    for side in left, right:
        side[np.maximum.accumulate(side == 4, axis=1)] = 4
    return window_codes(own.codes, width)[at], left, right


def _is_one_of(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(codes, known) if known.size else np.zeros(codes.size, bool)


def _windows(width: int, known: np.ndarray, together: int = 1 << 22):
    """A mapInArrow function: of rows (id, seq, letters) the anchors' candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            begin, size = 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= together or end == len(texts):
                    codes, row, pos = anchors(texts[begin:end], width)
                    if codes.size:
                        place = [batch.column(i).take(pa.array(row + begin)) for i in (0, 1)]
                        yield pa.RecordBatch.from_arrays([pa.array(codes), *place, pa.array(pos.astype(np.int32)), pa.array(_is_one_of(codes, known))], schema=_FOUND)
                    begin, size = end, 0

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, width = rows.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _surrounded(width: int, reach: int, letters: int = 1 << 22, anchors_at_once: int = 1 << 16):
    """A mapInArrow function: of rows (id, part, no, letters, near) the occurrences of anchors with their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, near = batch.column(3).to_pylist(), batch.column(4)
            begin, size = 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size < letters and end < len(texts):
                    continue
                part = near.slice(begin, end - begin)
                row = np.repeat(np.arange(end - begin), pc.list_value_length(part).to_numpy())
                at = part.flatten().to_numpy()
                for k in range(0, at.size, anchors_at_once):
                    own = row[k : k + anchors_at_once]
                    code, left, right = surroundings(texts[begin:end], own, at[k : k + anchors_at_once], width, reach)
                    place = [batch.column(i).take(pa.array(own + begin)) for i in range(3)]
                    columns = [*place, pa.array(at[k : k + anchors_at_once].astype(np.int32)), pa.array(code), _bytes(left), _bytes(right)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "part", "no", "pos", "code", "left", "right"])
                begin, size = end, 0

    return run


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes that recur much within a chunk, with their number and their least and greatest id; the row of a null id has
    the chunk's total."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        codes = rows.column("code").to_numpy()
        order = np.argsort(codes)
        c = codes[order]
        begins = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[begins, c.size])
        many = (sizes > 1) & (sizes * HEAVY > c.size)
        out = [[0], [rows.num_rows], [None], [None]]
        for b, n in zip(begins[many], sizes[many]):
            ids = rows.column("id").take(pa.array(order[b : b + n]))
            for col, v in zip(out, (c[b], n, pc.min(ids).as_py(), pc.max(ids).as_py())):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["code", "n", "first", "last"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield settle(held)
            held, size = [], 0
    if size:
        yield settle(held)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by code, those whose code is shown by two ids. Holds back only what one id shows at first, so no more
    than a record's own windows."""
    last, first_id, shared, held = None, None, False, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).to_numpy()
        ids = batch.column(1).dictionary_encode()
        who = ids.indices.to_numpy()
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        run = np.repeat(np.arange(begins.size), np.diff(np.r_[begins, codes.size]))
        mixed = batch.column(4).to_numpy(zero_copy_only=False)[begins]  # a settled code's rows are all settled
        np.logical_or.at(mixed, run, who != who[begins][run])
        head, tail = int(codes[0]), int(codes[-1])
        if head == last:
            mixed[0] |= shared or ids.dictionary[int(who[0])].as_py() != first_id
            if mixed[0]:
                yield from held
                held = []
        else:
            held, first_id = [], None
        keep = mixed[run]
        if keep.any():
            yield batch.filter(pa.array(keep))
        one = begins.size - 1
        if begins.size > 1 or head != last:
            held, first_id = [], ids.dictionary[int(who[begins[one]])].as_py()
        last, shared = tail, bool(mixed[one])
        if not shared:
            held.append(batch.slice(int(begins[one])))


def _settled(windows: DataFrame) -> np.ndarray:
    """The codes, fewer than MOST_HEAVY, that make up much of all windows and occur in two ids."""
    heavy = (
        windows.mapInArrow(_heavy, "code bigint, n bigint, first string, last string")
        .groupBy("code", F.col("first").isNull().alias("is_total"))
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    heavy = shared_checkpoint(heavy)
    total = heavy.where("is_total").first()
    large = heavy.where(F.col("n") * MOST_HEAVY > (total["n"] if total else 0)).where("first <> last").select("code")
    return np.array([r["code"] for r in large.collect()], np.int64)


_CLASSED = [("code", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.int64()), ("runs", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))]
CLASSED = "code bigint, left binary, right binary, n bigint, runs array<struct<low: int, high: int>>"


def extend(code: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which spans over its anchor each row shares with another record: columns by the letters taken from the left.

    Rows are different surroundings of anchors, with the least and greatest record (as numbers) of each. Rows of one anchor
    are split into classes of equal letters, one letter further at each step, on either side.
    """
    n, reach = left.shape
    lefts, rights = [np.unique(code, return_inverse=True)[1]], [np.zeros(n, np.int64)]
    for side, classes in ((left, lefts), (right, rights)):
        for k in range(reach):
            classes.append(np.unique(classes[-1] * 5 + side[:, k], return_inverse=True)[1])
    shared = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        fits = np.flatnonzero((left[:, o - 1] < 4 if o else True) & (right[:, reach - o - 1] < 4 if o < reach else np.ones(n, bool)))
        if fits.size:
            own = np.unique(lefts[o][fits] * n + rights[reach - o][fits], return_inverse=True)[1]
            low, high = np.full(own.max() + 1, first.max() + 1), np.full(own.max() + 1, -1)
            np.minimum.at(low, own, first[fits])
            np.maximum.at(high, own, last[fits])
            shared[fits, o] = (low < high)[own]
    return shared


def _extended(batches: Iterator[pa.RecordBatch], reach: int, together: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """From surroundings sorted by anchor those with shared spans, and runs of these: begun from low to high letters before
    the anchor. Whole groups of an anchor are extended together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= together:
            rows = pa.Table.from_batches(held).combine_chunks()
            codes = rows.column("code").to_numpy()
            whole = int(np.searchsorted(codes, codes[-1]))
            if whole:
                yield _runs(rows.slice(0, whole), reach)
            held, size = rows.slice(whole).to_batches(), rows.num_rows - whole
    if size:
        yield _runs(pa.Table.from_batches(held).combine_chunks(), reach)


def _runs(rows: pa.Table, reach: int) -> pa.RecordBatch:
    code = rows.column("code").to_numpy()
    sides = []
    for name in ("left", "right"):
        data = b"".join(rows.column(name).to_pylist())
        sides.append(np.frombuffer(data, np.uint8).reshape(len(code), reach).astype(np.int64))
    names = np.unique(np.r_[rows.column("first").to_numpy(zero_copy_only=False), rows.column("last").to_numpy(zero_copy_only=False)], return_inverse=True)[1]
    shared = extend(code, *sides, names[: len(code)], names[len(code) :])
    edge = np.diff(np.pad(shared.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    picked, where = np.unique(row, return_inverse=True)
    runs: list[list] = [[] for _ in picked]
    for k, a, b in zip(where.tolist(), low.tolist(), high.tolist()):
        runs[k].append({"low": a, "high": b})
    kept = rows.select(["code", "left", "right", "n"]).take(pa.array(picked)).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(runs, _CLASSED[4][1])], [c for c, _ in _CLASSED])


def _spread_join(many: DataFrame, one: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """``many`` joined to its row of ``one``, whose ``n`` says how many there are; frequent keys are spread over several tasks."""
    # At most rows / rows_per_task keys.
    hot = one.where(F.col("n") > rows_per_task).select(*keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), salts).cast("int"))
    top = F.greatest(F.ceil(F.col("n") / rows_per_task).cast("int"), F.lit(1))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), top - 1)))
    return left.drop("salts").join(right, [*keys, "salt"]).drop("salt", "n")


def _shared_runs(around: DataFrame, reach: int, group_rows: int) -> DataFrame:
    """Different surroundings (with ``first``, ``last``, ``n``) to those with shared spans, and their runs."""
    # Anchors with very many surroundings: at most rows / group_rows of them.
    huge = around.groupBy("code").count().where(F.col("count") > group_rows).select("code", F.lit(True).alias("huge"))
    marked = around.join(F.broadcast(huge), "code", "left")
    ordered = marked.where("huge is null").drop("huge").repartition("code").sortWithinPartitions("code")
    plain = ordered.mapInArrow(lambda batches: _extended(batches, reach), CLASSED)
    # Those are compared span by span: the aggregation combines on the map side, so a frequent span costs no skew.
    spans = (
        marked.where("huge").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(reach))))
        .withColumns({"l": F.substring("left", F.lit(1), F.col("o")), "r": F.substring("right", F.lit(1), F.lit(reach) - F.col("o"))})
        .where(~F.hex(F.concat("l", "r")).contains("04"))
    )
    keys = ["code", "o", "l", "r"]
    both = spans.groupBy(keys).agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count("*").alias("n")).where("a < b").select(*keys, "n")
    met = _spread_join(spans.select(*keys, "left", "right", F.col("n").alias("many")), both, keys, group_rows)
    split = met.groupBy("code", "left", "right").agg(F.max("many").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("o").alias("low"), F.col("o").alias("high")))).alias("runs"))
    return plain.unionByName(split)


def shared_spans(sequences: DataFrame, min_length: int = 40, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Runs of positions that lie in a span of ``min_length`` letters which another record holds too.

    Args:
        sequences: columns ``id`` (string), ``part`` (string), ``no`` (int) and ``letters`` (string); others are
            ignored. A record is an id with all its sequences; each (id, part, no) names one sequence (the runs of
            different texts under one name are merged).
        min_length: 30 or more, so that a window of the cover has at least 10 letters (31 at most).
        group_rows: an anchor with more different surroundings than this is split by its spans, and surroundings that occur
            more often are spread; the result is the same.

    Returns:
        ``id, part, no, span_start, span_end``: from 0, the end not included. Upper and lower case are the same;
        spans with other letters than A, C, G, T don't count; a span lies in one sequence and is compared in the
        same direction only. Null, empty and short sequences, and rows with a null id, have no span. Repeats within
        a record don't count as shared. Exact copies of a row change nothing.
    """
    if min_length < 30:
        raise ValueError("min_length must be at least 30")
    width = min(min_length - PERIOD + 1, 31)
    reach = min_length - width
    rows = sequences.select(F.col("id").cast("string"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("no").cast("int"), F.lit(0)).alias("no"), "letters")
    rows = rows.where(F.col("id").isNotNull() & (F.length("letters") >= min_length))
    # Kept, so that they are made once and keep their numbers.
    rows = shared_checkpoint(rows.withColumn("seq", F.monotonically_increasing_id()))

    texts = rows.select("id", "seq", "letters")
    heavy = _settled(texts.mapInArrow(_windows(width, np.zeros(0, np.int64)), FOUND))
    windows = texts.mapInArrow(_windows(width, heavy), FOUND)
    # A settled code needs no neighbours: its rows are spread over all partitions.
    spread = F.when(F.col("settled"), F.xxhash64("seq", "pos")).otherwise(F.lit(0))
    met = windows.repartition("code", spread).sortWithinPartitions("code", "id").mapInArrow(_streamed, FOUND)
    near = shared_checkpoint(met.groupBy("seq").agg(F.collect_set("pos").alias("near")))

    found = rows.join(near, "seq").select("id", "part", "no", "letters", "near").mapInArrow(_surrounded(width, reach), AROUND)
    around = found.groupBy("code", "left", "right").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    classed = _shared_runs(around, reach, group_rows)
    placed = _spread_join(found, classed, ["code", "left", "right"], group_rows)
    run = placed.select("id", "part", "no", "pos", F.explode("runs").alias("x"))
    spans = run.select("id", "part", "no", (F.col("pos") - F.col("x.high")).alias("s"), (F.col("pos") - F.col("x.low") + min_length).alias("e")).distinct()
    # A sequence has no more runs than letters, and was a single row before.
    order = Window.partitionBy("id", "part", "no").orderBy("s")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("s") > reached, F.lit(True)).cast("int")
    return (
        spans.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("id", "part", "no", "run")
        .agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
        .drop("run")
    )


def shared_shares(sequences: DataFrame, spans: DataFrame) -> DataFrame:
    """Per record its number of letters, how many of them lie in shared spans, and their share (null without letters)."""
    letters = sequences.where(F.col("id").isNotNull()).groupBy("id").agg(F.sum(F.coalesce(F.length("letters"), F.lit(0))).alias("n_letters"))
    found = spans.groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    shared = F.coalesce("n", F.lit(0))
    return letters.join(found, "id", "left").select(
        "id", "n_letters", shared.alias("n_shared"), F.when(F.col("n_letters") > 0, shared / F.col("n_letters")).alias("share")
    )
