"""Items into containers of a fixed capacity, by swap-based local search in bounded blocks.

Items are spread over blocks of a bounded size. In a block they are first placed best-fit, longest first. Then the
underfull containers are searched: the emptiest one is the giver, and its items are moved into another container, or
exchanged one for one, two for one or one for two, whenever that raises the sum of the squared fills, until the giver
is empty. Containers that stay underfull leave their block; their items are gathered into fewer, again bounded, blocks
and packed anew, until a round saves no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import shared_checkpoint

BLOCK_ITEMS = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items of each bin: each item, longest first, into the fullest bin that it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills; never makes a bin overfull.

    The emptiest bin gives first. All underfull bins give and take, again and again, until a whole pass changes nothing.
    Bins that hold the same sizes are looked at once.
    """
    held = [sorted((sizes[i], i) for i in b) for b in bins]
    fill = [sum(s for s, _ in b) for b in held]
    kinds = Underfull(held, fill, capacity)
    for b in range(len(bins)):
        kinds.enter(b)
    changed = True
    while changed:
        changed = False
        stuck: set[tuple[int, ...]] = set()  # since the last change
        for giver in sorted((b for own in kinds.bins.values() for b in own), key=lambda b: (fill[b], b)):
            kind = _kind(held[giver])
            if kind not in kinds.bins or kind in stuck:
                continue
            kinds.leave(giver)
            moved = True
            while held[giver] and moved:
                moved = any(_step(held, fill, capacity, giver, item, kinds) for item in dict((x[0], x) for x in held[giver][::-1]).values())
                if moved:
                    changed = True
                    stuck.clear()
            kind = _kind(held[giver])
            if kind in kinds.bins:  # so it was tried with its like, too
                stuck.add(kind)
            kinds.enter(giver)
    return [[i for _, i in b] for b in held if b]


def _kind(items: list[tuple[int, int]]) -> tuple[int, ...]:
    return tuple(s for s, _ in items)


class Underfull:
    """The underfull bins by the sizes that they hold, with an index by room."""

    def __init__(self, held: list[list[tuple[int, int]]], fill: list[int], capacity: int):
        self.held, self.fill, self.capacity = held, fill, capacity
        self.bins: dict[tuple[int, ...], dict[int, None]] = {}
        self.by_room: list[tuple[int, tuple[int, ...]]] = []  # (-room, sizes), sorted: the roomiest first

    def enter(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            kind = _kind(self.held[b])
            if kind not in self.bins:
                self.bins[kind] = {}
                insort(self.by_room, (self.fill[b] - self.capacity, kind))
            self.bins[kind][b] = None

    def leave(self, b: int) -> None:
        kind = _kind(self.held[b])
        own = self.bins[kind]
        del own[b]
        if not own:
            del self.bins[kind]
            del self.by_room[bisect_left(self.by_room, (self.fill[b] - self.capacity, kind))]


def _exchange(own: list[tuple[int, int]], item: tuple[int, int], theirs: list[tuple[int, int]], room: int):
    """Of all ways to bring ``item`` into a bin with that room the one that fills it most: (growth, in, out)."""
    size = item[0]
    if size <= room:
        return size, (item,), ()
    best = (0, (), ())
    at = bisect_left(theirs, (size - room, -1))  # one for one: the smallest that makes place
    if at < len(theirs) and theirs[at][0] < size:
        best = (size - theirs[at][0], (item,), (theirs[at],))
    low, high = 0, len(theirs) - 1  # two out for one in: the smallest sum that makes place
    while low < high and best[0] < room:
        both = theirs[low][0] + theirs[high][0]
        if both < size - room:
            low += 1
        else:
            if both < size and size - both > best[0]:
                best = (size - both, (item,), (theirs[low], theirs[high]))
            high -= 1
    for out in theirs[bisect_left(theirs, (size, -1)) :]:  # one out for two in
        if best[0] == room:
            break
        k = bisect_left(own, (room + out[0] - size + 1, -1)) - 1
        if k >= 0 and own[k] == item:
            k -= 1
        if k >= 0 and size + own[k][0] - out[0] > best[0]:
            best = (size + own[k][0] - out[0], (item, own[k]), (out,))
    return best


def _step(held, fill, capacity, giver, item, kinds) -> bool:
    """The one change that takes ``item`` out of the giver and raises the squared fill most, if any does."""
    most, chosen = 0, None
    for less, kind in kinds.by_room:
        room = -less
        if room * (capacity - fill[giver]) <= most:  # what filling it up would bring; later ones have less room
            break
        b = next(iter(kinds.bins[kind]))
        grow, there, back = _exchange(held[giver], item, held[b], room)
        gain = grow * (fill[b] - fill[giver] + grow)
        if grow and gain > most:
            most, chosen = gain, (b, grow, there, back)
    if chosen is None:
        return False
    b, grow, there, back = chosen
    kinds.leave(b)
    for source, target, items in ((giver, b, there), (b, giver, back)):
        for x in items:
            held[source].remove(x)
            insort(held[target], x)
    fill[giver] -= grow
    fill[b] += grow
    kinds.enter(b)
    return True


PACKED = "block bigint, bin int, item_id bigint, piece_no int, n_tokens int, fill int"


def _pack(capacity: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "piece_no"], ignore_index=True)
        sizes = rows["n_tokens"].tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        number, fill = [0] * len(sizes), [0] * len(sizes)
        for n, b in enumerate(sorted(bins, key=min)):
            total = sum(sizes[i] for i in b)
            for i in b:
                number[i], fill[i] = n, total
        return pd.DataFrame({"block": key[0], "bin": number, "item_id": rows["item_id"], "piece_no": rows["piece_no"], "n_tokens": sizes, "fill": fill})

    return pack


def _containers(packed: DataFrame) -> int:
    return packed.select("block", "bin").distinct().count()


def pack_items(items: DataFrame, capacity: int, block_items: int = BLOCK_ITEMS, full: float = 0.995, seed: int = 0) -> DataFrame:
    """Every item in exactly one container; no container above the capacity.

    Args:
        items: columns ``item_id`` (bigint) and ``n_tokens`` (int); others are ignored. Rows with a null id, and
            items of null or no tokens, take no part. Repeated rows are one item; of an id with different sizes the
            largest counts.
        capacity: the most tokens of a container.
        block_items: about the most items that one task packs together.
        full: containers that are filled at least so far stay; others are gathered and packed anew, in rounds, until a
            round saves no container or all of them fit in one block.

    Returns:
        ``container_id`` (string), ``item_id``, ``piece_no``, ``token_start``, ``n_tokens`` and ``fill`` (all tokens
        of the container). An item larger than the capacity is divided into pieces: full containers of their own
        and a remainder, packed as an item; piece_no counts from 0. Other items are one piece.
    """
    sized = items.where(F.col("item_id").isNotNull() & (F.col("n_tokens") > 0)).groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max("n_tokens").cast("int").alias("n_tokens"))
    sized = shared_checkpoint(sized)
    whole = sized.where(F.col("n_tokens") >= capacity).select(
        "item_id", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece_no")
    )
    done = [
        whole.select(
            F.concat(F.lit("full-"), "item_id", F.lit("-"), "piece_no").alias("container_id"),
            "item_id", "piece_no", F.lit(capacity).alias("n_tokens"), F.lit(capacity).alias("fill"),
        )
    ]
    rest = sized.select("item_id", (F.col("n_tokens") / capacity).cast("int").alias("piece_no"), (F.col("n_tokens") % capacity).cast("int").alias("n_tokens")).where("n_tokens > 0")
    turn, before = 0, None
    while blocks := -(-rest.count() // block_items):
        block = F.pmod(F.xxhash64("item_id", F.lit(seed + turn)), F.lit(blocks)).cast("int").alias("block")
        spread = rest.select(block, "item_id", "piece_no", "n_tokens").repartitionById(blocks, "block")  # one block a task
        packed = shared_checkpoint(spread.groupBy("block").applyInPandas(_pack(capacity), PACKED))
        last = blocks == 1 or (before is not None and _containers(packed) >= before)
        settled = packed if last else packed.where(F.col("fill") >= full * capacity)
        done.append(settled.select(F.concat_ws("-", F.lit(turn), "block", "bin").alias("container_id"), "item_id", "piece_no", "n_tokens", "fill"))
        if last:
            break
        underfull = packed.where(F.col("fill") < full * capacity)
        rest, before, turn = underfull.select("item_id", "piece_no", "n_tokens"), _containers(underfull), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("token_start", F.col("piece_no") * capacity)
