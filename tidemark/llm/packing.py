"""Filling containers of fixed capacity: tiers by length, gap filling from shorter tiers, balanced step groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import rank_within, staged
from .tokens import TOKENIZER_FILE, token_sizes


@dataclass
class Plan:
    """Runs of items of one size that go to consecutive containers.

    Run i takes the items of size `size[i]` from rank `rank[i]` on and puts them into window `window[i]` of the containers from
    `container[i]` on. For each run of containers in `first`, `fill` gives the tokens that one of them holds and `tier` the tier of its
    windows. Containers are numbered by tier and, within it, by falling fill.
    """

    size: np.ndarray
    rank: np.ndarray
    container: np.ndarray
    window: np.ndarray
    first: np.ndarray
    fill: np.ndarray
    tier: np.ndarray
    containers: int


def tier_limits(capacity: int, tiers: int) -> list[int]:
    """Window length of each tier: the capacity and its halves."""
    return [max(1, capacity >> t) for t in range(tiers)]


@dataclass
class _Held:
    """What a window holds: `items` of `size`, and what it held before."""

    size: int
    items: int
    before: _Held | None


class _Windows:
    """Open windows as runs of equal content, by gap."""

    def __init__(self) -> None:
        self.gaps: list[int] = []  # distinct gaps, ascending
        self.runs: dict[int, list[tuple[_Held, int]]] = {}  # gap: (content, windows)

    def put(self, gap: int, held: _Held, n: int) -> None:
        if gap not in self.runs:
            self.runs[gap] = []
            insort(self.gaps, gap)
        self.runs[gap].append((held, n))

    def fill(self, size: int, items: int) -> int:
        """Give `items` of `size` to the tightest gaps that hold them; returns how many found none."""
        while items:
            at = bisect_left(self.gaps, size)
            if at == len(self.gaps):
                break
            gap = self.gaps[at]
            held, n = self.runs[gap].pop()
            if not self.runs[gap]:
                del self.runs[gap], self.gaps[at]
            each = min(gap // size, items)  # of one window; as many windows as get that many
            taken = min(n, items // each)
            if taken < n:
                self.put(gap, held, n - taken)
            self.put(gap - each * size, _Held(size, each, held), taken)
            items -= each * taken
        return items

    def open(self, length: int, size: int, items: int) -> None:
        each = length // size
        full, rest = divmod(items, each)
        if full:
            self.put(length - each * size, _Held(size, each, None), full)
        if rest:
            self.put(length - rest * size, _Held(size, rest, None), 1)


def _contents(held: _Held | None) -> list[tuple[int, int]]:
    out = []
    while held:
        out.append((held.size, held.items))
        held = held.before
    return out


def _packed(histogram: dict[int, int], limits: list[int], slack: float) -> list[tuple[int, int, list[tuple[int, int]], int]]:
    """Runs (tier, fill, content, windows) for items by size."""
    rest, loose, out = dict(histogram), {}, []
    for t, length in enumerate(limits):
        windows = _Windows()
        floor = limits[t + 1] if t + 1 < len(limits) else 0
        for size in sorted((s for s in rest if floor < s <= length), reverse=True):
            windows.open(length, size, windows.fill(size, rest.pop(size)))
        for size in sorted(rest, reverse=True):  # gaps are filled from the shorter tiers
            if left := windows.fill(size, rest[size]):
                rest[size] = left
            else:
                del rest[size]
        for gap in windows.gaps:
            for held, n in windows.runs[gap]:
                content = _contents(held)
                if t and gap > length * slack:  # a short window that stays loose is dissolved
                    for size, items in content:
                        loose[size] = loose.get(size, 0) + items * n
                else:
                    out.append((t, length - gap, content, n))
    windows = _Windows()
    for size in sorted(loose, reverse=True):
        windows.open(limits[0], size, windows.fill(size, loose[size]))
    return out + [(0, limits[0] - gap, _contents(held), n) for gap in windows.gaps for held, n in windows.runs[gap]]


def plan_containers(histogram: dict[int, int], capacity: int, tiers: int = 4, slack: float = 0.004) -> Plan:
    """Containers for `histogram` (items by size, 1..capacity).

    A tier has windows of its own length (the capacity and its halves). Items are routed to the tier of the shortest window that
    holds them. Tiers are packed from the longest on: its items, by falling size, go to the tightest gap that holds them or open a
    window of the tier; the gaps that stay are filled with items of the shorter tiers. Short windows with more than `slack` of their
    length unused are dissolved and their items packed into windows of full length. A container of a shorter tier has two or more of
    its windows side by side. Work and result grow with the distinct sizes (at most `capacity`), not with the items, as windows of the
    same content are handled as one run.
    """
    limits = tier_limits(capacity, tiers)
    packed = sorted(_packed(histogram, limits, slack), key=lambda r: -r[1])
    runs: list[tuple[int, int, list[list[tuple[int, int]]], int]] = []  # tier, fill, contents of its windows, containers
    for t, length in enumerate(limits):
        each, spare = capacity // length, []
        for _, fill, content, n in (r for r in packed if r[0] == t):
            if n >= each:
                runs.append((t, fill * each, [content] * each, n // each))
            spare += [(fill, content)] * (n % each)
        for lo in range(0, len(spare), each):
            runs.append((t, sum(f for f, _ in spare[lo : lo + each]), [c for _, c in spare[lo : lo + each]], 1))
    runs.sort(key=lambda r: (r[0], -r[1]))
    placed: dict[int, list[tuple[int, int, int]]] = {}  # size: (container, window, containers)
    first, at = [], 0
    for _, _, contents, n in runs:
        first.append(at)
        for w, content in enumerate(contents):
            for size, items in content:
                placed.setdefault(size, []).extend([(at, w, n)] * items)
        at += n
    cut = []
    for size in sorted(placed):
        rank = 0
        for container, window, n in placed[size]:
            cut.append((size, rank, container, window))
            rank += n
    parts = np.array(cut, dtype=np.int64).reshape(-1, 4)
    column = lambda i: np.array([r[i] for r in runs], dtype=np.int64)
    return Plan(parts[:, 0], parts[:, 1], parts[:, 2], parts[:, 3], np.array(first, dtype=np.int64), column(1), column(0), at)


def step_groups(plan: Plan, container: np.ndarray, group_size: int) -> np.ndarray:
    """Step group of each container. A group has containers of one tier only; a tier's containers, in order of their fill, are dealt to
    its groups there and back."""
    tiers = np.unique(plan.tier)
    start = np.array([plan.first[plan.tier == t].min() for t in tiers], dtype=np.int64)
    count = np.diff(np.append(start, plan.containers))
    groups = np.maximum(1, -(-count // group_size))
    of = np.searchsorted(start, container, "right") - 1
    turn, at = np.divmod(container - start[of], groups[of])
    return (np.cumsum(groups) - groups)[of] + np.where(turn % 2 == 0, at, groups[of] - 1 - at)


def pack(items: DataFrame, item_id: str = "doc_id", size: str = "n_tokens", capacity: int = 2000, tiers: int = 4, group_size: int = 64, salts: int = 64, slack: float = 0.004) -> DataFrame:
    """Pack `items` (an id and a size) into containers of `capacity`, never splitting one that fits.

    Columns: `item_id`, piece_no (0 but for items above the capacity, which are cut into full pieces and a rest), n_tokens of the
    piece, container (from 0, by tier and falling fill), tier (0 the longest windows) and window of the container that it is in,
    unused (space left in the container), step_group. Items with null or no size take no space: container, tier, window and step_group
    are null, unused 0. Repeated ids are items of their own. Other columns are not carried. No items, no rows.

    The only thing gathered is the count of items by size, at most `capacity` rows. See `plan_containers`.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = items.select(F.col(item_id).alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    pieces = sized.select("_id", "_size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no"))
    pieces = pieces.select("_id", "piece_no", F.least(F.lit(capacity), F.col("_size") - F.col("piece_no").cast("bigint") * capacity).cast("int").alias("n_tokens"))
    pieces = staged(pieces, "pieces")
    histogram = {r.n_tokens: r["count"] for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}
    plan = plan_containers(histogram, capacity, tiers, slack)
    ranked = rank_within(pieces, ["n_tokens"], [], ["_id", "piece_no"], salts, "_rank")
    span = 1 << 40
    starts = plan.size * span + plan.rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, rank = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            empty = tokens == 0
            zero = np.zeros(len(tokens), dtype=np.int64)
            container = window = tier = unused = group = zero
            if len(starts):
                run = np.maximum(np.searchsorted(starts, tokens * span + rank, "right") - 1, 0)
                container = np.where(empty, 0, plan.container[run] + rank - plan.rank[run])
                at = np.searchsorted(plan.first, container, "right") - 1
                window, tier, unused, group = plan.window[run], plan.tier[at], np.where(empty, 0, capacity - plan.fill[at]), step_groups(plan, container, group_size)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array(container, mask=empty), pa.array(tier.astype(np.int32), mask=empty), pa.array(window.astype(np.int32), mask=empty),
                    pa.array(unused.astype(np.int32)), pa.array(group, mask=empty),
                ],
                names=[item_id, "piece_no", "n_tokens", "container", "tier", "window", "unused", "step_group"],
            )

    kind = items.schema[item_id].dataType.simpleString()
    return ranked.select("_id", "piece_no", "n_tokens", "_rank").mapInArrow(place, f"`{item_id}` {kind}, piece_no int, n_tokens int, container bigint, tier int, window int, unused int, step_group bigint")


def pack_texts(docs: DataFrame, capacity: int = 2000, tokenizer_file: str = TOKENIZER_FILE, **options) -> DataFrame:
    """`pack` for doc_id and text: sizes are tokens; a null or empty text has none."""
    return pack(token_sizes(docs.select("doc_id", "text"), tokenizer_file=tokenizer_file), capacity=capacity, **options)


def containers(packed: DataFrame) -> DataFrame:
    """One row per container: container, tier, step_group, items, n_tokens, unused."""
    return packed.filter("container is not null").groupBy("container", "tier", "step_group").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("n_tokens"), F.first("unused").alias("unused"))
