"""Best-fit packing after Martello-Toth dominance reduction.

Packing only looks at how many pieces there are of each length, so the instance is a histogram of at most `capacity`
numbers however large the corpus. Reduction fixes small sets of lengths that provably dominate every other set with
the same longest piece; best-fit decreasing packs the rest, many equal bins at a time. The plan is a list of runs, of a
size bounded by the capacity alone, and pieces find their places by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import small_batches, written

CAPACITY = 2048
END_ID = 0

#: (length, first rank, pieces, first bin, pieces a bin, offset in the bin)
Run = tuple[int, int, int, int, int, int]


def _best_sum(sizes: list[int], most: int) -> int:
    """Largest sum up to most of two pieces or more, any number of each size: an upper bound for what a set can hold."""
    mask, total = (1 << (most + 1)) - 1, 0
    frontier = sum(1 << s for s in sizes)
    while frontier:
        step = 0
        for s in sizes:
            step |= frontier << s
        frontier = step & mask & ~total
        total |= frontier
    return max(total.bit_length() - 1, 0)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins fixed by dominance as (lengths, how often), and the counts that remain.

    For the longest remaining piece j, a set {j, k} dominates all others with j where k is the largest that fits and
    (a) fills the bin exactly, or (b) nothing that fits beside j sums to more than k. {j} alone dominates where nothing
    fits; {j, k, b} where at most two fit beside j, k and b are the largest choices in turn and every pair with a
    smaller piece above b sums to k at most. Fixing a dominating set costs no bin in any packing.
    """
    left = {s: n for s, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for s in lengths:
            left[s] -= times
            if not left[s]:
                del left[s]
                sizes.remove(s)

    for j in range(capacity, 0, -1):
        while left.get(j):
            room = capacity - j
            fit = [s for s in sizes[: bisect.bisect_right(sizes, room)] if s != j or left[j] > 1]
            if not fit:
                take((j,), left[j])
                continue
            k = fit[-1]
            times = left[j] // 2 if j == k else min(left[j], left[k])
            least = [s for s in fit[:3] for _ in range(min(3, left[s] - (s == j)))][:3]  # the smallest beside j
            if k == room or len(least) < 2 or least[0] + least[1] > room or _best_sum(fit, room) <= k:
                take((j, k), times)
                continue
            if len(least) < 3 or sum(least[:3]) > room:  # at most two beside j
                rest = [s for s in fit if s <= room - k and left[s] > (s == j) + (s == k)]
                if rest:
                    b = rest[-1]
                    above = [s for s in fit if s > b]
                    worst = max((s + t for s in above for t in above if s + t <= room), default=0)
                    if worst <= k:
                        take((j, k, b), 1)
                        continue
            break
    return fixed, left


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of bins."""
    ranks = dict.fromkeys(counts, 0)
    runs: list[Run] = []
    bins = 0

    def place(size: int, n: int, first_bin: int, per: int, offset: int) -> None:
        runs.append((size, ranks[size], n, first_bin, per, offset))
        ranks[size] += n

    fixed, left = reduce_dominated(counts, capacity)
    for lengths, times in fixed:
        offset = 0
        for s in lengths:
            place(s, times, bins, 1, offset)
            offset += s
        bins += times
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of bins (first, how many)
    rooms: list[int] = []

    def offer(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room, first, many = capacity, bins, -(-n // (capacity // s))
                bins += many
            per = room // s
            full = min(many, n // per)
            if full:
                place(s, full * per, first, per, capacity - room)
                offer(room - per * s, first, full)
                n -= full * per
                first, many = first + full, many - full
            if many and n:
                place(s, n, first, n, capacity - room)  # fewer than fit in one bin
                offer(room - n * s, first, 1)
                first, many, n = first + 1, many - 1, 0
            offer(room, first, many)
    return runs, bins


def encoder(vocabulary: bytes, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level BPE tokenizer's JSON file, as the tokenizers library gives them.

    The merges run in a faster engine, whose ranks are the file's ids; the file's added tokens are found in texts as they
    stand. Merge order must be that of the ids, as it is in files that were trained so.
    """
    import tiktoken

    spec = json.loads(vocabulary)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    bytes_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(bytes_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def _pieces(vocabulary: bytes, pattern: str, capacity: int):
    """Token ids of each text, cut into pieces; each piece knows its place among those of its length in its partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array(encode(text or ""), "<u4")
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                start, end, piece = 0, min(first, len(ids)), 0
                while start < len(ids):
                    size = end - start
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start:end].tobytes()), part, seen[size]))
                    seen[size] += 1
                    start, end, piece = end, end + capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Place every document's tokens in sequences of at most capacity tokens.

    vocabulary: a tokenizer's JSON file, read on the driver; pattern is what it splits text by before merges. A document
    is its ids (those of the file's added tokens where their strings stand in a text) and END_ID; one that is longer than capacity is cut, its first piece taking
    the remainder. Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece. A null or
    empty text is END_ID alone; repeated rows are packed as often as they occur, null ids stay null, other columns are
    ignored, and an empty table gives no pieces.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        tokenizer = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = written(rows.mapInPandas(_pieces(tokenizer, pattern or public_tokenizers.PATTERN, capacity), schema), "pieces")
    local = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = local.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = spark.createDataFrame(runs, "length long, first long, many long, bin long, per long, at long")
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).alias("p")
    here = (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.first")) & (F.col("p.rank") < F.col("r.first") + F.col("r.many"))
    k = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(placed.alias("r")), here).select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("bin") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("p.length")).alias("offset")
    )
