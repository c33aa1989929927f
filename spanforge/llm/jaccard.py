"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles, each set an embedding of MinHash values: two sets agree on a coordinate with the
probability of their Jaccard similarity. A run starts at a root and, at every node, samples FANOUT coordinates; the
sets that share a node's path and the value at a sampled coordinate go to the same child bucket. Buckets of at most
`small` sets are brute-forced, larger ones are split again, and what is still large at the last depth is brute-forced
in blocks. Runs repeat until a pair at the threshold is found with the target recall. Brute force compares embeddings
first; connected candidates then meet in groups where their exact shingle sets are compared, each pair once. Only
texts that may be candidates, by a bitmap of their hashes, are sent to those groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import dropped, small_batches, with_group, written, written_at
from spanforge.llm.graph import components

COORDS = 64  # embedded coordinates that paths sample
SKETCH = 128  # coordinates compared in brute force, a byte each
FANOUT = 2  # coordinates sampled at a node
DEPTH = 3  # levels of splitting at most
MARK_BLOCK = 1024  # sets in a block of brute force over embeddings
SET_BLOCK = 2**20  # shingles in a block of brute force over exact sets; a set counts as LEAST to MOST, so a block has 256 to 2048 sets
LEAST, MOST = 512, 4096
SIEVE_BITS = 2**28  # of the bitmap of candidates, at most: 32 MB

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_XOR = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
_POS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def runs_for(recall: float, threshold: float, fanout: int = FANOUT, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the last depth with probability recall."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - threshold * meet) ** fanout
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; a shorter text with a word has one shingle of all its words."""
    out: list[np.ndarray] = []
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    start, ends = 0, np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64))
    while start < len(texts):  # slices of some MB keep the working arrays in cache
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
        out += _shingles(texts.slice(start, stop - start), n)
        start = stop
    return out


def _shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    empty = np.empty(0, np.uint64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(bounds[-1] - bounds[0])
    if not size:
        return [empty] * len(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    solid = ~_SPACE[data]
    fresh = np.zeros(size + 1, bool)
    fresh[bounds] = True  # a text's first byte
    before = np.empty(size, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    if not len(starts):
        return [empty] * len(texts)
    power = np.empty(size, np.uint64)
    power[0], power[1:] = 1, _R
    np.multiply.accumulate(power, out=power)
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    back = np.empty(len(starts), np.uint64)
    inverse = np.empty(size, np.uint64)
    inverse[0], inverse[1:] = 1, _RINV
    np.multiply.accumulate(inverse, out=inverse)
    back = inverse[starts]
    word = _mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(bounds, starts, "right") - 1
    # with empty texts several bounds are equal; the last of them owns the byte
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    full = len(word) - n + 1
    if full > 0:
        grams = np.zeros(full, np.uint64)
        for k in range(n):
            grams += word[k : k + full] * _POS[k]
        grams = _mix(grams)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _POS[32 : 32 + b - a]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(empty)
    return out


def minhash(tokens: np.ndarray) -> np.ndarray:
    """SKETCH minima of a non-empty set."""
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    best = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, ((x[i : i + 1024, None] ^ _XOR) * _MUL).min(0), out=best)
    return best


def _embed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingles(part.column(2), n)
                marks = [minhash(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([m[:COORDS].view(np.int32) if m is not None else None for m in marks], pa.list_(pa.int32())),
                        pa.array([(m >> np.uint32(24)).astype(np.uint8).tobytes() if m is not None else None for m in marks], pa.binary()),
                    ],
                    names=["doc", "node", "n", "emb", "sk"],
                )

    return run


def _joined(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, m: int) -> np.ndarray:
    """Least index of each of m rows' component, where near[i, j] links rows[i] to cols[j]."""
    labels = np.arange(m, dtype=np.int32)
    while True:
        new = labels.copy()
        for i in range(0, len(rows), 256):
            part, at = near[i : i + 256], rows[i : i + 256]
            new[at] = np.minimum(new[at], np.where(part, labels[cols][None, :], np.int32(m)).min(1))
            new[cols] = np.minimum(new[cols], np.where(part, labels[at][:, None], np.int32(m)).min(0))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _agree(x: np.ndarray, size: np.ndarray, rows: np.ndarray, cols: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Which pairs of rows and cols have embeddings and sizes that allow the threshold."""
    same = np.zeros((len(rows), len(cols)), np.uint8)  # SKETCH at most
    left, right = (np.ascontiguousarray(x[at].T) for at in (rows, cols))
    for k in range(SKETCH):
        same += left[k][:, None] == right[k][None, :]
    low, high = np.minimum.outer(size[rows], size[cols]), np.maximum.outer(size[rows], size[cols])
    return (same >= least) & (low >= threshold * high - 1e-9)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys from batches sorted by them; a group may lie across batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        differs = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            differs[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(differs)]
        for i, j in zip(at, at[1:], strict=False):
            yield batch.iloc[i:j]
        rest = batch.iloc[at[-1] :]
    if rest is not None and len(rest):
        yield rest


def _candidates(threshold: float, least: int, keys: list[str]):
    """Spanning edges (a, b) of each bucket's pairs whose embeddings agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = [], []
        for group in _groups(batches, keys):
            node = group["node"].to_numpy()
            node, at = np.unique(node, return_index=True)
            if len(node) > 1:
                x = np.frombuffer(b"".join(group["sk"].to_numpy()[at]), np.uint8).reshape(-1, SKETCH)
                if len(node) == 2:
                    s = group["n"].to_numpy()[at]
                    if min(s) >= threshold * max(s) - 1e-9 and (x[0] == x[1]).sum() >= least:
                        left.append(node[:1]), right.append(node[1:])
                else:
                    rows = cols = np.arange(len(node))
                    if "p" in keys:  # pairs inside a block are met where that block meets itself
                        block = group["block"].to_numpy()[at]
                        rows, cols = (np.flatnonzero(block == group[k].iloc[0]) for k in ("p", "q"))
                    if not len(rows) or not len(cols):
                        continue
                    roots = _joined(_agree(x, group["n"].to_numpy()[at], rows, cols, threshold, least), rows, cols, len(node))
                    moved = roots != np.arange(len(node))
                    left.append(node[moved]), right.append(node[roots[moved]])
            if len(left) > 2000:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
                left, right = [], []
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def _by_token(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets' distinct tokens; where each one's rows begin and how many they are; the rows."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    distinct, at, count = np.unique(tokens[order], return_index=True, return_counts=True)
    return distinct, at, count, np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]


def _ranges(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, count[k] numbers from at[k] on; and the k of each number."""
    which = np.repeat(np.arange(len(at)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + at[which], which


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left shares with each of right: tokens of many pairs by matrices, those of few pair by pair."""
    m, k = len(left), len(right)
    out = np.zeros((m, k), np.int32)
    x, y = (one := _by_token(left)), one if left is right else _by_token(right)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    xat, xn, yat, yn = x[1][i], x[2][i], y[1][j], y[2][j]
    pairs = xn * yn
    many = np.flatnonzero(pairs > m * k / 256)
    for at in range(0, len(many), 1024):
        c = many[at : at + 1024]
        blocks = []
        for rows, start, count, size in ((x[3], xat[c], xn[c], m), (y[3], yat[c], yn[c], k)):
            place, col = _ranges(start, count)
            blocks.append(np.zeros((size, len(c)), np.float32))
            blocks[-1][rows[place], col] = 1
        out += (blocks[0] @ blocks[1].T).astype(np.int32)
    few = np.flatnonzero(pairs <= m * k / 256)
    ends, at = np.cumsum(pairs[few]), 0
    while at < len(few):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
        c = few[at:stop]
        place, col = _ranges(np.zeros(len(c), np.int64), pairs[c])
        rows = x[3][xat[c][col] + place // yn[c][col]] * k + y[3][yat[c][col] + place % yn[c][col]]
        out += np.bincount(rows, minlength=m * k).reshape(m, k).astype(np.int32)
        at = stop
    return out


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None = None, *, threshold: float) -> np.ndarray:
    """Which pairs of a set of left and one of right have the threshold, from exact set sizes; of two of left where right is None."""
    size, other = (np.array([len(x) for x in sets], np.int64) for sets in (left, left if right is None else right))
    shared = shared_tokens(left, left if right is None else right)
    near = np.empty(shared.shape, bool)
    for i in range(0, len(left), 256):
        near[i : i + 256] = shared[i : i + 256] >= threshold * (size[i : i + 256, None] + other - shared[i : i + 256]) - 1e-9
    if right is None:
        np.fill_diagonal(near, False)
    return near


def _verify(threshold: float, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["comp", "p", "q"]):
            group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
            node, copies, block = (group[c].to_numpy() for c in ("node", "copies", "block"))
            p, q = int(group["p"].iloc[0]), int(group["q"].iloc[0])
            sets = shingles(pa.array(group["text"], pa.large_string()), n)
            rows, cols = np.flatnonzero(block == p), np.flatnonzero(block == q)
            if not len(rows) or not len(cols):
                continue
            links, texts = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            if p == q:
                near = exact_links(sets, threshold=threshold)
            else:  # pairs inside a block are met where that block meets itself
                near = exact_links([sets[i] for i in rows], [sets[i] for i in cols], threshold=threshold)
                links[cols], texts[cols] = copies[rows] @ near, near.sum(0)
            links[rows], texts[rows] = near @ copies[cols], near.sum(1)
            roots = _joined(near, rows, cols, len(node))
            yield pd.DataFrame({"node": node, "links": links, "texts": texts, "root": node[roots]})

    return run


def _sieve(nodes: DataFrame):
    """A filter of record batches that lets the rows of these nodes through, and few others: a bitmap of 16 bits a node."""
    spark = nodes.sparkSession
    bits = min(SIEVE_BITS, 1 << max(10, (16 * nodes.count()).bit_length()))
    at = F.col("node").bitwiseAND(F.lit(bits - 1))
    words = nodes.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("node").to_numpy() & (bits - 1)
            yield batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))

    return run


def _block_pairs(df: DataFrame, size: Column, block: int) -> DataFrame:
    """Rows of a key, once for each pair of blocks that holds theirs; blocks by hash, `block` of the key's size each on average."""
    blocks = F.ceil(size / F.lit(block)).cast("int")
    return (
        df.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("p", F.least("block", "other"))
        .withColumn("q", F.greatest("block", "other"))
        .drop("other", "blocks")
    )


def _multi(buckets: DataFrame) -> DataFrame:
    """Rows (bucket, node) of buckets that hold two sets or more, with the number m."""
    return with_group(buckets, "bucket", "node", "m", F.count(F.lit(1)), F.sum).where("m > 1")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 64) -> DataFrame:
    """All links of Jaccard similarity >= threshold between texts, as a row for each document.

    Words are runs of characters outside white space, taken as they are; shingles are ngram words in a row, and a
    text with fewer words has one shingle of all of them. Returns, for every row of docs:
    doc_id, text_id (least doc_id with an equal text), class_id (least doc_id of the connected component of links;
    its own text_id where there are none), n_links (other documents, copies included, at or above the threshold) and
    n_text_links (different texts so linked). Null and blank texts have no shingles: nothing but an equal text links
    to them. Repeated rows count as copies; a null id stays in its class but never names it. Other columns are ignored.
    recall is the probability with which the paths meet for a pair at the threshold (more for closer pairs).
    """
    rows = _rows(docs, id_col, text_col)
    return rows.select("doc", "node").join(_classes(rows, ngram, threshold, recall, small), "node").select(F.col("doc").alias("doc_id"), "text_id", "class_id", "n_links", "n_text_links")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc", _node(F.col("text")).alias("node"), "text")


def _node(text: Column) -> Column:
    return F.xxhash64(text, F.lit("text"))


def _classes(rows: DataFrame, ngram: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 64) -> DataFrame:
    """Class (label, class_id), text_id and links of every different text of rows (doc, node, text)."""
    small_batches(rows.sparkSession)
    marked = rows.select(F.col("doc").cast("long").alias("doc"), "node", "text").mapInArrow(_embed(ngram), "doc long, node long, n int, emb array<int>, sk binary")
    cls = written(marked.groupBy("node").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("emb").alias("emb"), F.first("sk").alias("sk")), "texts")

    runs = runs_for(recall, threshold)
    start = [(r, (r * FANOUT + k) * 5 % COORDS) for r in range(runs) for k in range(FANOUT)]
    root = F.array(*[F.xxhash64(F.lit(r), F.lit(c), F.col("emb")[c]) for r, c in start])
    level, path = written_at(_multi(cls.where("n > 0").select("node", F.explode(root).alias("bucket"))), "buckets")
    used = [path]
    least = math.floor(SKETCH * threshold - 4.3 * math.sqrt(SKETCH * threshold * (1 - threshold)))
    done, hot = [level.where(F.col("m") <= small)], level.where(F.col("m") > small)
    for _ in range(DEPTH - 1):
        if hot.isEmpty():
            break
        picks = F.array(*[F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(COORDS // FANOUT)).cast("int") + k * (COORDS // FANOUT) for k in range(FANOUT)])
        child = hot.join(cls.select("node", "emb"), "node").select("node", "bucket", "emb", F.explode(picks).alias("c")).select("node", F.xxhash64("bucket", "c", F.col("emb")[F.col("c")]).alias("bucket"))
        level, path = written_at(_multi(child), "buckets")
        used.append(path)
        done.append(level.where(F.col("m") <= small))
        hot = level.where(F.col("m") > small)
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)
    marks = cls.select("node", "n", "sk")
    small_rows = pairs.select("bucket", "node").join(marks, "node").repartition("bucket").sortWithinPartitions("bucket")
    found = small_rows.select("bucket", "node", "n", "sk").mapInPandas(_candidates(threshold, least, ["bucket"]), "a long, b long")
    if not hot.isEmpty():
        blocks = _block_pairs(hot, F.col("m"), MARK_BLOCK).select("bucket", "p", "q", "block", "node").join(marks, "node")
        blocks = blocks.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        found = found.unionByName(blocks.select("bucket", "p", "q", "block", "node", "n", "sk").mapInPandas(_candidates(threshold, least, ["bucket", "p", "q"]), "a long, b long"))
    comp = components(found.distinct())
    dropped(rows.sparkSession, *used)

    weight = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), "n")).cast("long")
    members = with_group(comp.join(cls.select("node", "rep", "copies", "n"), "node"), "label", "node", "m", F.sum(weight), F.sum)
    members = _block_pairs(members.withColumnRenamed("label", "comp"), F.col("m"), SET_BLOCK).drop("m", "n")
    texts = rows.select(F.col("doc").cast("long").alias("doc"), "node", "text").mapInArrow(_sieve(comp.select("node")), "doc long, node long, text string")
    texts = texts.withColumnRenamed("node", "own").join(members, (F.col("own") == F.col("node")) & F.col("doc").eqNullSafe(F.col("rep")))
    texts = texts.select("comp", "p", "q", "block", "node", "copies", "text").repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q")
    checked = written(texts.mapInPandas(_verify(threshold, ngram), "node long, links long, texts long, root long"), "checked")
    linked = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    label = components(checked.where("node <> root").select("node", "root"))
    named = cls.select("node", "rep", "copies").join(linked, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = with_group(named, "label", "node", "class_id", F.min("rep"), F.min)
    return named.select("node", "label", F.col("rep").alias("text_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near duplicates: that of the least id, a null one last; columns as they are.

    Of rows that repeat both id and text, the one with the least other columns stays; where those have no order, any one.
    """
    rows = _rows(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc").isNull().alias("without"), F.col("doc").cast("long").alias("long"), "node", "doc"))
    chosen = rows.select("doc", "node").join(_classes(rows, **options).select("node", "label"), "node").groupBy("label").agg(first.alias("first"))
    chosen = chosen.select(F.col("first.node").alias("__node"), F.col("first.doc").alias("__doc"))
    keyed = docs.withColumns({"__node": _node(F.coalesce(F.col(text_col), F.lit(""))), "__key": F.col(id_col)})
    same = (F.col("__at") == F.col("__node")) & F.col("__key").eqNullSafe(F.col("__doc"))
    times = keyed.select(F.col("__node").alias("__at"), "__key").join(chosen, same).groupBy("__node", "__doc").agg(F.count(F.lit(1)).alias("__times"))
    chosen = written(times, "chosen")
    keyed = keyed.withColumnRenamed("__node", "__at")
    kept = keyed.join(chosen.where("__times = 1"), same, "left_semi").select(*docs.columns)
    repeated = chosen.where("__times > 1")
    if repeated.isEmpty():
        return kept
    found = keyed.join(repeated, same, "left_semi")
    ordered = not any(kind in dtype for _, dtype in docs.dtypes for kind in ("map<", "variant"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    found = found.groupBy("__at", "__key").agg((F.min(row) if ordered else F.first(row)).alias("__row"))
    return kept.unionByName(found.select("__row.*"))
