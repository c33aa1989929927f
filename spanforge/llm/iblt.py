"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in Spark expressions only.

A text's paragraphs (lines, cut at sentence ends) have 64-bit digests, whose last CHECK_BITS are a hash of the others.
A digest goes to one cell of each of three subtables; a cell keeps how many there are and their exclusive or. A table
has room for its own digests, and is made larger until peeling gives all of them back, so a fingerprint alone tells
them. Tables of two versions subtract cell by cell, and digests in both cancel. A cell that then holds a single digest,
which its check bits and its place tell, gives it away; removing it from its other cells frees more. If cells remain,
both tables' digests go to larger tables, which are subtracted and peeled again.

Tables are kept sparse: arrays of cells in order. Steps are columns of their own, so that no expression nests deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import let

SUB = 16  # cells of a subtable at least
CHECK_BITS = 20
ROUNDS = 30  # peeling rounds at most
GROW = 8  # a table that does not peel is made so many times larger
NARROW = 32  # cells in which removed digests are looked up one by one; more are folded with all cells
BLOCK_ROWS = 4000  # documents of a block of neighbours, about
MAX_BLOCKS = 100_000  # beyond 400 million documents blocks grow; they are sorted on disk, not held


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs that have a character beyond white space."""
    parts = F.filter(F.split(text, r"\n|(?<=[.!?])\x20", -1), lambda p: p.rlike(r"[^\x09-\x0D\x20]"))
    return F.array_distinct(F.transform(parts, lambda p: _checked(F.xxhash64(p))))


def _checked(key: Column) -> Column:
    """key with its check bits."""
    high = F.shiftright(key, CHECK_BITS)
    return F.shiftleft(high, CHECK_BITS).bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)))


# The steps below are SQL expressions as text, which Spark parses at once.


def _cell(key: str, j: str, sub: str) -> str:
    """A digest's cell in subtable j (0 to 2) of sub cells, a power of two."""
    return f"((xxhash64({key}, {j}) & ({sub} - 1)) * 3 + {j})"


def _dealt(keys: str, n: int, sub: str) -> str:
    """An entry for each of the three cells of every digest, counted n."""
    entries = ", ".join(f"named_struct('cell', {_cell('k', str(j), sub)}, 'n', {n}, 'key', k)" for j in range(3))
    return f"flatten(transform({keys}, k -> array({entries})))"


def _alone(c: str, sub: str) -> str:
    """Whether a cell holds one digest: its count, its check bits and its place say so."""
    high = f"shiftright({c}.key, {CHECK_BITS})"
    return f"({c}.n in (1, -1) and {c}.key = (shiftleft({high}, {CHECK_BITS}) | (xxhash64({high}) & {(1 << CHECK_BITS) - 1})) and {c}.cell = {_cell(c + '.key', f'cast({c}.cell % 3 as int)', sub)})"


def _heads(entries: str) -> str:
    """Where the runs of a cell begin in sorted entries, and their end as the last one."""
    starts = f"filter(sequence(0, size({entries}) - 1), i -> i = 0 or get({entries}, i).cell != get({entries}, i - 1).cell)"
    return f"if(size({entries}) = 0, array(0), concat({starts}, array(size({entries}))))"


def _folded(entries: str, heads: str) -> str:
    """Cells that are not empty, from sorted entries."""
    more = f"aggregate(slice({entries}, s + 2, get({heads}, i + 1) - s - 1), get({entries}, s), (a, c) -> named_struct('cell', a.cell, 'n', a.n + c.n, 'key', a.key ^ c.key))"
    return f"filter(transform(slice({heads}, 1, size({heads}) - 1), (s, i) -> if(get({heads}, i + 1) = s + 1, get({entries}, s), {more})), c -> c.n != 0 or c.key != 0)"


def _peel(cells: str, sub: str) -> str:
    """(plus, minus) digests that cells give back, by the sign of their count; null if cells remain.

    A round has five phases, each of which fills fields of the state: which cells hold one digest; those digests; the
    entries of the other cells, less those digests; the runs of equal cells; and the cells that remain.
    """
    fields = ("cells", "plus", "minus", "lone", "more", "less", "entries", "heads", "over")
    put = lambda **new: "named_struct(" + ", ".join(f"'{f}', {new.get(f, 'st.' + f)}" for f in fields) + ")"
    mark = put(lone=f"transform(st.cells, c -> {_alone('c', sub)})")
    keys = lambda n: f"array_distinct(filter(st.cells, (c, i) -> get(st.lone, i) and c.n = {n}).key)"
    find = put(more=keys(1), less=keys(-1), entries="filter(st.cells, (c, i) -> not get(st.lone, i))")
    gone = f"concat({_dealt('st.more', -1, sub)}, {_dealt('st.less', 1, sub)})"
    near = f"concat(st.entries, filter({gone}, c -> array_contains(st.entries.cell, c.cell)))"
    left = f"case when size(st.entries) = 0 then st.entries when size(st.entries) <= {NARROW} then {near} else concat(st.cells, {gone}) end"
    remove = put(entries=f"sort_array({left})", plus="concat(st.plus, st.more)", minus="concat(st.minus, st.less)", over="size(st.more) = 0 and size(st.less) = 0")
    runs = put(heads=_heads("st.entries"))
    fold = put(cells=_folded("st.entries", "st.heads"), over="size(st.entries) = 0")
    none = "cast(array() as array<bigint>)"
    begin = {"cells": cells, "plus": none, "minus": none, "lone": "array(false)", "more": none, "less": none, "entries": cells, "heads": "array(0)", "over": f"size({cells}) = 0"}
    phases = " ".join(f"when nth % 5 = {i} then {x}" for i, x in enumerate((mark, find, remove, runs)))
    step = f"case when st.over then st {phases} else {fold} end"
    done = "if(st.over and size(st.entries) = 0, named_struct('plus', st.plus, 'minus', st.minus), null)"
    start = "named_struct(" + ", ".join(f"'{f}', {begin[f]}" for f in fields) + ")"
    return f"if({cells} is null, null, aggregate(sequence(0, {5 * ROUNDS}), {start}, (st, nth) -> {step}, st -> {done}))"


def _room(n: Column) -> Column:
    """The least power of two that is SUB or more, and twice n or more."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.greatest(2 * n, F.lit(SUB)).cast("bigint") - 1)))


def _peeled(df: DataFrame, entries: str, sub: str, name: str) -> DataFrame:
    """df with the cells of entries as <name>_cells, and what they give back as <name>_peel. Null entries give nulls."""
    df = df.withColumn("__entries", F.expr(f"sort_array({entries})"))
    df = df.withColumn("__heads", F.expr(f"if(__entries is null, null, {_heads('__entries')})"))
    df = df.withColumn(f"{name}_cells", F.expr(_folded("__entries", "__heads"))).drop("__entries", "__heads")
    return df.withColumn(f"{name}_peel", F.expr(_peel(f"{name}_cells", sub)))


def with_table(df: DataFrame, keys: str, name: str) -> DataFrame:
    """df with the table of its distinct digests: sub, cells, and keys, the digests that peeling gives back.

    A table that does not give all of them back is made GROW times larger. If that does not do either (digests that
    share all their hashes), the larger one stays, and keys are the digests as they came.
    """
    df = _peeled(df.withColumn("__sub", _room(F.size(keys))), _dealt(keys, 1, "__sub"), "__sub", "__a")
    df = df.withColumn("__more", F.expr(f"if(__a_peel is null, __sub * {GROW}, null)"))
    df = _peeled(df, f"if(__more is null, null, {_dealt(keys, 1, '__more')})", "__more", "__b")
    first = "named_struct('sub', __sub, 'cells', __a_cells, 'keys', __a_peel.plus)"
    larger = f"named_struct('sub', __more, 'cells', __b_cells, 'keys', coalesce(__b_peel.plus, {keys}))"
    return df.withColumn(name, F.expr(f"if(__more is null, {first}, {larger})")).drop("__sub", "__more", "__a_cells", "__a_peel", "__b_cells", "__b_peel")


def with_difference(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with (removed, added): digests of table a only and of table b only, from the subtracted tables.

    Tables of different sizes are subtracted at the larger one, to which the smaller one's digests are dealt again. If
    that does not peel, both are dealt to tables GROW times larger; if that does not either, the tables' own digests are
    compared as they are.
    """
    df = df.withColumn("__sub", F.expr(f"greatest({a}.sub, {b}.sub)"))
    mine = f"if({a}.sub = __sub, {a}.cells, {_dealt(a + '.keys', 1, '__sub')})"
    minus = f"transform({b}.cells, c -> named_struct('cell', c.cell, 'n', -c.n, 'key', c.key))"
    df = _peeled(df, f"concat({mine}, if({b}.sub = __sub, {minus}, {_dealt(b + '.keys', -1, '__sub')}))", "__sub", "__a")
    df = df.withColumn("__more", F.expr(f"if(__a_peel is null, __sub * {GROW}, null)"))
    again = f"concat({_dealt(a + '.keys', 1, '__more')}, {_dealt(b + '.keys', -1, '__more')})"
    df = _peeled(df, f"if(__more is null, null, {again})", "__more", "__b")
    plain = f"named_struct('plus', array_except({a}.keys, {b}.keys), 'minus', array_except({b}.keys, {a}.keys))"
    df = df.withColumn("__found", F.expr(f"coalesce(__a_peel, __b_peel, {plain})"))
    return df.withColumn(name, F.expr("named_struct('removed', __found.plus, 'added', __found.minus)")).drop("__sub", "__more", "__a_cells", "__a_peel", "__b_cells", "__b_peel", "__found")


def as_text(table: Column) -> Column:
    """A table as text: sub, then cell:count:digests of each cell that is not empty, numbers but sub in hexadecimal."""
    cell = lambda c: F.concat_ws(":", F.lower(F.hex(c["cell"])), F.lower(F.hex(c["n"].cast("bigint"))), F.lower(F.hex(c["key"])))
    return F.concat_ws(" ", table["sub"].cast("string"), F.array_join(F.transform(table["cells"], cell), " "))


def likeness(table: Column, diff: Column) -> Column:
    """Shared digests over all digests of a table and the one it differs from by diff, 0 to 1; 1 for two empty ones."""
    n, gone, more = F.size(table["keys"]), F.size(diff["removed"]), F.size(diff["added"])
    return F.when(n + more == 0, F.lit(1.0)).otherwise((n - gone) / (n + more).cast("double"))


def _block(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by a coarse and then a fine look; 0 for null."""
    width = max(1, round(len(bounds) ** 0.5))
    as_array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded to a literal
    count = lambda values: F.size(F.filter(values, lambda b: b <= key))
    if not bounds:
        return F.lit(0)
    coarse = count(as_array(bounds[::width]))  # groups of width whose first bound is passed
    return let(coarse, lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * width + count(F.slice(as_array(bounds), (c - 1) * width + 1, width))))


def in_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in blocks, so that the next document by descending doc_id (after the last: the first) is in a row's block.

    Blocks of ids, from approximate quantiles, hold neighbours together; the first document of each block also goes to
    the block before it, marked as its border, so no order of all rows is ever made in one place. Null ids come last;
    equal ids are ordered by h, a hash of their text.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n = rows.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    cuts = [i / blocks for i in range(1, blocks)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * blocks))).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    rows = rows.withColumn("block", _block(F.col("doc_id"), bounds))
    heads = rows.groupBy("block").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("nh"))).alias("head"))
    order = Window.orderBy(F.col("block").desc())  # a row for each block, MAX_BLOCKS at most
    to = heads.select(F.col("head.doc_id").alias("hid"), F.bitwise_not("head.nh").alias("hh"), F.coalesce(F.lag("block").over(order), F.min("block").over(Window.partitionBy(F.lit(1)))).alias("to"))
    border = rows.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh")))
    border = border.select("doc_id", "text", "h", F.col("to").alias("block"), F.lit(True).alias("border"))
    both = rows.withColumn("border", F.lit(False)).unionByName(border).repartition("block")
    return both


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edit of it, how alike they are, and the digests that differ.

    The edited text is the text whose last floor(n/2) code points are replaced by the first as many (or all) of the
    next document's. Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (the tables as text),
    near_edited and near_next (of the tables' digests, those in both over all), n_paragraphs, and removed and added:
    the digests that peeling recovers from the text's table less the edited one's, sorted. Null texts are empty, with
    an empty table; two empty texts are alike (1). Repeated rows are documents of their own, a single document is its
    own next, an empty table gives an empty result, and other columns are ignored. A text of any length has a table
    that is large enough; the table has about 3 cells a paragraph.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = in_blocks(rows).select("doc_id", "text", "h", "block", "border", digests(F.col("text")).alias("keys"))
    blocks = with_table(blocks, "keys", "own").drop("keys")
    after = Window.partitionBy("block").orderBy("border", F.col("doc_id").desc_nulls_last(), "h")
    pairs = blocks.select("*", F.lead("text").over(after).alias("next_text"), F.lead("own").over(after).alias("next")).where("not border")
    cut = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("next_text", F.lit(1), cut))
    found = with_difference(pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "own", edited.alias("edited"), "next"), "own", "next", "n").drop("next")
    found = with_table(found.withColumn("keys", digests(F.col("edited"))), "keys", "e").drop("keys")
    found = with_difference(found, "own", "e", "d")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("d")).alias("near_edited"),
        likeness(F.col("own"), F.col("n")).alias("near_next"),
        F.size("own.keys").alias("n_paragraphs"),
        F.sort_array("d.removed").alias("removed"),
        F.sort_array("d.added").alias("added"),
    )
