"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role become a block, and blocks are
joined to one string:

    <|turn|>role<|text|>first text<|part|>second text<|end|>\n<|turn|>...

Control strings begin with "<|". In texts and roles a backslash becomes two and "<|" becomes "<\\|", so that no control
string can occur in them; `unescape` undoes both. The loss mask is a list of spans (start, length) in the formatted
string, one for each text of the learnt role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import let

STRIDE = 64  # texts whose lengths are summed at once for the offsets
TURN, TEXT, PART, END, GLUE = "<|turn|>", "<|text|>", "<|part|>", "<|end|>", "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _literal(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row (conv_id, n_blocks, formatted, loss_mask) for each conversation.

    Turns sort by number, then role, then text, so ties and repeated rows have one order; all of them stay. A null
    turn sorts first, a null role or text is empty, and rows with a null conversation form one. loss_mask holds
    (start, length) in code points for each text of the role learn, texts in order; empty without any. Other
    columns are ignored; an empty table gives an empty result.
    """
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def merged(ts: Column) -> Column:
        """Blocks (role, texts): slices of the sorted turns between changes of role."""
        changes = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))
        return let(
            changes,
            lambda at: F.transform(
                at,
                lambda s, k: F.struct(
                    F.get(ts, s)["role"].alias("role"),
                    F.transform(F.slice(ts, s + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - s), lambda x: escape(x["text"])).alias("texts"),
                ),
            ),
        )

    blocks = sorted_turns.select("conv_id", let(F.col("ts"), merged).alias("bs"))

    def block_text(b: Column) -> Column:
        return F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(b["texts"], PART), F.lit(END))

    def widths(bs: Column) -> Column:
        """For each text its own length, its length with the marks before it, and whether it is learnt."""
        length = lambda c: F.length(c).cast("bigint")
        first = lambda b, k: F.when(k > 0, F.lit(len(END) + len(GLUE))).otherwise(F.lit(0)) + F.lit(len(TURN) + len(TEXT)) + length(escape(b["role"]))
        one = lambda b, k: F.transform(
            b["texts"], lambda x, i: F.struct(length(x).alias("length"), (length(x) + F.when(i == 0, first(b, k)).otherwise(F.lit(len(PART)))).alias("width"), (b["role"] == learn).alias("learnt"))
        )
        return F.flatten(F.transform(bs, one))

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def spans(texts: Column, bases: Column) -> Column:
        """Starts and lengths of the learnt texts: the sum of all strides before, and of the widths in the text's own."""
        end = lambda i: F.get(bases, F.floor(i / STRIDE).cast("int")) + total(F.slice(texts, i - i % STRIDE + 1, i % STRIDE + 1)["width"])
        every = F.transform(texts, lambda x, i: F.when(x["learnt"], F.struct((end(i) - x["length"]).alias("start"), x["length"].alias("length"))))
        return F.filter(every, lambda s: s.isNotNull())

    made = blocks.select("conv_id", F.size("bs").cast("bigint").alias("n_blocks"), F.array_join(F.transform("bs", block_text), GLUE).alias("formatted"), widths(F.col("bs")).alias("texts"))
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size("texts") - 1) / STRIDE).cast("int")), lambda c: total(F.slice("texts", c * STRIDE + 1, STRIDE)["width"]))
    made = made.withColumn("strides", strides)
    made = made.withColumn("bases", F.transform("strides", lambda _, c: total(F.slice("strides", 1, c))))
    return made.select("conv_id", "n_blocks", "formatted", let(F.col("texts"), lambda texts: let(F.col("bases"), lambda bases: spans(texts, bases))).alias("loss_mask"))


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped, in order."""

    def block(b: Column) -> Column:
        return let(
            F.split(F.substring_index(b, END, 1), _literal(TEXT), -1),
            lambda rb: F.transform(F.split(F.get(rb, F.lit(1)), _literal(PART), -1), lambda x: F.struct(unescape(F.get(rb, F.lit(0))).alias("role"), unescape(x).alias("text"))),
        )

    found = F.split(formatted, _literal(TURN), -1)
    return F.flatten(F.transform(let(found, lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))), block))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Spans are in order, so a stride of them is cut out first."""
    cut = lambda t, start, n: F.substr(t, (start + 1).cast("int"), n.cast("int"))

    def stride(spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0)), F.get(spans, F.size(spans) - 1)
        return let(cut(formatted, first["start"], last["start"] + last["length"] - first["start"]), lambda t: F.array_join(F.transform(spans, lambda s: unescape(cut(t, s["start"] - first["start"], s["length"]))), ""))

    strides = F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / STRIDE).cast("int"))
    return F.when(F.size(mask) == 0, F.lit("")).otherwise(F.array_join(F.transform(strides, lambda c: let(F.slice(mask, c * STRIDE + 1, STRIDE), stride)), ""))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and masks hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks."""
    read = chats.select("conv_id", "n_blocks", "formatted", parse_chats(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    )
