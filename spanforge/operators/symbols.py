"""Names as single characters, so that sequences are strings and models are regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = 0x4E00  # no metacharacter and no line end from here on
FIRST_BMP_ROOM = 20_992
SPILL = 0x20000


def _character(cp: Column) -> Column:
    low = F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")
    high = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return F.when(cp < 0x10000, low).otherwise(high)


def alphabet(names: DataFrame) -> DataFrame:
    """(name, kind, cp, sym) from distinct (name, kind): events first, by name, so that codes are stable across runs."""
    order = Window.orderBy(F.col("kind").desc(), "name")  # a dimension of distinct names, not of events
    rank = F.row_number().over(order) - 1
    cp = F.when(rank < FIRST_BMP_ROOM, rank + FIRST).otherwise(rank - FIRST_BMP_ROOM + SPILL)
    return names.select("name", "kind").distinct().withColumn("cp", cp).withColumn("sym", _character(F.col("cp")))


def encode(trace: DataFrame, symbols: DataFrame) -> DataFrame:
    """(tid, enc): every thread as a string. Names without a symbol are left out."""
    coded = trace.select("tid", "pos", "name").join(symbols.select("name", "sym"), "name")
    return coded.groupBy("tid").agg(F.expr("listagg(sym, '') WITHIN GROUP (ORDER BY pos)").alias("enc"))


def encode_calls(kb: DataFrame, symbols: DataFrame) -> DataFrame:
    """(api, rid, enc): every realization as a string, empty ones included."""
    rows = kb.select("api", "rid", F.posexplode("calls").alias("pos", "c")).select("api", "rid", "pos", F.col("c.name").alias("name"))
    coded = rows.join(symbols.select("name", "sym"), "name").groupBy("api", "rid").agg(F.expr("listagg(sym, '') WITHIN GROUP (ORDER BY pos)").alias("enc"))
    return kb.select("api", "rid").join(coded, ["api", "rid"], "left").select("api", "rid", F.coalesce("enc", F.lit("")).alias("enc"))


def decode(encoded: DataFrame, symbols: DataFrame) -> DataFrame:
    """(tid, pos, name) of strings (tid, enc)."""
    chars = encoded.select("tid", F.posexplode(F.filter(F.split("enc", ""), lambda c: c != "")).alias("pos", "sym"))
    return chars.join(symbols.select("name", "sym"), "sym").select("tid", F.col("pos").cast("long").alias("pos"), "name")


def fold_runs(enc: Column) -> Column:
    """Runs of one symbol as symbol+."""
    return F.regexp_replace(enc, r"(.)\1+", r"$1+")


def fold_repeats(enc: Column) -> Column:
    """One pass of repetition folding: the leftmost repeated unit, the shortest first, as unit+ or (unit)+."""
    return F.regexp_replace(F.regexp_replace(enc, r"(.+?)\1+", "($1)+"), r"\((.)\)\+", "$1+")
