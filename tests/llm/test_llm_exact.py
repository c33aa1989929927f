"""Operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanforge.llm import graph, html, iblt, jaccard, langid, mixing, packing, pii, quality, queries, warc


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def words(t: str) -> list[str]:
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


def shingle_set(t: str) -> set:
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_matches_brute_force(spark, sf_dir, docs):
    sets = {i: shingle_set(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    links = Counter()
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in queries.op2_jaccard(spark, sf_dir).collect()}
    assert got == {i: links[i] for i in ids}


def test_jaccard_of_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:30] + [f"x{k}"] + base[31:])) for k in range(150)] + [(1000 + k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df, small=16).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert j >= 0.8 and all(got[k] == (0, 149) for k in range(150)) and all(got[1000 + k] == (1000 + k, 0) for k in range(50))


def test_every_link_of_a_query_set_is_found(spark):
    """Recall against brute force: queries are the ids divisible by 20, against all rows of sf0.1."""
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    sets = [shingle_set(t) for t in d.text]
    asked = {s for i, x in zip(d.doc_id, sets, strict=True) if i % 20 == 0 for s in x}
    where: dict = {}
    for k, x in enumerate(sets):
        for s in x & asked:
            where.setdefault(s, []).append(k)
    want = {}
    for k, (i, x) in enumerate(zip(d.doc_id, sets, strict=True)):
        if i % 20 == 0:
            shared = Counter(j for s in x for j in where[s])
            want[i] = sum(n >= 0.8 * (len(x) + len(sets[j]) - n) - 1e-9 for j, n in shared.items() if j != k)
    got = {r["doc_id"]: r["n_links"] for r in queries.op2_jaccard(spark, "/root/testdata/sf0.1").where("doc_id % 20 = 0").collect()}
    assert sum(want.values()) > 200 and sum(got.values()) <= sum(want.values())
    assert sum(min(got[i], n) for i, n in want.items()) >= 0.99 * sum(want.values())
    print("recall", sum(got.values()) / sum(want.values()), sum(want.values()))


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.9999, 0.8) >= 4 and jaccard.runs_for(0.9, 0.8) < jaccard.runs_for(0.9999, 0.8)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (4, 4), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["label"] for r in graph.components(chain).collect()} == {0}


def unpack(print_: str) -> tuple[int, dict]:
    """A fingerprint's size, and its cells (count, digests) by number."""
    sub, *cells = print_.split()
    signed = lambda x: (v := int(x, 16)) - (1 << 64 if v >> 63 else 0)
    return int(sub), {int(c, 16): (signed(n), signed(k)) for c, n, k in (x.split(":") for x in cells)}


def test_fingerprints_match_sets(spark, sf_dir, docs, monkeypatch):
    monkeypatch.setattr(iblt, "BLOCK_ROWS", 20)
    got = {r["doc_id"]: r for r in queries.op4_iblt(spark, sf_dir).collect()}
    pieces = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) ", t) if re.search(r"[^\x09-\x0D ]", p)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    d = docs.sort_values("doc_id", ascending=False, ignore_index=True)
    seen = {}
    for i, (k, t) in enumerate(zip(d.doc_id, d.text, strict=True)):
        after = d.text[(i + 1) % len(d)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(pieces(t), pieces(edited))) and r["near_next"] == pytest.approx(like(pieces(t), pieces(after)))
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert len(r["removed"]) == len(pieces(t) - pieces(edited)) and len(r["added"]) == len(pieces(edited) - pieces(t))


def test_likeness_is_that_of_the_printed_fingerprints(spark, sf_dir):
    """Peel the two strings alone, cell by cell, with the table's hashes taken from Spark."""
    rows = queries.op4_iblt(spark, sf_dir).collect()[:60]
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(iblt.digests(F.col("text"))))
    keys = sorted({r[0] for r in own.collect()} | {k for r in rows for k in r["added"]})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    hashes = {r["k"]: (r["c"], r["h"]) for r in df.select("k", (iblt._checked(F.col("k")) == F.col("k")).alias("c"), F.array(*[F.xxhash64("k", F.lit(j)) for j in range(3)]).alias("h")).collect()}

    def given_back(cells: dict, sub: int) -> set:
        cells, out, todo = {c: list(x) for c, x in cells.items()}, set(), True
        while todo:
            todo = [(k, n) for c, (n, k) in cells.items() if abs(n) == 1 and k in hashes and hashes[k][0] and (hashes[k][1][c % 3] & (sub - 1)) * 3 + c % 3 == c]
            for k, n in dict(todo).items():
                out.add((k, n))
                for j in range(3):
                    x = cells.setdefault((hashes[k][1][j] & (sub - 1)) * 3 + j, [0, 0])
                    x[0], x[1] = x[0] - n, x[1] ^ k
            cells = {c: x for c, x in cells.items() if x != [0, 0]}
        assert not cells
        return out

    for r in rows:
        (s, a), (z, b) = unpack(r["fingerprint"]), unpack(r["edited_fingerprint"])
        mine, other = given_back(a, s), given_back(b, z)
        assert all(n == 1 for _, n in mine | other) and len(mine) == r["n_paragraphs"]
        assert r["near_edited"] == pytest.approx(len(mine & other) / len(mine | other) if mine | other else 1.0)
        assert {k for k, _ in mine - other} == set(r["removed"]) and {k for k, _ in other - mine} == set(r["added"])


def test_peeling_recovers_the_difference(spark):
    long = [f"p{i}" for i in range(3000)]
    rows = [([f"p{i}" for i in range(40)], [f"p{i}" for i in range(30)] + [f"q{i}" for i in range(5)]), ([], ["x"]), (["same", "line"], ["line", "same"]), (long, long[7:] + ["z"]), (long, []), ([], []), (["a"], long)]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    df = df.select("i", iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
    got = iblt.with_difference(iblt.with_table(iblt.with_table(df, "a", "x"), "b", "y"), "x", "y", "d").orderBy("i").collect()
    for r in got:
        assert set(r["d"]["removed"]) == set(r["a"]) - set(r["b"]) and set(r["d"]["added"]) == set(r["b"]) - set(r["a"])
        assert len(r["d"]["removed"]) + len(r["d"]["added"]) == len(set(r["a"]) ^ set(r["b"]))


def test_tables_that_do_not_peel_are_made_larger(spark, monkeypatch):
    monkeypatch.setattr(iblt, "_room", lambda n: F.lit(8).cast("bigint"))
    df = spark.createDataFrame([("\n".join(f"p{k}-{i}" for i in range(12)), "\n".join(f"p{k}-{i}" for i in range(5, 17))) for k in range(40)], "a string, b string")
    df = df.select(iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
    got = iblt.with_difference(iblt.with_table(iblt.with_table(df, "a", "x"), "b", "y"), "x", "y", "d").collect()
    assert {r["x"]["sub"] for r in got} == {8, 64}
    assert all(set(r["x"]["keys"]) == set(r["a"]) and set(r["d"]["removed"]) == set(r["a"]) - set(r["b"]) for r in got)


def test_blocks_count_bounds(spark):
    bounds = [1, 5, 9, 12, 20, 21, 30]
    df = spark.range(-2, 35).select("id", iblt._block(F.col("id"), bounds).alias("b"))
    assert all(r["b"] == sum(x <= r["id"] for x in bounds) for r in df.collect())


def test_packing_plan_is_sound_and_tight(spark, sf_dir, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = queries.op6_packing(spark, sf_dir).toPandas()
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert (rows.length <= 2048).all()
    for seq in rows.groupby("sequence_id"):
        s = seq[1].sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1 + -(-rows.length.sum() // 2048) * 1.02
    for doc, part in rows.groupby("doc_id"):
        ids = hf.encode(docs.text[docs.doc_id == doc].iloc[0], add_special_tokens=False).ids + [0]
        p = part.sort_values("piece")
        assert p.length.sum() == len(ids) and list(p.start) == [0, *p.length.cumsum()[:-1]]
        for x in p.itertuples():
            assert x.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[x.start : x.start + x.length]))


def test_ids_are_those_of_the_tokenizers_library(docs):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    hf = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        encode = packing.encoder(f.read(), public_tokenizers.PATTERN)
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = random.Random(4)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [*docs.text, *(f"a{chr(c)}a 1{chr(c)}1 {chr(c)} !{chr(c)}!" for c in rng.sample(points, 20_000)), "<|endoftext|>" * 3, " <|endoftext|>\n", "<|endoftext", "<|endoftext|><|endof"]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "  ", "\n", "a", "'s", "12", "é", "日", "!", "\u00a0", "\x85"]) for _ in range(12)) for _ in range(3000)]
    assert all(e.ids == encode(t) for e, t in zip(hf.encode_batch(texts, add_special_tokens=False), texts, strict=True))


def test_reduction_costs_no_bin():
    import random

    rng = random.Random(5)

    def best(items: list[int], cap: int) -> int:
        least = [len(items)]
        items = sorted(items, reverse=True)

        def rec(i: int, bins: list[int]) -> None:
            if len(bins) >= least[0]:
                return
            if i == len(items):
                least[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                    bins[k] += items[i]
                    rec(i + 1, bins)
                    bins[k] -= items[i]
            rec(i + 1, [*bins, items[i]])

        rec(0, [])
        return least[0]

    for _ in range(500):
        cap = rng.choice([10, 20, 30])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce_dominated(Counter(items), cap)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, cap) if rest else 0) == best(items, cap)
        runs, bins = packing.plan(Counter(items), cap)
        assert sum(n for _, _, n, *_ in runs) == len(items) and bins >= best(items, cap)


def test_pii_base_spans_are_the_patterns(docs):
    rules = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def plain(t: str) -> list:
        out = []
        for kind, rule in rules.items():
            for m in rule.finditer(t):
                digits = re.sub(r"[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == "card" and not (12 <= len(digits) <= 19 and pii._luhn(digits)):
                    continue
                if kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                out.append((kind, m.start(), m.end()))
        return sorted(out, key=lambda s: (s[1], list(rules).index(s[0])))

    import random

    rng = random.Random(1)
    texts = [*docs.text, *("".join(rng.choice("a@.1250+-( )9x.1.") for _ in range(rng.randint(0, 40))) for _ in range(20_000))]
    assert all(pii.base_spans(t) == plain(t) for t in texts)
    assert len(pii.base_spans("9" * 200_000 + "@")) == 0 and len(pii.base_spans("a" * 200_000)) == 0  # no quadratic time


def test_pii_query_keeps_base_spans(spark, sf_dir, docs):
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in queries.op8_pii(spark, sf_dir).collect():
        base = pii.base_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii._digest(base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


def test_labelers_learn_what_to_trust():
    table = [("card", (1, 1, 1, 0, 0), 100.0), ("card", (0, 0, 0, 0, 0), 80.0), ("phone", (0, 1, 1, 0, 0), 3.0), ("card", (0, 0, 1, 0, 1), 10.0)]
    hit, false, like = pii.expectation_maximisation(table)
    assert hit[1] > 0.9 > false[1] and like[0] == 1 and like[1] < 0.1 and like[2] > 0.8 and like[3] < 0.2


def test_quality_counts(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, sf_dir).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    lab = pd.read_parquet(f"{sf}/labels.parquet")
    got = queries.op9_quality(spark, sf).toPandas().merge(lab, on="doc_id")
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.99


def test_distance_is_jensen_shannon(spark):
    import math

    p, q = [0.5, 0.25, 0.25, 0.0], [0.25, 0.25, 0.0, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    counts = F.array(*[F.lit(c).cast("bigint") for c in (2, 1, 1, 0)])
    got = spark.range(1).select(quality.distance(counts, F.lit(4.0), q).alias("d")).first()["d"]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.op10_langid(spark, sf).toPandas().merge(d, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_lookup_equals_convolution():
    import numpy as np

    model = langid.train([b"hello there world"] * 8 + [b"bonjour le monde"] * 8, [0] * 8 + [1] * 8, ["en", "fr"], epochs=1)
    x = np.zeros((1, langid.WINDOW), np.uint8)
    x[0, :11] = np.frombuffer(b"hello world", np.uint8)
    tops = []
    for conv, bias in zip(model.convs, model.bias, strict=True):
        e = model.embed[x[0]]
        z = np.array([sum(e[i + j] @ conv[j] for j in range(len(conv))) for i in range(langid.WINDOW - len(conv) + 1)])
        tops.append(z.max(0) + bias)
    want = langid._softmax((np.maximum(np.concatenate(tops), 0) @ model.dense + model.dense_bias)[None])
    assert np.allclose(langid.Scorer(model).windows(x), want, atol=1e-4)


def test_raking_meets_the_marginals():
    import numpy as np

    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 100, (4, 3, 2)).astype(float)
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    at = [x.ravel() for x in np.indices(tokens.shape)]
    shares = mixing.rake(tokens.ravel(), at, goals).reshape(tokens.shape)
    for axis, goal in enumerate(goals):
        assert shares.sum(tuple(i for i in range(3) if i != axis)) == pytest.approx(goal)
    weight, chance = (x.reshape(tokens.shape) for x in mixing.probabilities(tokens.ravel(), at, goals, 0.3))
    assert (chance <= 1).all() and (chance * tokens).sum() == pytest.approx(0.3 * tokens.sum())
    assert weight * tokens / tokens.sum() == pytest.approx(shares)


def test_mixing_rows_are_those_of_a_dense_raking(spark):
    """op5 against a raking of the dense tensor, scaled and bounded by another road: repeated clipping of the largest factor."""
    import numpy as np

    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    assert (rows.n_tokens.to_numpy() == [len(words(t)) for t in d.text[rows.doc_id]]).all()
    assert (rows.source.to_numpy() == d.source[rows.doc_id].to_numpy()).all() and (rows.lang.to_numpy() == d.lang[rows.doc_id].to_numpy()).all()
    names = [sorted(rows[c].unique()) for c in mixing.DIMS]
    tensor = np.zeros([len(n) for n in names])
    where = tuple(np.array([n.index(x) for x in rows[c]]) for n, c in zip(names, mixing.DIMS, strict=True))
    np.add.at(tensor, where, rows.n_tokens)
    shares = tensor / tensor.sum()
    for _ in range(500):
        for axis in range(3):
            others = tuple(i for i in range(3) if i != axis)
            goal = tensor.sum(others) ** mixing.TEMPER
            have = shares.sum(others, keepdims=True)
            shares = shares * np.divide((goal / goal.sum()).reshape(have.shape), have, out=np.zeros_like(have), where=have > 0)
    weight = np.divide(shares, tensor / tensor.sum(), out=np.zeros_like(shares), where=tensor > 0)
    assert rows.weight.to_numpy() == pytest.approx(weight[where], rel=1e-6)
    drawn = rows[rows.sampled]
    for c in mixing.DIMS:  # what is drawn comes near what is expected
        want = (rows.n_tokens * rows.probability).groupby(rows[c]).sum()
        got = drawn.n_tokens.groupby(drawn[c]).sum().reindex(want.index, fill_value=0)
        assert np.abs(got / got.sum() - want / want.sum()).max() < 0.06


def test_mixing_query(spark):
    got = queries.op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert got.sampled.sum() > 0 and abs(got.n_tokens[got.sampled].sum() / (got.n_tokens * got.probability).sum() - 1) < 0.1


def test_html_of_every_page(spark, sf_dir):
    import html as entities

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.op7_html(spark, sf_dir).collect()}
    for i, h in zip(pages.page_id, pages.html, strict=True):
        article = h[h.index("<article>") : h.index("</article>")]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1|article)>", article)]
        assert got[i] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("instead", ["div", "section", ""])
def test_scores_alone_find_the_article(instead):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    for h in pages.html:
        plain = h.replace("<article>", f"<{instead}>" if instead else "").replace("</article>", f"</{instead}>" if instead else "")
        assert html.main_text(plain) == html.main_text(h)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div id=x><div class=lead><p>First words, of some length, that open the piece.</p></div><div class=body><p>Then much more follows, with commas, and yet more of it, as is usual.</p><p>And an end.</p></div></div><div class=links><a href=a>One link to go on</a> <a href=b>Another link, to go</a></div>", "First words, of some length, that open the piece.\nThen much more follows, with commas, and yet more of it, as is usual.\nAnd an end."),
        ("<article><p>Sum <math><mi>x</mi></math> and <object>o</object> <audio>s</audio>.</p></article><article class=comment><p>A reader says, and says, and says more than enough.</p></article>", "Sum x and o s."),
        ('<body><header><h1>Site</h1></header><div id="main-menu"><a href=x>a</a></div><div class="story"><p>This is a long paragraph, with commas, and with text enough to score.</p><p>More follows here, too.</p><div class="comments"><p>A reader says, and says, and says more than enough.</p></div></div><div class="cookie-notice"><p>We use cookies, and so on, please accept them all.</p></div></body>', "This is a long paragraph, with commas, and with text enough to score.\nMore follows here, too."),
        ("<article><header><h1>T</h1><span>by x</span></header><p>Text &lt;b&gt; here<ul><li>one<li>two</ul><form><p>mail</form></article>", "T\nText <b> here\none\ntwo"),
        ("<main><p>a<p>b<br>c&nbsp;d</p><aside>x</aside><table><tr><td>1<td>2</table></main>", "a\nb c d\n1\n2"),
    ],
)
def test_html_shapes(page, text):
    assert html.main_text(page) == text


def test_chain_rejects_marks_in_payloads(spark):
    rows = [(1, 0, 100), (1, 40, 60), (1, 60, 90), (1, 100, 250), (1, 130, 250), (1, 250, 300), (2, 5, 10)]
    got = warc.reachable(spark.createDataFrame(rows, "file long, offset long, next long"))
    assert {tuple(r) for r in got.collect()} == {(1, 0), (1, 100), (1, 250)}


def test_layout_names_do_not_hide_the_article():
    story = "<p>This is a long paragraph, with commas, and with text enough.</p><p>And another one, with more text.</p>"
    text = "This is a long paragraph, with commas, and with text enough.\nAnd another one, with more text."
    assert html.main_text(f'<div class="content has-sidebar">{story}</div><div class="sidebar"><p>Links.</p></div>') == text
    assert html.main_text('<div class="ad">An advert that is longer than the rest, by far.</div><article><p>Short.</p></article>') == "Short."
