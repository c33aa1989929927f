"""Whole results: what the operators once cut short."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanforge.llm import html, jaccard, mixing, pii, quality, queries


def test_mixing_rows_meet_their_targets(spark):
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    took = rows.probability * rows.n_tokens
    assert rows.probability.between(0, 1).all() and took.sum() > 0
    for dim in mixing.DIMS:
        have = rows.n_tokens.groupby(rows[dim]).sum()
        goal = (have / have.sum()) ** mixing.TEMPER * (have > 0)
        got = took.groupby(rows[dim]).sum()
        assert (got / got.sum()).to_numpy() == pytest.approx((goal / goal.sum()).to_numpy(), abs=1e-4)


def test_mixing_meets_far_targets_and_reports_what_it_cannot():
    cells = [("a", "en", "note", 9, 900), ("a", "fr", "note", 9, 60), ("b", "en", "note", 9, 30), ("b", "fr", "note", 9, 10)]
    with pytest.warns(UserWarning, match="infeasible"):
        table = mixing.calibrate(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "fr": 0.3}}, 0.8)
    took = {c[:2]: c[4] * n[4] for c, n in zip(table, cells, strict=True)}
    total = sum(took.values())
    assert sum(v for k, v in took.items() if k[0] == "b") / total == pytest.approx(0.5, abs=1e-4)
    assert sum(v for k, v in took.items() if k[1] == "fr") / total == pytest.approx(0.3, abs=1e-4)
    assert total == pytest.approx(80, rel=1e-3)  # source b whole


def _junk(kind: str, n: int = 300) -> str:
    rng = random.Random(kind)
    if kind == "gibberish":
        words = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    elif kind == "numbers":
        words = [str(rng.randint(10, 10**6)) for _ in range(n)]
    else:
        words = rng.choices(["house", "green", "river", "walked", "stone", "paper", "quickly", "seven", "window", "morning", "letter", "bright"], k=n)
    return " ".join((w.capitalize() if i % 12 == 0 else w) + ("." if i % 12 == 11 else "," if i % 7 == 3 else "") for i, w in enumerate(words))


def test_prose_like_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    kinds = ["gibberish", "numbers", "salad"]
    junk = spark.createDataFrame([(-1 - i, _junk(k), "en") for i, k in enumerate(kinds)], docs.schema)
    both = docs.unionByName(junk)
    rows = {r["doc_id"]: r for r in quality.quality(both).collect()}
    assert [rows[-1 - i]["base_failed"] for i in range(3)] == [False] * 3
    assert [rows[-1 - i]["kept"] for i in range(3)] == [False] * 3
    assert {r["doc_id"] for r in quality.keep_good(both).select("doc_id").collect()} == {i for i, r in rows.items() if r["kept"]}


CASELESS = {
    "ar": "ذهب الرجل إلى السوق في الصباح واشترى خبزا وحليبا، ثم عاد إلى بيته وقرأ كتابا قديما عن تاريخ المدينة.",
    "hi": "आदमी सुबह बाज़ार गया और रोटी और दूध खरीदा। फिर वह अपने घर लौटा और शहर के इतिहास की किताब पढ़ी।",
    "ko": "남자는 아침에 시장에 가서 빵과 우유를 샀다. 그리고 집에 돌아와 도시의 역사에 관한 오래된 책을 읽었다.",
}


def test_languages_without_case_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng, rows = random.Random(3), []
    for k, (lang, text) in enumerate(CASELESS.items()):
        for i in range(3):
            rows.append((-1 - 10 * k - i, " ".join(" ".join(rng.sample(text.split(), len(text.split()))) for _ in range(8)), lang))
    rows.append((-100, _junk("gibberish"), "en"))
    got = {r["doc_id"]: r for r in quality.quality(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    assert all(got[i]["kept"] for i, _, _ in rows[:-1]) and not got[-100]["kept"]


def test_every_match_of_a_pattern_is_a_candidate():
    for text in ["PASSWORD=abcd1234efgh5678", "API_KEY: abcd1234efgh5678", "Token: abcd1234efgh5678", "SECRET=abcd1234efgh5678", "ann(AT)example.com", "ann [AT] example.com", "ann at example.com", "ann AT example.com"]:
        for around in ("", " and (at) dot dot"):
            spans = pii._loose_spans(text + around, [])
            assert [(s, e) for _, s, e in spans] == [(0, len(text))], text
    rules = {kind: pattern for kind, _, pattern in pii._LOOSE}
    rng = random.Random(2)
    parts = ["a", "at", "(at)", "[AT]", " at ", " dot ", ".", "example.com", "ToKen", "Pa\u017fsword", "=", "abcd1234efgh", "Mr. ", "Ann", "555-123-4567", "078-05-1120", "10.1.2.3", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(12))
        found = pii._loose_spans(text, [])
        for rule in rules.values():
            assert all(any(s < e2 and s2 < e for _, s2, e2 in found) for s, e in (m.span() for m in rule.finditer(text)))


def test_secrets_are_masked_in_any_case(spark):
    texts = ["PASSWORD=abcd1234efgh5678 here", "Token: abcd1234efgh5678 here", "mail ann at example.com now", "we met at noon.Then we left"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], docs.schema)
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs.unionByName(extra)).where("doc_id < 0").collect()}
    assert [got[-1 - i] for i in range(4)] == ["<secret> here", "<secret> here", "mail <email> now", texts[3]]


def test_one_row_of_each_class_stays(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + docs[:20] * 3 + [(None, t) for _, t in docs[10:30]] + [(None, "only without an id")] * 2 + [(None, None), (-5, ""), (-5, "")]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        k = root(i)
        least[k] = min(least.get(k, (True, 0)), (doc is None, doc or 0))
    got = jaccard.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(least.values())


STORY = "<p>This is a long paragraph, with commas, and with text enough.</p><p>And another one, with more text.</p>"
LINES = "This is a long paragraph, with commas, and with text enough.\nAnd another one, with more text."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<main><h1>Title</h1><article>{STORY}</article></main>", f"Title\n{LINES}"),
        (f"<main><h1>Title</h1><div><article>{STORY}</article></div></main>", f"Title\n{LINES}"),
        (f"<div><article>{STORY}</article><article>{STORY}</article></div>", f"{LINES}\n{LINES}"),
        (f"<article><header><div><h1>T</h1><span>by x</span></div></header>{STORY}</article>", f"T\n{LINES}"),
        (f"<article>{STORY}<ol><li><a href=a>One source</a><li><a href=b>Two source</a><li><a href=c>Three source</a></ol></article>", f"{LINES}\nOne source\nTwo source\nThree source"),
        (f"<body><form action=x><div>{STORY}</div></form></body>", LINES),
        (f"<body><nav><a href=x>a</a></nav><h1>Site</h1><article><h1>T</h1>{STORY}</article><form><p>Mail<p>Name</form></body>", f"T\n{LINES}"),
    ],
)
def test_html_keeps_whole_articles(page, text):
    assert html.main_text(page) == text


def test_spans_have_no_longest_length():
    key = "a1" * 5000
    assert pii._loose_spans(f"token={key}", []) == [("secret", 0, 6 + len(key))]
    assert pii._loose_spans(f"{'b' * 300} (at) {'c' * 300}" + " dot cc" * 9, [])[0][2] == 606 + 63
    assert pii._loose_spans(f"Dr. A{'n' * 40} B{'o' * 40}", []) == [("name", 0, 4 + 41 + 1 + 41)]
    many = "call 555-123-4567, " * 20_000
    assert len(pii._loose_spans(many, [])) == 20_000


def test_fractions_and_powers_are_no_letters(spark):
    from spanforge.llm import langid

    rows = [(i, t, "en") for i, t in enumerate(["½ ² ¼ 12", "١٢٣", "a", "é", "日"])] + [(100 + i, "some words of a text", "en") for i in range(9)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[0] == got[1] == "und" and got[2] == got[3] == got[4] == "en"
