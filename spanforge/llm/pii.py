"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans. Expectation-maximisation over all candidates of the
corpus estimates how reliable each labeler is and how likely each candidate is personal data; a logistic classifier
fitted to those likelihoods decides on the spans. Only counts of vote patterns leave the executors. The base patterns'
spans always stay; the classifier decides on candidates beyond them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name", "ssn")
LABELERS = ("strict", "shape", "gazetteer", "context", "counter")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

class _Words:
    """Whether a text has one of some words in any case: quicker than a pattern that ignores case."""

    def __init__(self, *words: str) -> None:
        self.words = words

    def search(self, text: str) -> bool:
        folded = text.casefold()
        return any(w in folded for w in self.words)


#: Candidates beyond the base patterns. Texts without a match of the second pattern, which is cheaper, have none of the third.
_LOOSE: list[tuple[str, re.Pattern[str] | _Words | None, re.Pattern[str]]] = [
    ("email", re.compile(r"[(\[\x20]at[)\]\x20]", re.I), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,})+", re.I)),
    ("phone", _DIGIT, re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")),
    ("card", _DIGIT, re.compile(r"(?<![\w.-])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{13,19})(?![\w-])")),
    ("ip", _DIGIT, re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w.])")),
    ("ssn", _DIGIT, re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("secret", _Words("passw", "token", "secret", "api"), re.compile(r"(?:password|passwd|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?([A-Za-z0-9_/+-]{12,})\x22?", re.I)),
    ("name", None, re.compile(r"(?:Mr|Mrs|Ms|Dr)\.\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")),
]

#: Fixed values of the gazetteer labeler: words and endings that go with a kind.
GAZETTEER = {
    "email": (".com", ".org", ".net", ".edu", ".de", ".fr", ".es", ".info", ".io", " com", " org", " net"),
    "ip": ("10.", "172.", "192.168.", "127."),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011"),
    "phone": ("+1", "+33", "+34", "+44", "+49", "(", "555"),
    "secret": ("password", "token", "api_key", "secret"),
    "name": ("Smith", "Johnson", "Miller", "Brown", "Garcia", "Martin", "Bernard", "Dubois", "Müller", "Schmidt", "Schneider", "Lopez", "Fernandez"),
    "ssn": (),
}
#: Fixed values of the context labelers: words before a span that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "credit", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "whatsapp", "telefon"),
    "secret": ("key", "login", "credential", "auth", "export", "password", "token"),
    "name": ("by", "with", "from", "dear", "signed", "met"),
    "ssn": ("ssn", "social", "security", "tax"),
}
COUNTER = ("version", "isbn", "issn", "doi", "section", "chapter", "page", "figure", "order no", "serial", "example of")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start and then kind; each pattern in time linear in the text."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        done = max(done, at + 1)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", done)
    if _DIGIT.search(text):
        if "." in text:
            for m in _DOTTED.finditer(text):
                if m[0].count(".") >= 3:
                    parts, pos = m[0].split("."), m.start()
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        size = sum(map(len, four)) + 3
                        if all(len(s := x.lstrip("0")) <= 3 and int(s or 0) <= 255 for x in four):
                            found.append(("ip", pos, pos + size))
                        pos += size + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    return found


def _loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates beyond the base spans, none overlapping another or one of those."""
    found: list[Span] = []
    starts: list[int] = []  # what is taken, in order, without overlaps
    ends: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, needs, pattern in _LOOSE:
        if needs is not None and not needs.search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect.bisect_right(ends, s)  # the first that ends after s
            if at == len(ends) or starts[at] >= e:
                starts.insert(at, s)
                ends.insert(at, e)
                found.append((kind, s, e))
    return found


def _well_formed(kind: str, value: str) -> bool:
    """Whether a candidate beyond the base spans has the exact form of its kind."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return _luhn(digits)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "email":  # after the word alone, a sentence's end looks like a domain's
        low = value.lower()
        return any(x in low for x in ("(at)", "[at]", "(dot)", "[dot]", " dot ")) or low.endswith(tuple(g for g in GAZETTEER["email"] if g[0] == "."))
    if kind == "phone":
        return "(" in value or "+" in value
    if kind == "secret":
        key = re.split(r"[=:]", value, maxsplit=1)[-1].strip(" \x22")
        return len(key) >= 12 and any(c.isdigit() for c in key) and any(c.isalpha() for c in key)
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    return True


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 for, 0 none; the counter labeler's 1 is against."""
    kind, start, end = span
    value, before = text[start:end], text[max(0, start - 32) : start].lower()
    near = value.lower() + " " + before if kind == "secret" else before
    return (
        int(is_base),
        int(is_base or _well_formed(kind, value)),
        int(any(value.startswith(g) if kind in ("ip", "card") else g in value for g in GAZETTEER[kind])),
        int(any(re.search(rf"\b{w}", near) for w in CONTEXT[kind])),
        int(any(w in before for w in COUNTER)),
    )


def features(kind: str, vote: tuple[int, ...], shape: int) -> np.ndarray:
    """Votes, kind and a coarse shape (0 to 3) of a candidate, as the classifier's input."""
    x = np.zeros(len(LABELERS) + len(KINDS) + 5)
    x[: len(LABELERS)] = vote
    x[len(LABELERS) + KINDS.index(kind)] = 1
    x[len(LABELERS) + len(KINDS) + shape] = 1
    x[-1] = 1
    return x


def shape_of(text: str, span: Span) -> int:
    """0 to 3: whether the span has digits, and whether it has letters."""
    value = text[span[1] : span[2]]
    return 2 * any(c.isdigit() for c in value) + any(c.isalpha() for c in value)


#: What is believed of the labelers before any count: chances of a vote for personal data and for others.
PRIOR_HIT = np.array([0.9, 0.95, 0.6, 0.2, 0.02])
PRIOR_FALSE = np.array([0.001, 0.1, 0.15, 0.05, 0.2])
PRIOR_WEIGHT = 50  # observations that the belief is worth


def expectation_maximisation(table: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reliabilities from (kind, votes, how many) by EM of independent labelers.

    Returns for each labeler its chance of a vote for personal data and for others, and the likelihood of each entry.
    Entries that the strict labeler votes for anchor the model: they count as personal data throughout, and reliability
    of the other labelers is learned beside them. Its own vote says nothing of entries without it, so it is left out
    there. The beliefs above are worth PRIOR_WEIGHT observations.
    """
    v = np.array([t[1] for t in table], float)
    n = np.array([t[2] for t in table], float)
    sure = v[:, 0] == 1
    hit, false, prior = PRIOR_HIT, PRIOR_FALSE, 0.5
    like = np.ones(len(table))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + v[:, 1:] @ np.log(hit / false)[1:] + (1 - v[:, 1:]) @ np.log((1 - hit) / (1 - false))[1:]
        like = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        yes, no = n * like, n * (1 - like)
        prior = np.clip(((n * like * ~sure).sum() + 1) / ((n * ~sure).sum() + 2), 0.05, 0.95)
        hit = np.clip((yes @ v + PRIOR_WEIGHT * PRIOR_HIT) / (yes.sum() + PRIOR_WEIGHT), 1e-4, 1 - 1e-4)
        false = np.clip((no @ v + PRIOR_WEIGHT * PRIOR_FALSE) / (no.sum() + PRIOR_WEIGHT), 1e-4, 1 - 1e-4)
    return hit, false, like


def classifier(entries: list[tuple[str, tuple[int, ...], int, float]], likelihood: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic weights fitted by Newton steps to the likelihoods of all candidates, by how many there are of each."""
    x = np.array([features(k, v, s) for k, v, s, _ in entries])
    # entries weigh by the logarithm of their number, so that a frequent kind doesn't decide for the rare ones
    n = np.log1p(np.array([e[3] for e in entries], float))
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - likelihood)) + 1e-3 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple, int] = {}
        for text in batch["text"]:
            if not text:
                continue
            base = base_spans(text)
            for spans, is_base in ((base, True), (_loose_spans(text, base), False)):
                for s in spans:
                    key = (s[0], *votes(text, s, is_base), shape_of(text, s))
                    counts[key] = counts.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", *LABELERS, "look", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The span classifier's weights, learned from the candidates of all texts.

    Candidates are counted by kind, votes and shape on the executors; at most kinds x 2^labelers x 4 counts come to the
    driver. Without any candidate the weights are zero.
    """
    small_batches(docs.sparkSession)
    cols = ", ".join(f"{c} int" for c in LABELERS)
    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(_vote_rows, f"kind string, {cols}, look int, n long")
    rows = counted.groupBy("kind", *LABELERS, "look").agg(F.sum("n").alias("n")).collect()
    entries = sorted((r["kind"], tuple(r[c] for c in LABELERS), r["look"], float(r["n"])) for r in rows)
    if not entries:
        return np.zeros(len(LABELERS) + len(KINDS) + 5)
    _, _, likelihood = expectation_maximisation([(k, v, n) for k, v, _, n in entries])
    return classifier(entries, likelihood)


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): base ones stay, the classifier decides on the others; by start, then kind."""
    base = base_spans(text)
    more = [s for s in _loose_spans(text, base) if features(s[0], votes(text, s, False), shape_of(text, s)) @ weights > 0]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _map(weights: np.ndarray, row: Callable[[str, list[Span], list[Span]], tuple], names: list[str], keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, spans = find(text or "", weights)
                out.append(row(text, base, spans))
            made = pd.DataFrame(out, columns=names, index=batch.index)
            yield pd.concat([batch[keep], made], axis=1)

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans: all of them as
    kind:start:end (code points, end exclusive), comma-joined by start and then kind. Null texts are empty. Repeated
    rows each have their row, null ids stay null, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def row(text: str, base: list[Span], spans: list[Span]) -> tuple:
        kinds = [k for k, _, _ in base]
        return (*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans))

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    inner = _map(fit(rows), row, names, ["doc_id"])
    typed = lambda batches: inner(b.astype({"doc_id": "Int64"}) for b in batches)
    return rows.mapInPandas(typed, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, spans: list[Span]) -> str | None:
    """text with a mark of its kind for every span; of spans that overlap, one mark for all, of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data masked in text, and chars_col, if there is one, brought up to date.

    Other columns, of any type, pass through Arrow as they are. Null texts stay null, with their count.
    """
    weights = fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, at = list(batch.columns), batch.schema.get_field_index(text_col)
            old = cols[at].to_pylist()
            new = [masked(t, find(t, weights)[1]) if t else t for t in old]
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if (k := batch.schema.get_field_index(chars_col)) >= 0:
                counts = [c if t is None else len(t) for t, c in zip(new, cols[k].to_pylist(), strict=True)]
                cols[k] = pa.array(counts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
