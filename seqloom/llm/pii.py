"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, kept, quoted, read, unpacked

# The contract's patterns, and those of the added kinds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # no match of the plain pattern begins inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national")
#: Words within CONTEXT characters of a span that speak for its kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "compte"), "national": ("ssn", "social", "security", "national"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "sku")
CONTEXT = 40
#: A span's score before its context: base kinds stay whatever their context says, added ones need THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "national": 0.3}
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return kind != "iban" or mod97(s)


def emails(text: str):
    """What a leftmost search for LOCAL+ @ DOMAIN finds, from each @ outwards: a long run without @ costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


#: A cheap test of the whole text that each kind needs, and how its spans are proposed.
PROPOSE = {"email": ("@", emails)} | {k: (need, lambda t, p=p: (m.span() for m in p.finditer(t))) for k, need, p in (("ip", ".", IP), ("card", "", CARD), ("phone", "+", PHONE), ("iban", "", IBAN), ("national", "-", NATIONAL))}
SOME_DIGIT = re.compile("[0-9]")


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(re.findall("[a-z]+", f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()))
    return min(1.0, PRIOR[kind] + 0.3 * any(w in near for w in FOR[kind])) - 0.2 * any(w in near for w in AGAINST)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive. Spans of different kinds may overlap."""
    if not text:
        return []
    out, digit = [], SOME_DIGIT.search(text) is not None
    for kind, (need, propose) in PROPOSE.items():
        if (digit or kind == "email") and need in text:
            for start, end in propose(text):
                if _valid(kind, text[start:end]) and ((s := score(text, kind, start, end)) >= THRESHOLD or kind in BASE):
                    out.append((kind, start, end, s))
    return out


def redact(text: str | None, spans: list) -> str | None:
    """Each stretch of overlapping spans becomes the name of its first one's kind."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


RESULTS = "spans array<struct<kind string, start int, end int, score double>>, redacted string"


def _found(docs: DataFrame, keep: tuple, text_col: str) -> DataFrame:
    def work(texts):
        found = [spans_of(t) for t in texts]
        rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in found]
        return [rows, [redact(t, x) for t, x in zip(texts, found, strict=True)]]

    return beside(docs.select(kept(keep), quoted(text_col)), RESULTS, work)


def personal_data(docs: DataFrame, *, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, spans (array of kind, start, end, score) and redacted text.

    Works row by row without a shuffle. A null text has no spans and stays null; an empty one has none. Very long texts
    are searched whole. Repeated rows give a row each; an empty table gives an empty result. Columns that aren't kept
    don't matter; a kept one that has a result's name comes back as kept_<name>.
    """
    return unpacked(_found(docs, keep, text_col), ("spans", "redacted"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = personal_data(read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *map(number, BASE),
        F.sha2(told(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), told(spans).alias("spans"),
    )


def stage_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the names of its kinds, n_chars counted anew. Null texts stay null,
    with a null count; repeated rows stay; other columns are carried along, whatever their names. An empty table gives an
    empty one."""
    found, kind = _found(docs, tuple(docs.columns), "text"), docs.schema["n_chars"].dataType
    now = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast(kind)}
    return found.select(*(now.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns))
