"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Proposals of the base kinds (email, ip, card, phone) that hold are reported whatever their score. The kinds that the
method adds need a score of ADDED or more and must not touch an earlier span: iban (mod-97 at the length of its country;
of a country that is not known, words nearby as well), ssn, and short_card, a card of 13 to 15 digits (words nearby).
Spans are code points, end exclusive. Null texts count as empty; an empty text has no spans, an empty table no rows; a very
long text is read whole, in time that grows with its length; of proposals that touch, the kind listed first stays. Repeated
rows give repeated results; other columns are not read, and ids never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "iban", "ssn", "short_card")
#: Least score of an added span; characters on either side in which context words count.
ADDED, AROUND = 0.7, 48
#: Score of a proposal, and what a context word adds, or an IBAN's known country.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.4, "short_card": 0.4}
WORD, COUNTRY = 0.3, 0.2
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|telefon|tel.fono|t.l.phone", re.I),
    "iban": re.compile(r"iban|account|konto|cuenta|compte|bank", re.I),
    "ssn": re.compile(r"\bssn\b|social security", re.I),
    "short_card": re.compile(r"card|visa|credit|karte|tarjeta|carte|amex|american express|diners", re.I),
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Characters of the IBANs of a country.
_IBAN_SIZE = {c: n for n, some in {15: "NO", 16: "BE", 18: "DK FO FI GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in some.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    return not (sum(map(int, digits[-1::-2])) + sum(_TWICE[int(x)] for x in digits[-2::-2])) % 10


def mod97(iban: str) -> bool:
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern local@domain, found from its @, so that long runs of local characters are read once."""
    past = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            past = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """At each place the pattern's longest end, or one at a blank before it, that has the length of the country (any, if
    it is none of the known ones) and the right remainder."""
    at = 0
    while m := _IBAN.search(text, at):
        a, at = m.start(), m.start() + 2
        for b in [m.end(), *(a + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]:
            x = text[a:b].replace(" ", "")
            if 15 <= len(x) <= 34 and len(x) == _IBAN_SIZE.get(x[:2], len(x)) and mod97(x):
                yield a, b
                at = b
                break


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    yield from (("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")))
    yield from (("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(x := _digits(m[0])) <= 19 and luhn(x))
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    yield from (("iban", a, b) for a, b in _ibans(text))
    yield from (("ssn", *m.span()) for m in _SSN.finditer(text))
    yield from (("short_card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(x := _digits(m[0])) <= 15 and luhn(x))


def find(text: str) -> list[Span]:
    """All spans, by kind as listed, then start."""
    if not any(map(text.__contains__, "0123456789@")):
        return []
    out: list[Span] = []
    for kind, a, b in _proposals(text):
        near = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]
        known = kind == "iban" and text[a : a + 2] in _IBAN_SIZE
        score = min(1.0, SCORE[kind] + WORD * bool(CONTEXT[kind].search(near)) + COUNTRY * known)
        if kind in BASE or score >= ADDED and not any(x.start < b and a < x.end for x in out):
            out.append(Span(kind, a, b, score))
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of kind, start, end, score."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, score: double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[x._asdict() for x in find(t)] for t in batch], dtype=object)

    return texts(docs).select("doc_id", spans("text").alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted and digested; all spans, and the score of each."""
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    scores = F.array_join(F.transform(spans, lambda x: F.format_string("%.1f", x["score"])), ",").alias("scores")
    return pii_spans(table(spark, sf_dir, "documents")).select("doc_id", *map(n, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), scores)
