"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Every kind has a pattern, a validator and a prior score. A proposal whose
validator fails is dropped; only an IBAN is looked for again inside it, and behind
the end that its checksum confirms. Words of the kind's context within ``CONTEXT``
characters before or behind a span raise its score. Base kinds
(email, ip, card, phone) keep every confirmed span whatever its score, so that
they never depend on context; added kinds (iban, ssn) need ``THRESHOLD``.

All scans are linear in the text: patterns start only at the begin of a run, so
long runs of digits or letters cost no square.

Defined results: a null or empty text has no spans. Offsets count code points,
the end is exclusive; spans are ordered by start, then kind as in ``KINDS``.
Existing columns with the name of an output column are replaced, others kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import caches
from loomwork.session import prepare

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
CONTEXT = 40
CONTEXT_GAIN = 0.3
THRESHOLD = 0.6
CONTEXT_WORDS = {
    "email": "email|e-mail|mail|contact|correo|courriel|kontakt",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|security number|tax id",
}
NEAR = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.IGNORECASE).search for k, v in CONTEXT_WORDS.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}").finditer
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").search
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}").finditer
DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits move to the end, letters count 10 to 35; the rest by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN(text, at + 1)):
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)


def addresses(text: str):
    for chain in DOTTED(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):  # the next match starts behind the one before
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in CARD(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str):
    at = 0
    while m := IBAN(text, at):
        start, end = m.span()
        at = start + 1
        if start and text[start - 1].isalnum():
            continue
        while end - start >= 15:  # at most 45 characters: words behind it may have joined
            if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " " and mod97(text[start:end].replace(" ", "")):
                yield start, end
                at = end
                break
            end -= 1


def ssns(text: str):
    for m in SSN(text):
        start, end = m.span()
        around = text[max(0, start - 1) : start] + text[end : end + 1]
        s = m.group()
        if not re.search(r"[\w-]", around) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
            yield start, end


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of every span of a whole text, in order."""
    if not text:
        return []
    kinds = ["email"] if "@" in text else []
    if DIGIT(text):
        kinds += ["ip", "card", "iban", "ssn"] + (["phone"] if "+" in text else [])
    out = []
    for kind in kinds:
        for start, end in FINDERS[kind](text):
            near = NEAR[kind](text[max(0, start - CONTEXT) : start]) or NEAR[kind](text[end : end + CONTEXT])
            score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(near))
            if kind in BASE or score >= THRESHOLD:
                out.append((start, KINDS.index(kind), end, score))
    return sorted(out)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    spans = find(text)
    if not spans:
        return text
    out, last, until = [], 0, -1
    for start, kind, end, _ in spans:
        if start >= until:
            out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        until = max(until, end)
        last = until
    return "".join([*out, text[last:]])


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double"))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    caches.use("pii")
    found = [find(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)])
    flat = [x for spans in found for x in spans]
    columns = [
        pa.array([KINDS[x[1]] for x in flat], pa.string()),
        pa.array([x[0] for x in flat], pa.int32()),
        pa.array([x[2] for x in flat], pa.int32()),
        pa.array([x[3] for x in flat], pa.float64()),
    ]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "start", "end", "score"]))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array) -> pa.Array:
    caches.use("pii")
    return pa.array([masked(t) for t in texts.to_pylist()], pa.string())


def detect(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of personal data in ``text_col``."""
    prepare(df.sparkSession)
    return df.withColumn(out, _spans(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span in ``text_col`` by its kind in angle brackets; null stays null."""
    prepare(df.sparkSession)
    return df.withColumn(text_col, _masked(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
