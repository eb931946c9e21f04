"""Find and mask personal data.

Regular expressions propose spans, validators confirm them, and context words
before a span adjust its score. A span stands if its score reaches ``KEEP``.

* email, ip, card (Luhn) and phone are base kinds: every confirmed span stands.
* iban stands if as many characters as its country has, whatever follows after a
  space, give 1 by mod-97.
* card_short (13 to 15 digits) and national_id stand only near a context word.

Every proposal is found in time linear in the text, also in very long runs of
digits or letters. Defined results: null and empty texts have no spans; offsets
count code points, the end is exclusive; each row, repeated or not, is searched
on its own; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_short", "national_id")
KEEP = 0.5
WINDOW = 48

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can only match what the run's start matches too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# The registered length of an IBAN by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
# As many characters as the country has; a word or an amount may follow after a space.
IBAN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTH.items())
    + r")(?![A-Za-z0-9])"
)

CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "card_short": ("card", "amex", "credit", "karte", "carte", "tarjeta"),
    "national_id": ("ssn", "social security", "national id"),
}
START_SCORE = {
    "email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "card_short": 0.3,
    "national_id": 0.3,
}
CONTEXT_GAIN = 0.2

SPANS = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("score", DoubleType()),
        ]
    )
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _matches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, str]]:
    for found in pattern.finditer(text):
        yield *found.span(), found.group()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    found = IBAN.search(text)
    while found:
        confirmed = mod_97(found.group().replace(" ", ""))
        if confirmed:
            yield found.span()
        # Another may start inside a proposal that the checksum refutes.
        found = IBAN.search(text, found.end() if confirmed else found.start() + 1)


def _digits(proposal: str) -> str:
    return "".join(c for c in proposal if c in "0123456789")


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind as listed, then start."""
    for start, end in _emails(text):
        yield "email", start, end
    for start, end, found in _matches(IP, text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split(".")):
            yield "ip", start, end
    runs = [(start, end, _digits(found)) for start, end, found in _matches(CARD, text)]
    for start, end, digits in runs:
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", start, end
    for start, end, found in _matches(PHONE, text):
        if 8 <= len(_digits(found)) <= 15:
            yield "phone", start, end
    for start, end in _ibans(text):
        yield "iban", start, end
    for start, end, digits in runs:
        if 13 <= len(digits) <= 15 and luhn(digits):
            yield "card_short", start, end
    for start, end, _ in _matches(NATIONAL_ID, text):
        yield "national_id", start, end


def spans_in(text: str | None) -> list[dict]:
    """The spans that stand, by kind as listed in ``KINDS``, then start."""
    kept = []
    for kind, start, end in _proposals(text or ""):
        near = text[max(0, start - WINDOW) : start].lower()
        score = START_SCORE[kind] + CONTEXT_GAIN * any(word in near for word in CONTEXT[kind])
        if score >= KEEP:
            kept.append({"kind": kind, "start": start, "end": end, "score": round(score, 3)})
    return kept


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one mark."""
    if text is None:
        return None
    parts, done = [], 0
    for span in sorted(spans_in(text), key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= done:
            parts += [text[done : span["start"]], f"<{span['kind'].upper()}>"]
        done = max(done, span["end"])
    return "".join(parts) + text[done:]


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(spans_in)


@F.pandas_udf(StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(masked)


def pii_spans(text: str = "text") -> Column:
    """Array of (kind, start, end, score) found in a text column."""
    return _spans(text_of(text))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars`` counted anew; null stays null."""
    text = _masked(F.col("text").cast("string"))
    shown = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        shown = shown.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return shown
