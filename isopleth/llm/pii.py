"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Fixed patterns of the base kinds, as RE2 and DuckDB read them.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IBAN_PATTERN = r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
SSN_PATTERN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"

# The same matches for a backtracking matcher, in linear time: a match can only begin where its
# first run begins or where the match before ended, and no run is ever given back.
_LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE_PATTERNS["phone"],
    "iban": IBAN_PATTERN,
    "ssn": SSN_PATTERN,
}


@dataclass(frozen=True)
class Kind:
    """score: of a confirmed span; bonus: added when a context word stands near; base spans are kept whatever their score."""

    name: str
    base: bool
    score: float
    bonus: float
    context: str


KINDS = (
    Kind("email", True, 0.8, 0.2, r"(?i)mail|contact|write"),
    Kind("ip", True, 0.6, 0.3, r"(?i)\bip\b|address|host|server"),
    Kind("card", True, 0.7, 0.3, r"(?i)card|visa|credit|payment"),
    Kind("phone", True, 0.6, 0.3, r"(?i)phone|tel|call|mobile|fax"),
    Kind("iban", False, 0.8, 0.2, r"(?i)iban|bank|account"),
    Kind("ssn", False, 0.2, 0.6, r"(?i)ssn|social security"),
)
#: Code points before and after a span in which a context word counts.
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
MIN_SCORE = 0.5

_SPAN = "array<struct<start:int,end:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when 12 to 19 digits have a Luhn sum divisible by ten."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """True when the account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(iban, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        value = F.when(char >= "A", F.ascii(char) - 55).otherwise(F.ascii(char) - 48)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in order. The pieces between matches give the positions."""
    pattern = _LINEAR[kind.name]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        match = F.coalesce(x["match"], F.lit(""))
        begin, finish = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(match)
        first = begin + F.when(F.substring(match, 1, 1).rlike("[A-Z]"), 0).otherwise(1) if kind.name == "iban" else begin
        found = F.array(F.struct(first.cast("int").alias("start"), finish.cast("int").alias("end"))).cast(_SPAN)
        keep = x["match"].isNotNull() & _confirmed(kind.name, match)
        return F.struct(finish.cast("int").alias("at"), F.when(keep, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    folded = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, folded).otherwise(F.array().cast(_SPAN))


def _scored(text: Column, kind: Kind, rank: int, spans: Column) -> Column:
    def one(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT_BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_BEFORE)))
        near = F.concat_ws(" ", before, F.substring(text, s["end"] + 1, F.lit(CONTEXT_AFTER)))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.bonus).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), score.alias("score"))

    scored = F.transform(spans, one)
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add column `out`: array of (start, rank, kind, end, score) ordered by start, then kind as listed in KINDS.

    Positions count code points; ends are exclusive. A null or empty text gives an empty array, every row
    is kept (repeated ones too) and other columns pass through; `out` must not name one of them.
    Spans of one kind never overlap; spans of different kinds may.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [free_name(df, f"spans_{k.name}") for k in KINDS]
    held = df.select("*", *(_spans(whole, k).alias(n) for k, n in zip(KINDS, names)))
    parts = [_scored(whole, k, i, F.col(n)) for i, (k, n) in enumerate(zip(KINDS, names))]
    return held.select(*(F.col(f"`{c}`") for c in df.columns), F.array_sort(F.concat(*parts)).alias(out))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span that find_pii reports by its kind in brackets; overlapping spans become the first one's mark.

    Null and empty texts stay as they are; the rows, repeated ones too, and the columns are those of `df`.
    """
    whole, found = F.col(f"`{text}`"), free_name(df, "pii")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(F.col(found), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole))))
    clean = F.when(F.size(found) > 0, cut).otherwise(whole).alias(text)
    return find_pii(df, text, found).select(*(clean if c == text else F.col(f"`{c}`") for c in df.columns))


def digest(df: DataFrame, key: str = "doc_id", pii: str = "pii") -> DataFrame:
    """Counts and base digest of find_pii's spans, one row per row of `df`."""
    spans, base = F.col(pii), [k.name for k in KINDS if k.base]

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return df.select(key, *counts, F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(spans).alias("spans"))
