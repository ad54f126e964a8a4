"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

Kinds, in the order of ties: email, ip (parts at most 255), card (12 to 19 digits that pass Luhn), phone (9 to 15
digits) - the base - then iban (mod-97) and national_id, which the method adds where the score is high enough. Kinds
are searched for independently of each other, so spans of different kinds may overlap. A match that fails its check
is dropped, and the search goes on behind it. Offsets count code points; the end is exclusive.

A null text is an empty one; rows come out as they came in (null ids, repeated rows), other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Marks around matches while a text is cut; in the text itself both become U+0003, which no pattern takes.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
#: Spans of an array that a prefix is folded over at once.
_BLOCK = 128
#: Code points before a span in which context words count.
CONTEXT = 40
#: Least score of a span that is not of the base.
LEAST_SCORE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = _digits(value)
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    letters = F.split(moved, "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), step) == 1


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


@dataclass(frozen=True)
class Kind:
    """hint: what a text must have for a match to be possible. The pattern is possessive where that changes nothing."""

    name: str
    hint: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    for_words: str
    against_words: str
    base: bool = True


KINDS = (
    Kind("email", "@",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None,
         0.9, "mail|contact|write", "example"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts,
         0.6, "ip|host|server|address", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++",
         lambda v: _between(12, 19)(v) & luhn(v), 0.8, "card|visa|credit|pay", "isbn|order|serial"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _between(9, 15), 0.7, "phone|call|tel|mobile|fax", "offset|sum"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97,
         0.8, "iban|account|bank|transfer", "isbn|serial", base=False),
    Kind("national_id", r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None,
         0.4, "ssn|social|security|national|passport", "order|serial|part", base=False),
)


def _with_prefixes(df: DataFrame, names: list[str], start: Column, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """df with <name>_before for each array column: for each element, the fold of start and all elements before it.

    Two levels, blocks and the elements of a block, so that it isn't quadratic. The levels are columns of their own:
    inside the function of an array they would be computed again for every element.
    """
    def blocks_of(n: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(n) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)), start, fold))

    df = df.withColumns({f"{n}_blocks": blocks_of(n) for n in names})

    def at(n: str) -> Callable[[Column, Column], Column]:
        def over(_: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            blocks = F.when(F.size(f"{n}_blocks") > 0, F.slice(f"{n}_blocks", F.lit(1), b))
            return F.aggregate(F.slice(n, b * _BLOCK + 1, i - b * _BLOCK), F.aggregate(blocks, start, fold), fold)
        return over

    return df.withColumns({f"{n}_before": F.transform(n, at(n)) for n in names}).drop(*(f"{n}_blocks" for n in names))


_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,score:double,base:boolean>>"


def _spans(text: str, parts: str, starts: str, number: int, kind: Kind) -> Column:
    """The spans of one kind; parts: the text cut before each match, and each match closed by a mark."""
    def span(part: Column, i: Column) -> Column:
        value = F.substring_index(part, _CLOSE, 1)
        start = F.get(starts, i)
        near = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
        score = (F.lit(kind.score) + F.when(near.rlike(kind.for_words), 0.2).otherwise(0.0)
                 - F.when(near.rlike(kind.against_words), 0.3).otherwise(0.0))
        valid = F.lit(True) if kind.valid is None else kind.valid(value)
        kept = (i > 0) & valid if kind.base else (i > 0) & valid & (score >= LEAST_SCORE)
        return F.when(kept, F.struct(
            start.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"),
            (start + F.length(value)).alias("end"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"),
            F.lit(kind.base).alias("base")))

    found = F.filter(F.transform(parts, span), lambda s: s.isNotNull())
    return F.when(F.size(parts) > 1, found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans of its texts in a column `out`, by start and then by kind."""
    columns = [c for c in df.columns if c != out]
    held = "__pii_text"
    rows = df.select(*(F.col(f"`{c}`") for c in columns), F.translate(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _OPEN + _CLOSE, _OTHER * 2).alias(held))
    parts = {k: f"__pii_{k.name}" for k in KINDS}
    rows = rows.withColumns({n: F.when(F.col(held).rlike(k.hint), F.split(F.regexp_replace(
        held, F.lit(k.pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)).otherwise(F.array(held)) for k, n in parts.items()})
    rows = rows.withColumns({f"{n}_sizes": F.transform(
        n, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)) for n in parts.values()})
    rows = _with_prefixes(rows, [f"{n}_sizes" for n in parts.values()], F.lit(0), lambda a, b: a + b)
    found = [_spans(held, n, f"{n}_sizes_before", i, k) for i, (k, n) in enumerate(parts.items())]
    return rows.select(*(F.col(f"`{c}`") for c in columns), F.array_sort(F.concat(*found)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with each span of its texts replaced by [KIND]; what overlaps is replaced once, by the kind that starts first."""
    held, ends = F.col(f"`{spans}`"), "__pii_ends"
    rows = _with_prefixes(df.withColumn(ends, F.transform(held, lambda s: s.end)), [ends], F.lit(0), lambda a, b: F.greatest(a, b))
    whole = F.col(f"`{text}`")

    def piece(s: Column, i: Column) -> Column:
        at = F.get(f"{ends}_before", i)
        return F.when(s.start >= at, F.concat(
            F.substring(whole, at + 1, s.start - at), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit(""))

    clean = F.concat(F.array_join(F.transform(held, piece), ""), F.substring(whole, F.array_max(ends) + 1, F.length(whole)))
    return rows.withColumn(text, F.when(F.size(held) > 0, clean).otherwise(whole)).drop(ends, f"{ends}_before")
