"""Scalar functions over columns: names, numbers, dates, hashes, and what models answer as JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit separator between the parts of what is hashed.
APART = chr(31)
NO_NUMBER = ("", "--", "---", "N/A")


def ticker_list(raw: Column) -> Column:
    """The upper-cased tickers of a text, parted by white space, commas or semicolons; what isn't a ticker is left out."""
    return F.transform(F.filter(F.split(F.trim(raw), r"[\s,;]+"), lambda x: F.rlike(x, F.lit(r"^[A-Za-z0-9.^=-]+$"))), F.upper)


def ticker_code(text: Column) -> Column:
    """The code in `2330`, `2330.TW` or `2330.TWO`, whatever the case; null for anything else."""
    return F.nullif(F.regexp_extract(F.trim(text), r"(?i)^(\d{4,6})(?:\.(?:TW|TWO))?$", 1), F.lit(""))


def entity_of_ticker(ticker: Column) -> Column:
    """`2330.TW` and `2330.TWO` -> `TW:2330`; null without such an ending."""
    code = F.regexp_extract(F.upper(F.trim(ticker)), r"^(.+?)\.(?:TWO|TW)$", 1)
    return F.when(code != "", F.concat(F.lit("TW:"), F.trim(code)))


def with_suffix(code: Column, listed: Column) -> Column:
    return F.concat(F.trim(code), F.when(listed, ".TW").otherwise(".TWO"))


def number(text: Column) -> Column:
    """A number with thousands separators; null and the signs for no number are 0, and what can't be read is null."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ""))
    return F.when(clean.isin(*NO_NUMBER), F.lit(0).cast("decimal(20,4)")).otherwise(clean.try_cast("decimal(20,4)"))


def roc_date(text: Column) -> Column:
    """`113/03/19` and `1130319` -> a date, 1911 years later; null for other shapes and for days that don't exist."""
    digits = F.regexp_replace(F.trim(text), "/", "")
    iso = F.concat((F.substring(digits, 1, 3).try_cast("int") + 1911).cast("string"), F.lit("-"), F.substring(digits, 4, 2), F.lit("-"), F.substring(digits, 6, 2))
    return F.when(F.rlike(digits, F.lit(r"^\d{7}$")), iso.try_cast("date"))


def utc(text: Column) -> Column:
    """A time with an offset, or Z, as a timestamp; one without is refused with null."""
    return F.when(F.rlike(text, F.lit(r"(?:Z|[+-]\d{2}:\d{2})$")), text.try_cast("timestamp"))


def digest(width: int, *parts: Column) -> Column:
    """The first hex digits of the SHA-256 of the parts, a unit separator between them; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws(APART, *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, width)


def unversioned(values: Column, versions: Column) -> Column:
    """The names in the map `values` that the map `versions` lacks."""
    return F.array_except(F.map_keys(values), F.map_keys(versions))


def blocking(findings: Column) -> Column:
    """Of an array of structs with `severity`, those that hold a signal back."""
    return F.filter(findings, lambda f: f["severity"].isin("CRITICAL", "HIGH"))


def round_trip_bps(commission_bps: float = 14.25, tax: float = 0.003, slippage_bps: float = 5.0) -> float:
    """Basis points of buying and selling once, without impact."""
    return 2 * commission_bps + tax * 10_000 + 2 * slippage_bps


def dividend_factor(reference: Column, prior: Column) -> Column:
    """Reference price over the close before; null unless both are above 0."""
    return F.when((reference > 0) & (prior > 0), reference / prior)


@dataclass(frozen=True)
class Answer:
    """What a model's JSON must hold: closed sets of strings, ranges of numbers, most characters of strings, and sizes of arrays."""

    schema: str
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    lengths: dict[str, tuple[int, int]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)


def unfenced(text: Column) -> Column:
    """The lines between the first and the last of a text that begins with a code fence, if it has more than two; else the text."""
    bare = F.trim(text)
    return F.when(F.rlike(bare, F.lit(r"(?s)^```[^\n]*\n.*\n[^\n]*$")), F.regexp_extract(bare, r"(?s)^```[^\n]*\n(.*)\n[^\n]*$", 1)).otherwise(bare)


def answer(text: Column, form: Answer) -> Column:
    """A struct of payload and reason: null reason and the parsed payload, or no payload (the model counts as abstaining) and why:
    json, missing, enum, range, length or size."""
    data = F.from_json(unfenced(F.coalesce(text, F.lit(""))), form.schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    names = [*form.sets, *form.ranges, *form.lengths, *form.sizes]
    any_of = lambda conditions: F.coalesce(F.greatest(*conditions, F.lit(False)), F.lit(False)) if conditions else F.lit(False)
    reason = (
        F.when(data.isNull() | data["_bad"].isNotNull(), "json")
        .when(any_of([data[n].isNull() for n in names]), "missing")
        .when(any_of([~data[n].isin(*allowed) for n, allowed in form.sets.items()]), "enum")
        .when(any_of([~data[n].between(low, high) for n, (low, high) in form.ranges.items()]), "range")
        .when(any_of([~F.length(data[n]).between(low, high) for n, (low, high) in form.lengths.items()]), "length")
        .when(any_of([F.size(data[n]) != size for n, size in form.sizes.items()]), "size")
    )
    return F.struct(F.when(reason.isNull(), data).alias("payload"), reason.alias("reason"))
