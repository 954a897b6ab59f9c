"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is Spark SQL expressions inside one scan: no shuffle, no Python. Matches are cut out with ``split`` and
``regexp_extract_all`` of the same pattern, so offsets are running sums of piece lengths, in code points.

Cases: null or empty text has no spans. Repeated rows each get their own result. Extra columns pass through; only
a column of the result's own name is replaced. Texts of any length are scanned whole; every pattern starts
only where a run of its characters starts, so scanning is linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, the score of a confirmed match, and words that raise it when they stand before."""

    name: str
    pattern: str
    score: float
    context: str
    least: float = 0.0   # spans under this score after the context is read are dropped


# Patterns are those of the contract with an anchor in front: a match can start only at the head of its character run or
# where the last match ended, because a later start in the same run fails exactly when the head does.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile"),
)

EXTRA = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.8, "iban|account|bank", 0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|tax", 0.5),
)

KINDS = BASE + EXTRA


def _luhn(digits: Column) -> Column:
    """Luhn's sum over the digits from the right: every second is doubled, nines cast out."""
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _mod97(code: Column) -> Column:
    """IBAN check: the first four characters go last, letters become 10 to 35, the number must leave 1 over 97."""
    turned = F.concat(F.substring(code, 5, 99), F.substring(code, 1, 4))
    at = F.sequence(F.lit(1), F.length(turned))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(at, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """What a proposed match must fulfil beyond its pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # by digits, as a part of any length must not overflow a number
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.length(bare).between(15, 34) & _mod97(bare)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda a plain reference would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, join, zero: Column) -> Column:
    """For each element what ``join`` makes of all earlier ones, in blocks: whole blocks first, then inside each block."""

    def over(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        tops = F.transform(blocks, lambda b: F.aggregate(part(b), zero, join))

        def inside(t: Column, b: Column) -> Column:
            head = F.aggregate(F.slice(t, F.lit(1), b), zero, join)
            return let(F.struct(part(b).alias("p"), head.alias("h")), lambda x: F.transform(
                x["p"], lambda _, i: F.aggregate(F.slice(x["p"], F.lit(1), i), x["h"], join)))

        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b: inside(t, b))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<bigint>")))


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"



def spans_of(text: Column, kind: Kind, window: int = 40) -> Column:
    """Confirmed spans of one kind as an array of (kind, start, end, score), starts ascending."""

    def span(cut: Column, past: Column, m: Column, i: Column) -> Column:
        before = F.element_at(cut["piece"], i + 1)
        start = F.element_at(past, i + 1) + F.length(before)
        near = F.lower(F.substring(before, F.greatest(F.length(before) - window + 1, F.lit(1)), F.lit(window)))
        bonus = F.when(near.rlike(rf"(?:^|[^a-z])(?:{kind.context})(?:[^a-z]|$)"), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                        F.least(F.lit(kind.score) + bonus, F.lit(1.0)).alias("score"), confirmed(kind.name, m).alias("ok"))

    def located(cut: Column) -> Column:
        sizes = F.transform(cut["found"], lambda m, i: (F.length(F.element_at(cut["piece"], i + 1)) + F.length(m)).cast("long"))
        return let(_before(sizes, lambda a, b: a + b, F.lit(0).cast("long")), lambda past: F.transform(cut["found"], lambda m, i: span(cut, past, m, i)))

    cut = F.struct(F.split(text, kind.pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    kept = F.filter(let(cut, located), lambda s: s["ok"] & (s["score"] >= kind.least))
    plain = F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))
    return F.when(text.rlike(kind.pattern), plain.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``into``: all confirmed spans, by kind in the order of ``kinds``, then by start.

    Null text counts as empty. A column already called ``into`` is replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(into, F.concat(*[spans_of(whole, k) for k in kinds]))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replace each confirmed span by its kind in brackets; spans that overlap become one, called after the earliest.

    A null text stays null; texts without spans stay as they are.
    """
    whole = F.col(f"`{text}`")
    found = F.array_sort(F.transform(F.concat(*[spans_of(F.coalesce(whole, F.lit("")), k) for k in kinds]),
                                     lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def drawn(s: Column, upto: Column) -> Column:
        """The text since the last end and the mark; nothing for a span that starts inside an earlier one."""
        gap = F.substring(whole, (upto + 1).cast("int"), (s["start"] - upto).cast("int"))
        return F.when(s["start"] < upto, "").otherwise(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def masked(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        parts = let(_before(ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("long")), lambda upto: F.zip_with(spans, upto, drawn))
        return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(whole, (F.array_max(ends) + 1).cast("int"), F.length(whole)))
                      ).otherwise(whole)

    return docs.withColumn(text, let(found, masked))
