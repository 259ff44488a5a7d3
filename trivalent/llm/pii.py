"""Personal data in whole texts, with column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Characters before a span that are searched for context words.
CONTEXT = 48


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits of ``hit`` pass the Luhn check."""
    reverse = F.split(F.reverse(digits_of(hit)), "")

    def weigh(digit: Column, i: Column) -> Column:
        twice = digit.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    weighed = F.transform(F.filter(reverse, lambda d: d != ""), weigh)
    return F.aggregate(weighed, F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number (country, two check digits, the rest) leaves 1 on division by 97."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        letter = char.rlike("[A-Z]")
        value = F.when(letter, F.ascii(char) - 55).otherwise(F.ascii(char) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def octets(hit: Column) -> Column:
    """Whether every part of a dotted number is 255 at most; leading zeros don't count."""
    bare = F.transform(F.split(hit, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def eight_to_fifteen(hit: Column) -> Column:
    return F.length(digits_of(hit)).between(8, 15)


@dataclass(frozen=True)
class Kind:
    """A kind of span: the pattern that proposes, the check that confirms, and the words that raise its score.

    ``hint`` is a plain string without which no span can be, or None. Spans of a
    kind with ``base`` are all reported; of the others, those that score ``accept``.
    """

    name: str
    pattern: str
    check: object = None
    prior: float = 0.5
    words: str = ""
    hint: str | None = None
    base: bool = True
    accept: float = 0.0


# Patterns find what the plain ones would, leftmost first and without overlap, but
# start only where a run of their first characters starts (or where the last span
# ended), and never go back over a run. So a long run is read once.
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++", None, 0.9, "mail|contact|write|from|to:", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.6, "ip|address|host|server|login", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", luhn, 0.8, "card|visa|master|credit|payment|account"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", eight_to_fifteen, 0.7, "phone|tel|call|mobile|fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", mod97, 0.9, "iban|account|bank|konto|compte|cuenta", None, False, 0.9),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", luhn, 0.4, "card|visa|amex|credit|payment", None, False, 0.6),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, 0.4, "ssn|social|security|tax", None, False, 0.6),
)


#: Spans of one text that are joined at once.
PART = 256


def spans_of(kind: Kind, text: Column, hits: Column) -> Column:
    """array<struct<start, end, hit, before>> of the hits, in code points, end exclusive; before are the CONTEXT characters before one.

    What stands between the hits is the text split by the same pattern, so that each
    start is a sum of lengths.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>")
    # What a lambda reads from outside is computed again for each element, so arrays come in by zipping and naming.
    earlier = F.concat(F.array(F.lit("")), F.slice(hits, 1, F.greatest(F.size(hits) - 1, F.lit(0))))
    pairs = F.zip_with(F.split(text, kind.pattern, -1), earlier, lambda gap, last: F.struct(gap.alias("gap"), last.alias("last")))
    both = F.zip_with(pairs, hits, lambda x, hit: F.struct(
        F.length(x["gap"]).alias("gap"), hit.alias("hit"), F.right(F.concat(F.coalesce(x["last"], F.lit("")), x["gap"]), F.lit(CONTEXT)).alias("before")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["hit"])
        made = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(made)).alias("out"))

    def run(state: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(made["at"].alias("at"), F.concat(state["out"], made["out"]).alias("out"))

    def joined(whole: Column) -> Column:
        # An array grows by copying it, so spans are joined part by part. The last gap has no hit.
        n = F.size(whole) - 1
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PART)), lambda i: F.slice(
            whole, i * PART + 1, F.least(F.lit(PART), n - i * PART).cast("int")))
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(n <= 0, none).otherwise(F.aggregate(parts, begin, run, lambda state: state["out"]))

    return F.get(F.transform(F.array(both), joined), 0)


def scored(kind: Kind, found: Column) -> Column:
    """The spans that pass the kind's check, each with a score: the prior, moved by words that stand close before."""

    def one(span: Column) -> Column:
        near = F.lower(span["before"]).rlike(rf"(?:^|[^a-z])(?:{kind.words})")
        score = F.when(near, kind.prior + 0.6 * (1 - kind.prior)).otherwise(F.lit(kind.prior))
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), score.alias("score"))

    confirmed = found if kind.check is None else F.filter(found, lambda s: kind.check(s["hit"]))
    out = F.transform(confirmed, one)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= kind.accept)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and, for each kind, the array ``spans_<kind>`` of (kind, start, end, score) of each row of ``df``.

    Positions are code points of the whole text, ends exclusive. Per kind, spans are
    the leftmost matches without overlap; a match that fails its check is dropped and
    not tried again. A null text is the empty text, which has none; repeated rows are
    searched each; an empty table gives an empty result.
    """
    rows = id_and_text(df, id_col, text_col)
    none = F.array().cast("array<string>")
    hits = {}
    for k in kinds:
        all_hits = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
        hits[f"hits_{k.name}"] = all_hits if k.hint is None else F.when(F.contains("text", F.lit(k.hint)), all_hits).otherwise(none)
    rows = rows.select("doc_id", "text", *[v.alias(n) for n, v in hits.items()])
    empty = "array<struct<kind:string,start:int,end:int,score:double>>"
    made = [
        F.when(F.size(f"hits_{k.name}") > 0, scored(k, spans_of(k, F.col("text"), F.col(f"hits_{k.name}"))))
        .otherwise(F.array().cast(empty)).alias(f"spans_{k.name}")
        for k in kinds
    ]
    return rows.select("doc_id", *made)


def listed(columns: list[Column]) -> Column:
    """kind:start:end of the spans, comma-joined in the order of the columns, then of starts."""
    words = F.transform(F.concat(*columns), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(words, ",")


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as a string."""
    base = [k for k in kinds if k.base]
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(listed([F.col(f"spans_{k.name}") for k in base]).cast("binary"), 256).alias("base_sha256"),
        listed([F.col(f"spans_{k.name}") for k in kinds]).alias("spans"),
        F.aggregate(
            F.concat(*[F.col(f"spans_{k.name}") for k in kinds]), F.lit(0.0), lambda top, s: F.greatest(top, s["score"])
        ).alias("max_score"),
    )
