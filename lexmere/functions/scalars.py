"""Column functions; every one is an expression of Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date patterns in the order they are tried, and the zone of dates that name none.
DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-ddXXX")
DEFAULT_ZONE = "-03:00"

#: Month and weekday labels, Monday first.
MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
WEEKDAYS = ("Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom")

#: Role of each kind of reference.
ROLES = {"espacio": "location", "humanos": "participant", "objetos": "object"}

#: Letters with accents, and what they fold to.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"

#: Red, green and blue of the palette's colours.
PALETTE = (
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44), (152, 223, 138), (214, 39, 40), (255, 152, 150), (148, 103, 189), (197, 176, 213),
    (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210), (127, 127, 127), (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
)


def parsed_date(text: Column) -> Column:
    """H1: ISO with zone, ISO without, blank instead of T, or a date alone; no zone means DEFAULT_ZONE. Blank, fractional or unknown: null."""
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zoned = F.when(t.rlike(r"[+-]\d\d:\d\d$"), t).otherwise(F.concat(t, F.lit(DEFAULT_ZONE)))
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(p)) for p in DATE_PATTERNS])


def iso(ts: Column) -> Column:
    """H2: ISO-8601 text with offset."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")


def tracking_model(model: Column, mode: Column) -> Column:
    """H3: the model's name, marked for instruct mode."""
    return F.when(F.lower(F.trim(mode)) == "instruct", F.concat(model, F.lit(" [I]"))).otherwise(model)


def found_at(text: Column, quote: Column) -> Column:
    """H4: 0-based position of the quote: as written, else in any letter case, else null. Empty or null quotes are not found."""
    exact, folded = F.position(quote, text), F.position(F.lower(quote), F.lower(text))
    return F.when(quote != "", F.when(exact > 0, exact - 1).when(folded > 0, folded - 1)).cast("int")


def word_count(text: Column) -> Column:
    """H6: runs between Unicode white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def normal_form(text: Column) -> Column:
    """H7: lower case without accents, trimmed, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\s+", " "))


def either_contains(a: Column, b: Column) -> Column:
    """H8: one holds the other in any letter case; empty texts hold nothing."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def token_estimate(text: Column) -> Column:
    """H9: a quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def stable_hash(text: Column) -> Column:
    """31-multiplier hash of the characters in 31 bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0x7FFFFFFF)))


def colour(index: Column) -> Column:
    """The palette's entry for an index, as `rgb(r,g,b)`; index modulo the palette's size."""
    return F.element_at(F.array(*[F.lit(f"rgb({r},{g},{b})") for r, g, b in PALETTE]), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def days_in_month(day: Column) -> Column:
    """H12."""
    return F.dayofmonth(F.last_day(day))


def day_fraction(day: Column) -> Column:
    """0 on the first of the month, 1 on its last."""
    return (F.dayofmonth(day) - 1) / (days_in_month(day) - 1)


def month_label(day: Column) -> Column:
    """`Ene 2026`."""
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))


def weekday_label(ts: Column) -> Column:
    """`Dom 6 18:00`, without the hour at midnight."""
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(ts) + 1)
    hour = F.date_format(ts, "HH:mm")
    return F.concat_ws(" ", day, F.dayofmonth(ts).cast("string"), F.when(hour != "00:00", hour))


def key_id(*parts: Column) -> Column:
    """sha256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def log_id(*parts: Column) -> Column:
    """The first 16 digits of the sha256 of the parts, one after another."""
    return F.left(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256), F.lit(16))


def extension(name: Column) -> Column:
    """With its dot, in lower case; empty if none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def shortened(text: Column, most: int) -> Column:
    """H16."""
    return F.left(text, F.lit(most))


def event_entity_name(what: Column) -> Column:
    """`Event: ` and up to 80 characters, with an ellipsis if there were more."""
    t = F.trim(what)
    return F.concat(F.lit("Event: "), F.when(F.length(t) > 80, F.concat(F.left(t, F.lit(80)), F.lit("..."))).otherwise(t))


def role_of(kind: Column) -> Column:
    """H19."""
    return reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), list(ROLES.items())[1:], F.when(kind == next(iter(ROLES)), ROLES[next(iter(ROLES))])).otherwise("subject")


def whole_number(text: Column) -> Column:
    """The integer a text holds, else 0."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def event_text(title: Column, description: Column) -> Column:
    """The title, else 140 characters of the description, else a fixed label."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(title), filled(F.left(description, F.lit(140))), F.lit("(sin título)"))


def masked_key(key: Column) -> Column:
    """Four characters and stars; one if it is no longer than four; null if empty."""
    return F.when(F.length(key) > 4, F.concat(F.left(key, F.lit(4)), F.lit("****"))).when(F.length(key) > 0, F.concat(F.left(key, F.lit(1)), F.lit("****")))
