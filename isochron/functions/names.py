"""Names, labels and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded to a plain one before names are compared.
FOLDED = {
    "a": "áàâäãåāăąæ",
    "e": "éèêëēĕėęě",
    "i": "íìîïĩīĭį",
    "o": "óòôöõøōŏőœ",
    "u": "úùûüũūŭůű",
    "y": "ýÿ",
    "c": "çćĉċč",
    "n": "ñńņň",
    "s": "šśşșß",
    "z": "žźż",
    "d": "ďđð",
    "l": "łľ",
    "g": "ğ",
    "t": "ťțþ",
    "r": "řŕ",
}
_FROM = "".join(FOLDED.values())
_TO = "".join(k * len(v) for k, v in FOLDED.items())
_INT = r"^[+-]?[0-9]{1,18}$"


def fold_accents(text: Column) -> Column:
    """Lower-case accented letters replaced by their plain letter."""
    return F.translate(text, _FROM, _TO)


def accent_count(text: Column) -> Column:
    """How many letters ``fold_accents`` would change, in any case."""
    low = F.lower(text)
    return F.length(low) - F.length(F.regexp_replace(low, f"[{_FROM}]", ""))


def name_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, accents folded; an empty array for none."""
    clean = F.trim(F.regexp_replace(fold_accents(F.lower(text)), r"[^\p{L}\p{Nd}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def same_folded(a: Column, b: Column) -> Column:
    return name_tokens(a) == name_tokens(b)


def normal_name(text: Column) -> Column:
    """Lower case without dots, commas and apostrophes; dashes and slashes are blanks; single blanks."""
    plain = F.translate(F.regexp_replace(F.lower(F.trim(text)), "[.,'’]", ""), "-–/", "   ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_shouting(text: Column) -> Column:
    """More than one letter, and all of them capitals."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    return (F.length(letters) > 1) & (F.length(F.regexp_replace(letters, r"\P{Lu}", "")) == F.length(letters))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits; blanks, dashes and underscores as single inner dashes; the rest dropped."""
    dashed = F.regexp_replace(fold_accents(F.lower(text)), "[ _–-]", "-")
    plain = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(plain, "^-|-$", "")


def natural_key(label: Column) -> Column:
    """Sort key: numbers first and by value, then texts."""
    num = F.when(label.rlike(_INT), label.cast("bigint"))
    return F.struct(num.isNull().alias("text"), F.coalesce(num, F.lit(0)).alias("number"), F.when(num.isNull(), label).otherwise("").alias("label"))


def letters_first_key(label: Column) -> Column:
    """Sort key: texts first, then numbers by value."""
    num = F.when(label.rlike(_INT), label.cast("bigint"))
    return F.struct(num.isNotNull().alias("number_last"), F.when(num.isNull(), label).otherwise("").alias("label"), F.coalesce(num, F.lit(0)).alias("number"))


def feed_prefix(identifier: Column) -> Column:
    """``fN`` of an id ``fN:...``, else the empty string."""
    return F.regexp_extract(identifier, r"^(f[+-]?[0-9]+):", 1)


def feed_index(identifier: Column) -> Column:
    """N of an id ``fN:...``, else 0."""
    return F.coalesce(F.regexp_extract(identifier, r"^f([0-9]+):", 1).try_cast("int"), F.lit(0))


def bare_id(identifier: Column) -> Column:
    """The id without its feed prefix."""
    return F.regexp_replace(identifier, r"^f[+-]?[0-9]+:", "")


def shape_of_piece(shape_id: Column) -> Column:
    """The shape a window piece was cut from."""
    return F.regexp_replace(shape_id, r"#(clip|exc)[0-9]+.*$", "")


def display_label(override: Column, short: Column, long: Column) -> Column:
    """The first that isn't empty, commas as blanks."""
    pick = F.coalesce(*[F.when(c != "", c) for c in (override, short, long)], F.lit(""))
    return F.replace(pick, F.lit(","), F.lit(" "))


def display_color(override: Column, of_class: Column, own: Column) -> Column:
    """Override, class colour, own colour, or grey."""
    return F.coalesce(*[F.when(c != "", c) for c in (override, of_class, own)], F.lit("888888"))


def text_color(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^#", "")


def same_color(a: Column, b: Column) -> Column:
    """Equal but for case and a leading ``#``."""
    return F.upper(F.regexp_replace(a, "^#", "")) == F.upper(F.regexp_replace(b, "^#", ""))


def color_number(text: Column) -> Column:
    """24-bit number of six hex digits, an optional ``#`` before; 0 for anything else."""
    h = F.regexp_replace(text, "^#", "")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.conv(h, 16, 10).cast("int")).otherwise(0)


def is_bullet(label: Column, median: Column) -> Column:
    """Whether a label is short enough for a bullet.

    Up to two characters always, up to four with a digit; three without one if
    half the labels around have at most two.
    """
    n = F.length(label)
    return (n <= 2) | ((n <= 4) & label.rlike(r"\p{Nd}")) | ((n == 3) & (median <= 2))


def better_name(feed: Column, other: Column, lost: Column, most_lost: float = 0.45) -> Column:
    """Whether ``other`` should replace ``feed``: better spelling of the same words, or little information lost."""
    spelling = F.when(accent_count(feed) != accent_count(other), accent_count(other) > accent_count(feed)).otherwise(
        is_shouting(feed) & ~is_shouting(other)
    )
    return F.when((other == "") | (other == feed), False).when(same_folded(feed, other), spelling).otherwise(lost <= most_lost)


def variant_hidden(label: Column, labels: Column) -> Column:
    """Whether ``label`` is a diamond variant (``6X``) of another label of the array."""
    base = F.regexp_extract(label, "^(.+)X$", 1)
    return (base != "") & F.array_contains(labels, base)
