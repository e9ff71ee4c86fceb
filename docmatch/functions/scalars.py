"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexlang import to_java

WS = r"\p{IsWhite_Space}"
FLOAT = r"[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a column that is used several times in
    the making of the next one would double the expression at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(to_java(pattern))


def trim(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def blank(text: Column) -> Column:
    return ~text.rlike(r"\P{IsWhite_Space}")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trim(F.regexp_replace(text, rf"{WS}+", " "))


def lines(text: Column) -> Column:
    """Lines without their ends; a final empty one doesn't count."""
    # all but the last piece had an end, and may have had a carriage return before it
    whole = F.regexp_replace(text, r"\r\n", "\n")
    dropped = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(whole, "\n", -1), dropped)


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalise_cell(text: Column) -> Column:
    """Trimmed, with one layer of each markdown mark taken off."""

    def strip(mark: str) -> Callable[[Column], Column]:
        n = len(mark)

        def step(x: Column) -> Column:
            whole = x.startswith(mark) & x.endswith(mark) & (F.length(x) >= 2 * n)
            return F.when(whole, trim(F.substr(x, F.lit(n + 1), F.length(x) - 2 * n))).otherwise(x)

        return step

    def bare(t: Column) -> Column:
        for mark in "** __ ` * _".split():
            t = let(t, strip(mark))
        return t

    return let(trim(text), lambda t: F.when(t.rlike("^[*_`]"), bare(t)).otherwise(t))


def is_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).rlike(rf"^{FLOAT}\z")


def is_currency(text: Column) -> Column:
    return F.contains(text, F.lit("$")) & F.translate(text, "$,", "").rlike(rf"^{FLOAT}\z")


def is_percentage(text: Column) -> Column:
    core = F.regexp_replace(text, r"%\z", "")
    return text.endswith("%") & F.replace(trim(core), F.lit(","), F.lit("")).rlike(rf"^{FLOAT}\z")


MONTHS = "january february march april may june july august september october november december".split()


def is_date(text: Column) -> Column:
    """One of six forms, of a day that exists."""

    def exists(year: Column, month: Column, day: Column) -> Column:
        y, m, d = (F.try_to_number(c, F.lit("9999")).cast("int") for c in (year, month, day))
        return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull()

    def part(pattern: str, g: int) -> Column:
        return F.regexp_extract(text, pattern, g)

    def month_number(name: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substr(name, F.lit(1), F.lit(3))))
        return at.cast("string")

    iso, slash4, slash2 = r"^(\d{4})-(\d{1,2})-(\d{1,2})\z", r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", r"^(\d{1,2})/(\d{1,2})/(\d{2})\z"
    names = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS)
    named, dashed = rf"(?i)^({names})\s+(\d{{1,2}}),\s*(\d{{4}})\z", rf"(?i)^(\d{{1,2}})-({'|'.join(m[:3] for m in MONTHS)})-(\d{{4}})\z"
    century = F.when(part(slash2, 3) < "70", F.concat(F.lit("20"), part(slash2, 3))).otherwise(F.concat(F.lit("19"), part(slash2, 3)))
    # all forms end in a digit and have one of the three signs
    return (
        F.when(~(text.rlike(r"[0-9]\z") & text.rlike("[-/,]")), False)
        .when(text.rlike(iso), exists(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(text.rlike(slash4), exists(part(slash4, 3), part(slash4, 1), part(slash4, 2)))
        .when(text.rlike(slash2), exists(century, part(slash2, 1), part(slash2, 2)))
        .when(text.rlike(named), exists(part(named, 3), month_number(part(named, 1)), part(named, 2)))
        .when(text.rlike(dashed), exists(part(dashed, 3), month_number(part(dashed, 2)), part(dashed, 1)))
        .otherwise(False)
    )


def cell_type(value: Column) -> Column:
    """empty, percentage, currency, number, date or string."""
    return let(
        trim(normalise_cell(value)),
        lambda t: F.when(t == "", "empty").when(~t.rlike("(?i)[0-9]|inf|nan"), "string").when(is_percentage(t), "percentage").when(is_currency(t), "currency")
        .when(is_number(t), "number").when(is_date(t), "date").otherwise("string"),
    )


def distance_form(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else as single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def heading_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(distance_form(a), distance_form(b))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*\z", 1)


def extension(path: Column) -> Column:
    """After the last dot of the name, lower-cased; a name that begins with its only dot
    has none."""
    return ascii_lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*\z"), F.regexp_extract(name, r"^(.+)\.[^.]*\z", 1)).otherwise(name)


def scalar_text(text: Column) -> Column:
    """Control characters as spaces, then collapsed."""
    odd = text.rlike(rf"\p{{Cc}}|^{WS}|{WS}\z|{WS}{{2}}|(?! ){WS}")
    return F.when(odd, collapse(F.regexp_replace(text, r"\p{Cc}", " "))).otherwise(text)


def a1(row: Column, col: Column) -> Column:
    """The name of a cell from 0-based row and column (up to three letters)."""
    c = col.cast("int")
    letter = lambda x: F.chr(x + 65)
    one, two = letter(c % 26), F.when(c >= 26, letter(F.floor(c / 26 - 1).cast("int") % 26)).otherwise("")
    three = F.when(c >= 702, letter(F.floor((c - 702) / 676).cast("int"))).otherwise("")
    return F.concat(three, two, one, (row + 1).cast("string"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Of a 0-based rank; 0 for none."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank + 1), F.lit(0.0))


def rfc3339(text: Column) -> Column:
    """Timestamp of text with an offset or Z; null for anything else."""
    good = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z")
    return F.when(good, F.try_to_timestamp(F.translate(text, "tz", "TZ")))


def family(template_id: Column) -> Column:
    """The family of a template id: bdc-soi-X.vN and a/X.vN are X; others lower-cased."""
    low = F.lower(F.trim(template_id))
    a, b = r"^bdc-soi-([a-z0-9_-]+)\.v\d+$", r"^.*/([a-z0-9_-]+)\.v\d+$"
    return F.when(low.rlike(a), F.regexp_extract(low, a, 1)).when(low.rlike(b), F.regexp_extract(low, b, 1)).otherwise(low)
