"""Normalizing scalar functions as Columns: everything here stays in generated code, but for the folding of non-ASCII letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rowkin.functions import lexicons as lex


@F.arrow_udf(StringType())
def _folded(values: pa.Array) -> pa.Array:
    plain = ("".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) if v else v for v in values.to_pylist())
    return pa.array([v.upper() if v else v for v in plain], pa.string())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fold(value: Column, unicode: bool = True) -> Column:
    """Upper case without marks, single spaces, trimmed; null is ''. ``unicode=False`` where values are known to be ASCII, which keeps Python out of the plan."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    upper = F.when(value.rlike("[^\\x00-\\x7F]"), _folded(F.when(value.rlike("[^\\x00-\\x7F]"), value))).otherwise(F.upper(value)) if unicode else F.upper(value)
    return F.trim(F.regexp_replace(upper, "(?U)\\s+", " "))


def strip_punctuation(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, "(?U)[^\\w\\s]", " "), "(?U)\\s+", " "))


def split_words(value: Column) -> Column:
    return F.filter(F.split(value, " "), lambda t: t != "")


def tokens(value: Column, unicode: bool = True) -> Column:
    return split_words(strip_punctuation(fold(value, unicode)))


def trigrams(value: Column) -> Column:
    """Distinct three-letter runs of the value without spaces, padded by two spaces before and one after; none for ''."""
    bare = F.replace(F.coalesce(value, F.lit("")), F.lit(" "), F.lit(""))
    padded = F.concat(F.lit("  "), bare, F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


# --- people -----------------------------------------------------------------


def given_name(value: Column, unicode: bool = True) -> Column:
    """Canonical form of the first word of a given name."""
    head = F.coalesce(F.try_element_at(tokens(value, unicode), F.lit(1)), F.lit(""))
    return let(head, lambda h: F.when(h.isin(lex.CANONICAL), h).otherwise(F.coalesce(lex.map_column(lex.NICKNAME_MAP)[h], h)))


def is_affix(token: Column) -> Column:
    return F.replace(token, F.lit("-"), F.lit("")).isin(lex.AFFIXES)


def affix_tokens(value: Column) -> Column:
    """Affixes of a suffix field, where PA-C is one."""
    bare = F.replace(fold(value), F.lit("."), F.lit(""))
    return F.filter(F.transform(F.split(bare, "[,\\s]+"), lambda t: F.replace(t, F.lit("-"), F.lit(""))), lambda t: t != "")


def person_name(first: Column, middle: Column, last: Column, suffix: Column | None = None) -> Column:
    """struct(ordered, sorted, dropped): the nickname map applies to the first kept word only."""
    names = lex.map_column(lex.NICKNAME_MAP)
    more = F.array().cast("array<string>") if suffix is None else affix_tokens(suffix)

    def parts(x: Column) -> Column:
        named = F.transform(F.filter(x["raw"], lambda t: ~is_affix(t)), lambda t, i: F.when(i == 0, F.coalesce(names[t], t)).otherwise(t))
        dropped = F.concat(F.filter(x["raw"], is_affix), x["more"])
        return let(named, lambda n: F.struct(joined(n).alias("ordered"), joined(F.array_sort(n)).alias("sorted"), dropped.alias("dropped")))

    return let(F.struct(tokens(F.concat_ws(" ", first, middle, last)).alias("raw"), more.alias("more")), parts)


# --- organizations ----------------------------------------------------------


def org_name(value: Column, unicode: bool = True) -> Column:
    """struct(name, legal_form): legal forms leave the end (the outermost names it), acronyms are expanded. ``unicode``: see ``fold``."""
    plain = F.replace(F.replace(fold(value, unicode), F.lit("&"), F.lit(" AND ")), F.lit("."), F.lit(""))
    forms, long = lex.map_column(lex.LEGAL_MAP), lex.map_column(lex.ACRONYM_MAP)
    none = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    ends = lambda s, t: let(s["on"] & forms[t].isNotNull(), lambda on: F.struct(on.alias("on"), (s["n"] + on.cast("int")).alias("n")))

    def split(words: Column, tail: Column) -> Column:
        kept = F.slice(words, F.lit(1), F.size(words) - tail)
        return F.struct(joined(F.transform(kept, lambda t: F.coalesce(long[t], t))).alias("name"), F.when(tail > 0, forms[F.element_at(words, -1)]).otherwise("").alias("legal_form"))

    # the tail: how many words of the end are legal forms
    return let(split_words(strip_punctuation(plain)), lambda words: let(F.aggregate(F.reverse(words), none, ends)["n"], lambda tail: split(words, tail)))


def org_tokens(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda t: (t != "") & ~t.isin(*lex.ORG_STOP_WORDS))


def org_acronym(name: Column) -> Column:
    return let(org_tokens(name), lambda words: F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.left(t, F.lit(1))), "")).otherwise(""))


# --- identifiers ------------------------------------------------------------


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "\\D", "")


def ein(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 9, F.concat(F.left(d, F.lit(2)), F.lit("-"), F.right(d, F.lit(7)))).otherwise("")


def state(value: Column) -> Column:
    codes, names, other = sorted(lex.STATE_MAP.values()), lex.map_column(lex.STATE_MAP), lex.map_column(lex.SPELLING_MAP)

    def code(folded: Column, bare: Column) -> Column:
        head = F.split(bare, " ")[0]
        return F.when(bare.isin(codes), bare).otherwise(F.coalesce(names[bare], other[bare], other[folded], F.when(head.isin(codes), head), F.lit("")))

    return let(fold(value), lambda folded: let(strip_punctuation(folded), lambda bare: code(folded, bare)))


def zip5(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) >= 5, F.left(d, F.lit(5))).otherwise("")


def license_number(value: Column) -> Column:
    bare = F.regexp_replace(fold(value), "(?U)[^\\p{L}\\p{N}]", "")
    numbers = lambda x: F.regexp_replace(F.regexp_replace(x, "\\D", ""), "^0+", "")
    return let(bare, lambda x: F.when(numbers(x) == "", x).otherwise(F.concat(F.regexp_replace(x, "[^\\p{L}]", ""), numbers(x))))


def address(line1: Column, line2: Column, city: Column, state_: Column, zip_: Column) -> Column:
    """struct(line, unit, house_number, city, state, zip5, po_box): a unit word takes one word after it."""
    streets, unit_words = lex.map_column(lex.STREET_MAP), lex.UNITS
    none = F.array().cast("array<string>")

    def lines(folded: Column) -> Column:
        return F.aggregate(
            split_words(folded),
            F.struct(none.alias("street"), none.alias("unit"), F.lit(False).alias("open")),
            lambda s, t: F.struct(
                F.when(t.isin(*unit_words) | s["open"], s["street"]).otherwise(F.array_append(s["street"], F.coalesce(streets[t], t))).alias("street"),
                F.when(t.isin(*unit_words) | s["open"], F.array_append(s["unit"], t)).otherwise(s["unit"]).alias("unit"),
                t.isin(*unit_words).alias("open"),
            ),
        )

    def whole(x: Column, parts: Column) -> Column:
        folded = x["folded"]
        box = F.lit(False)
        for mark in lex.BOXES:
            box = box | folded.startswith(mark) | folded.contains(f" {mark}")
        first = F.coalesce(F.try_element_at(parts["street"], F.lit(1)), F.lit(""))
        number = F.regexp_extract(folded, "(\\d+)", 1)
        return F.struct(
            joined(parts["street"]).alias("line"),
            joined(parts["unit"]).alias("unit"),
            F.when(first.rlike("^\\d+$"), first).otherwise("").alias("house_number"),
            x["city"].alias("city"),
            x["state"].alias("state"),
            x["zip5"].alias("zip5"),
            F.when(box, F.when(number != "", number).otherwise("UNKNOWN")).otherwise("").alias("po_box"),
        )

    street = strip_punctuation(fold(F.concat_ws(" ", F.nullif(line1, F.lit("")), F.nullif(line2, F.lit("")))))
    given = F.struct(street.alias("folded"), strip_punctuation(fold(city)).alias("city"), state(state_).alias("state"), zip5(zip_).alias("zip5"))
    return let(given, lambda x: let(lines(x["folded"]), lambda parts: whole(x, parts)))


def luhn_digit(body: Column, prefix: str = "80840") -> Column:
    """Check digit of nine digits under the prefix that the registry uses."""
    whole = F.concat(F.lit(prefix), body)
    n = len(prefix) + 9
    each = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substr(whole, i, F.lit(1)).cast("int") * F.when((F.lit(n) - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda t, d: t + F.when(d > 9, d - 9).otherwise(d))
    return (10 - total % 10) % 10  # one mention of ``body`` only


def npi(value: Column) -> Column:
    """struct(status, digits): sentinels are told before the checksum is looked at."""
    raw = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))

    def classified(raw: Column, spaced: Column, clean: Column) -> Column:
        status = (
            F.when(raw == "", "MISSING")
            .when(raw.isin(*lex.PLACEHOLDERS) | spaced.isin("", *lex.PLACEHOLDERS) | clean.isin(*lex.PLACEHOLDERS), "PLACEHOLDER_TEXT")
            .when(clean == "", "MISSING")
            .when(~clean.rlike("^\\d+$"), "MALFORMED")
            .when(clean.isin(*lex.SENTINEL_NPIS), "SENTINEL")
            .when(F.length(clean) != 10, "MALFORMED")
            .when(luhn_digit(F.left(clean, F.lit(9))) != F.right(clean, F.lit(1)).cast("int"), "CHECKSUM_FAIL")
            .otherwise("VALID")
        )
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s.isin("MISSING", "PLACEHOLDER_TEXT"), "").otherwise(clean).alias("digits")))

    return let(raw, lambda r: let(F.regexp_replace(r, "[\\s\\-._/]", " "), lambda spaced: classified(r, F.trim(spaced), F.replace(spaced, F.lit(" "), F.lit("")))))


# --- dates ------------------------------------------------------------------


def four_digit_year(value: Column) -> Column:
    return F.when(value >= 100, value).when(value <= 26, value + 2000).otherwise(value + 1900)


def partial_date(value: Column) -> Column:
    """struct(year, month, day), each null where unknown; anything unreadable is three nulls."""
    month_names = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
    months = F.create_map(*(F.lit(x) for kv in month_names.items() for x in kv))
    none = F.lit(None).cast("int")
    make = lambda y, m, x: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), x.cast("int").alias("day"))
    part = lambda v, top: F.when((v >= 1) & (v <= top), v)

    def read(x: Column) -> Column:
        """x: struct(d, digit runs; n, the same as numbers; named, the month by name)."""
        d, n, named = x["d"], x["n"], x["named"]
        at = lambda i: F.try_element_at(n, F.lit(i))
        one = F.try_element_at(d, F.lit(1))
        first = lambda test: F.try_element_at(F.filter(n, test), F.lit(1))
        swapped = (at(1) > 12) & (at(2) <= 12)
        return (
            F.when(named.isNotNull(), make(four_digit_year(first(lambda v: v > 31)), named, first(lambda v: v <= 31)))
            .when((F.size(d) == 1) & (F.length(one) == 8), make(F.left(one, F.lit(4)), F.substr(one, F.lit(5), F.lit(2)), F.right(one, F.lit(2))))
            .when((F.size(d) == 1) & (F.length(one) == 4), make(one, none, none))
            .when(F.size(d) < 2, make(none, none, none))
            .when(F.length(one) == 4, make(at(1), part(at(2), 12), part(at(3), 31)))
            .when(F.size(d) == 2, make(four_digit_year(at(2)), part(at(1), 12), none))
            .otherwise(make(four_digit_year(at(3)), part(F.when(swapped, at(2)).otherwise(at(1)), 12), part(F.when(swapped, at(1)).otherwise(at(2)), 31)))
        )

    numbers = lambda d: F.filter(F.transform(d, lambda x: F.left(x, F.lit(9)).try_cast("int")), lambda x: x.isNotNull())
    runs = lambda text: F.struct(F.regexp_extract_all(text, F.lit("(\\d+)"), F.lit(1)).alias("d"), months[F.left(F.regexp_extract(text, "([A-Z]{3,})", 1), F.lit(3))].alias("named"))
    return let(fold(value), lambda text: let(runs(text), lambda r: let(F.struct(r["d"].alias("d"), numbers(r["d"]).alias("n"), r["named"].alias("named")), read)))


def hash_share(*parts: Column) -> Column:
    """The first 64 bits of the SHA-256 of the text, as a share of 2**64: the same draw on every run."""
    text = F.concat(*parts)
    return F.conv(F.left(F.sha2(text, 256), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def record_key(*parts: Column) -> Column:
    """A key made of the folded parts: K- and 20 hexadecimal digits."""
    whole = F.concat_ws("\x1f", *(fold(p) for p in parts))
    return F.concat(F.lit("K-"), F.upper(F.left(F.sha2(whole, 256), F.lit(20))))
