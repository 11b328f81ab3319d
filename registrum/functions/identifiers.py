"""Identifier checks and readings, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def valid_lei(code: Column) -> Column:
    """Shape and ISO 7064 mod 97-10."""
    rest = F.aggregate(F.split(code, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + _value(c)) % 97))
    return F.coalesce(code.rlike("^[0-9A-Z]{18}[0-9]{2}$") & (rest == 1), F.lit(False))


def valid_isin(code: Column) -> Column:
    """Shape and Luhn over the code with letters as two digits."""
    digits = F.reverse(F.array_join(F.transform(F.split(code, ""), lambda c: F.when(c == "", "").otherwise(_value(c).cast("string"))), ""))
    double = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    terms = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x, i: double(x.cast("int"), i))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + x)
    return F.coalesce(code.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$") & (total % 10 == 0), F.lit(False))


def valid_bic(code: Column, countries: list[str]) -> Column:
    """Shape and one of the countries given."""
    return F.coalesce(code.rlike("^[0-9A-Z]{4}[A-Z]{2}[0-9A-Z]{2}([0-9A-Z]{3})?$") & F.substring(code, 5, 2).isin(countries), F.lit(False))


def readings(text: Column, countries: list[str]) -> Column:
    """Every identifier that a text could be: struct of lei, isin, bic, each null or upper case without spaces. Spaces are allowed
    only between an LEI's groups of four and all groups of a BIC."""
    code, trimmed = ascii_upper(F.regexp_replace(text, r"\s+", "")), F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = ~trimmed.rlike(r"\s")
    return F.struct(
        F.when((whole | trimmed.rlike(r"^\S{4}( \S{4}){4}$")) & valid_lei(code), code).alias("lei"),
        F.when(whole & valid_isin(code), code).alias("isin"),
        F.when((whole | trimmed.rlike(r"^\S{4} \S{2} \S{2}( \S{3})?$")) & valid_bic(code, countries), code).alias("bic"),
    )


def register_number(text: Column) -> Column:
    """The text as a register number, or null: five digits at least, half of its letters and digits or more, not only years, and
    not shaped like another identifier."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    compact = F.upper(F.replace(t, F.lit(" "), F.lit("")))
    letters, digits = F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")), F.length(F.regexp_replace(t, "[^0-9]", ""))
    long = F.regexp_extract_all(t, F.lit("([0-9]{4,})"), F.lit(1))
    only_years = (F.size(long) > 0) & F.forall(long, lambda x: x.rlike(r"^(19|20)[0-9]{2}$"))
    shaped = compact.rlike("^[0-9A-Z]{19,20}$") | compact.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$")
    good = (F.length(t) >= 5) & t.rlike(r"^[A-Za-z0-9 .\-/]+$") & ~shaped & (digits >= 5) & (digits * 2 >= letters) & ~only_years
    return F.when(good, t)


# Fixed value: no identifier is longer.
LONGEST_LOOKUP = 35


def lookups(text: Column, countries: list[str]) -> Column:
    """array of struct(kind, code): every lookup that an input calls for, in the order of lei, isin, bic, reg.no; none for a text longer
    than any identifier."""
    r = readings(text, countries)
    one = lambda kind, code: F.when(code.isNotNull(), F.struct(F.lit(kind).alias("kind"), code.alias("code")))
    found = F.filter(F.array(one("lei", r["lei"]), one("isin", r["isin"]), one("bic", r["bic"]), one("reg.no", register_number(text))), lambda x: x.isNotNull())
    return F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) <= LONGEST_LOOKUP, found).otherwise(F.filter(found, lambda x: F.lit(False)))


def partial_lei(text: Column) -> Column:
    """How many characters of an LEI a text without spaces could be the start of, or 0: 6 to 19 with three digits or more, not as long
    as another code (8, 11, 12)."""
    code = ascii_upper(F.regexp_replace(text, r"\s+", ""))
    one_word = ~F.regexp_replace(text, r"^\s+|\s+$", "").rlike(r"\s")
    fits = one_word & code.rlike("^[0-9A-Z]{6,19}$") & (F.length(F.regexp_replace(code, "[^0-9]", "")) >= 3) & ~F.length(code).isin(8, 11, 12)
    return F.when(fits, F.length(code)).otherwise(0)


def bad_lei(text: Column) -> Column:
    """Whether a text without spaces has an LEI's shape and not its check digits."""
    code = ascii_upper(F.regexp_replace(text, r"\s+", ""))
    return F.coalesce(~F.regexp_replace(text, r"^\s+|\s+$", "").rlike(r"\s") & code.rlike("^[0-9A-Z]{18}[0-9]{2}$") & ~valid_lei(code), F.lit(False))
