"""Labels, addresses, escapes, links and paths of record pages, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes, line breaks, characters of links, states and times to live.
TRIMMED = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_BREAKS = r"[\x0A-\x0D\x{85}\x{2028}\x{2029}]+"
MARKUP = r"[\\*_\[\]()#<>`|@]|:(?=//)|(?<=\bwww)\."
LINK_CHARACTERS = r"A-Za-z0-9\-._~:/?#@$&+,;=%"
CURRENT = ("ISSUED", "PENDING_TRANSFER", "PENDING_ARCHIVAL")
LEAST_TTL, MOST_TTL, HOUR_TTL = 300, 86_400, 3_600
MOST_QUERY = 200


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{TRIMMED}+|{TRIMMED}+$", "")


def plain_words(code: Column) -> Column:
    """A code in plain lower case: NO_KNOWN_PERSON is "no known person"."""
    return F.translate(F.lower(code), "_-", "  ")


def state(entity_status: Column, registration: Column) -> Column:
    """struct(label, tone) of a record: one word for its state, and active, lapsed or retired."""
    e, r = F.coalesce(entity_status, F.lit("NULL")), F.coalesce(registration, F.lit("NULL"))
    label = F.when(e == "INACTIVE", "inactive").when(r == "LAPSED", "lapsed").when(r.isin(*CURRENT), "active").when(r == "NULL", "unknown").otherwise(plain_words(r))
    tone = F.when(e == "INACTIVE", "retired").when(r.isin("LAPSED", "NULL"), "lapsed").when(r.isin(*CURRENT), "active").otherwise("retired")
    return F.struct(label.alias("label"), tone.alias("tone"))


def address_text(a: Column) -> Column:
    """An address struct (mailRouting, lines, number, numberWithinBuilding, postalCode, city, region, country) on one line; null if
    nothing is in it."""
    given = lambda c: F.nullif(c, F.lit(""))
    place = F.concat_ws(" ", given(a["postalCode"]), given(a["city"]))
    lines = F.coalesce(a["lines"], F.array().cast("array<string>"))
    parts = F.concat(F.array(a["mailRouting"]), lines, F.array(a["number"], a["numberWithinBuilding"], place, F.coalesce(a["region"], a["country"])))
    return given(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ", "))


def query_from_hash(fragment: Column) -> Column:
    """The text that a link "#q=..." searches for, at most 200 code points; null if it is no such link, empty or wrongly escaped."""
    raw = F.substr(fragment, F.lit(4))
    text = F.try_url_decode(raw)
    # the decoder puts U+FFFD for bytes that aren't UTF-8
    broken = text.contains("�") & ~F.upper(raw).contains("%EF%BF%BD") & ~raw.contains("�")
    capped = F.regexp_replace(F.left(trimmed(text), F.lit(MOST_QUERY)), f"{TRIMMED}+$", "")
    return F.when(F.startswith(fragment, F.lit("#q=")) & ~broken, F.nullif(capped, F.lit("")))


def escape_markdown(text: Column) -> Column:
    """Text that Markdown shows as it is, on one line, never as a list."""
    flat = F.regexp_replace(F.regexp_replace(text, LINE_BREAKS, " "), f"(?i)({MARKUP})", r"\\$1")
    return F.regexp_replace(F.regexp_replace(flat, r"^(\s*)([-+])(?=\s|$)", r"$1\\$2"), r"^(\s*\d+)\.(?=\s|$)", r"$1\\.")


def markdown_url(url: Column) -> Column:
    """A link's target with everything but characters of URLs as percent-encoded UTF-8."""
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    pieces = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(f"^[{LINK_CHARACTERS}]?$"), c).otherwise(escaped(c)))
    return F.when(url.rlike(f"^[{LINK_CHARACTERS}]*$"), url).otherwise(F.array_join(pieces, ""))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


def mark_html(name: Column, ranges: Column) -> Column:
    """A name as HTML with its ranges (code points, end exclusive, ascending) marked."""
    from registrum.functions.text import escape_html

    piece = lambda a, b: escape_html(F.substr(name, a + 1, b - a))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, r: F.struct(F.concat(acc["out"], piece(acc["at"], r["start"]), F.lit("<mark>"), piece(r["start"], r["end"]), F.lit("</mark>")).alias("out"), r["end"].alias("at"))
    return F.aggregate(ranges, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.char_length(name))))


def pick_format(accept: Column) -> Column:
    """html, json or markdown by an Accept header: the weight of a type is that of the most specific range that covers it; markdown
    wins a tie with json, html every tie. A header that is missing or can't be read asks for html."""

    def media_range(entry: Column) -> Column:
        parts = F.transform(F.split(entry, ";"), lambda p: F.lower(trimmed(p)))
        media = F.split(F.get(parts, 0), "/", -1)
        given = F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit("q="))), F.lit(-1))
        number = F.substr(given, F.lit(3))
        q = F.when(given.isNull(), 1.0).when(number.rlike(r"^(0(\.[0-9]{0,3})?|1(\.0{0,3})?)$"), number.try_cast("double")).otherwise(-1.0)
        whole = (F.size(media) == 2) & (F.get(media, 0) != "") & (F.get(media, 1) != "")
        return F.struct(F.when(whole, F.get(media, 0)).alias("type"), F.get(media, 1).alias("subtype"), q.alias("q"))

    ranges = F.filter(F.transform(F.split(F.coalesce(accept, F.lit("")), ","), media_range), lambda r: r["type"].isNotNull() & (r["q"] >= 0))

    def weight(kind: str, subtype: str) -> Column:
        fit = lambda r: F.when((r["type"] == kind) & (r["subtype"] == subtype), 2).when((r["type"] == kind) & (r["subtype"] == "*"), 1).when((r["type"] == "*") & (r["subtype"] == "*"), 0)
        best = F.array_max(F.filter(F.transform(ranges, lambda r: F.struct(fit(r).alias("fit"), r["q"].alias("q"))), lambda x: x["fit"].isNotNull()))
        return F.coalesce(best["q"], F.lit(0.0))

    page, json, markdown = weight("text", "html"), weight("application", "json"), weight("text", "markdown")
    return F.when((markdown > page) & (markdown >= json), "markdown").when(json > page, "json").otherwise("html")


def record_ttl(published: Column, now: Column) -> Column:
    """Seconds to keep a record of a copy published then: a day and an hour after it, at least 5 minutes and at most a day; an hour
    if the moment is not known."""
    at = F.try_to_timestamp(published)
    left = F.ceil((F.unix_millis(at) + 90_000_000 - F.unix_millis(now)) / 1000)
    # greatest() would pass over a null
    return F.when(left.isNull(), HOUR_TTL).otherwise(F.least(F.greatest(left, F.lit(LEAST_TTL)), F.lit(MOST_TTL))).cast("long")


def cache_ttl(outcome: Column, published: Column, now: Column) -> Column:
    """Seconds to keep an answer: a record's for what was found, an hour for what was not, none for failures."""
    return F.when(outcome == "found", record_ttl(published, now)).when(outcome == "not-found", F.lit(HOUR_TTL)).otherwise(F.lit(0)).cast("long")


def redirect_location(url: Column, target: str) -> Column:
    """The same path and query at another origin; a path that starts with // stays a path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(F.lit(target.rstrip("/")), F.when(path == "", "/").otherwise(path), query)


def split_extension(path: Column) -> Column:
    """struct(path, extension): .json or .md taken off the last segment."""
    shape = r"^(.*[^/])(\.json|\.md)(/?)$"
    part = lambda k: F.regexp_extract(path, shape, k)
    fits = path.rlike(shape)
    return F.struct(F.when(fits, F.concat(part(1), part(3))).otherwise(path).alias("path"), F.when(fits, part(2)).otherwise("").alias("extension"))


def lei_of_path(path: Column) -> Column:
    """struct(lei, canonical) of a path /lei/<code>; null if it holds no code of that shape."""
    from registrum.functions.identifiers import ascii_upper

    tail = F.regexp_extract(path, r"^/lei/(.*)$", 1)
    segment = F.regexp_replace(tail, "/$", "")
    # a plus sign is itself in a path
    code = ascii_upper(F.regexp_replace(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), rf"({TRIMMED})+", ""))
    return F.when(code.rlike("^[0-9A-Z]{20}$"), F.struct(code.alias("lei"), ((segment == code) & ~F.endswith(tail, F.lit("/"))).alias("canonical")))


def listed_link(html: Column, pattern: str) -> Column:
    """The first https link to a CSV file in a page whose address matches."""
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(r'href="(https://[^"]*\.csv)"'), F.lit(1)), lambda x: x.rlike(pattern)), 0)
