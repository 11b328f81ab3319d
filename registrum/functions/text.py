"""Folding and tokens of names and queries, as Column expressions."""

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions.constants import FOLDS, LEGAL_FORMS, QUERY_STOP

#: White space between chunks.
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{_BLANK}]"
#: Syllables that are written as two or three letters by rule: first one, letters of each place.
_HANGUL, _LEAD, _VOWEL, _TAIL = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A8, 27)


def _unmarked(text: str) -> str:
    text = unicodedata.normalize("NFKD", "".join(FOLDS.get(c, c) for c in text))
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


def fold_text(text: str) -> str:
    """The fold of one text: explicit folds, compatibility decomposition, no non-spacing marks, lower case."""
    return _unmarked(text).lower()


def _char_class(letters: list[str]) -> str:
    """A pattern of these letters, in ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs) + "]"


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one letter (or, at the end of the list, to none) and to which, and those that fold to several; worked out by
    the same rule as fold_text, letter by letter, but for case."""
    one, gone, several = {}, [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if _HANGUL <= code < _HANGUL + 11172 or unicodedata.category(c) in ("Cn", "Cs", "Co"):
            continue
        x = _unmarked(c)
        if not x:
            gone.append(c)
        elif len(x) > 1:
            several[c] = x
        elif x != c:
            one[c] = x
    return "".join([*one, *gone]), "".join(one.values()), several


def _letters(first: int, n: int) -> Column:
    return F.lit("".join(map(chr, range(first, first + n))))


def _spelled(text: Column) -> Column:
    """Hangul syllables as their letters."""

    def letters(c: Column) -> Column:
        n = F.ascii(c) - _HANGUL
        at = lambda place, k: F.substr(_letters(*place), k + 1, F.lit(1))
        tail = n % (_TAIL[1] + 1)
        both = F.concat(at(_LEAD, F.floor(n / (_VOWEL[1] * (_TAIL[1] + 1)))), at(_VOWEL, F.floor(n / (_TAIL[1] + 1)) % _VOWEL[1]))
        return F.when(c.between(chr(_HANGUL), chr(_HANGUL + 11171)), F.concat(both, F.when(tail > 0, at(_TAIL, tail - 1)).otherwise(F.lit("")))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


def fold(text: Column) -> Column:
    """The fold as a translation, without Python: lower case for texts of ASCII alone; else the letters that fold to several are looked
    up and replaced, each once, and the others translated. Equal to fold_text for every text."""
    source, target, several = _fold_tables()
    met = F.array_distinct(F.regexp_extract_all(text, F.lit(_char_class(list(several))), F.lit(0)))
    spelled = F.split(F.lit("\0".join(several.values())), "\0")  # one literal: a tree of a thousand would be walked by every rule
    wide = F.aggregate(met, text, lambda a, c: F.replace(a, c, F.get(spelled, F.position(c, F.lit("".join(several))) - 1)))
    wide = F.when(text.rlike(f"[\\x{{{_HANGUL:X}}}-\\x{{{_HANGUL + 11171:X}}}]"), _spelled(wide)).otherwise(wide)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.lower(F.translate(wide, source, target)))


def chunks(folded: Column) -> Column:
    return F.filter(F.split(folded, SPACE + "+"), lambda x: x != "")


def _runs(chunk: Column) -> Column:
    return F.regexp_extract_all(chunk, F.lit("([a-z0-9]+)"), F.lit(1))


def _short(runs: Column) -> Column:
    """Two runs or more, none longer than two characters: written apart, read together."""
    return (F.size(runs) >= 2) & F.forall(runs, lambda x: F.length(x) <= 2)


def merge_single_letters(tokens: Column) -> Column:
    """Adjacent one-character tokens become one."""
    joined = F.regexp_replace(F.array_join(tokens, " "), r"(?<=(?:^| )[a-z0-9]) (?=[a-z0-9](?: |$))", "")
    return F.filter(F.split(joined, " "), lambda x: x != "")


#: A whole chunk of short runs, or a run.
_TOKEN = rf"(?<![^{_BLANK}])[^a-z0-9{_BLANK}]*+[a-z0-9]{{1,2}}(?:[^a-z0-9{_BLANK}]++[a-z0-9]{{1,2}})++[^a-z0-9{_BLANK}]*+(?![^{_BLANK}])|[a-z0-9]+"


def folded_tokens(folded: Column) -> Column:
    """The words of a folded text: chunks of short runs joined, other runs apart, single letters merged. One pass takes both."""
    listed = F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))
    return merge_single_letters(F.transform(listed, lambda x: F.regexp_replace(x, "[^a-z0-9]+", "")))


def query_tokens(query: Column) -> Column:
    return folded_tokens(fold(query))


name_seq = query_tokens


def name_extras(name: Column) -> Column:
    """Spellings beside the sequence: joined chunks of several runs, and the runs of short ones; two characters at least."""
    none = F.array().cast("array<string>")
    extra = F.transform(F.transform(chunks(fold(name)), _runs), lambda r: F.when(_short(r), r).when(F.size(r) >= 2, F.array(F.array_join(r, ""))).otherwise(none))
    return F.filter(F.array_except(F.array_distinct(F.flatten(extra)), name_seq(name)), lambda x: F.length(x) >= 2)


def index_terms(seq: Column, extras: Column) -> Column:
    return F.filter(F.array_distinct(F.concat(seq, extras)), lambda x: F.length(x) >= 2)


def last_is_prefix(query: Column) -> Column:
    return ~query.rlike(SPACE + r"$")


def is_stop(word: Column) -> Column:
    return word.isin(QUERY_STOP)


def form_start(seq: Column) -> Column:
    """Where the legal form at the end of a name starts; never 0 for a name with words."""
    open_run = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda a, x: F.struct((a["n"] + F.when(a["open"] & x.isin(LEGAL_FORMS), 1).otherwise(0)).alias("n"), (a["open"] & x.isin(LEGAL_FORMS)).alias("open"))
    forms = F.aggregate(F.reverse(F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0)))), open_run, step, lambda a: a["n"])
    return F.size(seq) - forms


def name_initials(seq: Column, start: Column) -> Column:
    """First letters of the words before the legal form, and once with its first word if that is spelled out; 3 to 6 letters."""
    words = F.filter(F.slice(seq, 1, start), lambda x: ~x.isin(QUERY_STOP))
    first = F.array_join(F.transform(words, lambda x: F.left(x, F.lit(1))), "")
    form = F.get(seq, start)
    both = F.array(first, F.when(F.length(form) >= 4, F.concat(first, F.left(form, F.lit(1)))))
    fits = F.filter(both, lambda x: x.isNotNull() & F.length(x).between(3, 6))
    return F.when(F.forall(words, lambda x: x.rlike("^[a-z]")), fits).otherwise(F.array().cast("array<string>"))


def clean_name(name: Column) -> Column:
    """Tabs and line ends become spaces; white space at the ends goes."""
    return F.regexp_replace(F.translate(name, "\t\r\n", "   "), f"^{SPACE}+|{SPACE}+$", "")


def escape_html(text: Column) -> Column:
    for c, x in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(x))
    return text
