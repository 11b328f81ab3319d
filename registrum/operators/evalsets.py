"""Evaluation sets: well-known entities by label and alias (head), by distinctive words (torso), by whole names (tail), with typing
errors, and acronyms with their verification. Samples are taken in the order of a seeded hash, so any partitioning gives the same."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.operators.evaluate import hash_rank

# What identifiers look like, words that tell no entity apart, and forms that may lead a name.
CODES = (
    r"^[A-Z]{2}-[A-Z0-9]{1,3}$",
    r"^[A-Z0-9]{18}[0-9]{2}$",
    r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$",
    r"^Q[0-9]+$",
    r"(?i)^(NYSE|NASDAQ|LSE|TYO|TSE|FWB|SIX|OMX|HKEX|SSE|SZSE|ASX|TSX|BME|BIT|Euronext)\s*:",
    r"^[A-Z][a-z]{1,4}\.$",
)
COMMON_WORDS = """
    the and of de du des la le les der die das und y e et di del della van von for en i a
    limited company corporation incorporated private public sociedad anonima societa spolka ograniczona odpowiedzialnoscia
    responsabilita limitata limitada gesellschaft beschrankter haftung mbh haftungsbeschrankt korlatolt felelossegu tarsasag
    sirketi akcyjna komandytowa jawna responsabilidad societe responsabilite limitee anonyme simplifiee par actions
""".split()
LEADING_FORMS = ("the", "aktiebolaget", "ab", "as", "oy", "sa")
LONGEST_PHRASE = 6


def is_code(text: Column) -> Column:
    """Whether an alias is an identifier rather than a name: without letters, shaped like a code, or at least half digits (four or
    more)."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.length(F.regexp_replace(s, r"[^\p{Nd}]", ""))
    shaped = F.lit(False)
    for shape in CODES:
        shaped = shaped | s.rlike(shape)
    return ~s.rlike("[A-Za-z]") | shaped | ((digits >= 4) & (digits * 2 >= F.length(F.replace(s, F.lit(" "), F.lit("")))))


def answerable(query_tokens: Column, name_terms: Column) -> Column:
    """Whether every word asked begins some word of the names."""
    return F.forall(query_tokens, lambda x: F.exists(name_terms, lambda y: F.startswith(y, x)))


def plain_tokens(text: Column) -> Column:
    """The baseline's words: distinct runs of two letters or digits and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(T.fold(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) >= 2))


def frozen_tokens(name: Column) -> Column:
    """The evaluation's words: runs as they are, single letters in a row together; short runs of one chunk aren't joined."""
    runs = F.flatten(F.transform(T.chunks(T.fold(name)), lambda c: F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))))
    return T.merge_single_letters(runs)


def legal_form_phrases(names: DataFrame, name: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """(phrase): the word sequences of up to six words in a list of legal forms, unless all their words are protected."""
    seq = names.select(T.name_seq(F.col(name)).alias("seq")).where(F.size("seq").between(1, LONGEST_PHRASE))
    return seq.where(~F.forall("seq", lambda x: x.isin(*protected)) if protected else F.lit(True)).select(F.array_join("seq", " ").alias("phrase")).distinct()


def core_range(seq: Column, phrases: list[str]) -> Column:
    """struct(start, end) of a name without its legal forms: the longest phrase at the end goes, again and again, then leading forms
    one by one; one word always stays. phrases is a code list's, whose length the caller knows."""
    ends = lambda end, k: F.array_join(F.slice(seq, F.greatest(end - k + 1, F.lit(1)), k), " ").isin(*phrases)

    def shorter(end: Column, _: Column) -> Column:
        cut = F.when(F.lit(False), end)
        for k in range(LONGEST_PHRASE, 0, -1):
            cut = cut.when((end > k) & ends(end, F.lit(k)), end - k)
        return cut.otherwise(end)

    steps = F.when(F.size(seq) > 0, F.sequence(F.lit(1), F.size(seq))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, F.size(seq), shorter)
    forms = F.aggregate(steps, F.lit(0), lambda a, i: F.when((a == i - 1) & F.coalesce(F.get(seq, i - 1), F.lit("")).isin(*LEADING_FORMS), i).otherwise(a))
    return F.struct(F.least(forms, F.greatest(end - 1, F.lit(0))).alias("start"), end.alias("end"))


def token_frequencies(forms: DataFrame, form: str, names: DataFrame, name: str) -> DataFrame:
    """(token, n): in how many names each word of the legal forms is, words in no name with 0."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(T.fold(F.col(c)), F.lit("([a-z0-9]+)"), F.lit(1)))
    wanted = forms.select(F.explode(words(form)).alias("token")).distinct()
    counts = names.select(F.explode(words(name)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def group_codes(rows: DataFrame, code: str, row: str, first: list[str], lists: list[str]) -> DataFrame:
    """One row a code of a list that has a row for each language: of `first` the first row's value, of `lists` all that aren't empty, in
    order."""
    clean = lambda c: F.regexp_replace(F.translate(c, "\t\n", "  "), r"^\s+|\s+$", "")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(row, clean(F.col(c)).alias("v"))))), lambda x: x["v"])
    return rows.groupBy(code).agg(*(F.min_by(clean(F.col(c)), row).alias(c) for c in first), *(ordered(c).alias(c) for c in lists))


def best_items(items: DataFrame) -> DataFrame:
    """(lei, qid): the item (qid, lei, links) with most links for each entity, then the least number. An entity is no other item's."""
    links = F.coalesce(F.col("links").try_cast("int"), F.lit(0))
    return items.groupBy("lei").agg(F.max_by("qid", F.struct(links, -F.substr("qid", F.lit(2)).try_cast("long"))).alias("qid"))


def halved(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows, told apart by their keys, with split: the first half of them in the order given is train, the rest test."""
    first = rows.orderBy(*order).limit(rows.count() // 2).select(*keys, F.lit("train").alias("split"))
    return rows.join(first, keys, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def head(items: DataFrame, n: int, seed: str, most_aliases: int) -> DataFrame:
    """(qid, query, kind, leis, split): labels of the n items (qid, lei, label, aliases, links) with most links whose label is a name, and
    up to most_aliases of their other names; n and most_aliases are the set's size."""
    own = items.join(best_items(items), ["lei", "qid"])
    by = own.groupBy("qid").agg(F.max(F.coalesce(F.col("links").try_cast("int"), F.lit(0))).alias("links"), F.max("label").alias("label"), F.first("aliases").alias("aliases"), F.sort_array(F.collect_set("lei")).alias("leis"))
    good = by.where((F.coalesce(F.col("label"), F.lit("")) != "") & ~is_code(F.col("label")))
    top = good.orderBy(F.col("links").desc(), F.substr("qid", F.lit(2)).try_cast("long")).limit(n)
    top = halved(top, ["qid"], [hash_rank(F.get("leis", F.lit(0)), seed), F.col("qid")])
    labels = top.select("qid", F.col("label").alias("query"), F.lit("label").alias("kind"), "leis", "split")
    spoken = lambda c: F.array_join(T.query_tokens(c), " ")
    others = top.select("qid", "leis", "split", "label", F.explode("aliases").alias("query")).withColumn("key_", spoken(F.col("query")))
    others = others.where((F.col("key_") != spoken(F.col("label"))) & ~is_code(F.col("query")) & (F.length(F.replace("key_", F.lit(" "), F.lit(""))) > 2) & (F.length("query") <= 60)).dropDuplicates(["qid", "key_"])
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(hash_rank(F.col("query"), seed), "query"))
    return labels.unionByName(others.withColumn("nth_", nth).where(F.col("nth_") <= most_aliases).select("qid", "query", F.lit("alias").alias("kind"), "leis", "split"))


def torso(entities: DataFrame, known: DataFrame, n: int, seed: str, common: list[str]) -> DataFrame:
    """(lei, query, kind): n active entities (lei, name, entity_status, n_direct, n_ultimate, n_branch, isin, bic) with children, securities
    or a bank code that no item (known: lei) is of, asked for by their first one or two distinctive words."""
    pool = entities.where((F.col("entity_status") == "ACTIVE") & ((F.col("n_direct") + F.col("n_ultimate") + F.col("n_branch") > 0) | (F.col("isin") > 0) | F.col("bic"))).join(known.select("lei"), "lei", "left_anti")
    words = F.filter(T.name_seq(F.col("name")), lambda x: (F.length(x) >= 2) & ~x.isin(*common) & ~x.rlike("^[0-9]+$"))
    told = pool.select("lei", words.alias("words")).where(F.size("words") > 0)
    two = (F.size("words") >= 2) & (F.conv(F.right(hash_rank(F.col("lei"), f"{seed}-words"), F.lit(1)), 16, 10).cast("int") % 2 == 1)
    out = told.select("lei", F.when(two, 2).otherwise(1).alias("k"), "words").orderBy(hash_rank(F.col("lei"), seed), "lei").limit(n)
    return out.select("lei", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("query"), F.concat(F.lit("words"), F.col("k").cast("string")).alias("kind"))


def tail(entities: DataFrame, known: DataFrame, n: int, seed: str) -> DataFrame:
    """(lei, query): n issued entities (lei, name, registration) with a name that no other has when folded, and that no item is of.
    Names are counted by their digest."""
    spoken = F.array_join(T.name_seq(F.col("name")), " ")
    keyed = entities.withColumn("key_", F.when(spoken != "", F.sha2(spoken, 256))).where(F.col("key_").isNotNull())
    once = keyed.groupBy("key_").agg(F.count(F.lit(1)).alias("n_"), F.first("lei").alias("lei"), F.first("name").alias("name"), F.first("registration").alias("registration")).where("n_ = 1")
    pool = once.where(F.col("registration") == "ISSUED").join(known.select("lei"), "lei", "left_anti")
    return pool.orderBy(hash_rank(F.col("lei"), seed), "lei").limit(n).select("lei", F.col("name").alias("query"))


def typo(text: Column, key: Column, seed: str, early: bool) -> Column:
    """struct(text, op, at) of a folded text with one letter left out, replaced or swapped with the next, within its first three letters
    and digits or after them; null below five. Position, kind and letter follow from a hash of key and seed."""
    s = T.fold(text)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)).rlike(r"^[\p{L}\p{N}]$"))
    places = F.slice(at, 1, 3) if early else F.slice(at, 4, F.greatest(F.size(at) - 3, F.lit(0)))
    pick = lambda what: F.sha1(F.concat_ws(":", F.lit(seed), key.cast("string"), what).cast("binary"))
    letter = lambda i, k: F.substr(s, i + k, F.lit(1))
    swaps = lambda i: (letter(i, 1).rlike(r"^[\p{L}\p{N}]$")) & (letter(i, 1) != letter(i, 0))
    choice = lambda i, op: F.struct(pick(F.concat(i.cast("string"), F.lit(op))).alias("h"), i.alias("at"), F.lit(op).alias("op"))
    choices = F.flatten(F.transform(places, lambda i: F.filter(F.array(choice(i, "delete"), choice(i, "substitute"), F.when(swaps(i), choice(i, "transpose"))), lambda x: x.isNotNull())))
    best = F.array_min(choices)
    i = best["at"]
    shift = (F.conv(F.right(best["h"], F.lit(4)), 16, 10).cast("int") % 25) + 1
    other = F.when(letter(i, 0).rlike("^[a-z]$"), F.chr(F.pmod(F.ascii(letter(i, 0)) - 97 + shift, F.lit(26)) + 97)).otherwise(F.chr(shift + 96))
    before, after = F.left(s, i - 1), lambda k: F.substr(s, i + k, F.lit(1_000_000))
    out = F.when(best["op"] == "delete", F.concat(before, after(1))).when(best["op"] == "substitute", F.concat(before, other, after(1))).otherwise(F.concat(before, letter(i, 1), letter(i, 0), after(2)))
    return F.when((F.size(at) >= 5) & best.isNotNull(), F.struct(out.alias("text"), best["op"].alias("op"), (i - 1).alias("at")))


def acronyms(queries: DataFrame, taken: DataFrame, entities: DataFrame, seed: str) -> DataFrame:
    """(query, lei, name, split) of queries (query, lei, alternatives) none of whose entities is in another set (taken: lei). Fails when
    one is not among the entities (lei, name, entity_status) or not active."""
    ids = queries.select("query", F.explode(F.array_append(F.coalesce("alternatives", F.array().cast("array<string>")), F.col("lei"))).alias("lei"))
    kept = queries.join(ids.join(taken.select("lei"), "lei", "left_semi").select("query"), "query", "left_anti")
    met = kept.select("query", "lei").join(entities.select("lei", "name", "entity_status"), "lei", "left")
    sound = F.when(F.col("entity_status") == "ACTIVE", F.col("name")).otherwise(F.raise_error(F.concat_ws(" ", "query", "lei", F.coalesce("entity_status", F.lit("is not in the copy")))))
    told = met.select("query", "lei", sound.alias("name"))
    return halved(told, ["query", "lei"], [hash_rank(F.col("lei"), seed), F.col("lei"), F.col("query")])
