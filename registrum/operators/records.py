"""Records of entities: reading their JSON documents, naming what they refer to, looking them up, and drawing them as rows, Markdown
and linked data."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import render as R

_NAMED = "struct<name:string,language:string,type:string>"
_ADDRESS = "struct<language:string,addressLines:array<string>,addressNumber:string,addressNumberWithinBuilding:string,mailRouting:string,city:string,region:string,country:string,postalCode:string>"
_ENTITY = (
    f"struct<legalName:{_NAMED},otherNames:array<{_NAMED}>,transliteratedOtherNames:array<{_NAMED}>,status:string,legalAddress:{_ADDRESS},headquartersAddress:{_ADDRESS},"
    "registeredAt:struct<id:string,other:string>,registeredAs:string,legalForm:struct<id:string,other:string>,jurisdiction:string,category:string,subCategory:string,creationDate:string,"
    "expiration:struct<date:string,reason:string>,successorEntities:array<struct<lei:string,name:string>>,successorEntity:struct<lei:string,name:string>>"
)
_REGISTRATION = "struct<status:string,initialRegistrationDate:string,lastUpdateDate:string,nextRenewalDate:string,corroborationLevel:string,managingLou:string>"
_LINK = "struct<data:struct<type:string,id:string>>"
RESOURCES = (
    f"array<struct<id:string,attributes:struct<lei:string,bic:array<string>,isin:string,entity:{_ENTITY},registration:{_REGISTRATION}>,"
    f"relationships:struct<`direct-parent`:{_LINK},`ultimate-parent`:{_LINK}>,links:struct<self:string>>>"
)
INCLUDED = "array<struct<type:string,id:string,attributes:struct<reason:string,reference:string>>>"
PAGING = "total bigint, currentPage bigint, perPage bigint, lastPage bigint"

# Kinds of names.
NAME_KINDS = {"TRADING_OR_OPERATING_NAME": "trading", "ALTERNATIVE_LANGUAGE_LEGAL_NAME": "alternative-language", "PREVIOUS_LEGAL_NAME": "previous"}
#: The code of a legal form that no list has.
NO_FORM = "8888"
LEI_SHAPE = "^[0-9A-Z]{20}$"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _listed(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def resources(document: Column) -> Column:
    """The document's data, one resource or a list, as a list."""
    return _listed(F.from_json(F.get_json_object(document, "$.data"), RESOURCES), RESOURCES[6:-1])


def golden_copy_date(document: Column) -> Column:
    return _given(F.get_json_object(document, "$.meta.goldenCopy.publishDate"))


def _other_names(entity: Column) -> Column:
    kind = lambda t: F.when(t.isNull(), "other").otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in NAME_KINDS.items() for x in p)), t), F.lit("other")))
    named = lambda x, k: F.struct(_given(x["name"]).alias("name"), _given(x["language"]).alias("language"), k.alias("kind"), F.coalesce(x["type"], F.lit("")).alias("type"))
    plain = F.transform(_listed(entity["otherNames"], _NAMED), lambda x: named(x, kind(x["type"])))
    written = F.transform(_listed(entity["transliteratedOtherNames"], _NAMED), lambda x: named(x, F.lit("transliterated")))
    return F.filter(F.concat(plain, written), lambda x: x["name"].isNotNull())


def _address(a: Column) -> Column:
    lines = F.filter(_listed(a["addressLines"], "string"), lambda x: x.isNotNull())
    fields = {"number": "addressNumber", "numberWithinBuilding": "addressNumberWithinBuilding", "mailRouting": "mailRouting", "city": "city", "region": "region", "country": "country", "postalCode": "postalCode"}
    return F.when(a.isNotNull(), F.struct(_given(a["language"]).alias("language"), lines.alias("lines"), *(_given(a[old]).alias(new) for new, old in fields.items())))


def _successors(entity: Column) -> Column:
    shape = lambda x: F.struct(_given(x["lei"]).alias("lei"), _given(x["name"]).alias("name"))
    many = F.filter(F.transform(_listed(entity["successorEntities"], "struct<lei:string,name:string>"), shape), lambda x: x.isNotNull())
    one = shape(entity["successorEntity"])
    return F.when(F.size(many) > 0, many).otherwise(F.filter(F.array(one), lambda x: x["lei"].isNotNull() | x["name"].isNotNull()))


def _parent(link: Column, included: Column) -> Column:
    """struct(kind, lei, reason, reference, name): reported, exception or none."""
    kind, code = _given(link["data"]["type"]), _given(link["data"]["id"])
    reported, excepted = (kind == "lei-records") & code.isNotNull(), (kind == "reporting-exceptions") & code.isNotNull()
    found = F.get(F.filter(included, lambda x: (x["type"] == kind) & (x["id"] == code)), 0)["attributes"]
    return F.struct(
        F.when(reported, "reported").when(excepted, "exception").otherwise("none").alias("kind"), F.when(reported, code).alias("lei"),
        F.when(excepted, _given(found["reason"])).alias("reason"), F.when(excepted, _given(found["reference"])).alias("reference"), F.lit(None).cast("string").alias("name"),
    )


def parse_record(documents: DataFrame, document: str, base_url: str) -> DataFrame:
    """documents with record: a struct of all fields, missing ones null and never empty; null for a document without a code or a legal
    name. The JSON is parsed once a document."""
    read = documents.withColumn("res_", F.get(resources(F.col(document)), 0)).withColumn("inc_", _listed(F.from_json(F.get_json_object(document, "$.included"), INCLUDED), INCLUDED[6:-1]))
    res, inc = F.col("res_"), F.col("inc_")
    a, e, g = res["attributes"], res["attributes"]["entity"], res["attributes"]["registration"]
    lei = F.coalesce(_given(a["lei"]), _given(res["id"]))
    plain = lambda src, *names: [_given(src[n]).alias(n) for n in names]
    record = F.struct(
        lei.alias("lei"),
        F.struct(_given(e["legalName"]["name"]).alias("name"), _given(e["legalName"]["language"]).alias("language")).alias("legalName"),
        _other_names(e).alias("otherNames"),
        F.coalesce(_given(e["status"]), F.lit("NULL")).alias("entityStatus"),
        F.coalesce(_given(g["status"]), F.lit("NULL")).alias("registrationStatus"),
        _address(e["legalAddress"]).alias("legalAddress"),
        _address(e["headquartersAddress"]).alias("headquartersAddress"),
        F.struct(_given(e["registeredAt"]["id"]).alias("id"), _given(e["registeredAt"]["other"]).alias("other"), F.lit(None).cast("string").alias("name")).alias("registrationAuthority"),
        _given(e["registeredAs"]).alias("registerNumber"),
        F.struct(_given(e["legalForm"]["id"]).alias("code"), _given(e["legalForm"]["other"]).alias("other"), F.lit(None).cast("string").alias("name")).alias("legalForm"),
        *plain(e, "jurisdiction", "category", "subCategory", "creationDate"),
        *plain(g, "initialRegistrationDate", "lastUpdateDate", "nextRenewalDate", "corroborationLevel", "managingLou"),
        F.struct(_given(e["expiration"]["date"]).alias("date"), _given(e["expiration"]["reason"]).alias("reason")).alias("expiration"),
        _successors(e).alias("successors"),
        F.filter(_listed(a["bic"], "string"), lambda x: x.isNotNull()).alias("bics"),
        _parent(res["relationships"]["direct-parent"], inc).alias("directParent"),
        _parent(res["relationships"]["ultimate-parent"], inc).alias("ultimateParent"),
        F.struct(F.coalesce(_given(res["links"]["self"]), F.concat(F.lit(f"{base_url}/lei-records/"), lei)).alias("apiUrl"), golden_copy_date(F.col(document)).alias("goldenCopyDate")).alias("source"),
    )
    return read.withColumn("record", F.when(lei.isNotNull() & _given(e["legalName"]["name"]).isNotNull(), record)).drop("res_", "inc_")


def parse_summaries(documents: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """(keys, lei, legal_name, country, jurisdiction, authority, register_number, entity_status, registration_status), a row for each
    resource with a code and a legal name."""
    r = documents.select(*keys, F.explode(resources(F.col(document))).alias("r"))
    a, e = F.col("r.attributes"), F.col("r.attributes.entity")
    out = r.select(
        *keys, F.coalesce(_given(a["lei"]), _given(F.col("r.id"))).alias("lei"), _given(e["legalName"]["name"]).alias("legal_name"), _given(e["legalAddress"]["country"]).alias("country"),
        _given(e["jurisdiction"]).alias("jurisdiction"), _given(e["registeredAt"]["id"]).alias("authority"), _given(e["registeredAs"]).alias("register_number"),
        F.coalesce(_given(e["status"]), F.lit("NULL")).alias("entity_status"), F.coalesce(_given(a["registration"]["status"]), F.lit("NULL")).alias("registration_status"),
    )
    return out.where(F.col("lei").isNotNull() & F.col("legal_name").isNotNull())


def parse_isins(documents: DataFrame, document: str, keys: list[str]) -> DataFrame:
    found = documents.select(*keys, F.explode(resources(F.col(document))).alias("r")).select(*keys, _given(F.col("r.attributes.isin")).alias("isin"))
    return found.where(F.col("isin").isNotNull())


def paging(document: Column, items: Column, page: Column, size: Column) -> Column:
    """struct(total, page, page_size, page_count) of a listing; what it doesn't say is taken from the request."""
    p = F.from_json(F.get_json_object(document, "$.meta.pagination"), PAGING)
    return F.struct(F.coalesce(p["total"], items).alias("total"), F.coalesce(p["currentPage"], page).alias("page"), F.coalesce(p["perPage"], size).alias("page_size"), F.coalesce(p["lastPage"], F.lit(1)).alias("page_count"))


def leis_to_name(record: Column, most: int = 50) -> Column:
    """The codes whose names a page would show if it had them: reported parents, then successors without names; once each, not the
    record's own, at most `most` of them, as the page's feature is."""
    parents = F.array(record["directParent"]["lei"], record["ultimateParent"]["lei"])
    unnamed = F.transform(F.filter(record["successors"], lambda s: s["name"].isNull()), lambda s: s["lei"])
    wanted = F.array_distinct(F.concat(parents, unnamed))
    return F.slice(F.filter(wanted, lambda x: x.isNotNull() & (x != record["lei"]) & x.rlike(LEI_SHAPE)), 1, most)


def build_documents(records: DataFrame, names: DataFrame, forms: DataFrame, registers: DataFrame, origin: str) -> DataFrame:
    """records with record's names filled in and url: parents and successors from names (lei, name), legal forms and registers from
    code lists (code, name). A name that the record gives itself wins. Only rows that refer to others shuffle by what they refer to;
    a page names at most 50."""
    keyed = records.withColumn("lei_", F.col("record.lei"))
    wanted = keyed.select("lei_", F.explode(leis_to_name(F.col("record"))).alias("lei")).distinct()
    known = wanted.join(names.select("lei", "name"), "lei").groupBy("lei_").agg(F.map_from_entries(F.collect_set(F.struct("lei", "name"))).alias("names_"))
    form = forms.where(_given(F.col("name")).isNotNull()).groupBy("code").agg(F.min("name").alias("form_")).withColumnRenamed("code", "form_code_")
    register = registers.where(_given(F.col("name")).isNotNull()).groupBy("code").agg(F.min("name").alias("register_")).withColumnRenamed("code", "register_code_")
    met = keyed.join(known, "lei_", "left").join(form, F.col("record.legalForm.code") == F.col("form_code_"), "left").join(register, F.col("record.registrationAuthority.id") == F.col("register_code_"), "left")
    r = F.col("record")
    named = lambda code: F.try_element_at(F.col("names_"), code)
    filled = (
        r.withField("legalForm.name", F.when(r["legalForm"]["other"].isNull(), F.col("form_")))
        .withField("registrationAuthority.name", F.col("register_"))
        .withField("directParent.name", named(r["directParent"]["lei"]))
        .withField("ultimateParent.name", named(r["ultimateParent"]["lei"]))
        .withField("successors", F.transform(r["successors"], lambda s: F.struct(s["lei"].alias("lei"), F.coalesce(s["name"], named(s["lei"])).alias("name"))))
    )
    out = met.withColumn("record", F.when(r.isNotNull(), filled)).withColumn("url", document_url(origin, F.col("lei_")))
    return out.select(*records.columns, "url")


def document_url(origin: str, lei: Column) -> Column:
    return F.concat(F.lit(f"{origin}/lei/"), lei)


def _part(kind: str, text: Column, lei: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if lei is None else lei).alias("lei"))


def _parts(*parts: Column) -> Column:
    """A list of parts without those that are null."""
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def _row(label: str, field: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.struct(F.lit(label).alias("label"), F.lit(field).alias("field"), items.alias("items")))


def _single(label: str, field: str, parts: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.when(F.size(parts) > 0, F.struct(F.lit(label).alias("label"), F.lit(field).alias("field"), F.array(F.struct(parts.alias("parts"), none.alias("lang"))).alias("items")))


def _line(label: str, field: str, text: Column) -> Column:
    return _single(label, field, _parts(F.when(_given(text).isNotNull(), _part("text", text))))


def _named_link(lei: Column, name: Column) -> list[Column]:
    """The name as the link with the code beside it, or the code alone."""
    both = lei.isNotNull() & name.isNotNull()
    return [
        F.when(lei.isNull(), _part("text", F.coalesce(name, F.lit("")))).otherwise(_part("link", F.coalesce(name, lei), lei)),
        F.when(both, _part("text", F.lit(" "))),
        F.when(both, _part("dim", lei)),
    ]


def day(iso: Column) -> Column:
    return F.left(iso, F.lit(10))


def record_rows(r: Column) -> Column:
    """A record's rows in the order of its page: array of struct(label, field, items), an item being struct(parts, lang) and a part
    struct(kind, text, lei). Kinds are text, punct, dim, tone and link."""
    dot = F.lit(" · ")
    ended = r["expiration"]["date"].isNotNull() | r["expiration"]["reason"].isNotNull()
    reason = r["expiration"]["reason"]
    status = _parts(
        _part("tone", R.state(r["entityStatus"], r["registrationStatus"])["label"]),
        F.when(ended, _part("text", F.concat(dot, F.lit("ended"), F.coalesce(F.concat(F.lit(" "), day(r["expiration"]["date"])), F.lit(""))))),
        F.when(reason.isNotNull(), _part("punct", F.lit(" ("))),
        F.when(reason.isNotNull(), _part("text", R.plain_words(reason))),
        F.when(reason.isNotNull(), _part("punct", F.lit(")"))),
    )
    aside = lambda x: F.concat(R.plain_words(x["kind"]), F.coalesce(F.concat(dot, x["language"]), F.lit("")))
    others = F.transform(r["otherNames"], lambda x: F.struct(_parts(_part("text", x["name"]), _part("text", F.lit(" ")), _part("dim", aside(x))).alias("parts"), x["language"].alias("lang")))
    legal, seat = R.address_text(r["legalAddress"]), R.address_text(r["headquartersAddress"])
    authority, number = r["registrationAuthority"], r["registerNumber"]
    keeper = F.when(authority["id"].isNull(), authority["other"]).otherwise(F.concat(F.coalesce(F.concat(_given(authority["name"]), dot), F.lit("")), authority["id"]))
    register = _parts(F.when(number.isNotNull(), _part("text", number)), F.when(number.isNotNull() & keeper.isNotNull(), _part("text", F.lit(" "))), F.when(keeper.isNotNull(), _part("dim", keeper)))
    form = r["legalForm"]
    form_name = F.coalesce(form["other"], form["name"], form["code"])
    coded = form["code"].isNotNull() & (form["code"] != NO_FORM) & (form_name != form["code"])
    forms = _parts(F.when(form_name.isNotNull(), _part("text", form_name)), F.when(coded, _part("text", F.lit(" "))), F.when(coded, _part("dim", form["code"])))

    def parent(p: Column) -> Column:
        told = F.when(p["kind"] == "exception", F.concat(F.lit("none: "), F.coalesce(R.plain_words(p["reason"]), F.lit("no reason given")))).otherwise("none reported")
        link = _named_link(p["lei"], p["name"])
        reported = p["kind"] == "reported"
        return _parts(F.when(reported, link[0]).otherwise(_part("dim", told)), F.when(reported, link[1]), F.when(reported, link[2]))

    heirs = F.transform(r["successors"], lambda s: F.struct(_parts(*_named_link(s["lei"], s["name"])).alias("parts"), F.lit(None).cast("string").alias("lang")))
    renews = F.coalesce(F.concat(F.lit(" · renews "), day(r["nextRenewalDate"])), F.lit(""))
    category = F.concat(R.plain_words(r["category"]), F.coalesce(F.concat(dot, R.plain_words(r["subCategory"])), F.lit("")))
    rows = F.array(
        _single("status", "status", status),
        _line("registration", "registration", F.concat(R.plain_words(r["registrationStatus"]), renews)),
        _row("also known as", "other-names", others),
        _line("address", "legal-address", legal),
        _line("headquarters", "hq-address", F.when(~seat.eqNullSafe(legal), seat)),
        _single("register", "register", register),
        _single("legal form", "legal-form", forms),
        _line("jurisdiction", "jurisdiction", r["jurisdiction"]),
        _line("category", "category", category),
        _line("bic", "bic", F.array_join(r["bics"], " ")),
        _single("parent", "parent", parent(r["directParent"])),
        F.when(r["ultimateParent"]["kind"] != "none", _single("ultimate", "ultimate-parent", parent(r["ultimateParent"]))),
        _row("successor", "successors", heirs),
        _line("since", "created", day(r["creationDate"])),
        _line("registered", "registered", day(r["initialRegistrationDate"])),
        _line("updated", "updated", day(r["lastUpdateDate"])),
        _line("corroboration", "corroboration", R.plain_words(r["corroborationLevel"])),
        _single("managed by", "managing-lou", _parts(F.when(r["managingLou"].isNotNull(), _part("link", r["managingLou"], r["managingLou"])))),
    )
    return F.when(r.isNotNull(), F.filter(rows, lambda x: x.isNotNull()))


def render_markdown(r: Column, rows: Column, origin: str) -> Column:
    """A record as a Markdown page with absolute links. rows is the column that record_rows() made."""

    def part(p: Column, k: Column) -> Column:
        shown = R.escape_markdown(p["text"])
        link = F.concat(F.lit("["), shown, F.lit("]("), R.markdown_url(document_url(origin, p["lei"])), F.lit(")"))
        beside = F.when(k == 0, shown).otherwise(F.concat(F.lit("("), shown, F.lit(")")))
        return F.when(p["kind"] == "punct", p["text"]).when(p["kind"] == "link", link).when(p["kind"] == "dim", beside).otherwise(shown)

    items = lambda row: F.transform(row["items"], lambda i: F.array_join(F.transform(i["parts"], part), ""))
    head = lambda row: F.concat(F.lit("- **"), row["label"], F.lit(":**"))
    line = lambda row: F.when(F.size(row["items"]) == 1, F.concat(head(row), F.lit(" "), F.array_join(items(row), ""))).otherwise(F.concat(head(row), F.lit("\n  - "), F.array_join(items(row), "\n  - ")))
    api = R.safe_url(r["source"]["apiUrl"])
    source = F.coalesce(F.concat(F.lit("[GLEIF API]("), R.markdown_url(api), F.lit(")")), F.lit("GLEIF API"))
    golden = F.coalesce(R.escape_markdown(day(r["source"]["goldenCopyDate"])), F.lit("unknown"))
    foot = F.concat(F.lit("Source: "), source, F.lit(" · golden copy "), golden, F.lit(" · permalink: <"), R.markdown_url(document_url(origin, r["lei"])), F.lit(">"))
    title = F.concat(F.lit("# "), R.escape_markdown(r["legalName"]["name"]))
    page = F.concat_ws("\n", title, F.lit(""), F.concat(F.lit("LEI: "), R.escape_markdown(r["lei"])), F.lit(""), F.array_join(F.transform(rows, line), "\n"), F.lit(""), foot, F.lit(""))
    return F.when(r.isNotNull(), page)


def json_ld(r: Column, origin: str) -> Column:
    """A record as a schema.org Organization; keys without a value are left out."""
    a, p, number = r["legalAddress"], r["directParent"], r["registerNumber"]
    unless_empty = lambda x: F.when(F.size(x) > 0, x)
    current = F.transform(F.filter(r["otherNames"], lambda n: ~n["kind"].isin("transliterated", "previous")), lambda n: n["name"])
    address = F.struct(F.lit("PostalAddress").alias("@type"), _given(F.array_join(a["lines"], ", ")).alias("streetAddress"), a["city"].alias("addressLocality"), a["region"].alias("addressRegion"), a["postalCode"].alias("postalCode"), a["country"].alias("addressCountry"))
    above = F.struct(F.lit("Organization").alias("@type"), document_url(origin, p["lei"]).alias("@id"), p["lei"].alias("leiCode"), p["name"].alias("name"))
    value = lambda key, v: F.struct(F.lit("PropertyValue").alias("@type"), key.alias("propertyID"), v.alias("value"))
    authority = r["registrationAuthority"]["id"]
    own = F.filter(F.array(F.when(number.isNotNull() & authority.isNotNull(), value(authority, number))), lambda x: x.isNotNull())
    data = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), document_url(origin, r["lei"]).alias("@id"),
        r["legalName"]["name"].alias("name"), r["legalName"]["name"].alias("legalName"), r["lei"].alias("leiCode"),
        unless_empty(current).alias("alternateName"), day(r["creationDate"]).alias("foundingDate"), day(r["expiration"]["date"]).alias("dissolutionDate"),
        F.when(a.isNotNull(), address).alias("address"), F.when(p["kind"] == "reported", above).alias("parentOrganization"),
        unless_empty(F.concat(F.transform(r["bics"], lambda b: value(F.lit("BIC"), b)), own)).alias("identifier"),
    )
    # a page may hold it in a script
    return F.when(r.isNotNull(), F.replace(F.to_json(data, {"ignoreNullFields": "true"}), F.lit("<"), F.lit("\\u003c")))


def valid_document(text: Column) -> Column:
    """Whether a cached text is a whole document: an object with all the members that a page needs, each of its kind."""
    kinds = {"lei": '"', "url": '"', "legalName.name": '"', "otherNames": "[", "successors": "[", "bics": "[", "legalForm": "{", "registrationAuthority": "{", "directParent": "{", "ultimateParent": "{", "expiration": "{", "source.apiUrl": '"'}
    v = F.try_parse_json(text)
    good = lambda path, kind: {'"': lambda s: s == "STRING", "[": lambda s: F.startswith(s, F.lit("ARRAY")), "{": lambda s: F.startswith(s, F.lit("OBJECT"))}[kind](F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")))
    whole = F.lit(True)
    for path, kind in kinds.items():
        whole = whole & good(path, kind)
    return F.coalesce(whole, F.lit(False))


def find_by_isin(asked: DataFrame, isins: DataFrame) -> DataFrame:
    """asked (code) with the codes (lei) of those that issue it."""
    return asked.withColumn("isin", R.trimmed(F.col("code"))).join(isins.select("isin", "lei"), "isin").select("code", "lei")


def find_by_bic(asked: DataFrame, bics: DataFrame) -> DataFrame:
    """asked (code) with the holders (lei) of that bank code; eight characters mean the head office, XXX."""
    code = R.trimmed(F.col("code"))
    return asked.withColumn("bic", F.when(F.length(code) == 8, F.concat(code, F.lit("XXX"))).otherwise(code)).join(bics.select("bic", "lei"), "bic").select("code", "lei")


def find_by_register_number(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(code, lei, exact) of entities (lei, register_number) whose number holds every word of what was asked; exact if it equals it in
    any case. Words meet by an equi-join on the longest word asked, the rest is checked on what it finds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))
    q = asked.withColumn("need_", words(F.col("code"))).where(F.size("need_") > 0)
    q = q.withColumn("word_", F.array_max(F.transform("need_", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"])
    e = entities.select("lei", "register_number", words(F.col("register_number")).alias("has_")).withColumn("word_", F.explode("has_"))
    met = q.join(e, "word_").where(F.forall("need_", lambda x: F.array_contains(F.col("has_"), x)))
    return met.select("code", "lei", (F.lower("register_number") == F.lower(R.trimmed(F.col("code")))).alias("exact"))


def compose(lookups: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, lei, via, rank): what identifier lookups (qid, reading_no, kind, lei) found, an entity once with all its kinds, then the
    name hits (qid, lei, rank) that no lookup found, in their order."""
    found = lookups.groupBy("qid", "lei").agg(F.min("reading_no").alias("first_"), F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("reading_no", "kind"))), lambda x: x["kind"]), " · ").alias("via"))
    rest = hits.join(found.select("qid", "lei"), ["qid", "lei"], "left_anti")
    both = found.select("qid", "lei", "via", F.lit(0).alias("part_"), F.col("first_").cast("int").alias("nth_")).unionByName(rest.select("qid", "lei", F.lit(None).cast("string").alias("via"), F.lit(1).alias("part_"), F.col("rank").cast("int").alias("nth_")))
    return both.select("qid", "lei", "via", F.row_number().over(Window.partitionBy("qid").orderBy("part_", "nth_", "lei")).alias("rank"))
