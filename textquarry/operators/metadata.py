"""Designations, registrations and the live status registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import stripped
from textquarry.session import table

# Prefixes in order of priority, marks of international standards, statuses and their other spellings (without the letters that vary).
PREFIXES = ("ГОСТ Р", "ГОСТ", "ОСТ", "СТО", "СТП", "СНиП", "СП", "РД", "ТУ", "ЕСКД")
INTERNATIONAL = ("ISO", "ИСО", "IEC", "МЭК", "EN", "ЕН")
STATUSES = ("действующий", "заменён", "отменён", "неизвестно")
ALIASES = {
    "деиствующии": "действующий",
    "деиствует": "действующий",
    "деиствующая": "действующий",
    "актуальныи": "действующий",
    "отменен": "отменён",
    "отмененныи": "отменён",
    "отменена": "отменён",
    "заменен": "заменён",
    "замененныи": "заменён",
    "заменена": "заменён",
    "неизвестно": "неизвестно",
}
_PREFIX = "|".join(p.replace(" ", r"\s+") for p in PREFIXES)
_INTL = "(?:" + "|".join(INTERNATIONAL) + ")"
#: A designation with its year: prefix, international mark, number, year.
STRICT = rf"(?iU)\b({_PREFIX})\s*({_INTL}(?:/{_INTL})?)?\s*(\d+(?:\.\d+)*)\s*[-–—]\s*(\d{{2,4}})\b"
#: As questions write it: a case ending may follow the prefix, the year may be missing.
LOOSE = rf"(?iU)\b({_PREFIX})(?:ом|ов|у|а|е)?\s*(?:({_INTL}(?:/{_INTL})?)\s*)?(\d+(?:\.\d+)*)(?:\s*[-–—]\s*(\d{{2,4}}))?\b"


def plain_designation(prefix: Column, international: Column, number: Column, year: Column) -> Column:
    """One spelling: upper case, single spaces, Russian names of ISO and IEC, the year as written."""
    intl = F.regexp_replace(F.regexp_replace(F.upper(international), "ISO", "ИСО"), "IEC", "МЭК")
    return F.concat_ws(
        " ", F.upper(F.regexp_replace(prefix, r"(?U)\s+", " ")), F.nullif(intl, F.lit("")), F.concat(number, F.when(year != "", F.concat(F.lit("-"), year)).otherwise(""))
    )


def find_designation(text: Column) -> Column:
    """First designation with a year, in plain spelling; null where there is none."""
    parts = [F.regexp_extract(text, STRICT, g) for g in (1, 2, 3, 4)]
    return F.when(parts[0] != "", plain_designation(*parts))


def find_designations(text: Column) -> Column:
    """All designations of a question, the year left out where it isn't given, in order of first occurrence."""
    parts = [F.regexp_extract_all(text, F.lit(LOOSE), F.lit(g)) for g in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "piny")))
    return F.array_distinct(F.transform(zipped, lambda m: plain_designation(m["p"], m["i"], m["n"], m["y"])))


def expand_year(digits: Column) -> Column:
    n = digits.cast("int")
    return F.when(F.length(digits) == 4, n).when(n > 30, n + 1900).otherwise(n + 2000)


def parse_year(designation: Column) -> Column:
    y = F.regexp_extract(designation, r"-(\d{2,4})$", 1)
    return F.when(y != "", expand_year(F.nullif(y, F.lit(""))))


def doc_type(designation: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(PREFIXES):
        out = F.when(F.upper(designation).startswith(p.upper()), F.lit(p)).otherwise(out)
    return out


def doc_slug(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("document"))


def registry_key(designation: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(designation, r"\s+", " ")))


def coerce_status(status: Column) -> Column:
    folded = F.translate(F.lower(stripped(status)), "ёй", "еи")
    out = F.lit("неизвестно")
    for alias, value in ALIASES.items():
        out = F.when(folded == alias, F.lit(value)).otherwise(out)
    return out


def guessed_title(text: Column, designation: Column) -> Column:
    """The first of six lines after the one with the designation (from the top, if none) that has ten Cyrillic letters."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    after = F.when(designation.isNull(), 0).otherwise(F.coalesce(F.array_position(F.transform(lines, lambda x: F.regexp_extract(x, STRICT, 1) != ""), True), F.lit(0)))
    able = F.filter(F.slice(lines, after.cast("int") + 1, 6), lambda x: F.length(F.regexp_replace(x, "[^А-Яа-яЁё]", "")) >= 10)
    return F.substring(F.try_element_at(able, F.lit(1)), 1, 300)


def first_texts(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: the first page of a document that is not blank."""
    return pages.where(F.col("text").rlike(r"(?U)\S")).groupBy("doc_id").agg(F.min_by("text", F.struct("page_no", "page_id")).alias("text"))


def passports(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``id, doc_id, designation, title, year, status, doc_type, source_url, replaced_by`` of each file.

    ``files`` has ``id, path, text`` (of the first page), the registry one row a key.  A
    designation in the file name beats one in the first 3000 characters; the registry
    gives status, title and year, else the title is guessed and the year parsed.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = files.withColumn("found", F.coalesce(find_designation(name), find_designation(F.substring("text", 1, 3000)))).withColumn("key", registry_key(F.col("found")))
    r = registry.select("key", *(F.col(c).cast("string").alias("r_" + c) for c in ("status", "title", "year", "source_url", "replaced_by")))
    j, d = found.join(r, "key", "left"), F.col("found")
    full = lambda c: F.nullif(F.col("r_" + c), F.lit(""))
    return j.select(
        "id",
        doc_slug(F.coalesce(d, F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))).alias("doc_id"),
        d.alias("designation"),
        F.coalesce(full("title"), guessed_title(F.col("text"), d)).alias("title"),
        F.coalesce(F.when(F.col("r_year").rlike(r"^\d+$"), F.col("r_year").cast("int")), parse_year(d)).alias("year"),
        F.when(full("status").isNotNull(), coerce_status(full("status"))).otherwise("неизвестно").alias("status"),
        doc_type(d).alias("doc_type"),
        full("source_url").alias("source_url"),
        full("replaced_by").alias("replaced_by"),
    )


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlay(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Status, replacement, title and address of the live registry over those stored.

    ``rows`` has ``key, status, replaced_by, title, source_url``; the registry has one row a key.
    A found row always sets ``replaced_by``; the others only where not empty;
    without a row everything stays.
    """
    fields = ("status", "replaced_by", "title", "source_url")
    r = registry.select("key", *(F.col(c).alias("r_" + c) for c in fields), F.lit(True).alias("found"))
    j = rows.join(r, "key", "left")
    return j.select(
        *[c for c in rows.columns if c not in fields],
        F.when(F.coalesce("r_status", F.lit("")) != "", coerce_status(F.col("r_status"))).otherwise(F.col("status")).alias("status"),
        F.when(F.col("found"), F.nullif("r_replaced_by", F.lit(""))).otherwise(F.col("replaced_by")).alias("replaced_by"),
        *(F.when(F.coalesce("r_" + c, F.lit("")) != "", F.col("r_" + c)).otherwise(F.col(c)).alias(c) for c in ("title", "source_url")),
    )


def editions(available: DataFrame) -> DataFrame:
    """``designation, key, base``: a designation under every form that names it, its own and those cut before a dash."""
    parts = F.split(F.upper("designation"), "-")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    known = available.where("designation is not null").select("designation").distinct()
    return known.select("designation", base_number(F.col("designation")).alias("base"), F.explode(keys).alias("key"))


def base_number(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), r"-\d{2,4}$", "")


def resolve(mentions: DataFrame, available: DataFrame) -> DataFrame:
    """``mention, matched, alternatives``: editions in the corpus of each mention.

    A mention without year matches every edition of its number, one with year only
    itself; where nothing matches, other editions of the number are alternatives.
    The theta condition runs as an equi-join on the forms that name an edition.
    """
    known = editions(available)
    m = mentions.select("mention", F.upper("mention").alias("key"), base_number(F.col("mention")).alias("base")).distinct()
    found = m.join(known.select("designation", "key"), "key", "left").groupBy("mention", "base").agg(F.array_join(F.array_sort(F.collect_set("designation")), ",").alias("matched"))
    other = known.select("designation", "base").distinct()
    j = found.join(other, "base", "left").groupBy("mention", "matched").agg(F.array_join(F.array_sort(F.collect_set("designation")), ",").alias("every"))
    return j.select("mention", "matched", F.when(F.col("matched") == "", F.col("every")).otherwise("").alias("alternatives"))


def q_find(spark, sf):
    return table(spark, sf, "documents").select("doc_id", find_designation(F.col("text")).alias("found")).where("found is not null")


def q_fields(spark, sf):
    d = F.col("designation")
    return table(spark, sf, "doc_meta").select("meta_id", registry_key(d).alias("key"), parse_year(d).alias("parsed_year"), doc_type(d).alias("parsed_type"), doc_slug(d).alias("slug"))


def q_status(spark, sf):
    return table(spark, sf, "doc_meta").select("meta_id", coerce_status(F.col("status")).alias("status"))


def q_overlay(spark, sf):
    meta = table(spark, sf, "doc_meta").withColumn("key", registry_key(F.col("designation"))).where("key is not null")
    live = last_by_key(meta, "key", "meta_id")
    return overlay(meta.select("meta_id", "key", "status", "replaced_by", "title", "source_url"), live).select("meta_id", "key", "status", "replaced_by", "title", "source_url")


def q_resolve(spark, sf):
    d = table(spark, sf, "doc_meta").where("designation is not null")
    gold = table(spark, sf, "eval_items").where("gold_designation is not null").select(F.col("gold_designation").alias("mention"))
    short = d.select(F.regexp_replace("designation", r"-\d{2,4}$", "").alias("mention"))
    other = d.select(F.concat(F.regexp_replace("designation", r"-\d{2,4}$", ""), F.lit("-1901")).alias("mention"))
    return resolve(gold.unionByName(short).unionByName(other), d.select("designation"))


def registry_of(spark, sf) -> DataFrame:
    """The last registration of each designation, as rows of the registry."""
    meta = table(spark, sf, "doc_meta").withColumn("key", registry_key(F.col("designation"))).where("key <> ''")
    return last_by_key(meta, "key", "meta_id")


def q_build(spark, sf):
    """Passport of each registered path."""
    files = table(spark, sf, "doc_meta").select(F.col("meta_id").alias("id"), F.col("source_path").alias("path"), "doc_id").join(first_texts(table(spark, sf, "page_docs")), "doc_id", "left").drop("doc_id")
    return passports(files, registry_of(spark, sf)).withColumnRenamed("id", "meta_id")


def q_titles(spark, sf):
    """Titles guessed from the first pages."""
    texts = first_texts(table(spark, sf, "page_docs"))
    return texts.select("doc_id", guessed_title(F.col("text"), find_designation(F.col("text"))).alias("title"))


def _case(folded: str) -> str:
    return "CASE " + " ".join(f"WHEN {folded} = '{a}' THEN '{v}'" for a, v in ALIASES.items()) + " ELSE 'неизвестно' END"


def _status(c: str) -> str:
    return _case(rf"translate(lower(regexp_replace({c}, '^[\s\x{{a0}}\x{{2007}}\x{{202f}}\x{{2009}}\x{{3000}}]+|[\s\x{{a0}}\x{{2007}}\x{{202f}}\x{{2009}}\x{{3000}}]+$', '', 'g')), 'ёй', 'еи')")


_YEAR = r"CASE WHEN regexp_extract({d}, '-(\d{{2,4}})$', 1) = '' THEN NULL WHEN length(regexp_extract({d}, '-(\d{{2,4}})$', 1)) = 4 THEN regexp_extract({d}, '-(\d{{2,4}})$', 1)::INT WHEN regexp_extract({d}, '-(\d{{2,4}})$', 1)::INT > 30 THEN regexp_extract({d}, '-(\d{{2,4}})$', 1)::INT + 1900 ELSE regexp_extract({d}, '-(\d{{2,4}})$', 1)::INT + 2000 END"
_KEY = r"upper(trim(regexp_replace(designation, '\s+', ' ', 'g')))"
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({d}), '[^\pL\pN_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document')"
_TYPE = "CASE " + " ".join(f"WHEN starts_with(upper({{d}}), '{p.upper()}') THEN '{p}'" for p in PREFIXES) + " END"
_BASE = r"regexp_replace(upper({d}), '-\d{{2,4}}$', '')"
_S = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
#: The patterns for RE2, which knows neither look-around nor Unicode word bounds.
_RE2 = (r"(?i)(?:^|[^\pL\pN_])" + STRICT[len(r"(?iU)\b") : -len(r"\b")] + r"(?:$|[^\pL\pN_])").replace(r"\s", _S)
_RE2_LOOSE = (r"(?i)(?:^|[^\pL\pN_])" + LOOSE[len(r"(?iU)\b") : -len(r"\b")] + r"(?:$|[^\pL\pN_])").replace(r"\s", _S)
_PLAIN = "concat_ws(' ', upper(regexp_replace({p}, '" + _S.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g')), nullif(replace(replace(upper({i}), 'ISO', 'ИСО'), 'IEC', 'МЭК'), ''), {n} || CASE WHEN {y} <> '' THEN '-' || {y} ELSE '' END)"


def _find(c: str) -> str:
    part = lambda g: f"regexp_extract({c}, '{_RE2}', {g})"
    return f"CASE WHEN regexp_matches({c}, '{_RE2}') THEN " + _PLAIN.format(p=part(1), i=part(2), n=part(3), y=part(4)) + " END"


_STRIPPED = r"regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
_PATTERN = _RE2.replace("{", "{{").replace("}", "}}")
_TITLE = (
    "substr(list_filter(list_slice(ls, CASE WHEN {d} IS NULL THEN 0 ELSE coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '" + _PATTERN + "')), true), 0) END + 1, CASE WHEN {d} IS NULL THEN 0 ELSE coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '" + _PATTERN + "')), true), 0) END + 6), lambda x: length(regexp_replace(x, '[^А-Яа-яЁё]', '', 'g')) >= 10)[1], 1, 300)"
)
_FIRST = r"first AS (SELECT doc_id, arg_min(text, (page_no, page_id)) AS text FROM page_docs WHERE regexp_matches(text, '[^\s\x{a0}]') GROUP BY 1)"
_LINES = "list_filter(list_transform(string_split(text, E'\\n'), lambda x: " + _STRIPPED.format(c="x") + "), lambda x: x <> '')"
_REGISTRY = f"registry AS (SELECT * FROM (SELECT *, {_KEY} AS key FROM doc_meta) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY meta_id DESC) = 1)"
QUERIES = {
    "find_designation": q_find, "designation_fields": q_fields, "coerce_status": q_status, "registry_overlay": q_overlay, "resolve_editions": q_resolve, "build_metadata": q_build,
    "guess_title": q_titles,
}
ORACLES = {
    "find_designation": f"SELECT * FROM (SELECT doc_id, {_find('text')} AS found FROM documents) WHERE found IS NOT NULL",
    "designation_fields": f"SELECT meta_id, {_KEY} AS key, {_YEAR.format(d='designation')} AS parsed_year, {_TYPE.format(d='designation')} AS parsed_type, {_SLUG.format(d='designation')} AS slug FROM doc_meta",
    "coerce_status": f"SELECT meta_id, {_status('status')} AS status FROM doc_meta",
    "registry_overlay": f"""WITH m AS (SELECT *, {_KEY} AS key FROM doc_meta WHERE designation IS NOT NULL), r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY meta_id DESC) = 1)
      SELECT m.meta_id, m.key, CASE WHEN coalesce(r.status, '') <> '' THEN {_status('r.status')} ELSE m.status END AS status, nullif(r.replaced_by, '') AS replaced_by, CASE WHEN coalesce(r.title, '') <> '' THEN r.title ELSE m.title END AS title, CASE WHEN coalesce(r.source_url, '') <> '' THEN r.source_url ELSE m.source_url END AS source_url FROM m JOIN r USING (key)""",
    "resolve_editions": f"""WITH d AS (SELECT DISTINCT designation FROM doc_meta WHERE designation IS NOT NULL),
      s AS (SELECT regexp_replace(designation, '-\\d{{2,4}}$', '') AS b FROM d),
      m AS (SELECT gold_designation AS mention FROM eval_items WHERE gold_designation IS NOT NULL UNION SELECT b FROM s UNION SELECT b || '-1901' FROM s),
      j AS (SELECT mention, designation, upper(designation) = upper(mention) OR starts_with(upper(designation), upper(mention) || '-') AS same FROM m LEFT JOIN d ON {_BASE.format(d='mention')} = {_BASE.format(d='designation')} OR upper(designation) = upper(mention) OR starts_with(upper(designation), upper(mention) || '-')),
      g AS (SELECT mention, coalesce(string_agg(designation, ',' ORDER BY designation) FILTER (same), '') AS matched, coalesce(string_agg(designation, ',' ORDER BY designation) FILTER ({_BASE.format(d='mention')} = {_BASE.format(d='designation')}), '') AS every FROM j GROUP BY 1)
      SELECT mention, matched, CASE WHEN matched = '' THEN every ELSE '' END AS alternatives FROM g""",
    "build_metadata": rf"""WITH {_FIRST}, {_REGISTRY}, f AS (SELECT meta_id AS id, regexp_extract(source_path, '([^/]*)$', 1) AS name, text, {_LINES} AS ls FROM doc_meta LEFT JOIN first USING (doc_id)),
      g AS (SELECT *, coalesce({_find('name')}, {_find('substr(text, 1, 3000)')}) AS d FROM f),
      j AS (SELECT g.*, r.* EXCLUDE (doc_id, designation, doc_type, source_path, sha256, ingested_at) FROM g LEFT JOIN registry r ON r.key = {_KEY.replace('designation', 'g.d')})
      SELECT id AS meta_id, {_SLUG.format(d="coalesce(d, regexp_replace(name, '(.)[.][^.]+$', '\\1'))")} AS doc_id, d AS designation, coalesce(nullif(title, ''), {_TITLE.format(d='d')}) AS title, coalesce(year, {_YEAR.format(d='d')}) AS year,
        CASE WHEN nullif(status, '') IS NOT NULL THEN {_status('status')} ELSE 'неизвестно' END AS status, {_TYPE.format(d='d')} AS doc_type, nullif(source_url, '') AS source_url, nullif(replaced_by, '') AS replaced_by FROM j""",
    "guess_title": f"WITH {_FIRST}, l AS (SELECT doc_id, {_find('text')} AS d, {_LINES} AS ls FROM first) SELECT doc_id, {_TITLE.format(d='d')} AS title FROM l",
}
