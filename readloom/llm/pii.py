"""Surrogates for personal data, in DataFrame functions alone.

Every mention of an e-mail address, phone or card number, network address, secret, social security or bank account
number, or name after a title is replaced. A surrogate is derived from a secret key, the kind and the canonical form of
the entity, so that mentions of one entity get one surrogate everywhere, and it keeps the mention's format: separators,
letter case and length for codes, the country for phone and account numbers, a valid check digit for cards that have
one, title, gender and script for names. Family and given names are entities of their own, without title, dots and
letter case, so that a person keeps the family name however often and in whatever form the text says it; a name that
the text has after a title is replaced where it stands without one too.

Distinct entities must get distinct surrogates that no real entity has. All canonical forms are checked for that with
one aggregation; those that collide get another attempt, of a longer name, until none does. Attempts other than the
first are exceptions, joined to the texts that mention them by a hash of the text.

The key is a parameter, by default the setting spark.readloom.surrogates.key: whoever knows it can try out all phone
numbers. The key in this file serves where that is unset, for tests.

Defined results: a null text stays null and has no mentions; a text without mentions is unchanged; repeated rows are
treated alike; an empty table gives no rows; other columns, whatever their names, are kept by replaced()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, masked

KEY = "readloom-surrogates-1"
KEY_SETTING = "spark.readloom.surrogates.key"
#: Titles, by gender. Fixed values.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа"]
#: Given names and syllables of family names, by script and gender. Fixed values.
GIVEN = {
    ("latin", "male"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Noel", "Oscar", "Paul"],
    ("latin", "female"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Frida", "Greta", "Hanna", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "male"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Игорь", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Юрий"],
    ("cyrillic", "female"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Ирина", "Лидия", "Майя", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Юлия"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "ke", "lin", "mo", "nar", "pe", "ros", "sta", "ter", "vo", "wei", "zan"],
    "cyrillic": ["ба", "ден", "фи", "гор", "хал", "ке", "лин", "мо", "нар", "пе", "рос", "ста", "тер", "во", "вей", "зан"],
}
TITLES = [x for t in MALE + FEMALE for x in (t, t.upper())]
_name = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,}(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)",
    "address": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? {_name}(?: {_name})?(?!\p{{L}})",
}
PATTERN = "|".join(PATTERNS.values())
#: Every mention has one of these, so texts without any have no mention; the test is cheap. Secrets, accounts and cards
#: need not have three digits in a row.
HINT = rf"[0-9]{{3}}|@|[0-9A-Fa-f]{{32}}|[A-Z]{{2}}[0-9]{{2}}|[0-9](?:[ -]?[0-9]){{12}}|[0-9]\.[0-9]|(?:{'|'.join(TITLES)})\.? \p{{Lu}}"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once and stands once in the plan, however often f names it. Plans go through the
    driver many times over, as trees and as text, so their size is its memory."""
    return F.transform(F.array(value), f)[0]


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(m: Column) -> Column:
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    out = None
    for k in ("email", "phone", "address", "social", "secret", "card", "account"):
        out = F.when(whole[k], k) if out is None else out.when(whole[k], k)
    return out.otherwise("name")


def canonical(kind: Column, m: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, lower-case letters elsewhere."""
    return F.when(kind.isin("phone", "card", "social"), F.translate(m, "+() .-", "")).otherwise(F.lower(m))


def title_of(m: Column) -> Column:
    return F.regexp_extract(m, rf"^(?:{'|'.join(TITLES)})(?!\p{{L}})\.?", 0)


def parts(kind: Column, m: Column) -> Column:
    """The entities of a mention, kind, of and m: the mention itself or, of a name, the family name and, if there is
    one, the given name, whose kind tells the gender."""
    one = lambda k, x: F.struct(k.alias("kind"), canonical(k, x).alias("of"), x.alias("m"))

    def names(title: Column) -> Column:
        rest = F.substring(m, F.length(title) + 2, F.length(m))
        given = F.when(F.upper(F.translate(title, ".", "")).isin([t.upper() for t in MALE]), "given m").otherwise("given f")
        family = F.array(one(F.lit("family"), F.substring_index(rest, " ", -1)))
        return F.when(rest.contains(" "), F.concat(family, F.array(one(given, F.substring_index(rest, " ", 1))))).otherwise(family)

    return let(kind, lambda k: F.when(k == "name", let(title_of(m), names)).otherwise(F.array(one(k, m))))


def digest(key: str, kind: Column, of: Column, attempt: Column, part: int = 0) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(f"{key}/{part}/in"), kind, of, attempt.cast("string")).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(f"{key}/out"), inner).cast("binary"), 256)


def luhn(digits: Column) -> Column:
    """The check sum of a number, 0 if it is valid."""

    def total(digits: Column) -> Column:
        def add(so_far: Column, k: Column) -> Column:
            d = F.substring(digits, k, F.lit(1)).cast("int") * (1 + F.pmod(F.length(digits) - k, F.lit(2)))
            return so_far + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)

    return F.pmod(let(digits, total), F.lit(10))


def checked(m: Column, made: Column) -> Column:
    """A card number's surrogate, with a valid check digit if m has one. Both end in a digit."""
    stem = F.substring(made, F.lit(1), F.length(made) - 1)
    last = F.pmod(10 - luhn(F.translate(F.concat(stem, F.lit("0")), " -", "")), F.lit(10))
    return F.when(luhn(F.translate(m, " -", "")) == 0, F.concat(stem, last.cast("string"))).otherwise(made)


def overlaid(m: Column, hexes: Column, skip: Column) -> Column:
    """m with each digit and ASCII letter after the first `skip` characters replaced by one of its class; a replacement
    comes from two hex digits, those of its place among the characters that are no separators."""
    byte = lambda i: F.conv(F.substring(hexes, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")
    letter = lambda b, first: F.chr(F.lit(ord(first)) + F.pmod(b, F.lit(26)))

    def one(ch: Column, place: Column, x: Column) -> Column:
        i = F.length(F.translate(F.substring(x["m"], F.lit(1), place), "+() .-", ""))
        other = lambda b: F.when(ch.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(ch.rlike("[A-Z]"), letter(b, "A")).when(ch.rlike(r"\p{L}"), letter(b, "a")).otherwise(ch)
        return F.when(place < x["skip"], ch).otherwise(let(byte(i), other))

    return let(F.struct(m.alias("m"), skip.alias("skip")), lambda x: F.array_join(F.transform(F.split(x["m"], ""), lambda ch, place: one(ch, place, x)), ""))


def pick(choices: list[str], hexes: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), F.pmod(F.conv(F.substring(hexes, at, 4), 16, 10).cast("int"), F.lit(len(choices))) + 1)


def hexes_of(key: str, kind: Column, of: Column, attempt: Column) -> Column:
    """256 hex digits; longer codes repeat them."""
    return F.concat(*[digest(key, kind, of, attempt, i) for i in range(4)])


def named(m: Column, kind: Column, hexes: Column, attempt: Column) -> Column:
    """A family or given name in m's script; further attempts have further syllables."""

    def of(script: str) -> Column:
        more = F.transform(F.sequence(F.lit(0), 3 + attempt), lambda i: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[script]]), F.conv(F.substring(hexes, 20 + F.pmod(i, F.lit(200)), F.lit(1)), 16, 10).cast("int") + 1))
        first = F.when(kind == "given m", pick(GIVEN[script, "male"], hexes, 10)).when(kind == "given f", pick(GIVEN[script, "female"], hexes, 10))
        return F.when(kind == "family", F.initcap(F.array_join(more, ""))).otherwise(F.concat(first, F.array_join(F.slice(more, F.lit(1), attempt), "")))

    made = F.when(m.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))
    return let(made, lambda x: F.when((m == F.upper(m)) & (F.length(m) > 1), F.upper(x)).otherwise(x))


def surrogate(m: Column, kind: Column, hexes: Column, attempt: Column) -> Column:
    """The replacement of an entity."""
    octets = F.concat_ws(".", *[(F.pmod(F.conv(F.substring(hexes, 1 + 2 * i, 2), 16, 10).cast("int"), F.lit(254)) + 1).cast("string") for i in range(4)])
    code = F.substring(F.repeat(hexes, F.ceil(F.length(m) / 256).cast("int")), F.lit(1), F.length(m))
    as_said = lambda x: F.when(m == F.upper(m), F.upper(x)).otherwise(x)
    country = F.length(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0))
    subject = F.when(kind == "email", F.substring_index(m, "@", 1)).otherwise(m)
    skip = F.when(kind == "phone", country).when(kind == "account", F.lit(2)).otherwise(F.lit(0))

    def finished(made: Column) -> Column:
        mail = F.concat(F.lower(made), F.substring(hexes, 200, 6), F.lit("@"), F.substring(hexes, 210, 6), F.lit(".example"))
        return F.when(kind == "email", let(mail, as_said)).when(kind == "card", checked(m, made)).otherwise(made)

    return (
        F.when(kind == "address", octets).when(kind == "secret", let(code, as_said))
        .when(kind.isin("family", "given m", "given f"), named(m, kind, hexes, attempt)).otherwise(let(overlaid(subject, hexes, skip), finished))
    )


def entities(docs: DataFrame) -> DataFrame:
    """kind, of, m: each entity of the corpus once, with one of its mentions."""
    found = docs.select(F.explode(mentions(F.col("text"))).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("uses"))
    found = found.withColumn("kind", kind_of(F.col("m"))).select(F.inline(parts(F.col("kind"), F.col("m"))))
    return found.groupBy("kind", "of").agg(F.min("m").alias("m"))


def exceptions(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame | None:
    """kind, of, attempt of the entities whose first surrogate another entity has, or is; None if there are none."""
    scratch = Scratch(spark, "surrogates")
    known = scratch.keep(entities(docs).withColumn("attempt", F.lit(0)), "entities0")
    step = 0
    while True:
        made = known.withColumn("hexes", hexes_of(key, F.col("kind"), F.col("of"), F.col("attempt")))
        made = made.withColumn("s", surrogate(F.col("m"), F.col("kind"), F.col("hexes"), F.col("attempt"))).drop("hexes").withColumn("s", let(F.col("s"), lambda s: canonical(F.col("kind"), s)))
        # written, as the joins below read it twice and would work every surrogate out once more to filter it
        made = scratch.keep(made, f"made{step}")
        # of those with one surrogate the first keeps it, unless it is the form of a real entity
        first = made.groupBy("kind", "s").agg(F.min("of").alias("first"))
        made = made.join(first, ["kind", "s"]).join(known.select("kind", F.col("of").alias("s"), F.lit(True).alias("real")), ["kind", "s"], "left")
        clash = (F.col("of") != F.col("first")) | F.coalesce("real", F.lit(False))
        step += 1
        now = scratch.keep(made.select("kind", "of", "m", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), f"entities{step}")
        scratch.drop(f"made{step}")
        if now.where("clash").isEmpty():
            out = now.where("attempt > 0").select("kind", "of", "attempt")
            return None if out.isEmpty() else out
        known = now.drop("clash")


def replaced(spark: SparkSession, docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text; other columns unchanged. `n_mentions_of_pii` is added."""
    key = key or spark.conf.get(KEY_SETTING, KEY)
    names = docs.columns
    odd = exceptions(spark, docs, key)
    out = docs.withColumn("_m_of_pii", mentions(F.col("text")))
    if odd is None:
        attempt = lambda x: F.lit(0)
    else:
        # only texts that mention an exception get a map of attempts, by a hash of the text
        by = out.where(F.size("_m_of_pii") > 0).select(F.sha2(F.col("text").cast("binary"), 256).alias("_t_of_pii"), F.explode(F.array_distinct("_m_of_pii")).alias("m")).distinct()
        by = by.select("_t_of_pii", F.inline(parts(kind_of(F.col("m")), F.col("m")))).select("_t_of_pii", "kind", "of").distinct().join(odd, ["kind", "of"])
        by = by.groupBy("_t_of_pii").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "of"), "attempt"))).alias("_a_of_pii"))
        some, none = out.where(F.size("_m_of_pii") > 0), out.where(F.coalesce(F.size("_m_of_pii"), F.lit(0)) <= 0)
        some = some.withColumn("_t_of_pii", F.sha2(F.col("text").cast("binary"), 256)).join(by, "_t_of_pii", "left").drop("_t_of_pii")
        out = some.unionByName(none, allowMissingColumns=True)
        attempt = lambda x: F.coalesce(F.try_element_at(F.col("_a_of_pii"), F.concat_ws("|", x["kind"], x["of"])), F.lit(0))
    gaps = F.split("text", PATTERN, -1)
    # step by step, so that no step repeats the expressions of the one before
    made = F.transform("_m_of_pii", lambda m: F.struct(m.alias("m"), parts(kind_of(m), m).alias("parts")))

    def each(made: Column, step) -> Column:
        return F.transform(made, lambda x: F.struct(x["m"].alias("m"), F.transform(x["parts"], step).alias("parts")))

    made = each(made, lambda x: F.struct(x["kind"].alias("kind"), x["of"].alias("of"), x["m"].alias("m"), attempt(x).alias("attempt")))
    made = each(made, lambda x: F.struct(x["kind"].alias("kind"), x["m"].alias("m"), x["attempt"].alias("attempt"), hexes_of(key, x["kind"], x["of"], x["attempt"]).alias("hexes")))
    made = each(made, lambda x: F.struct(x["kind"].alias("kind"), x["m"].alias("m"), surrogate(x["m"], x["kind"], x["hexes"], x["attempt"]).alias("s")))
    out = out.withColumn("_s_of_pii", made)
    # a name's parts are the family name and then the given name
    whole = lambda x, f: F.concat_ws(" ", F.get(x["parts"], 1)[f], x["parts"][0][f])
    said = F.transform("_s_of_pii", lambda x: F.when(x["parts"][0]["kind"] == "family", F.concat(title_of(x["m"]), F.lit(" "), whole(x, "s"))).otherwise(x["parts"][0]["s"]))
    joined = F.array_join(F.zip_with(gaps, said, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    people = F.filter("_s_of_pii", lambda x: x["parts"][0]["kind"] == "family")
    full = F.transform(F.filter(people, lambda x: F.size(x["parts"]) > 1), lambda x: F.struct(whole(x, "m").alias("m"), whole(x, "s").alias("s")))
    family = F.transform(people, lambda x: F.struct(x["parts"][0]["m"].alias("m"), x["parts"][0]["s"].alias("s")))
    # names without a title: whole ones first
    again = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["m"], F.lit(r"\E(?![\p{L}\p{N}])")), x["s"])
    joined = F.when(F.exists("_s_of_pii", lambda x: x["parts"][0]["kind"] == "family"), F.aggregate(F.array_distinct(F.concat(full, family)), joined, again)).otherwise(joined)
    text = F.when(F.size("_m_of_pii") > 0, joined).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], F.greatest(F.size("_m_of_pii"), F.lit(0)).cast("bigint").alias("n_mentions_of_pii"))


def surrogates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, n_entities: the whole texts with surrogates."""
    return replaced(spark, docs.select("doc_id", "text")).select("doc_id", "text", F.col("n_mentions_of_pii").alias("n_entities"))


def without_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with surrogates; columns unchanged."""
    plain = masked(docs)
    return replaced(spark, plain).select(*plain.columns).toDF(*docs.columns)
