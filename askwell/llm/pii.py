"""Personal data replaced by keyed surrogates of the same type, script and format.

Only DataFrame functions: mentions are found by one pattern, every distinct
entity of the whole table gets one surrogate, and texts are put together again
from the pieces between their mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

# Forms of address, and the names and syllables that replace names.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
GIVEN = {
    ("male", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas"],
    ("female", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia"],
    ("male", "cyrillic"): ["Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Олег"],
    ("female", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Майя"],
}
SYLLABLES = {
    "latin": ["ba", "den", "for", "gil", "han", "jor", "kel", "lam", "mon", "nor", "pal", "rin", "sel", "tor", "vin", "wes"],
    "cyrillic": ["ба", "вен", "гор", "дин", "жан", "зор", "кел", "лам", "мон", "нор", "пал", "рин", "сел", "тор", "фин", "чер"],
}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"

LOCAL = r"\p{L}\p{M}\p{N}._%+\-"
NAME = r"\p{Lu}[\p{L}\p{M}'’\-]+"
ADDRESS = "(?:" + "|".join([*MALE, *FEMALE]) + ")"
PATTERNS = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)*\.\p{{L}}{{2,}}",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{13,19})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){ADDRESS}\.? {NAME}(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: After so many collisions a surrogate may leave the entity's exact shape; after twice as many,
#: a format may be used up, and surrogates need only differ from each other.
WIDEN = 8
DRAWS = 13  # hexadecimal digits of a draw: exact in a long


def mentioned(text: Column) -> Column:
    """True where a text holds any entity; a cheap scan rules out most texts first."""
    cue = text.rlike(r"[@\d]")
    for title in [*MALE, *FEMALE]:
        cue = cue | F.contains(text, F.lit(title))
    return F.coalesce(cue & text.rlike(ANY), F.lit(False))


def kind(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def entities(mention: Column) -> Column:
    """``array<struct<type, key>>`` of a mention; equal keys are the same entity however written.

    A name with its form of address gives a given name with its gender, if any,
    and a surname, so one person is recognised with and without the given name.
    """
    words = F.split(F.regexp_replace(mention, rf"^{ADDRESS}\.? ", ""), " ")
    gender = F.when(mention.rlike("^(?:" + "|".join(FEMALE) + r")\.? "), "female").otherwise("male")
    surname = F.lower(F.element_at(words, -1))
    given = F.lower(F.element_at(words, 1))

    def pair(type_: Column, key: Column) -> Column:
        return F.struct(type_.alias("type"), key.alias("key"))

    last = pair(F.concat(F.lit("surname_"), script(surname)), surname)
    first = pair(F.concat(F.lit("given_"), gender, F.lit("_"), script(given)), given)
    digits = F.regexp_replace(mention, r"[^\d]", "")
    plain = F.when(kind(mention).isin("phone", "ssn", "card"), digits).otherwise(F.lower(mention))
    return F.when(
        kind(mention) == "person", F.when(F.size(words) == 2, F.array(first, last)).otherwise(F.array(last))
    ).otherwise(F.array(pair(kind(mention), plain)))


def draw(secret: str, salt: Column, size: Column) -> Column:
    """A number below ``size`` that depends on the key, the entity, the attempt and the place."""
    digest = F.sha2(F.concat_ws("|", F.lit(secret), F.col("type"), F.col("key"), F.col("attempt").cast("string"), salt), 256)
    return F.conv(F.substring(digest, 1, DRAWS), 16, 10).cast("long") % size


def letters(secret: str, source: Column, part: str = "") -> Column:
    """``source`` with each character replaced by one of its class and script; parts draw apart."""

    def swap(c: Column, i: Column) -> Column:
        def of(alphabet: str) -> Column:
            place = draw(secret, F.concat(F.lit(part), i.cast("string")), F.lit(len(alphabet)))
            return F.substring(F.lit(alphabet), (place + 1).cast("int"), F.lit(1))

        hexadecimal = F.when(F.col("type") == "secret", of("abcdef"))
        return (
            F.when(c.rlike("[0-9]"), of("0123456789"))
            .when(c.rlike(r"\p{IsLatin}"), F.coalesce(hexadecimal, of(LATIN)))
            .when(c.rlike(r"\p{IsCyrillic}"), of(CYRILLIC))
            .when(c.rlike(r"\p{IsGreek}"), of(GREEK))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.regexp_extract_all(source, F.lit("(?s)."), F.lit(0)), swap), "")


def luhn(digits: Column) -> Column:
    """The weighted digit sum of card numbers; the last digit makes it a multiple of ten."""
    single = F.reverse(F.regexp_extract_all(digits, F.lit("."), F.lit(0)))
    weighted = F.transform(
        single,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5) + (2 * c.cast("int")) % 10),
    )
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x)


def surrogate(secret: str) -> Column:
    """The surrogate of the entity (type, key) at its ``attempt``."""
    type_, key, wide = F.col("type"), F.col("key"), F.col("attempt") >= WIDEN
    local, domain = F.substring_index(key, "@", 1), F.substring_index(key, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.expr("substring(key, instr(key, '@') + 1, length(key) - instr(key, '@') - 1 - length(substring_index(key, '.', -1)))")
    email = F.concat(
        letters(secret, local),
        F.when(wide, draw(secret, F.lit("tail"), F.lit(10**9)).cast("string")).otherwise(""),
        F.lit("@"),
        letters(secret, host, "host"),
        top,
    )

    def octet(part: Column, i: Column) -> Column:
        place = F.concat(F.lit("o"), i.cast("string"))
        low = F.when(wide, 1).when(F.length(part) == 1, 1).when(F.length(part) == 2, 10).otherwise(100)
        size = F.when(wide, 255).when(F.length(part) == 1, 9).when(F.length(part) == 2, 90).otherwise(156)
        return (low + draw(secret, place, size)).cast("string")

    address = F.array_join(F.transform(F.split(key, r"\."), octet), ".")
    code = F.greatest(F.length(key) - 10, F.lit(0))
    phone = F.concat(F.substring(key, F.lit(1), code), letters(secret, F.substring(key, code + 1, F.lit(10))))
    body = letters(secret, F.substring(key, F.lit(1), F.length(key) - 1))
    check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn(key) % 10 == 0, F.concat(body, check)).otherwise(letters(secret, key))
    out = (
        F.when(type_ == "email", email)
        .when(type_ == "ipv4", address)
        .when(type_ == "phone", phone)
        .when(type_ == "card", card)
        .when(type_.isin("ssn", "secret"), letters(secret, key))
    )
    for (gender, written), names in GIVEN.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (draw(secret, F.lit("given"), F.lit(len(names))) + 1).cast("int"))
        more = F.when(F.col("attempt") > 0, syllables(secret, written, F.lit(2) + F.floor(F.col("attempt") / WIDEN))).otherwise("")
        out = F.when(type_ == f"given_{gender}_{written}", F.lower(F.concat(pick, more))).otherwise(out)
    for written in SYLLABLES:
        count = F.lit(3) + F.floor(F.col("attempt") / WIDEN)
        out = F.when(type_ == f"surname_{written}", syllables(secret, written, count)).otherwise(out)
    return out


def syllables(secret: str, written: str, count: Column) -> Column:
    parts = F.array(*[F.lit(s) for s in SYLLABLES[written]])
    pick = lambda i: F.element_at(parts, (draw(secret, i.cast("string"), F.lit(len(SYLLABLES[written]))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), pick), "")


def surrogates(distinct: DataFrame, secret: str) -> DataFrame:
    """``type, key, surrogate`` of distinct entities, no two of a type alike and none a real entity.

    Whoever collides draws again; an entity that drew earlier keeps its surrogate.
    """
    table = kept(distinct.select("type", "key", F.lit(0).alias("attempt")).withColumn("surrogate", surrogate(secret)))
    real = distinct.select("type", F.col("key").alias("surrogate"), F.lit(True).alias("__real"))
    while True:
        order = Window.partitionBy("type", "surrogate").orderBy("attempt", "key")
        taken = F.row_number().over(order) > 1
        is_real = F.coalesce("__real", F.lit(False)) & (F.col("attempt") < 2 * WIDEN)
        tested = kept(table.withColumn("__taken", taken).join(real, ["type", "surrogate"], "left").withColumn("__bad", F.col("__taken") | is_real))
        if tested.filter("__bad").isEmpty():
            return table.select("type", "key", "surrogate")
        redrawn = tested.select("type", "key", (F.col("attempt") + F.col("__bad").cast("int")).alias("attempt"), "surrogate", "__bad")
        table = kept(
            redrawn.withColumn("surrogate", F.when(F.col("__bad"), surrogate(secret)).otherwise(F.col("surrogate"))).drop("__bad")
        )


def rendered(mention: Column, known: Column) -> Column:
    """A mention with its entities' surrogates (a map by type and key) in the mention's own writing."""
    found = entities(mention)
    values = F.transform(found, lambda e: F.element_at(known, F.concat_ws(":", e["type"], e["key"])))
    digit = F.regexp_extract_all(mention, F.lit("(?s)."), F.lit(0))
    only = values[0]

    def placed(c: Column, i: Column) -> Column:
        number = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\d]", ""))
        return F.when(c.rlike(r"\d"), F.substring(only, number, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(digit, placed), "")
    cased = F.when((F.upper(mention) == mention) & mention.rlike(r"\p{L}"), F.upper(only)).otherwise(only)
    names = F.concat(F.regexp_extract(mention, rf"^{ADDRESS}\.? ", 0), F.array_join(F.transform(values, F.initcap), " "))
    return F.when(kind(mention).isin("phone", "ssn", "card"), spaced).when(kind(mention) == "person", names).otherwise(cased)


def replace_entities(docs: DataFrame, secret: str = "surrogates", text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_replaced`` added.

    The same entity has the same surrogate in all texts, different entities have
    different ones. Null and empty texts and texts without entities stay as they
    are, with 0. Rows are told apart by their text, so missing and repeated ids
    do no harm; all columns stay. An empty table gives an empty result.
    """
    all_ = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    holding = docs.filter(mentioned(F.col(text))).withColumn("__h", F.sha2(F.col(text), 256))
    listed = holding.select("__h", F.explode(F.array_distinct(all_)).alias("__m"))
    used = kept(listed.select("__h", F.explode(entities(F.col("__m"))).alias("e")).select("__h", "e.type", "e.key").distinct())
    table = surrogates(kept(used.select("type", "key").distinct()), secret)
    entry = F.struct(F.concat_ws(":", "type", "key"), "surrogate")
    maps = used.join(table, ["type", "key"]).groupBy("__h").agg(F.map_from_entries(F.collect_list(entry)).alias("__map"))
    pieces, hits = F.split(F.col(text), ANY, -1), F.transform(all_, lambda m: rendered(m, F.col("__map")))
    gaps = F.transform(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: F.concat(x["p"], F.coalesce(x["h"], F.lit(""))))
    changed = holding.join(maps, "__h").select(
        *[F.array_join(gaps, "").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.size(all_).alias("n_replaced")
    )
    return changed.unionByName(docs.filter(~mentioned(F.col(text))).withColumn("n_replaced", F.lit(0)))
