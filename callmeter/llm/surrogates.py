"""Personal data replaced by keyed surrogates of the same kind; DataFrame functions only.

One pattern finds e-mail addresses, phone and card numbers, internet addresses, long secrets and titled
names; in a text that holds a titled name, its given and family names are found without the title too. Values are mentions of entities: lower-cased addresses, digits, a given name with its gender, a family name. Every distinct
entity gets a surrogate from a keyed hash (SHA-256 over key, kind, entity and attempt), and a mention is written in its own format: digits for digits, small letters for small ones, separators and
country code as they are, octets in range, valid check digits where the value has them, an address of version 6 short or full, a title's gender and a name's script kept. A family name has four syllables and two more with every attempt, so there are always enough. A surrogate that another entity has, or
that is itself an entity of the corpus, is drawn again with the next attempt, so distinct entities stay distinct and one entity
has one surrogate in whatever format it is mentioned.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.runtime import written

DEFAULT_KEY = "callmeter"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Господин|г-н", "Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа|г-жа"
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9.])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9.-])0[1-9][0-9]{2,3}[ -][0-9]{5,6}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# Every value holds a digit, an @ or a title; most texts hold none of them.
STEMS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Госпо", "г-")
# Calling codes of one and two digits; all others have three.
CALLING_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Given names by gender and script, and last syllables of family names (fixed values).
NAMES = {
    ("male", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oscar", "Paul"],
    ("female", "latin"): ["Anna", "Berta", "Clara", "Diana", "Eva", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Макар", "Олег", "Павел", "Роман", "Семён", "Тимур", "Юрий"],
    ("female", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита", "София", "Яна"],
}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "ne", "ri", "lo"], "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "не", "ри", "ло"]}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` and its lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(value: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        found = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def _nibble(stream: Column, i: Column) -> Column:
    """The i-th (from 0) number below 256 of the hash stream."""
    return F.conv(F.substring(stream, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")


def _like(value: Column, stream: Column, keep: Column) -> Column:
    """``value`` with every letter and digit after the first ``keep`` characters drawn anew in its own class."""
    small, great, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def drawn(i: Column) -> Column:
        old, number = F.substring(value, i + 1, F.lit(1)), _nibble(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))
        return F.when(i < keep, old).when(old.rlike("[0-9]"), pick(digits)).when(old.rlike(r"\p{Ll}"), pick(small)).when(old.rlike(r"\p{Lu}"), pick(great)).otherwise(old)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), drawn), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a card number: 0 where its last digit is right."""
    n = F.length(digits)

    def added(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(digit)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), added), F.lit(10))


def _mod97(account: Column) -> Column:
    """Remainder of an account number with its first four characters put last, letters as 10 to 35: 1 where its check digits are right."""

    def added(rest: Column, i: Column) -> Column:
        place = F.pmod(i + 3, F.length(account)) + 1
        code = F.ascii(F.substring(account, place, F.lit(1)))
        return F.pmod(F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55), F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), added)


def _checked_card(entity: Column, drawn: Column) -> Column:
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(10 - _once(F.concat(body, F.lit("0")), _luhn), F.lit(10))
    return F.when(_luhn(entity) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _checked_account(entity: Column, drawn: Column) -> Column:
    country, body = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    check = 98 - _once(F.concat(country, F.lit("00"), body), _mod97)
    return F.when(_mod97(entity) == 1, F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)).otherwise(drawn)


def _spelled(stream: Column, script: Column, n: Column) -> Column:
    out = F.lit("")
    for s, parts in SYLLABLES.items():
        own = F.array(*map(F.lit, parts))
        out = F.when(script == s, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(own, F.pmod(_nibble(stream, k), F.lit(16)) + 1)), "")).otherwise(out)  # noqa: B023
    return out


def _surrogate(key: str) -> Column:
    """From columns ``kind, entity, attempt``: the surrogate of that attempt."""
    seed = F.concat_ws("\u0001", F.lit(key), "kind", "entity", F.col("attempt").cast("string"))
    return _once(F.concat(*[F.sha2(F.concat_ws("\u0001", seed, F.lit(str(k))), 256) for k in range(4)]), _drawn)


def _drawn(stream: Column) -> Column:
    """The surrogate of columns ``kind, entity, attempt`` out of a stream of hash digits."""
    entity, attempt, kind = F.col("entity"), F.col("attempt"), F.col("kind")
    octet = lambda k: _nibble(stream, F.lit(k)).cast("string")
    # The private range first, the reserved one when that is full, then any.
    first = F.when(attempt < 8, "10").when(attempt < 24, (F.pmod(_nibble(stream, F.lit(3)), F.lit(15)) + 240).cast("string")).otherwise(octet(3))
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = F.lit("")
    for (g, s), names in NAMES.items():
        given = F.when((kind == f"given {g}") & (script == s), F.element_at(F.array(*map(F.lit, names)), F.pmod(_nibble(stream, F.lit(0)), F.lit(16)) + 1)).otherwise(given)
    return (
        F.when(kind == "email", F.concat(_like(F.substring_index(entity, "@", 1), stream, F.lit(0)), F.lit("."), F.substring(stream, 200, 8), F.lit("@example.org")))
        .when(kind == "ip", F.concat_ws(".", first, octet(0), octet(1), octet(2)))
        .when(kind == "ip6", F.concat(F.lit("20010db80000"), F.substring(stream, 1, 20)))
        .when(kind == "local", _like(entity, stream, F.lit(2)))
        .when(kind == "card", _once(_like(entity, stream, F.lit(0)), lambda drawn: _checked_card(entity, drawn)))
        .when(kind == "phone", _like(entity, stream, F.length(F.regexp_extract(entity, CALLING_CODE, 1))))
        .when(kind == "account", _once(_like(entity, stream, F.lit(2)), lambda drawn: _checked_account(entity, drawn)))
        .when(kind == "secret", F.substring(stream, F.lit(1), F.length(entity)))
        .when(kind == "family", F.initcap(_spelled(stream, script, 4 + 2 * attempt)))
        .when(kind.startswith("given"), F.when(attempt == 0, given).otherwise(F.concat(given, _spelled(stream, script, 2 * attempt))))
        .otherwise(_like(entity, stream, F.lit(0)))
    )


def _distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate`` for distinct ``entities(kind, entity)``: no two alike, none an entity itself.

    Each round draws again only what collides (all but the first entity of a collision); small kinds could run
    out of surrogates, which raises after 64 rounds instead of giving two entities one surrogate.
    """
    entities = written(entities.distinct(), "surrogates")
    state = written(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)), "surrogates")
    for _ in range(64):
        owner = state.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("o"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", F.col("o.entity").alias("owner"))
        taken = entities.select("kind", F.col("entity").alias("surrogate")).withColumn("taken", F.lit(True))
        judged = state.join(owner, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        again = judged.withColumn("again", F.coalesce("taken", F.lit(False)) | (F.col("owner").isNotNull() & (F.col("owner") != F.col("entity"))))
        if again.where("again").isEmpty():
            return state.select("kind", "entity", "surrogate")
        moved = again.select("kind", "entity", "surrogate", "attempt", "again").withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        state = written(moved.withColumn("surrogate", F.when(F.col("again"), _surrogate(key)).otherwise(F.col("surrogate"))).select("kind", "entity", "attempt", "surrogate"), "surrogates")
    raise ValueError("a kind of value has too few surrogates")


TITLE = rf"^((?:{FEMALE}|{MALE})\.? )"
#: Mentions of a person; all but the first stand without a title.
NAMED = ("name", "full female", "full male", "given female", "given male", "family")


def _title_and_words(value: Column) -> tuple[Column, Column]:
    """Gender by the title (male without one) and the words of a name."""
    female = F.regexp_extract(value, TITLE, 1).rlike(rf"^(?:{FEMALE})\.? $")
    return F.when(female, "female").otherwise("male"), F.split(F.regexp_replace(value, TITLE, ""), " ")


def _aliases(found: Column) -> Column:
    """What the titled names among ``found`` are called without a title, as sorted ``name \1 kind`` with each name once."""

    def names(value: Column) -> Column:
        gender, words = _title_and_words(value)
        alias = lambda name, *kind: F.concat(name, F.lit("\u0001"), *kind)
        family = alias(F.element_at(words, -1), F.lit("family"))
        given = alias(F.element_at(words, 1), F.lit("given "), gender)
        return F.when(F.size(words) > 1, F.array(alias(F.array_join(words, " "), F.lit("full "), gender), given, family)).otherwise(F.array(family))

    every = F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(found, lambda v: v.rlike(f"^(?:{KINDS['name']})$")), names))))
    return F.filter(every, lambda v, i: (i == 0) | (_before(v) != _before(F.get(every, i - 1))))


def _before(alias: Column) -> Column:
    return F.substring_index(alias, "\u0001", 1)


def _hextets(value: Column) -> Column:
    """The 32 digits of an address of version 6."""
    side = lambda k: F.filter(F.split(F.substring_index(F.lower(value), "::", k), ":"), lambda g: g != "")
    short = value.contains("::")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(side(1)) - F.size(side(-1)), F.lit(0)))
    groups = F.when(short, F.concat(side(1), zeros, side(-1))).otherwise(F.split(F.lower(value), ":"))
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _entities() -> Column:
    """From columns ``kind, value``: the entities it mentions, in order. A number without a country code is one of country 1."""
    kind, value = F.col("kind"), F.col("value")
    bare = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    gender, words = _title_and_words(value)
    entity = lambda k, e: F.struct(k.alias("kind"), e.alias("entity"))
    family = entity(F.lit("family"), F.element_at(words, -1))
    titled = F.when(F.size(words) > 1, F.array(entity(F.concat(F.lit("given "), gender), F.element_at(words, 1)), family)).otherwise(F.array(family))
    plain = (
        F.when(kind.isin("email", "secret"), F.lower(value))
        .when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .when(kind == "ip6", _hextets(value))
        .when((kind == "phone") & ~value.startswith("+"), F.concat(F.lit("1"), bare))
        .otherwise(bare)
    )
    return (
        F.when(kind == "name", titled)
        .when(kind.startswith("full "), F.array(entity(F.replace(kind, F.lit("full"), F.lit("given")), F.element_at(words, 1)), family))
        .when(kind.isin("family", "given female", "given male"), F.array(entity(kind, value)))
        .otherwise(F.array(entity(kind, plain)))
    )


def _rendered() -> Column:
    """From columns ``kind, value, drawn`` (surrogates of the entities, in order): the surrogate in the value's format."""
    kind, value, one = F.col("kind"), F.col("value"), F.element_at("drawn", 1)
    bare = lambda c: F.length(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    ahead = F.length(one) - bare(value)  # the country code that a mention leaves out

    def placed(i: Column) -> Column:
        old = F.substring(value, i + 1, F.lit(1))
        return F.when(old.rlike("[A-Za-z0-9]"), F.substring(one, ahead + bare(F.substring(value, F.lit(1), i + 1)), F.lit(1))).otherwise(old)

    like_value = lambda c: F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(c)).otherwise(c)
    group = lambda k: F.substring(one, 4 * k + 1, 4)
    short = F.concat(F.lit("2001:db8::"), F.concat_ws(":", *[F.regexp_replace(group(k), "^0{1,3}", "") for k in range(3, 8)]))
    full = F.concat_ws(":", *[group(k) for k in range(8)])
    return (
        F.when(kind.isin(*NAMED), F.concat(F.regexp_extract(value, TITLE, 1), F.array_join("drawn", " ")))
        .when(kind == "ip", one).when(kind.isin("email", "secret"), like_value(one))
        .when(kind == "ip6", like_value(F.when(value.contains("::"), short).otherwise(full)))
        .otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), placed), ""))
    )


def surrogate_table(values: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``values(kind, value)``: mentions of one entity share its surrogate, no two entities do."""
    mentions = written(values.distinct().select("kind", "value", F.posexplode(_entities()).alias("place", "of")).select("kind", "value", "place", "of.kind", "of.entity").toDF("kind", "value", "place", "of", "entity"), "surrogates")
    drawn = _distinct_surrogates(mentions.select(F.col("of").alias("kind"), "entity"), key).withColumnRenamed("kind", "of")
    whole = mentions.join(drawn, ["of", "entity"]).groupBy("kind", "value").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("parts"))
    return whole.withColumn("drawn", F.col("parts.surrogate")).select("kind", "value", _rendered().alias("surrogate"))


def replaced(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with every detected value replaced, and ``n_private``, the number of places.

    A null text stays null with 0 places. Rows are independent of their ids: repeated rows, ties and null ids are
    all kept. Values are replaced the same way in all rows. Rows without values are never shuffled. An empty table gives no rows.
    Extra columns of any name are kept, but for a given ``n_private``, whose place the count takes.
    A text is matched once; its values and what stands between them are written and read again.
    """
    kept = [c for c in docs.columns if c.lower() != "n_private"]
    own = {c: docs[f"`{c}`"] for c in kept}
    text = docs[f"`{text_col}`"]
    possible = reduce(lambda a, b: a | b, [text.contains(t) for t in STEMS], text.rlike("[0-9@]"))
    has = F.coalesce(possible & text.rlike(PATTERN), F.lit(False))
    clean = docs.where(~has).select(*own.values(), F.lit(0).cast("long").alias("n_private"))
    row = F.struct(*[F.lit("").alias(c) if c == text_col else own[c].alias(c) for c in kept])
    hit = docs.where(has).select(row.alias("row"), text.alias("text"))
    titled = reduce(lambda a, b: a | b, [F.col("text").contains(t) for t in STEMS])
    hit = hit.withColumn("alias", F.when(titled, _aliases(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).otherwise(F.array().cast("array<string>")))
    # Descending, so that a whole name comes before its first word.
    calls = F.array_join(F.reverse(F.transform("alias", _before)), "|")
    pattern = F.when(F.size("alias") > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), calls, F.lit(r")(?!\p{L})"))).otherwise(PATTERN)
    hit = hit.withColumn("pattern", pattern)
    called = F.map_from_arrays(F.transform("alias", _before), F.transform("alias", lambda a: F.substring_index(a, "\u0001", -1)))
    mention = lambda v: F.struct(F.coalesce(F.try_element_at(called, v), _kind(v)).alias("kind"), v.alias("value"))
    hit = written(hit.select(
        "row", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), F.split("text", F.col("pattern"), -1).alias("between"),
        F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), mention).alias("mentions"),
    ), "surrogates")
    # Rows are told apart by their text: equal texts have equal replacements.
    each = hit.select("h", "s", F.explode("mentions").alias("m")).select("h", "s", "m.kind", "m.value").where("kind is not null").distinct()
    table = surrogate_table(each.select("kind", "value"), key)
    named = lambda kind, value: F.concat(kind, F.lit("\u0001"), value)
    pairs = each.join(table, ["kind", "value"]).groupBy("h", "s").agg(F.map_from_entries(F.collect_list(F.struct(named(F.col("kind"), F.col("value")), "surrogate"))).alias("known"))
    fresh = F.transform("mentions", lambda m: F.coalesce(F.try_element_at("known", named(m["kind"], m["value"])), m["value"]))
    whole = F.array_join(F.zip_with("between", fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = hit.join(pairs, ["h", "s"], "left")
    return done.select(*[whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept], F.size("mentions").cast("long").alias("n_private")).unionByName(clean)
