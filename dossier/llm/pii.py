"""Personal data and secrets replaced by keyed surrogates, in SQL expressions only.

Entities are found by one pattern and taken apart into units: a mail address in small letters, the digits of a card or
phone number, the value of a secret, each word of a name.  Each distinct unit of the corpus gets one surrogate of
its own type, derived from a secret key, and each mention gets it in the mention's own format.  So mentions stay linked
however they are spelt, "Mr. John Brown" with "Mr Brown" too; the words of a name are replaced wherever its document repeats them.
If two units draw the same surrogate, or a surrogate is itself a unit of the corpus, the later unit draws
again, after some draws from a space that each further draw makes larger.

Names are found after a title only, and initials get letters of their own, whatever full name they stand for.  Postal
addresses are not looked for.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged

# Names by gender and script, all invented readers of the same letters.
NAMES = {
    ("female", "latin"): "Ada Anna Bella Cara Clara Dora Elena Elsa Emma Erika Flora Greta Helen Ida Irma Julia Karla Laura Lena Lisa Maria Marta Mona Nina Nora Olga Paula Rita Rosa Sara Sofia Vera",
    ("male", "latin"): "Adam Albert Anton Arno Boris Bruno Carl David Emil Erik Felix Frank Georg Hugo Igor Ivan Jakob Jonas Karl Leon Lukas Marco Martin Max Nils Oscar Otto Paul Peter Robert Simon Victor",
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Инна Ирина Лидия Мария Марина Нина Ольга Раиса Софья Юлия",
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Илья Кирилл Лев Максим Олег Павел Роман Сергей Юрий",
}
FAMILY = {
    "latin": "Al Ar Bal Bar Bel Ber Bor Cal Dan Del Dor Fal Far Gar Gel Hal Har Kal Kel Lan Mar Mel Nor Pal Ral Sal Tan Tor Val Var Wal Wel",
    "cyrillic": "Ал Ар Бал Бар Бел Бор Вал Вар Гал Дан Дар Кал Кар Лан Мал Мар",
}
ENDINGS = {"latin": "berg dale feld gard holm land man mark mont ridge sen son stad stein vale wood", "cyrillic": "анов енов инов аров еров дин лин мин нин рин енко онко ский ович евич ук"}
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Señorita|Sra|Srta|госпожа|г-жа"
MALE_TITLES = "Mr|Herr|Herrn|Monsieur|Señor|Sr|господин|г-н"
TITLE = rf"(?:{FEMALE_TITLES}|{MALE_TITLES})\.?[ ](?:(?:Dr|Prof)\.?[ ]){{0,2}}+"
NAME_WORD = r"\p{Lu}(?:\p{L}++(?:-\p{L}++|'\p{Lu}\p{L}++){0,6}+|'\p{Lu}\p{L}++)"
PARTICLE = r"(?:von|van|zu|zur|de|del|della|der|den|di|da|dos|du|la|le|bin|ibn|al)"
INITIAL = r"\p{Lu}\."
# Country codes of telephone numbers; all others have three digits.
COUNTRY_CODE = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SECRET_WORD = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
SECRET_HEAD = rf"(?i:\b{SECRET_WORD}\s{{0,3}}[=:]\s{{0,3}}[\"']?)"

# Shapes of entities, in order of preference at one place.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": rf"{SECRET_HEAD}[^\s\"',;<>]{{6,}}+",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}+|\bAIza[0-9A-Za-z_-]{35}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}?[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w.,/+-])(?!\d\d[ /-]\d\d[ /-]\d{4})(?=0(?:[ /-]{0,3}\d){8,12}(?![\d-]))0\d{1,4} ?[ /-] ?\d{2,9}(?:[ -]\d{2,5}){0,3}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"\b{TITLE}(?:(?:{NAME_WORD}|{INITIAL}|{PARTICLE}) ){{0,6}}{NAME_WORD}",
}
ENTITY = "|".join(f"(?:{shape})" for shape in SHAPES.values())
# What a text must hold to have any entity at all.
HINT = rf"[0-9@]|(?i:{SECRET_WORD}\s{{0,3}}[=:])|\b{TITLE}\p{{Lu}}"
CYRILLIC_LETTERS = "абвгдежзиклмнопрстуфхцчшэюя"
LATIN_LETTERS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
NAME_UNITS = ("family", "given-female", "given-male", "initial")
# What a secret may hold besides letters and digits.
SIGNS = "!#$%&*+-=?@^_~"


def kind_of(entity: Column) -> Column:
    """The first shape that matches the whole entity."""
    found = [F.when(entity.rlike(f"^(?:{shape})$"), F.lit(kind)) for kind, shape in SHAPES.items()]
    return F.coalesce(*found)


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    places = F.reverse(F.split(digits, ""))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(places, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda total, value: total + value) % 10 == 0


def _is_entity(entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return F.when(kind_of(entity) == "card", luhn_valid(digits)).otherwise(F.lit(True))


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty list if there are none."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.rlike(HINT), F.filter(found, _is_entity)).otherwise(F.array().cast("array<string>"))


def _draws(seed: Column, length: Column) -> Column:
    """``length`` numbers from 0 to 65535 that only the seed decides."""
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 16).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("/"), b.cast("string")), 256)), "")
    return F.transform(
        F.sequence(F.lit(0), (length - 1).cast("int")),
        lambda i: F.conv(F.substring(stream, 4 * i + 1, F.lit(4)), 16, 10).cast("int"),
    )


def _pick(letters: str, draw: Column) -> Column:
    return F.substring(F.lit(letters), (draw % len(letters) + 1).cast("int"), F.lit(1))


def same_shape(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Digits to digits and letters to letters of the same case and script; the rest stays."""
    small = HEX[10:] if hexadecimal else LATIN_LETTERS

    def one(char: Column, draw: Column) -> Column:
        return (
            F.when(char.rlike("[0-9]"), _pick("0123456789", draw))
            .when(char.rlike("[a-z]"), _pick(small, draw))
            .when(char.rlike("[A-Z]"), _pick(small.upper(), draw))
            .when(char.rlike(r"\p{IsCyrillic}"), F.when(char == F.upper(char), F.upper(_pick(CYRILLIC_LETTERS, draw))).otherwise(_pick(CYRILLIC_LETTERS, draw)))
            .when(char.rlike(r"\p{Lu}"), _pick(LATIN_LETTERS.upper(), draw))
            .when(char.rlike(r"\p{L}"), _pick(LATIN_LETTERS, draw))
            .when(char.rlike(r"\p{N}"), _pick("0123456789", draw))
            .otherwise(char)
        )

    return F.array_join(F.zip_with(F.split(value, ""), _draws(seed, F.length(value)), one), "")


def _checked(card: Column) -> Column:
    """The card number with its last digit set so that the check holds."""
    digits = F.regexp_replace(card, r"\D", "")
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fitting = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: luhn_valid(F.concat(head, d)))
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.element_at(fitting, 1))


def checked_iban(iban: Column) -> Column:
    """An IBAN without spaces, its two check digits set so that the check holds."""
    country, rest = F.substring(iban, 1, 2), F.substring(iban, F.lit(5), F.length(iban))
    turned = F.split(F.concat(rest, country, F.lit("00")), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
    left = F.aggregate(turned, F.lit(0).cast("long"), lambda total, c: (total * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _word(words: str, draw: Column) -> Column:
    listed = F.split(F.lit(words), " ")
    return F.element_at(listed, (draw % len(words.split()) + 1).cast("int"))


def _drawn_word(letters: str, seed: Column, length: int) -> Column:
    if not length:
        return F.lit("")
    return F.array_join(F.transform(_draws(F.concat(seed, F.lit("/+")), F.lit(length)), lambda draw: _pick(letters, draw)), "")


def _name_words(entity: Column) -> Column:
    """Words and initials of a name, without its title."""
    return F.filter(F.split(F.regexp_replace(entity, rf"^{TITLE}", ""), " "), lambda word: word.rlike(r"^\p{Lu}"))


def units(entity: Column, kind: Column) -> Column:
    """What an entity is made of, as (kind, identity): one for each word of a name, else one."""
    female = entity.rlike(rf"^(?:{FEMALE_TITLES})\b")
    words = _name_words(entity)
    given = F.when(female, F.lit("given-female")).otherwise(F.lit("given-male"))
    named = F.transform(
        words,
        lambda word, i: F.struct(
            F.when(word.rlike(rf"^{INITIAL}$"), F.lit("initial")).when(i < F.size(words) - 1, given).otherwise(F.lit("family")).alias("kind"),
            F.lower(word).alias("identity"),
        ),
    )
    identity = (
        F.when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind.isin("card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(entity, r"[^\d+]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(entity, f"^{SECRET_HEAD}", ""))
        .otherwise(entity)
    )
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), identity.alias("identity"))))


def _drawn_name(kind: Column, identity: Column, seed: Column, wider: int) -> Column:
    """A word for a word of a name, of its gender and script, in small letters; ``wider`` more parts follow hyphens."""
    draws = _draws(seed, F.lit(3 + 3 * wider))

    def by(script: str) -> Column:
        vowels = "aeiou" if script == "latin" else "аеиоу"
        # Two drawn parts and a drawn middle vowel make family names plenty.
        part = lambda i: F.concat(_word(FAMILY[script], draws[i]), _pick(vowels, draws[i + 2]), _word(ENDINGS[script], draws[i + 1]))
        places = range(0, 3 + 3 * wider, 3)
        letters = LATIN_LETTERS if script == "latin" else CYRILLIC_LETTERS
        return (
            F.when(kind == "family", F.concat_ws("-", *map(part, places)))
            .when(kind == "given-female", F.concat_ws("-", *(_word(NAMES["female", script], draws[i]) for i in places)))
            .when(kind == "given-male", F.concat_ws("-", *(_word(NAMES["male", script], draws[i]) for i in places)))
            .otherwise(F.concat(*(_pick(letters, draws[i]) for i in places), F.lit(".")))
        )

    return F.lower(F.when(identity.rlike(r"\p{IsCyrillic}"), by("cyrillic")).otherwise(by("latin")))


def surrogate(kind: Column, identity: Column, key: str, attempt: Column, wider: int = 0) -> Column:
    """The surrogate of one unit at its ``attempt``-th draw, longer by ``wider`` parts: some
    thousand times as many surrogates are possible for each."""
    named = F.concat(F.lit(key), F.lit("/in/"), kind, F.lit("/"), identity, F.lit("/"), attempt.cast("string"))
    seed = F.sha2(F.concat(F.lit(key), F.lit("/out/"), F.sha2(named, 256)), 256)
    shaped = same_shape(identity, seed)
    ending = F.concat(F.lit("."), F.substring_index(identity, ".", -1))
    octets = F.array_join(F.transform(_draws(seed, F.lit(4)), lambda d: (d % 254 + 1).cast("string")), ".")
    groups = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(_draws(seed, F.lit(6)), lambda d: F.lower(F.hex(d))), ":"))
    prefix = F.regexp_extract(identity, rf"^({COUNTRY_CODE}|0(?=\d{{8}})|[A-Z]{{2}}(?=\d)|(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza))", 1)
    keeping = F.concat(prefix, F.substring(shaped, F.length(prefix) + 1, F.length(identity)))
    mail = F.concat(F.substring(shaped, F.lit(1), F.length(identity) - F.length(ending)), ending)
    more = _drawn_word("0123456789", seed, 4 * wider)
    hexadecimal = same_shape(identity, seed, True)
    if wider:
        # A mailbox has 64 characters at most, and there are no more addresses of four numbers.
        box = F.concat(_drawn_word(LATIN_LETTERS, seed, 3 * wider), F.substring_index(mail, "@", 1))
        mail = F.concat(F.substring(box, 1, 64), F.lit("@"), F.substring_index(mail, "@", -1))
        octets = groups
    # A value without any letter or digit, as a masked one, keeps no sign of its own.
    signs = F.array_join(F.transform(_draws(seed, F.length(identity)), lambda d: _pick(SIGNS, d)), "")
    secret = F.when(identity.rlike("^[0-9a-f]+$"), hexadecimal).when(~identity.rlike(r"[\p{L}\p{N}]"), signs).otherwise(shaped)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", octets)
        .when(kind == "ip6", groups if wider else hexadecimal)
        .when(kind == "card", _checked(F.concat(shaped, more)))
        .when(kind.isin(*NAME_UNITS), _drawn_name(kind, identity, seed, wider))
        .when(kind == "secret", F.concat(secret, more))
        .when(kind == "iban", checked_iban(F.concat(keeping, more)))
        .when(kind.isin("phone", "key"), F.concat(keeping, more))
        .otherwise(F.concat(shaped, more))
    )


def unit_table(found: DataFrame, key: str, own_shape_draws: int = 4) -> DataFrame:
    """(kind, identity, surrogate) of all distinct units; surrogates are distinct and none is itself a unit, but
    given names and initials, which are few, may serve each other as surrogates.
    In a clash the least unit keeps its draw.  What still clashes after
    ``own_shape_draws`` draws gets a longer surrogate, by one part more at each further draw, so
    all units settle, however few surrogates their own shape has."""
    kind, identity = F.col("kind"), F.col("identity")
    few = kind.startswith("given") | (kind == "initial")
    # Words of names are told from each other by their kind, all else as it stands.
    domain = F.when(kind.isin(*NAME_UNITS), kind).otherwise(F.lit(""))
    open_ = staged(found.select("kind", "identity").distinct().withColumn("domain", domain), "units")
    real = open_.where(~few).select("domain", F.col("identity").alias("surrogate"))
    settled: DataFrame | None = None
    for attempt in count():
        wider = max(0, attempt + 1 - own_shape_draws)
        # Units are small rows but dear to draw for: they are dealt to all cores.
        dealt = open_.repartition(open_.sparkSession.sparkContext.defaultParallelism, "identity")
        drawn = staged(dealt.withColumn("surrogate", surrogate(kind, identity, key, F.lit(attempt), wider)), "drawn")
        changed = drawn.where(F.col("surrogate") != identity)
        first = changed.groupBy("domain", "surrogate").agg(F.min(F.struct("kind", "identity")).alias("unit"))
        good = first.join(real, ["domain", "surrogate"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("domain", "surrogate"), ["domain", "surrogate"], "left_anti")
        good = staged(good.select("unit.kind", "unit.identity", "domain", "surrogate"), "settled")
        settled = good if settled is None else staged(settled.unionByName(good), "settled-all")
        open_ = staged(open_.join(good.select("kind", "identity"), ["kind", "identity"], "left_anti"), "clashing")
        if open_.isEmpty():
            return settled.drop("domain")


def _laid(mention: Column, filling: Column, places: str) -> Column:
    """``mention`` with the characters that match ``places`` replaced by those of ``filling`` in turn; the rest of a longer ``filling`` follows."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(done: Column, char: Column) -> Column:
        ours = char.rlike(places)
        added = F.when(ours, F.substring(filling, done["at"], F.lit(1))).otherwise(char)
        return F.struct(F.concat(done["out"], added).alias("out"), (done["at"] + ours.cast("int")).alias("at"))

    return F.aggregate(F.split(mention, ""), start, step, lambda done: F.concat(done["out"], F.substring(filling, done["at"], F.length(filling))))


def _cased(mention: Column, word: Column) -> Column:
    """A word of a name, in capitals if the mention is, else with capital initials."""
    capitals = (F.length(mention) > 1) & (mention == F.upper(mention)) & ~mention.rlike(rf"^{INITIAL}$")
    return F.when(capitals, F.upper(word)).otherwise(F.array_join(F.transform(F.split(word, "-"), lambda part: F.initcap(part)), "-"))


def entity_table(found: DataFrame, key: str, own_shape_draws: int = 4) -> DataFrame:
    """(entity, surrogate, words) of all distinct entities; ``words`` holds (role and word, surrogate) of names,
    both in small letters."""
    entity, kind = F.col("entity"), F.col("kind")
    distinct = staged(found.select("entity").distinct().withColumn("kind", kind_of(entity)), "entities")
    parts = distinct.select("entity", kind.alias("of"), F.posexplode(units(entity, kind)).alias("at", "unit")).select("entity", "of", "at", "unit.*")
    parts = staged(parts, "entity-units")
    drawn = parts.join(unit_table(parts, key, own_shape_draws).withColumnRenamed("surrogate", "drawn"), ["kind", "identity"])
    grouped = drawn.groupBy("entity", F.col("of").alias("kind")).agg(F.sort_array(F.collect_list(F.struct("at", "drawn", F.col("kind").alias("role")))).alias("units"))
    one = F.col("units")[0]["drawn"]
    words = F.zip_with(_name_words(entity), F.col("units"), lambda word, unit: F.struct(unit["role"].alias("role"), word.alias("word"), unit["drawn"].alias("new")))
    title = F.regexp_extract(entity, rf"^({TITLE})", 1)
    name = F.aggregate(
        F.split(F.regexp_replace(entity, rf"^{TITLE}", ""), " "),
        F.struct(title.alias("out"), F.lit(0).alias("at")),
        lambda done, word: F.struct(
            F.concat(done["out"], F.when(done["out"] == title, F.lit("")).otherwise(F.lit(" ")), F.when(word.rlike(r"^\p{Lu}"), _cased(word, F.get(F.col("words"), done["at"])["new"])).otherwise(word)).alias("out"),
            (done["at"] + word.rlike(r"^\p{Lu}").cast("int")).alias("at"),
        ),
        lambda done: done["out"],
    )
    head = F.regexp_extract(entity, f"^({SECRET_HEAD})", 1)
    mail = F.array_join(F.zip_with(F.split(one, ""), F.split(entity, ""), lambda new, old: F.when(old.rlike("[A-Z]"), F.upper(new)).otherwise(F.coalesce(new, F.lit("")))), "")
    shown = (
        F.when(kind == "name", name)
        .when(kind == "email", mail)
        .when(kind == "secret", F.concat(head, one))
        .when(kind.isin("card", "ssn"), _laid(entity, one, "[0-9]"))
        .when(kind == "phone", _laid(entity, F.replace(one, F.lit("+"), F.lit("")), "[0-9]"))
        .when(kind == "iban", _laid(entity, one, "[A-Z0-9]"))
        .otherwise(one)
    )
    repeated = F.transform(
        F.filter(F.col("words"), lambda word: word["role"] != "initial"),
        lambda word: F.struct(F.concat_ws("/", word["role"], F.lower(word["word"])).alias("word"), word["new"].alias("new")),
    )
    listed = grouped.withColumn("words", F.when(kind == "name", words).otherwise(F.slice(words, 1, 0)))
    return staged(listed.select("entity", shown.alias("surrogate"), repeated.alias("words")), "entity-table")


def surrogate_table(found: DataFrame, key: str, own_shape_draws: int = 4) -> DataFrame:
    """(entity, surrogate) of all distinct entities."""
    return entity_table(found, key, own_shape_draws).select("entity", "surrogate")


def _words_replaced(piece: Column, words: Column) -> Column:
    """``piece`` with each word of a name that ``words`` (a map by role and word) holds replaced."""
    pattern = rf"(?<![\p{{L}}\p{{N}}]){NAME_WORD}(?![\p{{L}}\p{{N}}])"
    drawn = lambda word: F.coalesce(*(F.try_element_at(words, F.concat(F.lit(role + "/"), F.lower(word))) for role in ("family", "given-female", "given-male")))
    new = lambda word: F.coalesce(_cased(word, drawn(word)), word)
    between = F.split(piece, pattern, -1)
    tail = F.zip_with(F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))), F.regexp_extract_all(piece, F.lit(pattern), F.lit(0)), lambda rest, word: F.concat(new(word), F.coalesce(rest, F.lit(""))))
    return F.concat(F.element_at(between, 1), F.array_join(tail, ""))


def replaced(text: Column, found: Column, table: Column, words: Column) -> Column:
    """``text`` with each entity of ``found``, all that the pattern finds, replaced if ``table`` (a map) holds it, and
    between them each word of its names."""
    cut = F.split(text, ENTITY, -1)
    pieces = F.when(F.size(words) > 0, F.transform(cut, lambda piece: _words_replaced(piece, words))).otherwise(cut)
    tail = F.zip_with(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), found, lambda piece, entity: F.concat(F.coalesce(F.try_element_at(table, entity), entity), F.coalesce(piece, F.lit(""))))
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


def pseudonymised(docs: DataFrame, key: str = "surrogates-1", text_col: str = "text", count_col: str = "_n_entities") -> DataFrame:
    """``docs`` with its text replaced and ``count_col``, the number of entities found in it.

    A text without entities stays as it is, a null text stays null; both count none.
    Rows need no key: equal texts share their replacements, so repeated rows and null ids
    are no matter.  The longest text is one row of one task; there is no group larger than one
    text's distinct entities.  An empty table gives no rows; other columns, whatever their names, stay as they are.
    The key is the caller's secret: whoever has it can tell which surrogate a guessed value gets.
    """
    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    text = F.col(names[columns.index(text_col)])
    none = F.array().cast("array<string>")
    every = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), none)
    # The pattern passes over each text once here, and once more where a text with entities is cut.
    marked = staged(plain.withColumn("_all", every).withColumn("_found", F.filter("_all", _is_entity)), "pii-found")
    holding = marked.where(F.size("_found") > 0).withColumn("_key", F.unhex(F.md5(text)))
    mentions = staged(holding.select("_key", F.explode("_found").alias("entity")).distinct(), "mentions")
    entry = F.struct("entity", "surrogate")
    maps = staged(
        mentions.join(entity_table(mentions, key), "entity")
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_map"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("words")))).alias("_words")),
        "pii-maps",
    )
    swapped = holding.join(maps, "_key")
    new_text = replaced(text, F.col("_all"), F.col("_map"), F.col("_words"))
    one = swapped.select(*[new_text.alias(n) if c == text_col else F.col(n) for c, n in zip(columns, names)], F.size("_found").cast("long").alias("_n"))
    two = marked.where(F.size("_found") == 0).select(*names, F.lit(0).cast("long").alias("_n"))
    return one.unionByName(two).toDF(*columns, count_col)
