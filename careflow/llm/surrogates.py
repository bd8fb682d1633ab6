"""Personal data: keyed, type-consistent surrogates. DataFrame functions only.

Entities are found by one pattern. Every entity is one or more units of a kind (the digits of
a phone number, the local part and host of an address, a given or family name of a gender
and script), in a normal form that all its spellings share. A unit's surrogate is made from a
keyed hash of kind and normal form, keeps length, character classes and separators, and is
taken only if no other unit of the kind has it and it is no unit of the corpus; otherwise the
next attempt's is tried. So equal units stay equal and different ones different. Units of marks
only get letters. After `PLAIN` attempts surrogates grow with every attempt, so none runs out.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careflow.llm.common import free, written

# The session setting that holds the key. Who knows it can work out the surrogate of a given unit.
KEY_SETTING = "careflow.surrogates.key"
# Attempts that keep the length, and signs by which each later one is longer than the one before.
PLAIN, GROWTH = 4, 4

# Titles by gender, with which a name is recognised.
TITLES = {
    "m": "Mr Mister Herr Monsieur Señor Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split(),
}
# Given names by script and gender, syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Daniel Emil Felix Gabriel Hugo Ivan Julian Karl Leo Martin Nils Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nina Olga Paula".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Софья Юлия".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λευτέρης Μάρκος Νίκος Πέτρος Σπύρος Στέλιος Τάσος Φώτης Χρήστος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ειρήνη Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Όλγα Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba del fen gor hal ker lan mor nel ost per ran sol tam ver wen".split(),
    "cyrillic": "ба вел гор дан жук зар кол лин мар ник ост пет рам сол тур шев".split(),
    "greek": "βαρ γιο δελ θαν καλ λαμ μαρ νικ παπ ραφ σταμ ταλ φιλ χαρ ψαρ ωλε".split(),
}
SCRIPTS = ("latin", "cyrillic", "greek")
# How made-up given names end, by script and gender.
ENDINGS = {
    ("latin", "m"): "in", ("latin", "f"): "a", ("cyrillic", "m"): "ей", ("cyrillic", "f"): "а",
    ("greek", "m"): "ος", ("greek", "f"): "α",
}

# Country codes of phone numbers; none begins another, and all not listed have three digits.
COUNTRY = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
# What keys begin with.
KEYS = "(?:sk|pk|rk|ghp|gho|ghs|xoxb|xoxp|glpat)[-_]"
# Every pattern begins where a run begins and has bounded repeats or takes the run to its end, so time grows with the text.
WORD = "\\p{Lu}\\p{L}{1,40}+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}+\.){1,8}[A-Za-z]{2,24}+",
    "secret": r"(?<![A-Za-z0-9_])(?:" + KEYS + r"[A-Za-z0-9_\-]{16,}+|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?=[0-9A-Fa-f]{0,63}[0-9])(?=[0-9A-Fa-f]{0,63}[A-Fa-f])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z_]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(t for v in TITLES.values() for t in v)})\.? {WORD}(?:[ \-]{WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Texts without any of these hold no entity.
HINT = "[0-9@]|" + "|".join(t for v in TITLES.values() for t in v) + f"|{KEYS}|AKIA"
TITLE = rf"^((?:{'|'.join(t for v in TITLES.values() for t in v)})\.? )"


def _kind(raw: Column) -> Column:
    kind = F.lit("card")
    for name in reversed(PATTERNS):
        kind = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def _script(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column) -> Column:
    return F.when(F.regexp_replace(title, "[. ]", "").isin(TITLES["m"]), "m").otherwise("f")


def _unit(before: Column, kind: Column, raw: Column, norm: Column) -> Column:
    return F.struct(before.alias("before"), kind.alias("kind"), raw.alias("raw"), norm.alias("norm"))


def units(raw: Column) -> Column:
    """The units of one entity, in order: what stands before each, its kind, spelling and normal form."""
    none, kind = F.lit(""), _kind(raw)
    local, host = F.substring_index(raw, "@", 1), F.substring_index(raw, "@", -1)
    email = F.array(
        _unit(none, F.lit("local"), local, F.lower(local)), _unit(F.lit("@"), F.lit("host"), host, F.lower(host))
    )
    title = F.regexp_extract(raw, TITLE, 1)
    words = F.split(F.regexp_replace(raw, TITLE, ""), "[ \\-]")
    marks = F.concat(F.array(title), F.regexp_extract_all(F.regexp_replace(raw, TITLE, ""), F.lit("[ \\-]"), F.lit(0)))

    def word(w: Column, i: Column) -> Column:
        role = F.when(i == F.size(words) - 1, F.concat(F.lit("family_"), _script(w))).otherwise(
            F.concat(F.lit("given_"), _script(w), F.lit("_"), _gender(title))
        )
        return _unit(F.get(marks, i), role, w, F.lower(w))

    digits = F.regexp_replace(raw, "[^0-9A-Za-z+]", "")
    # The country code of a phone number and the country of an account are part of the kind.
    land = F.when(kind == "phone", F.regexp_extract(digits, rf"^(\+(?:{COUNTRY}))", 1)).when(kind == "iban", F.substring(raw, 1, 2)).otherwise("")
    luhn = F.when((kind == "card") & _luhn_ok(digits), "luhn").otherwise("")
    plain = F.array(
        _unit(none, F.concat_ws(":", kind, land, luhn), raw, F.when(kind.isin("secret", "iban"), F.lower(digits)).otherwise(digits))
    )
    plain = F.when((kind == "secret") & ~raw.rlike("^[0-9A-Fa-f]+$"), F.array(_unit(none, F.lit("key::"), raw, raw))).otherwise(plain)
    return F.when(kind == "email", email).when(kind == "name", F.transform(words, word)).otherwise(plain)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits, every second from the right but one doubled."""
    turned = _characters(F.reverse(digits))

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(turned, part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _luhn_ok(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def key_of(spark: SparkSession) -> str:
    """The session's key; a session without one gets a random key of its own."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def normal(kind: Column, made: Column) -> Column:
    """The normal form of a surrogate, by which it is compared with the corpus."""
    return F.when(kind.startswith("key:"), made).otherwise(F.lower(made))


def surrogate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The attempt's surrogate of a normal form: of the same character classes and, in the first
    `PLAIN` attempts, of the same length; `GROWTH` signs longer with every attempt from there."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)))
    h = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])
    grown = GROWTH * max(0, attempt - PLAIN + 1)
    further = [F.sha2(F.concat(seed, F.lit(f"|more{i}")), 256) for i in range(-(-grown // 32))]

    def byte(i: Column) -> Column:
        return F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")

    def more(i: int) -> Column:
        """The bytes of what a later attempt adds."""
        return F.conv(F.substr(further[i // 32], F.lit(2 * (i % 32) + 1), F.lit(2)), 16, 10).cast("int")

    def added(first: int, count: int) -> Column:
        return F.concat(F.lit(""), *[F.char(first + more(i) % count) for i in range(grown)])

    base = F.substring_index(kind, ":", 1)
    prefix = F.regexp_extract(norm, "^(AKIA|[a-z]+[-_])", 1)
    # Marks stay, but a unit of marks only would stay itself.
    marks = ~F.when(base == "key", F.substr(norm, F.length(prefix) + 1, F.length(norm))).otherwise(norm).rlike("[0-9A-Za-z]")

    def alike(c: Column, i: Column) -> Column:
        b = byte(i % 128)
        return (
            F.when(c.rlike("[0-9]"), F.char(48 + b % 10)).when(c.rlike("[a-z]") | marks, F.char(97 + b % 26))
            .when(c.rlike("[A-Z]"), F.char(65 + b % 26)).otherwise(c)
        )

    chars = _characters(norm)
    same = F.array_join(F.transform(chars, alike), "")
    land = F.regexp_replace(F.get(F.split(kind, ":"), F.lit(1)), "[+]", "")
    # What stays of the normal form: the country, the plus sign, the prefix of a key.
    stays = F.when(base == "phone", F.length(land) + F.when(norm.startswith("+"), 1).otherwise(0)).when(base == "iban", 2).when(
        base == "key", F.length(prefix)
    ).otherwise(0)
    digits, letters = added(48, 10), added(97, 26)
    kept = F.concat(F.substr(norm, F.lit(1), stays), F.substr(same, stays + 1, F.length(norm)))
    kept = F.concat(kept, F.when(base.isin("phone", "iban", "ssn"), digits).otherwise(letters))
    # A valid check digit stays valid.
    head = F.concat(F.substr(same, F.lit(1), F.length(norm) - 1), digits)
    check = (10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    card = F.when(kind.endswith("luhn"), F.concat(head, check.cast("string"))).otherwise(F.concat(same, digits))
    # Reserved addresses: no host has them. Later attempts take the longer ones kept for documents.
    if not grown:
        ip = F.concat_ws(".", 240 + byte(F.lit(0)) % 16, byte(F.lit(1)), byte(F.lit(2)), byte(F.lit(3)))
    else:
        ip = F.concat_ws(":", F.lit("2001:db8"), *[F.substr(h, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])
    host = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.char(97 + byte(i) % 26)), "")
    host = F.concat(host, letters, F.lit(".example.org"))
    hexed = F.concat(F.substr(h, F.lit(1), F.length(norm)), *[F.substr(F.lower(F.hex(more(i))), F.lit(-1), F.lit(1)) for i in range(grown)])
    out = F.when(base == "secret", hexed).when(base == "ip", ip).when(base == "host", host).when(base == "card", card)
    for (script, gender), names in GIVEN.items():
        if not attempt:
            name = F.get(F.array(*map(F.lit, names)), byte(F.lit(0)) % len(names))
        else:
            # When the plain names are taken, names are made up; later ones are longer.
            made_up = [*[byte(F.lit(i)) for i in range(2)], *map(more, range(grown // 2))]
            name = F.concat(F.initcap(_syllables(script, made_up)), F.lit(ENDINGS[script, gender]))
        out = out.when(kind == f"given_{script}_{gender}", name)
    for script in SCRIPTS:
        family = F.initcap(_syllables(script, [byte(F.lit(10 + 3 * i)) for i in range(4)]))
        out = out.when(kind == f"family_{script}", F.concat(family, _syllables(script, map(more, range(grown)))))
    return out.otherwise(kept)


def _syllables(script: str, bytes_) -> Column:
    pool = F.array(*map(F.lit, SYLLABLES[script]))
    return F.concat(F.lit(""), *[F.get(pool, b % 16) for b in bytes_])


def spelled(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the spelling of the entity: its separators and its upper case."""
    chars = _characters(raw)
    sign = "[0-9A-Za-z+]"

    def at(c: Column, i: Column) -> Column:
        # How many signs stand up to here tells which sign of the surrogate comes.
        upto = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9A-Za-z+]", ""))
        return F.when(c.rlike(sign), F.substr(made, upto, F.lit(1))).otherwise(c)

    base = F.substring_index(kind, ":", 1)
    # A grown surrogate has more signs than the entity; they follow its last one.
    rest = F.substr(made, F.length(F.regexp_replace(raw, "[^0-9A-Za-z+]", "")) + 1, F.length(made))
    laid = F.concat(F.array_join(F.transform(chars, at), ""), rest)
    laid = F.when(base.isin("phone", "card", "ssn", "iban"), laid).otherwise(made)
    return F.when((base != "key") & (raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(laid)).otherwise(laid)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made): a surrogate per unit, all different within a kind and none a unit itself."""
    taken = None
    pending = entities.select("kind", "norm")
    attempt = 0
    while True:
        tried = pending.withColumn("made", surrogate(F.col("kind"), F.col("norm"), attempt, key))
        tried = written(tried.withColumn("form", normal(F.col("kind"), F.col("made"))), "tried")
        # One unit per surrogate, whatever the spelling; counted before the shuffle.
        won = tried.groupBy("kind", "form").agg(F.min("norm").alias("norm"))
        won = won.join(entities.select("kind", F.col("norm").alias("form")), ["kind", "form"], "left_anti")
        if taken is not None:
            won = won.join(taken.select("kind", "form"), ["kind", "form"], "left_anti")
        won = won.join(tried.select("kind", "norm", "made"), ["kind", "norm"]).select("kind", "norm", "made", "form")
        taken = written(won if taken is None else taken.unionByName(won), "surrogates")
        pending = tried.join(taken.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm")
        if pending.isEmpty():
            return taken.drop("form")
        attempt += 1


def replace_personal(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """`docs` with all its columns, entities in `text` replaced by their surrogates.

    `count` names a column to add with the number of entities. Null and empty texts stay as
    they are, with 0 entities; so does all text outside the entities, and every text without
    any. Repeated rows are replaced alike. No rows give no rows. The same key and corpus give the
    same surrogates; without a key that of the session counts (`key_of`).
    """
    key = key or key_of(docs.sparkSession)
    if count in docs.columns:
        raise ValueError(f"there is already a column {count}")
    body = F.col(f"`{text}`")
    none = F.array().cast("array<string>")
    found = F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(none)
    found = F.coalesce(found, none)
    own, rid, listed = free(docs, "__found", "__rid", "__entities")
    counted = [F.size(own).cast("bigint").alias(count)] if count else []
    every = docs.withColumn(own, found)
    with_any = written(every.where(F.size(own) > 0).withColumn(rid, F.monotonically_increasing_id()), "personal")
    places = with_any.select(F.col(rid).alias("rid"), F.posexplode(own).alias("pos", "entity"))
    places = places.select("rid", "pos", F.posexplode(units(F.col("entity"))).alias("part", "u")).select("rid", "pos", "part", "u.*")
    places = written(places, "personal-units")
    made = assign(written(places.select("kind", "norm").distinct(), "entities"), key)
    # One row per unit on the right; a unit of very many places is split by adaptive execution.
    named = places.join(made, ["kind", "norm"])
    piece = F.concat("before", spelled(F.col("kind"), F.col("raw"), F.col("made")))
    pieces = named.select("rid", "pos", F.struct("part", piece.alias("piece")).alias("p"))
    entities = pieces.groupBy("rid", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("entity")
    )
    # In order of place, so the entity after a gap is found by its index.
    by_text = entities.groupBy(F.col("rid").alias(rid)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda e: e["entity"]).alias(listed)
    )
    between = F.split(body, ANY, -1)
    follows = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(F.col(listed), i), F.lit(""))))
    changed = with_any.join(by_text, rid).withColumn(text, F.array_join(follows, ""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = every.where(F.size(own) == 0)
    return rest.select(*columns, *counted).unionByName(changed.select(*columns, *counted))


def surrogates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, text with surrogates, n_entities."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return replace_personal(wanted, count="n_entities")
