"""Surrogates for personal data, with DataFrame functions only.

One pattern finds the entities of a text. The names found by it are looked for again in their text
as bare words, so `Smith` is replaced after `Mr Smith` as in it. An entity's surrogate is a keyed function of its kind,
its value and an attempt number, alike wherever the entity stands, so mentions of one entity stay
mentions of one. Distinct entities are collected once and checked: where two got the same
surrogate, or one got another real entity's value, all but the first move on to the next attempt.
Only those few exceptions are joined back; other texts are rewritten where they were read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.llm.storage import free_names, stored

# Forms of address and given names by gender, and the letters of scripts.
ADDRESS = {
    "m": "Mr Sir Herr Monsieur Señor Sr Signor Г-н г-н Господин господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Signora Г-жа г-жа Госпожа госпожа".split(),
    "any": "Dr Doctor Prof Professor Доктор Профессор".split(),
}
GIVEN = {
    "m_latin": "James John Robert Michael William David Richard Thomas Charles Daniel Hans Karl Jürgen Pierre Jean "
    "Antoine Carlos Miguel Javier Pablo Adam Peter Paul George Edward José Luis Juan Pedro Giovanni".split(),
    "f_latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Anna Greta Ursula Marie "
    "Camille Sophie Lucía Carmen Isabel Elena Emma Laura Julia Maria Ana Eva Helen Alice Claire Giulia".split(),
    "m_cyrillic": "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил".split(),
    "f_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
CHARACTER = {"latin": "\\p{IsLatin}", "cyrillic": "\\p{IsCyrillic}", "greek": "\\p{IsGreek}"}

OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
NAME = "\\p{Lu}(?:[\\p{L}\\-]|['’](?!s(?!\\p{L})))+"
ADDRESSES = [w for group in ADDRESS.values() for w in group]
HEX = "[\\da-fA-F]{1,4}"
SECRET_NAME = "(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd)\\s{0,3}[=:]\\s{0,3}"
BEARER = "(?i:bearer)\\s{1,3}"
# Without quotes a value must have a digit, or it may be a word.
BARE = "(?=[^\\s\"']*\\d)[\\w\\-+/=~!@#$%^&*]++(?:\\.[\\w\\-+/=~!@#$%^&*]++)*+"
PATTERNS = {
    "secret": f"{SECRET_NAME}(?:[\"'][^\"'\\s]{{8,}}+(?=[\"'])|(?=[^\\s\"']{{8}}){BARE})|{BEARER}(?=[^\\s\"']{{16}}){BARE}",
    "email": "[\\p{L}\\d][\\p{L}\\d._%+\\-]*+@[\\p{L}\\d\\-]+(?:\\.[\\p{L}\\d\\-]+)*\\.\\p{L}{2,}",
    "ip": f"(?:{OCTET}\\.){{3}}{OCTET}(?!\\.?\\d)",
    # A short form with letters only may be a name in a program.
    "ip6": f"(?:{HEX}:){{7}}{HEX}(?![\\da-fA-F:])|(?=[a-fA-F:]*\\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}(?![\\w:])",
    "ssn": "\\d{3}-\\d{2}-\\d{4}(?![\\d\\-])",
    "phone": "(?:\\+\\d{1,3}[ .\\-]?)?(?:\\(\\d{2,4}\\)[ .\\-]?|\\d{2,4}[ .\\-])\\d{3,4}[ .\\-]?\\d{4}(?!\\d)|\\+\\d{8,15}(?!\\d)",
    "card": "\\d{4}(?:[ \\-]\\d{4}){3}(?!\\d)|\\d{13,19}(?!\\d)",
    "iban": "[A-Z]{2}\\d{2}(?: ?[A-Z\\d]{4}){3,7}(?: ?[A-Z\\d]{1,3})?(?![A-Z\\d])",
    "person": f"(?=[\\p{{Lu}}г])(?:(?:{'|'.join(ADDRESSES)})\\.? {NAME}|(?:{'|'.join(n for g in GIVEN.values() for n in g)}) {NAME})"
    f"(?: {NAME})?",
}
ORDER = ("secret", "email", "card", "ip", "ip6", "ssn", "phone", "iban", "person")
START = "(?<![\\p{L}\\d_.+])"
PERSON = START + PATTERNS["person"]
ENTITY = START + "(?=[\\p{L}\\d+(])(?:" + "|".join(PATTERNS[k] for k in ORDER)  # the names of a text and a bracket follow
SHORTEST_NAME = 3  # letters of a name that is looked for as a bare word
ATTEMPTS_AT_LENGTH = 6  # attempts before a surrogate may be longer than what it stands for
ROUNDS = 40


def kind_of(mention: Column) -> Column:
    out = F.lit("person")
    for kind in reversed(ORDER[:-1]):
        out = F.when(mention.rlike("\\A(?:" + PATTERNS[kind] + ")\\z" if kind != "secret" else f"\\A(?:{SECRET_NAME}|{BEARER})"), kind).otherwise(out)
    return out


def pieces_of(mention: Column) -> Column:
    """A mention as (kind, value): one, or the words of a name; kind '' is kept as it is."""
    words = F.split(mention, " ")
    address = F.lit(False)
    for w in ADDRESSES:
        address |= F.element_at(words, 1).isin(w, w + ".")
    def word(w: Column, i: Column) -> Column:
        kind = F.lit("name")
        for group, names in GIVEN.items():
            kind = F.when(w.isin(*names), f"given_{group}").otherwise(kind)
        return piece(F.when((i == 0) & address, "").otherwise(kind), w)

    kind = kind_of(mention)
    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(piece(kind, mention)))


def piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"))


def number(digest: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal digest of 64 bytes, again from its start after the last."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))


def redrawn(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """Every digit and letter replaced by one of its class, script and case; the rest kept."""

    def draw(c: Column, i: Column) -> Column:
        n = number(digest, i)
        out = F.when(c.rlike("\\A\\d\\z"), pick("0123456789", n))
        out = out.when(hexadecimal & c.rlike("\\A[a-f]\\z"), pick("abcdef", n)).when(hexadecimal & c.rlike("\\A[A-F]\\z"), pick("ABCDEF", n))
        for script, letters in LETTERS.items():
            out = out.when(c.rlike(f"\\A(?=\\p{{Lu}}){CHARACTER[script]}\\z"), pick(letters.upper(), n))
            out = out.when(c.rlike(f"\\A{CHARACTER[script]}\\z"), pick(letters, n))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), draw), "")


def luhn_digit(digits: Column) -> Column:
    """The check digit which makes these digits and it a valid card number."""
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0).cast("long"), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What stands for an entity; only distinctness needs more than this (see `attempts`)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), value), 512)
    never = F.lit(False)

    def kept_start(pattern: str, hexadecimal: Column = never) -> Column:
        start = F.regexp_extract(value, "(?s)\\A(" + pattern + ")", 1)
        return F.concat(start, redrawn(F.substring(value, F.char_length(start) + 1, F.char_length(value)), digest, hexadecimal))

    body = F.regexp_extract(value, "(?s)\\A(.*)\\.[^.]+\\z", 1)
    email = F.concat(redrawn(body, digest, never), F.substring(value, F.char_length(body) + 1, F.char_length(value)))
    octets = F.transform(F.split(value, "\\."), lambda o, i: (number(digest, i) % 254 + 1).cast("string"))
    digits = F.regexp_replace(value, "\\D", "")
    drawn = redrawn(value, digest, never)
    check = luhn_digit(F.substring(F.regexp_replace(drawn, "\\D", ""), F.lit(1), F.char_length(digits) - 1))
    valid = F.right(digits, F.lit(1)) == luhn_digit(F.substring(digits, F.lit(1), F.char_length(digits) - 1))
    last = F.when(valid, check).otherwise(
        F.when(F.right(drawn, F.lit(1)) == check, ((check.cast("int") + 1) % 10).cast("string")).otherwise(F.right(drawn, F.lit(1))))
    card = F.concat(F.substring(drawn, F.lit(1), F.char_length(drawn) - 1), last)
    secret_start = f"(?:{BEARER}|[^=:]*[=:]\\s{{0,3}}[\"']?)"
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(digest, i * 4 + 1, F.lit(4)))
    ip6 = F.when(attempt >= ATTEMPTS_AT_LENGTH, F.array_join(groups, ":")).otherwise(redrawn(value, digest, F.lit(True)))
    secret_value = F.regexp_extract(value, "(?s)\\A" + secret_start + "(.*)\\z", 1)
    longer = F.when(attempt >= ATTEMPTS_AT_LENGTH, redrawn(F.repeat(F.lit("x"), attempt - ATTEMPTS_AT_LENGTH + 1), F.reverse(digest), never)).otherwise("")
    out = F.when(kind == "", value).when(kind == "ip", F.array_join(octets, ".")).when(kind == "ip6", ip6).when(kind == "email", F.concat(longer, email))
    out = out.when(kind == "card", card).when(kind == "phone", kept_start("(?:\\+\\d{1,3})?"))
    out = out.when(kind == "secret", F.concat(kept_start(secret_start, secret_value.rlike("\\A(?:[0-9a-f]+|[0-9A-F]+)\\z")), longer))
    out = out.when(kind == "iban", kept_start("[A-Z]{2}")).when(kind == "ssn", drawn)
    for group, names in GIVEN.items():
        # A keyed round through the list: no name stands for itself, and one pair tells no other.
        turn = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).digest())
        place = F.array_position(F.lit(turn), value).cast("int")
        out = out.when(kind == f"given_{group}", F.element_at(F.lit(turn), place % len(turn) + 1))
    return out.otherwise(F.concat(drawn, longer))


def names_of(text: Column) -> Column:
    """The distinct names in a text's mentions of persons, without forms of address and initials."""
    pieces = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), pieces_of))
    names = F.filter(pieces, lambda p: (p["kind"] != "") & (F.char_length(p["value"]) >= SHORTEST_NAME))
    return F.when(text.rlike(PERSON), F.array_distinct(F.transform(names, lambda p: p["value"])))


def entity_pattern(text: Column) -> Column:
    """ENTITY and the text's own names as whole words; names have letters, hyphens and apostrophes only."""
    own = F.concat(F.lit("|(?:"), F.array_join(names_of(text), "|"), F.lit(")(?![\\p{L}\\d_])"))
    return F.concat(F.lit(ENTITY), F.when(F.size(names_of(text)) > 0, own).otherwise(""), F.lit(")"))


def mentions(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the distinct entities whose first surrogate was not free.

    Given names are a keyed turn of their list: distinct as they are, and real by design. Every
    round is written to the checkpoint folder, so later rounds and readers don't repeat it.
    """
    settled = entities.where(~F.col("kind").startswith("given_")).distinct().withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        settled = stored(settled.withColumn("out", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "entities")
        owner = settled.groupBy("kind", "out").agg(F.min(F.struct("attempt", "value"))["value"].alias("owner"), F.count("*").alias("n"))
        real = settled.select("kind", F.col("value").alias("out"), F.lit(True).alias("real"))
        clash = (
            settled.join(owner.where("n > 1"), ["kind", "out"], "left").join(real, ["kind", "out"], "left")
            .select("kind", "value", "attempt",
                    (F.coalesce(F.col("owner") != F.col("value"), F.lit(False)) | F.coalesce("real", F.lit(False))).alias("taken"))
        )
        clash = stored(clash.where("taken"), "clashes")
        if clash.isEmpty():
            return settled.where("attempt > 0").select("kind", "value", "attempt")
        again = clash.select("kind", "value", F.lit(1).alias("more"))
        settled = settled.drop("out").join(again, ["kind", "value"], "left").select(
            "kind", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"entities without a free surrogate after {ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in their texts and the number of mentions in n_entities.

    Null texts stay null with no mentions, texts without entities stay as they are, repeated rows
    get the same answer each, and an empty table stays empty. Other columns are kept; one called
    n_entities is replaced. Names, and values in two kinds, are entities of their kind. A word that
    is a name in one place of a text is a name all over it.
    """
    kept = [c for c in docs.columns if c != "n_entities"]
    pattern, h, s, odd_ = free_names(kept, 4)
    docs = docs.select(*kept, entity_pattern(F.col(text)).alias(pattern))
    found = mentions(F.col(text), F.col(pattern))
    pieces = F.flatten(F.transform(found, pieces_of))
    odd = attempts(docs.select(F.explode(pieces).alias("p")).select("p.*").where("kind <> ''"), key)
    # Only texts with such an entity have rows here; their number follows the rate of collisions.
    hashes = [F.xxhash64(text).alias(h), F.sha1(F.col(text).cast("binary")).alias(s)]
    where = docs.select(*hashes, F.explode(F.array_distinct(pieces)).alias("p"))
    exceptions = where.select(h, s, "p.*").join(odd, ["kind", "value"]).distinct().groupBy(h, s).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias(odd_))
    exceptions = stored(exceptions, "exceptions")
    joined = docs.select("*", *hashes).join(exceptions, [h, s], "left")

    def replaced(p: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(odd_, F.concat_ws("|", p["kind"], p["value"])), F.lit(0))
        return surrogate(p["kind"], p["value"], attempt, key)

    gaps = F.split(F.col(text), F.col(pattern), -1)
    new = F.transform(found, lambda m: F.array_join(F.transform(pieces_of(m), replaced), " "))
    whole = F.concat(F.element_at(gaps, 1), F.array_join(
        F.zip_with(new, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda s, g: F.concat(s, g)), ""))
    n = F.coalesce(F.size(found), F.lit(0))
    return joined.select(
        *[F.when(n > 0, whole).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in kept],
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_entities"),
    )
