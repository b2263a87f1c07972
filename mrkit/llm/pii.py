"""Personal data and secrets replaced by keyed surrogates, in DataFrame functions alone.

One pattern finds e-mail addresses, telephone numbers, card and account numbers, social security numbers, IPv4
addresses, secrets and names behind a title. Each is replaced by one of its own type and layout: digits by digits,
letters by letters of the same script and case, vowels of names by vowels. Well-known first names become others of the
same gender and script. The check digit of a card stays right or wrong as it was; calling codes, country codes and
titles stay; addresses end in a reserved domain.

The surrogate is a keyed permutation of the contents: the two halves of the characters are numbers, and each is
shifted in turn by a digest of the key and the other. So one entity has one surrogate wherever it occurs, however it
is punctuated (coreference), and different ones of one type and layout have different surrogates, without a table of
entities. Contents of more than ``2 * HALF`` characters take characters of a digest. ``collisions`` checks
distinctness over a corpus; ``replace_private`` does so first and takes the next salt of the key if any two entities
would meet.

A corpus is read twice, rows stay where they are, and only entities that collide would ever reach the driver, as a
count.

Defined results: a NULL text stays NULL and has no entities, an empty one stays empty. Repeated rows are treated
alike. Rows without an id are treated as any other. All columns of the documents stay as they are, but for ``text``;
helper columns get names that are free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import free_name

# Characters in half of a permuted content; 35 ** 12 fits into a long.
HALF = 12
ROUNDS = 3
SALTS = 8

# Letters by script, vowels and consonants apart.
DIGITS = "0123456789"
HEX = "0123456789abcdef"
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
VOWELS = ["aeiou", "àáâãäåæèéêëìíîïòóôõöøùúûü", "аеиоуыэюя", "αεηιουω"]
CONSONANTS = ["bcdfghjklmnpqrstvwxyz", "çðñýþÿß", "бвгджзйклмнпрстфхцчшщъь", "βγδζθκλμνξπρστφχψ"]

# Titles, and well-known first names, by gender and script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Госпожа"], "m": ["Mr", "Herr", "Monsieur", "Sr", "Господин"]}
FIRST_NAMES = {
    "f": [["Anna", "Clara", "Emma", "Julia", "Laura", "Maria", "Nora", "Sara"], ["Анна", "Вера", "Елена", "Мария", "Ольга"]],
    "m": [["Carl", "David", "Felix", "Jonas", "Lucas", "Martin", "Paul", "Simon"], ["Борис", "Иван", "Олег", "Павел", "Сергей"]],
}

_TITLE = "|".join(title for titles in TITLES.values() for title in titles)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# In this order, as the first that matches at a place counts.
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk-|ghp_|gho_|xoxb-)[A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
PATTERN = "|".join(KINDS.values())
# No entity without one of these.
HINT = rf"[0-9@]|AKIA|ASIA|sk-|gh[po]_|xoxb-|[a-f]{{32}}|[A-F]{{32}}|(?:{_TITLE})\.? \p{{Lu}}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(*parts: Column) -> Column:
    """A number of 60 bits that depends on all parts."""
    whole = F.sha2(F.concat_ws("\u001f", *(part.cast("string") for part in parts)), 256)
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


# What a part's characters are taken from.
GENERAL, HEXADECIMAL, NAME, CARD = range(4)


def _alphabet(c: Column, kind: Column) -> Column:
    """The alphabet of a lower-case character, NULL for one that stays."""
    among = lambda alphabets: F.coalesce(*(F.when(F.instr(F.lit(a), c) > 0, F.lit(a)) for a in alphabets))
    listed = F.when(kind == HEXADECIMAL, among([HEX])).when(kind == NAME, among([*VOWELS, *CONSONANTS]))
    return F.when(c != "", listed.otherwise(among([DIGITS, *LETTERS])))


def _at(alphabet: Column, number: Column) -> Column:
    return F.substring(alphabet, (F.pmod(number, F.length(alphabet)) + 1).cast("int"), F.lit(1))


def _div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, exact also where doubles are not."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b).cast("long")


def permuted(items: Column, tweak: Column) -> Column:
    """The image of an array of ``(a, d)``, alphabets and places in them, as an array of characters."""
    half = F.floor(F.size(items) / 2).cast("int")
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m"))
    read = lambda part: F.aggregate(
        part,
        start,
        lambda s, x: F.struct((s["v"] * F.length(x["a"]) + x["d"]).alias("v"), (s["m"] * F.length(x["a"])).alias("m")),
    )
    write = lambda part, value: F.aggregate(
        F.reverse(part),
        F.struct(value.alias("v"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            _div(s["v"], F.length(x["a"])).alias("v"),
            F.concat(F.array(_at(x["a"], s["v"])), s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    left, right = F.slice(items, F.lit(1), half), F.slice(items, half + 1, F.size(items) - half)

    # The halves change places in every round, so an even number of rounds leaves them in order.
    def turn(s: Column, i: Column) -> Column:
        shifted = F.pmod(s["l"] + F.pmod(_digest(tweak, i, s["r"]), s["ml"]), s["ml"])
        return F.struct(s["r"].alias("l"), shifted.alias("r"), s["mr"].alias("ml"), s["ml"].alias("mr"))

    both = let(
        F.struct(read(left).alias("a"), read(right).alias("b")),
        lambda p: F.struct(
            p["a"]["v"].alias("l"), p["b"]["v"].alias("r"), p["a"]["m"].alias("ml"), p["b"]["m"].alias("mr")
        ),
    )
    turned = F.aggregate(F.array(*map(F.lit, range(2 * ROUNDS))), both, turn)
    short = let(turned, lambda n: F.concat(write(left, n["l"]), write(right, n["r"])))
    whole = F.array_join(F.transform(items, lambda x: F.concat_ws("", x["a"], x["d"].cast("string"))), "")
    long = F.transform(items, lambda x, i: _at(x["a"], _digest(tweak, whole, i)))
    return F.when(F.size(items) <= 2 * HALF, short).otherwise(long)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and reduced, the last one among them."""
    value = lambda d, i: let(
        d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)
    )
    return F.aggregate(F.transform(F.reverse(digits), value), F.lit(0), lambda a, x: a + x)


def _card(items: Column, tweak: Column) -> Column:
    """All digits but the last permuted; that is as far from the right check digit as it was."""
    body = F.slice(items, F.lit(1), F.size(items) - 1)
    old = F.element_at(items, -1)["d"] + _luhn(F.transform(body, lambda x: x["d"]))
    last = lambda new: F.array(F.pmod(old - _luhn(new), F.lit(10)).cast("string"))
    return let(permuted(body, tweak), lambda new: F.concat(new, last(new)))


def _image(part: Column) -> Column:
    """A part ``(keep, body, tweak, kind)`` with its body replaced character by character, in the case it had."""
    described = F.transform(
        F.split(part["body"], ""),
        lambda c: let(
            _alphabet(F.lower(c), part["kind"]),
            lambda a: F.struct(c.alias("c"), a.alias("a"), (F.instr(a, F.lower(c)) - 1).alias("d")),
        ),
    )

    def put(new: Column) -> Callable[[Column, Column], Column]:
        def add(s: Column, x: Column) -> Column:
            fits, own = x["a"].isNotNull(), F.get(new, s["i"])
            own = F.when(x["c"] != F.lower(x["c"]), F.upper(own)).otherwise(own)
            return F.struct(
                F.when(fits, s["i"] + 1).otherwise(s["i"]).alias("i"),
                F.concat(s["out"], F.when(fits, own).otherwise(x["c"])).alias("out"),
            )

        return add

    def replaced(chars: Column) -> Column:
        items = F.filter(chars, lambda x: x["a"].isNotNull())
        new = let(items, lambda i: F.when(part["kind"] == CARD, _card(i, part["tweak"])).otherwise(permuted(i, part["tweak"])))
        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
        return let(new, lambda n: F.aggregate(chars, start, put(n), lambda s: s["out"]))

    # A digit may become a letter there, which has the case of the others.
    capitals = (part["kind"] == HEXADECIMAL) & (part["body"] == F.upper(part["body"]))
    whole = let(described, replaced)
    return F.concat(part["keep"], let(whole, lambda text: F.when(capitals, F.upper(text)).otherwise(text)))


def _part(keep: Column, body: Column, tweak: Column, kind: int) -> Column:
    return F.struct(keep.alias("keep"), body.alias("body"), tweak.alias("tweak"), F.lit(kind).alias("kind"))


def _known_first_name(title: Column, name: Column, tweak: Column) -> Column:
    """Another first name of the list the name is in, if the title has the list's gender."""
    known = F.lit(None).cast("string")
    for gender, titles in TITLES.items():
        for listed in FIRST_NAMES[gender]:
            words = F.array(*map(F.lit, listed))
            # A rotation of the list by a secret step, never by none.
            step = 1 + F.pmod(_digest(tweak, F.lit(listed[0])), F.lit(len(listed) - 1))
            turned = F.get(words, F.pmod(F.array_position(words, name) - 1 + step, F.lit(len(listed))).cast("int"))
            known = F.when(F.rtrim(F.replace(title, F.lit("."))).isin(titles) & F.array_contains(words, name), turned).otherwise(known)
    return known


def _parts(entity: Column, kind: Column, key: Column) -> Column:
    """What is kept and what is replaced of an entity, in order."""
    tweak, nothing = F.concat(key, kind), F.lit("")
    behind = lambda head: F.array(_part(
        F.regexp_extract(entity, head, 0), F.regexp_replace(entity, head, ""), F.concat(tweak, F.regexp_extract(entity, head, 0)), GENERAL
    ))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.array(
        _part(nothing, local, F.concat(tweak, F.lower(domain)), GENERAL), _part(F.lit("@"), domain, tweak, GENERAL)
    )
    hexadecimal = entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    title = F.regexp_extract(entity, rf"^(?:{_TITLE})\.? ", 0)
    names = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    first, last = F.get(names, 0), F.get(names, 1)
    known = _known_first_name(title, first, tweak)
    full = F.array(
        F.when(known.isNotNull(), _part(F.concat(title, known), nothing, tweak, NAME)).otherwise(_part(title, first, tweak, NAME)),
        _part(F.lit(" "), last, tweak, NAME),
    )
    octets = F.transform(F.split(entity, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("long")), 2, "0")))
    return (
        F.when(kind == "email", email)
        .when((kind == "secret") & hexadecimal, F.array(_part(nothing, entity, tweak, HEXADECIMAL)))
        .when(kind == "secret", behind("^(?:AKIA|ASIA|sk-|ghp_|gho_|xoxb-)"))
        .when(kind == "ip", F.array(_part(nothing, F.array_join(octets, ""), tweak, HEXADECIMAL)))
        .when(kind == "phone", behind(r"^\+\d{1,3}(?=\D)"))
        .when(kind == "iban", behind("^[A-Z]{2}"))
        .when(kind == "card", F.array(_part(nothing, entity, tweak, CARD)))
        .when(kind == "ssn", F.array(_part(nothing, entity, tweak, GENERAL)))
        .when(F.size(names) > 1, full)
        .otherwise(F.array(_part(title, first, tweak, NAME)))
    )


def surrogate(entity: Column, key: Column) -> Column:
    """The surrogate of an entity that the pattern has found."""
    kind = F.lit("name")
    for name in reversed(list(KINDS)[:-1]):
        kind = F.when(entity.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(kind)

    def written(parts: Column, kind: Column) -> Column:
        text = F.array_join(F.transform(parts, _image), "")
        dotted = lambda t: F.concat_ws(".", *(F.conv(F.substring(t, 2 * i + 1, 2), 16, 10) for i in range(4)))
        return let(
            text, lambda t: F.when(kind == "ip", dotted(t)).when(kind == "email", F.concat(t, F.lit(".example"))).otherwise(t)
        )

    return let(kind, lambda k: let(_parts(entity, k, key), lambda parts: written(parts, k)))


def entities(text: str | Column) -> Column:
    """The entities of a text, in order; none for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(none)


def collisions(documents: DataFrame, key: str) -> DataFrame:
    """``(surrogate, n)`` for surrogates of more than one entity of the documents; layout and case do not tell entities apart."""
    found = documents.select(F.explode(entities("text")).alias("entity")).distinct()
    found = found.withColumn("surrogate", surrogate(F.col("entity"), F.lit(key)))
    return found.groupBy("surrogate").agg(F.count("*").alias("n")).where("n > 1")


def replace_private(documents: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, str]:
    """``documents`` with surrogates in their texts and the name of a column that counts entities."""
    for salt in range(SALTS):
        salted = f"{key}/{salt}"
        if not collisions(documents.select(F.col(text).alias("text")), salted).limit(1).count():
            break
    else:
        raise ValueError("entities collide under every salt of the key")
    found, count = free_name(documents, "entities"), free_name(documents, "n_entities")
    rows = documents.withColumn(found, entities(text))
    new = F.transform(found, lambda e: surrogate(e, F.lit(salted)))
    pieces = F.split(text, PATTERN, -1)
    between = F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda piece, e: F.array(piece, e))
    whole = F.when(F.size(found) > 0, F.array_join(F.flatten(between), "")).otherwise(F.col(text))
    return rows.withColumn(text, whole).withColumn(count, F.size(found)).drop(found), count


def surrogate_documents(documents: DataFrame, key: str) -> DataFrame:
    """``(doc_id, text, n_entities)``."""
    replaced, count = replace_private(documents.select("doc_id", "text"), key)
    return replaced.select("doc_id", "text", F.col(count).alias("n_entities"))
