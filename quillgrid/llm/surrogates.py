"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

Addresses of mail and of machines, telephone and card numbers, account numbers
and names (behind a title or a phrase that introduces one, or with a listed
given name) are found by one pattern. A surrogate is a keyed permutation of its
entity: each letter or digit moves within its own class (vowels, consonants and
digits of its script), by an amount that depends on the key and on what stands
before it, then once more from the right. Equal entities (whatever their case,
or the marks between their digits) get one surrogate, distinct ones distinct
surrogates, and script, case, length and marks stay. A telephone number keeps
its country, told by its digits; a card or account number stays valid or
invalid by its check digits; a part of a machine address stays in its range and
a zero in the newer kind stays zero, so that short forms stay possible. A
listed given name becomes another of its gender and script; any other name
keeps the ending that shows its gender (the permutation is walked on until the
ending is read off the surrogate as well). A check over all distinct entities
takes the next tweak of the key if two entities share a surrogate, one has two,
or one is its own. A mention of over LONGEST characters becomes a keyed label
of its kind, <email-0f3a...>, in which 128 bits stand for it.

The key is a secret: who has it can undo the permutation. There is no default;
query() takes it from the session's quillgrid.surrogate.key, and draws one that
is forgotten with the run if that isn't set.

Defined results: a null text stays null and an empty one empty, with no entity;
repeated rows get the same result each; an empty table gives an empty result;
texts of any length are taken whole; of two kinds that fit at one place the
first in KINDS wins; columns that come along are kept, but for those named
text, n_entities and kinds, which are replaced.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Classes within which a character moves.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
)
#: Given names by gender and script; a name moves within its row.
GIVEN = (
    ("Mary", "Anna", "Emma", "Laura", "Sarah", "Julia", "Linda", "Karen", "Susan", "Alice", "Marie", "Claire", "Sophie", "Camille", "Lucía", "Carmen", "Elena", "Sofía", "Greta", "Heidi", "Ingrid", "Katrin"),
    ("John", "James", "Robert", "Michael", "William", "David", "Thomas", "Peter", "George", "Henry", "Pierre", "Jacques", "Louis", "Antoine", "Carlos", "Miguel", "Pablo", "Diego", "Hans", "Karl", "Jürgen", "Stefan"),
    ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Светлана", "Татьяна"),
    ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Алексей", "Николай", "Михаил"),
    ("Μαρία", "Ελένη", "Αικατερίνη", "Σοφία", "Άννα"),
    ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης"),
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία")
#: What a name of two words may stand behind.
PHRASES = ("name is ", "name: ", "Name: ", "signed by ", "Signed by ", "Contact: ", "contact person ", "Attn: ", "m'appelle ", "Name ist ", "me llamo ", "Nom : ", "Nombre: ", "зовут ", "με λένε ")
#: Endings that show the gender of a name; they stay.
ENDINGS = ("ova", "eva", "ina", "skaya", "ska", "dottir", "dóttir", "ова", "ева", "ёва", "ина", "ская", "ая", "a", "e", "o", "а", "я", "η", "α")
#: Calling codes of one and two digits, as patterns; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NAMES = tuple(x for row in GIVEN for x in row)
ALL_TITLES = tuple(dict.fromkeys((*TITLES, *(t.upper() for t in TITLES))))
CAPITALS = tuple(dict.fromkeys(n.upper() for n in NAMES))
_LOWER = r"\p{Lu}[\p{Ll}\p{M}]++(?:[-'’]\p{Lu}[\p{Ll}\p{M}]++)*+"
_UPPER = r"\p{Lu}{2,}+(?:[-'’]\p{Lu}{2,}+)*+"
_WORD = rf"(?:{_UPPER}(?!\p{{L}})|{_LOWER})"
_HEX = "[0-9A-Fa-f]{1,4}"


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of words that branches letter by letter, so that text without them is left at once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [re.escape(h) + (any_of(tuple(t)) if any(t) else "") for h, t in heads.items() if h]
    return f"(?:{'|'.join(parts)}){'?' if ends else ''}"


def any_behind(phrases: tuple[str, ...]) -> str:
    """A pattern to look behind for phrases, which all end alike."""
    return f"(?:{'|'.join(re.escape(p) for p in phrases)})"


def _start(words: tuple[str, ...]) -> str:
    """A look at the first letter, before anything else is tried."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?<!\\p{{L}})"


#: Kinds in the order in which they are tried. None holds a capturing group, and each first looks at one character.
KINDS = {
    "email": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?=[A-Za-z0-9])[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,}",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": rf"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]++(?![0-9A-Za-z]))(?=[A-Fa-f:]*+\d)(?!(?:[0-9A-Fa-f]*+:){{8}})(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?!\d)",
    "phone": r"(?=[\d+(])(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "national": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{any_of(ALL_TITLES)}\.? {_WORD}(?: {_WORD})?|{any_of(NAMES)} {_LOWER}|{any_of(CAPITALS)} {_UPPER}|(?<={any_behind(PHRASES)}){_WORD} {_WORD})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without an @ and without a match of this has no entity.
HINT = rf"\d\D{{0,3}}\d|{_start((*ALL_TITLES, *NAMES, *CAPITALS))}{any_of((*ALL_TITLES, *NAMES, *CAPITALS))}\.? \p{{Lu}}|:[0-9A-Fa-f]|(?=[ ]\p{{Lu}})(?<={any_behind(tuple(p.rstrip() for p in PHRASES))})"
DIGIT_KINDS = ("card", "phone", "national")
TWEAKS = 16
#: Steps along a cycle, at most, and letters of a mention from which it becomes a label.
WALK, LONGEST = 24, 320


def amount(key: str, *parts: Column) -> Column:
    """A keyed number from the digest of parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 12), 16, 10).cast("bigint")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def each_character(s: Column, new: Callable[[Column], Column]) -> Column:
    """A string of new(place) for each place of s."""
    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), new), "")).otherwise(F.lit(""))


def _passed(s: Column, key: str, salt: str, back: bool) -> Column:
    """Every character moved within its class, by an amount that depends on what stands before it.

    On the way there the first character stays; on the way back, where it is
    the last, it moves by at least one, so that no string is its own surrogate.
    """
    classes = F.array(*map(F.lit, CLASSES))

    def moved(i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        by = amount(key, F.lit(salt), F.substr(s, F.lit(1), i - 1))

        def within(letters: Column) -> Column:
            n = F.length(letters)
            step = F.when(i == F.length(s), 1 + F.pmod(by, n - 1)).otherwise(by) if back else F.when(i == 1, 0).otherwise(by)
            return F.substr(letters, (F.pmod(F.position(c, letters) - 1 + step, n) + 1).cast("int"), F.lit(1))

        own = F.filter(classes, lambda letters: F.contains(letters, c))
        return F.coalesce(F.element_at(F.transform(F.concat(own, F.array(F.lit(None).cast("string"))), within), 1), c)

    return each_character(s, moved)


def permuted(s: Column, key: str, salt: str) -> Column:
    """A permutation of the lower-case strings of each shape."""
    there = let(s, lambda x: F.reverse(_passed(x, key, f"{salt}<", False)))
    return F.reverse(let(there, lambda x: _passed(x, key, f"{salt}>", True)))


def relaid(like: Column, letters: Column) -> Column:
    """letters with upper case where like has it."""

    def laid(new: Column) -> Column:
        def cased(i: Column) -> Column:
            c, n = F.substr(like, i, F.lit(1)), F.substr(new, i, F.lit(1))
            return F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(n)).otherwise(n)

        return each_character(like, cased)

    return let(letters, laid)


def laid_digits(like: Column, digits: Column) -> Column:
    """digits in the places of like's digits."""

    def laid(new: Column) -> Column:
        def put(i: Column) -> Column:
            c = F.substr(like, i, F.lit(1))
            before = F.length(F.regexp_replace(F.substr(like, F.lit(1), i), r"\D", ""))
            return F.when(c.rlike(r"^\d$"), F.substr(new, before, F.lit(1))).otherwise(c)

        return each_character(like, put)

    return let(digits, laid)


def luhn(digits: Column) -> Column:
    """The check digit that belongs behind digits."""

    def weight(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight), F.lit(10))


def kind_of(s: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(s.rlike(rf"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _numbers(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda o: o.cast("int").cast("string"))


def hextets(s: Column) -> Column:
    """The eight numbers of a machine address of the newer kind, written out."""
    sides = F.split(s, "::")

    def parts(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda x: x != "")

    left, right = parts(F.element_at(sides, 1)), F.when(F.size(sides) > 1, parts(F.element_at(sides, -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    return F.transform(F.concat(left, zeros, right), lambda x: F.conv(x, 16, 10))


def entity(kind: Column, s: Column) -> Column:
    """What makes two mentions one entity: digits or numbers, or lower case without titles and blanks."""
    text = F.lower(F.when(kind == "name", F.regexp_replace(s, rf"^(?:{'|'.join(ALL_TITLES)})\.? ", "")).when(kind == "iban", F.regexp_replace(s, " ", "")).otherwise(s))
    out = F.when(kind.isin(*DIGIT_KINDS), F.concat(F.regexp_extract(s, r"^\+?", 0), F.regexp_replace(s, r"\D", "")))
    return out.when(kind == "ip", F.array_join(_numbers(s), ".")).when(kind == "ip6", F.array_join(hextets(s), ":")).otherwise(text)


def _card(s: Column, digits: Column, key: str) -> Column:
    size = F.length(digits)
    body, last = F.substr(digits, F.lit(2), size - 2), F.substr(digits, size, F.lit(1)).cast("int")
    old = F.substr(digits, F.lit(1), size - 1)

    def checked(front: Column) -> Column:
        return laid_digits(s, F.concat(front, F.pmod(luhn(front) + last - luhn(old), F.lit(10)).cast("string")))

    return let(F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted(body, key, "card")), checked)


def _phone(s: Column, digits: Column, key: str) -> Column:
    country = F.when(F.startswith(s, F.lit("+")), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(0)  # stays
    return laid_digits(s, let(country, lambda n: F.concat(F.substr(digits, F.lit(1), n), permuted(F.substr(digits, n + 1, F.length(digits)), key, "phone"))))


def _ip(s: Column, key: str) -> Column:
    def moved(octets: Column) -> Column:
        def octet(i: Column) -> Column:
            by = amount(key, F.lit("ip"), F.array_join(F.slice(octets, F.lit(1), i - 1), "."))
            step = F.when(i == 1, 1 + F.pmod(by, F.lit(255))).otherwise(by)
            return F.pmod(F.element_at(octets, i).cast("int") + step, F.lit(256)).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), octet), ".")

    return let(_numbers(s), moved)


def _ip6(s: Column, key: str) -> Column:
    def moved(old: Column) -> Column:
        def number(i: Column) -> Column:
            n, by = F.element_at(old, i).cast("int"), amount(key, F.lit("ip6"), F.array_join(F.slice(old, F.lit(1), i - 1), ":"))
            return F.when(n == 0, "0").otherwise(F.lower(F.conv((F.pmod(n - 1 + 1 + F.pmod(by, F.lit(65534)), F.lit(65535)) + 1).cast("string"), 10, 16)))

        return F.transform(F.sequence(F.lit(1), F.lit(8)), number)

    def laid(new: Column) -> Column:
        sides = F.split(s, "::")
        left, right = (F.size(F.filter(F.split(F.element_at(sides, i), ":"), lambda x: x != "")) for i in (1, -1))
        short = F.concat(F.array_join(F.slice(new, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(new, 9 - right, right), ":"))
        out = F.when(F.contains(s, F.lit("::")), short).otherwise(F.array_join(new, ":"))
        return F.when(s.rlike("[A-F]"), F.upper(out)).otherwise(out)

    return let(let(hextets(s), moved), laid)


def _email(s: Column, key: str) -> Column:
    local, domain = F.regexp_extract(s, "^(.*)@", 1), F.regexp_extract(s, r"@(.*)\.[^.]+$", 1)
    return F.concat(relaid(local, permuted(F.lower(local), key, "local")), F.lit("@"), relaid(domain, permuted(F.lower(domain), key, "domain")), F.regexp_extract(s, r"(\.[^.]+)$", 1))


def mod97(s: Column) -> Column:
    """The remainder of an account number's letters and digits, in which a letter is a number from 10 on."""

    def add(total: Column, i: Column) -> Column:
        c = F.upper(F.substr(s, i, F.lit(1)))
        n = F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
        return F.pmod(total * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(s: Column, key: str) -> Column:
    whole = F.regexp_replace(s, " ", "")
    bare, country = F.substr(whole, F.lit(5), F.length(whole)), F.substr(whole, F.lit(1), F.lit(2))

    def numbered(new: Column) -> Column:
        # the check digits that leave the old remainder: from 2 on, as those of a valid number are
        check = F.pmod(mod97(F.concat(bare, F.substr(whole, F.lit(1), F.lit(4)))) - mod97(F.concat(new, country, F.lit("00"))) - 2, F.lit(97)) + 2
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    def laid(new: Column) -> Column:
        def put(i: Column) -> Column:
            c = F.substr(s, i, F.lit(1))
            return F.when(c == " ", c).otherwise(F.substr(new, F.length(F.regexp_replace(F.substr(s, F.lit(1), i), " ", "")), F.lit(1)))

        return each_character(s, put)

    return let(let(relaid(bare, permuted(F.lower(bare), key, "iban")), numbered), laid)


def _name(s: Column, key: str) -> Column:
    title = F.regexp_extract(s, rf"^((?:{'|'.join(ALL_TITLES)})\.? )", 1)

    def spelt(word: Column) -> Column:
        """A word of a script without classes."""
        return F.initcap(F.translate(F.substring(F.sha2(F.concat(F.lit(key), F.lower(word)), 256), 1, 16), "0123456789", "ghijklmnop"))

    def stem_of(word: Column) -> Column:
        stem = F.regexp_extract(word, rf"^(..+?)(?:{'|'.join(ENDINGS)})$", 1)
        return F.when(stem == "", word).otherwise(stem)

    def moved(word: Column) -> Column:
        def walked(stem: Column) -> Column:
            """The next stem along the permutation's cycle that keeps the ending and makes no listed name, so that no two words meet."""
            ending = F.substr(F.lower(word), F.length(stem) + 1, F.length(word))

            def step(new: Column, i: Column) -> Column:
                whole = F.concat(new, ending)
                stays = (i > 0) & (stem_of(whole) == new) & ~F.initcap(whole).isin(*NAMES)
                return F.when(stays, new).otherwise(permuted(new, key, "name"))

            return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), stem, step), ending)

        return let(relaid(word, let(stem_of(F.lower(word)), walked)), lambda x: F.when(x == word, spelt(word)).otherwise(x))

    def named(word: Column) -> Column:
        out, plain = moved(word), F.initcap(F.lower(word))
        for row in GIVEN:
            places = F.array(*map(F.lit, row))
            by = F.pmod(amount(key, F.lit("given"), F.lit(row[0])), F.lit(len(row) - 1)) + 1
            at = F.array_position(places, plain)
            other = F.element_at(places, (F.pmod(at - 1 + by, F.lit(len(row))) + 1).cast("int"))
            out = F.when(at > 0, F.when(word == F.upper(word), F.upper(other)).otherwise(other)).otherwise(out)
        return out

    words = F.split(F.substr(s, F.length(title) + 1, F.length(s)), " ")
    return F.concat(title, F.array_join(F.transform(words, named), " "))


def surrogate(kind: Column, s: Column, key: str) -> Column:
    """The surrogate of one mention."""
    digits = F.regexp_replace(s, r"\D", "")
    out = _name(s, key)
    for name, new in (("iban", _iban(s, key)), ("ip6", _ip6(s, key)), ("email", _email(s, key)), ("ip", _ip(s, key)), ("card", let(digits, lambda d: _card(s, d, key))), ("phone", let(digits, lambda d: _phone(s, d, key))), ("national", laid_digits(s, permuted(digits, key, "national")))):
        out = F.when(kind == name, new).otherwise(out)
    return F.when(F.length(s) > LONGEST, label(kind, s, key)).otherwise(out)


def mentions(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.when(F.contains(text, F.lit("@")) | text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def label(kind: Column, s: Column, key: str) -> Column:
    """A label of one mention's entity in the place of a surrogate, for mentions too long for one."""
    return F.concat(F.lit("<"), kind, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, entity(kind, s)), 256), 1, 32), F.lit(">"))


def clashes(docs: DataFrame, key: str) -> int:
    """Surrogates that two entities share or that are their own entity, and entities with two surrogates, over all rows."""
    found = docs.select(F.explode(mentions(F.col("text"))).alias("s")).distinct().withColumn("kind", kind_of(F.col("s")))
    pairs = found.withColumn("new", surrogate(F.col("kind"), F.col("s"), key)).select("kind", entity(F.col("kind"), F.col("s")).alias("old"), entity(F.col("kind"), F.col("new")).alias("new"))
    sides = F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("new").alias("one"), F.col("old").alias("other")), F.struct(F.lit("old").alias("side"), F.col("old").alias("one"), F.col("new").alias("other"))))
    met = pairs.select("kind", sides.alias("x")).groupBy("kind", "x.side", "x.one").agg(F.min("x.other").alias("a"), F.max("x.other").alias("b"))
    return met.where("a <> b or side = 'old' and a = one").count()


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, n_entities, and kinds (the kind of each mention in order)."""
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.drop("n_entities", "kinds")
    columns = docs.columns
    docs = docs.toDF(*[c if c == "text" else f"_c{i}" for i, c in enumerate(columns)]).withColumn("_m", mentions(F.col("text")))
    gaps = F.split("text", PATTERN, -1)
    new = F.transform("_m", lambda m: let(kind_of(m), lambda kind: surrogate(kind, m, key)))
    woven = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    text = F.when(F.size("_m") > 0, woven).otherwise(F.col("text"))
    same = [text.alias(c) if c == "text" else F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)]
    return docs.select(*same, F.coalesce(F.size("_m"), F.lit(0)).cast("bigint").alias("n_entities"), F.transform("_m", kind_of).alias("kinds"))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity replaced, under the first tweak of the key without a clash. Permutations can't clash; digests of 64 bits, for scripts without classes, hardly do."""
    if not key:
        raise ValueError("surrogates need a key")
    for tweak in range(TWEAKS):
        if not clashes(docs, f"{key}#{tweak}"):
            return replaced(docs, f"{key}#{tweak}")
    raise ValueError(f"{TWEAKS} tweaks of the key clash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("quillgrid.surrogate.key", None) or secrets.token_hex(32)
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "text", "n_entities", "kinds")
