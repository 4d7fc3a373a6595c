"""Surrogates for personal data, by DataFrame expressions alone.

Entities (mail, IP and IPv6 addresses, phone, card, account, passport and social security numbers, secrets; names after a title,
with a known given name, or beside words that go with persons) are found by patterns and replaced by surrogates of their kind. Words of a
name that a text gives in full are entities wherever else they stand in that text, so that a person who is named once more by
surname alone, or in capitals, is the same surrogate person; a street that bears the name keeps it. A surrogate is a keyed permutation of its kind's
own format: characters keep their class and script (digits, vowels, consonants, capitals, hexadecimal digits, letters of
other scripts), separators their place; a card number keeps its first digit and whether its check digit is right, an IP
address stays one, a mail address keeps its top-level domain, a given name becomes another of the same gender (the next in a
keyed order of the list), titles stay.
A permutation gives different entities different surrogates and one entity one surrogate wherever it occurs (numbers in
whatever grouping, mail addresses and surnames in whatever case), in this corpus and in the next. `collisions` checks that
on all entities of a table; the operator runs the check on what it has written and fails if it finds one. A surrogate of a
small space (an IP address, a name) may by chance be some other real entity; `real_surrogates` lists those of a table.

A null text stays null, an empty one empty; texts without an entity are returned as they are. Repeated rows are alike. Extra
columns are kept as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import cut

KEY = "tessella"
ROUNDS = 4

# Given names by gender (and script), and titles.
MALE = "Alexander Andreas Antonio Carlos Charles Daniel David Edward Francisco Frank George Hans Henri Jacques James Jean John Jose Juan Klaus Luis Manuel Mark Michael Miguel Paul Peter Pierre Richard Robert Stefan Thomas William Wolfgang".split()
FEMALE = "Alice Ana Anna Barbara Carmen Catherine Claire Dolores Elizabeth Emma Ingrid Isabel Jennifer Julia Karin Laura Linda Lucia Maria Marie Martha Mary Monika Nathalie Patricia Petra Sabine Sarah Sophie Susan Teresa Ursula".split()
CYRILLIC_MALE = "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Пётр Сергей".split()
CYRILLIC_FEMALE = "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split()
GIVEN = (MALE, FEMALE, CYRILLIC_MALE, CYRILLIC_FEMALE)
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Herr Frau Monsieur Madame Mademoiselle Mme Mlle Señor Señora Señorita Sr Sra Господин Госпожа".split()

# Words that stand before a person's name, and after one; words that make a name a street's.
BEFORE = "met told asked thanked called emailed phoned contact dear named paid married hired".split()
AFTER = "said says told asked met wrote thanked replied called emailed phoned lives lived works worked paid married signed".split()
STREETS = "Street St Road Rd Avenue Ave Lane Drive Square Court Boulevard".split()

_NAME = r"\p{Lu}[\p{L}\p{M}’'-]*\p{Ll}"
# Kinds, in order of precedence: pattern inside a text, and the whole of an entity.
PATTERNS = {
    "mail": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[\p{L}0-9-]++\.)+[A-Za-z]{2,}+",
    "secret": r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)\b[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?)[^\s\"',;]{4,}+",
    "key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}+\b|\b(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{1,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "passport": r"\b[A-Z]{1,2}\d{6,8}\b(?<=(?i:passport)(?: (?i:no|nr|number)\.?)?[ :#]{1,2}[A-Z]{1,2}\d{6,8})",
    "account": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ ./-]?\d{2,5}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w.-])0\d{2,4} \d{3,4} \d{3,4}(?![\w-])",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w])",
    "hex": r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b",
    "titled": rf"\b(?:{'|'.join(TITLES)})\b\.?\s{_NAME}(?:[ -]{_NAME}){{0,2}}+|\b(?:mr|mrs|ms|dr|prof)\b\.? (?:{'|'.join(n.lower() for n in MALE + FEMALE)}) \p{{Ll}}{{2,}}+|\b(?:{'|'.join(t.upper() for t in TITLES)})\b\.?\s\p{{Lu}}[\p{{Lu}}’'-]+(?: \p{{Lu}}{{2,}}+)?",
    "named": rf"\b(?:{'|'.join(MALE + FEMALE)}) {_NAME}\b|(?<![\p{{L}}\p{{M}}])(?:{'|'.join(CYRILLIC_MALE + CYRILLIC_FEMALE)}) {_NAME}(?![\p{{L}}\p{{M}}])",
    "cued": rf"(?<=\b(?i:{'|'.join(BEFORE)}) ){_NAME} {_NAME}\b|\b{_NAME} {_NAME}(?= (?:{'|'.join(AFTER)})\b|, (?:born|aged)\b)",
}
#: Entities by themselves, where the pattern looks at what stands before.
ALONE = {"passport": r"[A-Z]{1,2}\d{6,8}"}
NAMES = ("titled", "named", "cued")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity.
HINT = rf"[0-9@=:]|\b(?:{'|'.join(TITLES + [t.upper() for t in TITLES] + MALE + FEMALE)})\b|\p{{IsCyrillic}}|\b(?:mr|mrs|ms|dr|prof)\b|{PATTERNS['cued']}"

_LOWER_V, _LOWER_C = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ACCENTED = "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ"
ALPHABETS = ["0123456789", _LOWER_V, _LOWER_C, _LOWER_V.upper(), _LOWER_C.upper(), _ACCENTED, _ACCENTED.upper()]
HEX = ["0123456789abcdef", "ABCDEF"]
#: Letters of other scripts by ranges of code points: each stays in its range.
RANGES = [(0x0430, 32), (0x0410, 32), (0x03B1, 17), (0x0391, 17), (0x05D0, 27), (0x0627, 36), (0x0905, 53), (0x3042, 80), (0x30A2, 80), (0x4E00, 20902), (0xAC00, 11172)]


def _shifted(c: Column, by: Column, alphabets: list[str]) -> Column:
    out = None
    for a in alphabets:
        at = F.instr(F.lit(a), c)
        new = F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1))
        out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
    if alphabets is not HEX:
        code = F.ascii(c)
        for start, size in RANGES:
            new = F.pmod(code - start + by, F.lit(size)) + start
            out = out.when(code.between(start, start + size - 1), F.decode(F.unhex(F.lpad(F.hex(new.cast("long")), 4, "0")), "UTF-16BE"))
    return out.otherwise(c)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted(text: Column, kind: str, key: str, alphabets: list[str] = ALPHABETS) -> Column:
    """A keyed permutation of the strings of one length and the same classes at each place: a Feistel network whose halves are
    the odd and the even places; each round shifts one half by a digest of the other, read without regard to case."""

    def round_(chars: Column, r: Column) -> Column:
        other = F.array_join(F.transform(chars, lambda c, i: F.when(F.pmod(i + r, F.lit(2)) == 1, F.lower(c)).otherwise(F.lit("."))), "")
        digest = F.sha2(F.concat(F.lit(f"{key}\x00{kind}\x00"), r.cast("string"), F.lit("\x00"), other), 256)
        by = lambda d, i: F.conv(F.substring(d, F.pmod(i * 5, F.lit(59)).cast("int") + 1, F.lit(6)), 16, 10).cast("long") + i
        return _let(digest, lambda d: F.transform(chars, lambda c, i: F.when(F.pmod(i + r, F.lit(2)) == 0, _shifted(c, by(d, i), alphabets)).otherwise(c)))

    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.split(text, ""), round_), "")


def _refilled(template: Column, compact: Column) -> Column:
    """compact's characters at the letters and digits of template."""
    place = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(F.split(template, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(compact, place(i), F.lit(1))).otherwise(c)), "")


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def _check_digit(body: Column) -> Column:
    """Luhn's check digit of a string of digits."""
    digit = lambda i: F.substring(F.reverse(body), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, F.when(digit(i) * 2 > 9, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), lambda s, i: s + value(i))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _card(x: Column, key: str) -> Column:
    def make(digits: Column) -> Column:
        head, body, last = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2), F.substring(digits, -1, 1).cast("int")
        return _let(F.concat(head, permuted(body, "card", key)), lambda new: F.concat(new, F.pmod(_check_digit(new) + last - _check_digit(F.concat(head, body)), F.lit(10)).cast("string")))

    return _let(_compact(x), lambda d: _refilled(x, make(d)))


def _ip(x: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(x, r"\."), i).cast("int")
    start = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))

    def round_(s: Column, r: Column) -> Column:
        f = F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("ip"), r.cast("string"), s["b"].cast("string")), 256), 1, 4), 16, 10).cast("int")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f, F.lit(65536)).alias("b"))

    out = lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_), out)


def _name(x: Column, key: str) -> Column:
    """Word by word: titles stay, given names turn round within their gender's list, other words are permuted."""

    def word(w: Column) -> Column:
        out = F.when(F.regexp_replace(w, r"\.$", "").isin([*TITLES, *(t.upper() for t in TITLES), *(t.lower() for t in TITLES)]), w)
        for names in GIVEN:
            order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x00{n}".encode()).digest())
            listed = F.array(*map(F.lit, order))
            out = out.when(w.isin(names), F.element_at(listed, (F.pmod(F.array_position(listed, w), F.lit(len(order))) + 1).cast("int")))
        return out.otherwise(permuted(w, "name", key))

    # words and what parts them, alternately
    return F.array_join(F.zip_with(F.split(x, r"[\s-]+", -1), F.regexp_extract_all(x, F.lit(r"[\s-]+"), F.lit(0)), lambda w, s: F.concat(word(w), F.coalesce(s, F.lit("")))), "")


def _whole(kind: str) -> str:
    return rf"^(?:{ALONE.get(kind, PATTERNS[kind])})$"


def kind_of(x: Column) -> Column:
    """The kind of an entity; all names are of one kind."""
    out = None
    for kind in PATTERNS:
        hit = x.rlike(_whole(kind)) if kind not in NAMES else F.lit(True)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def surrogate(x: Column, key: str = KEY) -> Column:
    """The surrogate of an entity (a whole match of one of the patterns, or a word of a name)."""
    is_ = lambda kind: x.rlike(_whole(kind))
    tail = F.regexp_extract(x, r"\.[A-Za-z]+$", 0)
    secret_head = F.regexp_extract(x, rf"^(?i:[a-z_-]+[\"']?[ \t]*[=:][ \t]*[\"']?)", 0)
    secret = F.substring(x, F.length(secret_head) + 1, F.length(x))
    key_head = F.regexp_extract(x, r"^(?:[A-Z]{4}|[a-z]+[_-])", 0)
    dial = F.regexp_extract(x, r"^\+\d{1,3}(?=[ .(-])", 0)
    number = F.substring(x, F.length(dial) + 1, F.length(x))
    hexed = lambda v, kind: F.when(v.rlike(r"^[0-9a-f]+$"), permuted(v, kind, key, HEX)).otherwise(permuted(v, kind, key))
    grouped = lambda v, kind: _let(permuted(_compact(v), kind, key), lambda c: _refilled(v, c))
    return (
        F.when(is_("mail"), F.concat(permuted(F.substring(x, F.lit(1), F.length(x) - F.length(tail)), "mail", key), tail))
        .when(is_("secret"), F.concat(secret_head, hexed(secret, "secret")))
        .when(is_("key"), F.concat(key_head, permuted(F.substring(x, F.length(key_head) + 1, F.length(x)), "key", key)))
        .when(is_("ip"), _ip(x, key))
        .when(is_("ip6"), permuted(x, "ip6", key, HEX))
        .when(is_("passport"), permuted(x, "passport", key))
        .when(is_("account"), F.concat(F.substring(x, 1, 2), grouped(F.substring(x, F.lit(3), F.length(x)), "account")))
        .when(is_("phone"), F.concat(dial, grouped(number, "phone")))
        .when(is_("social"), grouped(x, "social"))
        .when(is_("card"), _card(x, key))
        .when(is_("hex"), hexed(x, "hex"))
        .otherwise(_name(x, key))
    )


def entities(text: Column) -> Column:
    """All entities of a text that its patterns find, in order; an empty array for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def mentions(found: Column) -> Column:
    """What else to look for in a text with these entities: its patterns, and the words of names (three letters or more), as they
    stand and in capitals, but not where they name a street."""
    is_name = lambda x: ~x.rlike("[0-9@=:]") & x.rlike("|".join(_whole(k) for k in ("titled", "named")) + rf"|^{_NAME} {_NAME}$")
    words = F.array_distinct(F.flatten(F.transform(F.filter(found, is_name), lambda x: F.split(x, r"[\s-]+"))))
    words = F.filter(words, lambda w: w.rlike(r"^\p{L}[\p{L}\p{M}’']{2,}$") & ~w.isin([*TITLES, *(t.upper() for t in TITLES)]))
    words = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.upper(w))))
    street = rf"(?! (?:{'|'.join(STREETS)})\b)"
    return _let(words, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(w, "|"), F.lit(r")(?![\p{L}\p{M}])" + street))).otherwise(F.lit(ANY)))


def _plain(table: DataFrame) -> DataFrame:
    """kind, entity and surrogate, apart from case."""
    return table.select(kind_of(F.col("entity")).alias("kind"), F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate"))


def pairs_of(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct (entity, surrogate) of a table's texts."""
    return docs.select(F.explode(entities(F.col("text"))).alias("entity")).distinct().withColumn("surrogate", surrogate(F.col("entity"), key))


def _colliding(pairs: DataFrame) -> DataFrame:
    return _plain(pairs).groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("entities")).where("entities > 1")


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, surrogate, entities) wherever entities that differ (apart from case and grouping) share a surrogate."""
    return _colliding(pairs_of(docs, key))


def real_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate) of surrogates that are themselves an entity of the same table."""
    table = _plain(pairs_of(docs, key)).distinct()
    return table.join(table.select("kind", F.col("entity").alias("surrogate")).distinct(), ["kind", "surrogate"], "left_semi").select("kind", "entity", "surrogate")


def pseudonymise(docs: DataFrame, key: str = KEY, check: bool = True) -> DataFrame:
    """docs with text's entities replaced, and n_entities (columns of that name are replaced).

    Entities are found once: the result is written with its pairs of entities and surrogates, and these are checked.
    """
    given = [c for c in docs.columns if c != "n_entities"]
    d = docs.select(*given).toDF(*["text" if c == "text" else f"column_{i}" for i, c in enumerate(given)])  # no clash with names of ours
    kept = d.columns
    d = d.withColumn("found", entities(F.col("text")))
    d = d.withColumn("pattern", F.when(F.size("found") > 0, mentions(F.col("found"))).otherwise(F.lit(ANY)))
    d = d.withColumn("found", F.when(F.size("found") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    d = d.withColumn("pairs", F.transform("found", lambda e: F.struct(e.alias("entity"), surrogate(e, key).alias("surrogate"))))
    parts = F.zip_with(F.split("text", F.col("pattern"), -1), "pairs", lambda a, b: F.array(a, F.coalesce(b["surrogate"], F.lit(""))))
    text = F.when(F.size("pairs") > 0, F.array_join(F.flatten(parts), "")).otherwise(F.col("text"))
    d = d.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], F.when(F.col("text").isNull(), 0).otherwise(F.size("pairs")).alias("n_entities"), "pairs")
    if check:
        d = cut(d, "surrogates")
        if bad := _colliding(d.select(F.explode("pairs").alias("p")).select("p.*").distinct()).take(1):
            raise RuntimeError(f"surrogates collide: {bad[0].kind}")
    return d.drop("pairs").toDF(*given, "n_entities")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_entities")
