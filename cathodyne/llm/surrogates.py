"""Surrogates for personal data, in DataFrame functions only (operator 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import column_free_of, discard, keep, let

# Titles by gender, given names by script and gender, syllables of surnames by script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Signora", "Госпожа", "Κυρία", "señora", "señorita", "madame", "mademoiselle", "doña"]
MALE_TITLES = ["Mr", "Herr", "M", "Sr", "Signor", "Господин", "Κύριος", "señor", "monsieur", "don"]
OTHER_TITLES = ["Dr", "Prof"]
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Laura", "Julia", "Emma", "Clara", "Alice", "Nora", "Elena", "Sofia", "Marta", "Ines", "Paula", "Helen", "Rosa", "Eva"],
    ("latin", "m"): ["John", "Peter", "Paul", "David", "Daniel", "Martin", "Thomas", "Robert", "Pablo", "Luis", "Hugo", "Oscar", "Felix", "Simon", "Leon", "Victor"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Николай", "Михаил", "Павел"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Δήμητρα", "Ιωάννα", "Χρυσούλα"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Γιάννης", "Κώστας", "Δημήτρης", "Παύλος", "Πέτρος", "Ανδρέας"],
}
SYLLABLES = {
    "latin": ["bar", "ben", "cor", "dal", "del", "fen", "gar", "hol", "kel", "lan", "mar", "nor", "pel", "ros", "tam", "wel"],
    "cyrillic": ["бар", "вол", "гор", "дан", "кол", "лев", "мир", "нов", "пет", "род", "сав", "тар", "фед", "хар", "чер", "щер"],
    "greek": ["βασ", "γαλ", "δημ", "ζαχ", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σαμ", "ταρ", "φωτ", "χρι", "ψαρ"],
}

_TITLES = "|".join([*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES])
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
# Words before a name, whatever the name.
CUES = ["my name is ", "My name is ", "I am called ", "mi nombre es ", "Mi nombre es ", "me llamo ", "Me llamo ", "je m'appelle ", "Je m'appelle ", "ich heiße ", "Ich heiße ", "меня зовут ", "Меня зовут ", "με λένε ", "Με λένε "]
CUES += ["Full name: ", "full name: ", "Name: ", "name: ", "Patient: ", "Employee: ", "Signed by ", "signed by ", "Written by ", "written by ", "Attn: ", "attn: "]
# What keys of well-known kinds begin with.
KEY_PREFIX = r"(?:(?:sk|pk|rk)_(?:live|test)_|(?:sk|pk|gh[opusr]|xox[abp])[_-]?|AKIA)"

_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
_KEYS = "token|password|passwd|secret|api_key|apikey|api-key"
_SECRET = rf"(?<![A-Za-z])(?i:{_KEYS})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|[23Ff][0-9A-Fa-f]{{3}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"
_SSN = r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_DIGITS = [
    rf"(?<![\w.])(?<!(?i:version|release|firmware|build) )(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    _SSN,
    r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])",
    r"(?<![\w.])\+\d(?:\)?[ .-]?\(?\d){7,14}(?!\w)",
    r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w)",
    r"(?<![\w.])\(?\d{3}(?:\)[ .-]?|[ .-])\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w.+])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?!\w)",
    r"(?<![\w.+-])0\d(?:([ .-])\d\d)(?:\2\d\d){3}(?![\w.-])",
]
_NAMES = [rf"(?<!\p{{L}})(?:{_TITLES})\.? {_CAPITAL}(?: {_CAPITAL})?", rf"(?<!\p{{L}})(?:{_GIVEN}) {_CAPITAL}", rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join(CUES)})){_CAPITAL}(?: {_CAPITAL})?"]
#: What counts as an entity, in the order in which alternatives are tried.
ENTITY_PARTS = [
    r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    rf"(?=[0-9+(])(?:{'|'.join(_DIGITS)})",
    _IPV6,
    rf"{_SECRET}[A-Za-z0-9+/_=-]{{8,}}",
    rf"(?<![A-Za-z0-9_-])(?!AKIA){KEY_PREFIX}(?=[A-Za-z]{{0,30}}\d)[A-Za-z0-9]{{16,}}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_-])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    _IBAN,
    *_NAMES,
]
ENTITY = "|".join(ENTITY_PARTS)
#: What every text with an entity holds; others are left alone.
HINT = "|".join(["[0-9@]", "AKIA", rf"(?i:{_KEYS})", *_NAMES])
#: Surrogates tried in an entity's own format; after these, longer ones.
TRIES = 8
KINDS = ["email", "ip", "card", "phone", "name", "secret", "iban", "ssn"]


def kind_of(match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, r"\D", ""))
    return (
        F.when(match.rlike(f"^{_SECRET}|^AKIA[0-9A-Z]{{16}}$"), "secret")
        .when(F.contains(match, F.lit("@")), "email")
        .when(match.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$|^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ip")
        .when(match.rlike(f"^{_SSN}$"), "ssn")
        .when(match.rlike(f"^{_IBAN}$"), "iban")
        .when(match.rlike(r"^[\d -]+$") & digits.between(13, 19), "card")
        .when(match.rlike(r"^[+(]?\d[\d ().-]*$") & match.rlike(r"[+ ().-]"), "phone")
        .when(match.rlike(rf"^(?:(?:{_TITLES})\.?|(?:{_GIVEN})) "), "name")
        .when(match.rlike(f"^{_CAPITAL}(?: {_CAPITAL})?$"), "name")  # a surname by itself, or what follows a cue
        .otherwise("secret")
    )


def _name_parts(match: Column) -> tuple[Column, Column, Column]:
    """Title with its space, given name and surname; the first two may be empty."""
    title = F.regexp_extract(match, rf"^(?:{_TITLES})\.? ", 0)
    rest = F.regexp_replace(match, rf"^(?:{_TITLES})\.? ", "")
    return title, F.regexp_extract(rest, r"^(\S+) \S", 1), F.regexp_extract(rest, r"(\S+)$", 1)


def _bare_surnames(found: Column) -> Column:
    """What counts as an entity besides in a text with these matches: the surnames among them by themselves; null if there are none."""
    surnames = F.array_distinct(F.transform(F.filter(found, lambda m: kind_of(m) == "name"), lambda m: _name_parts(m)[2]))
    bare = F.concat(F.lit(r"|(?<![\p{L}\p{N}_'’-])(?:"), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}_-])"))
    return F.when(F.size(surnames) > 0, bare)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    by_name = {g: [n for (_, k), names in GIVEN.items() if k == g for n in names] for g in "fm"}
    bare = F.regexp_replace(title, r"\.? $", "")
    female = bare.isin(FEMALE_TITLES) | (~bare.isin(MALE_TITLES) & given.isin(by_name["f"]))
    male = bare.isin(MALE_TITLES) | given.isin(by_name["m"])
    return F.when(female, "f").when(male, "m").otherwise(F.when(given.rlike("[aeαηая]$"), "f").otherwise("m"))


def identities(match: Column) -> Column:
    """What a match refers to: an array of (kind, norm). Spellings of one thing have one norm; a name has one for each part."""
    kind = kind_of(match)
    title, given, surname = _name_parts(match)
    digits = F.regexp_replace(match, r"\D", "")
    one = lambda k, norm: F.struct(k.alias("kind"), norm.alias("norm"))
    last = one(F.concat(F.lit("surname-"), _script(surname)), F.lower(surname))
    first = one(F.concat(F.lit("given-"), _script(given), F.lit("-"), _gender(title, given)), F.lower(given))
    return (
        F.when(kind == "name", F.when(given == "", F.array(last)).otherwise(F.array(first, last)))
        .when(kind.isin("card", "phone", "ssn"), F.array(one(kind, digits)))
        .when(kind.isin("email", "ip"), F.array(one(kind, F.lower(match))))
        .when(kind == "iban", F.array(one(kind, F.translate(match, " ", ""))))
        .when(kind == "secret", F.array(one(kind, F.regexp_replace(match, f"^{_SECRET}", ""))))
        .otherwise(F.array(one(kind, match)))
    )


def _byte(h: Column, i: Column) -> Column:
    """Byte ``i`` of a hex string, round and round."""
    return F.conv(F.substring(h, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), n % len(words) + 1)


def _shaped(text: Column, h: Column) -> Column:
    """Letters for letters, digits for digits, the rest as it is; hex digits for hex digits where there is nothing else."""
    is_hex = text.rlike("^[0-9a-f]*[a-f][0-9a-f]*$") | text.rlike("^[0-9a-f]*:[0-9a-f:]*$")

    def change(c: Column, i: Column) -> Column:
        b = _byte(h, i) + F.floor(i / 32).cast("int")
        return (
            F.when(is_hex & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.chr(b % 26 + 97))
            .when(c.rlike("[A-Z]"), F.chr(b % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string: every second digit from the right, but for the last, counts twice, less 9 above 9."""

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda total, x: total + x)


def _mod_97(text: Column) -> Column:
    """Rest by 97 of letters and digits read as one number, A being 10 and Z 35."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(norm: Column, shaped: Column) -> Column:
    """Country, check digits and an account of the same shape; check digits that were right are right again."""
    country, account = F.substring(norm, 1, 2), F.substring(shaped, F.lit(5), F.length(norm))
    right = _mod_97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    check = F.lpad((F.lit(98) - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(right, check).otherwise(F.substring(shaped, 3, 2)), account)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a norm: a function of key, kind, norm and attempt alone."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    return let(F.struct(h.alias("h"), kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt")), lambda x: _by_kind(x["h"], x["kind"], x["norm"], x["attempt"]))


def _by_kind(h: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    shaped = _shaped(norm, h)
    card = F.concat(F.substring(norm, 1, 1), F.substring(shaped, F.lit(2), F.length(norm) - 1))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    check = (F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn_sum(norm) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(card)
    fixed = F.greatest(F.length(norm) - 10, F.lit(0))  # a phone number's country code stays
    phone = F.concat(F.substring(norm, F.lit(1), fixed), F.substring(shaped, fixed + 1, F.length(norm)))
    number = lambda k, n, width: F.lpad(((_byte(h, F.lit(k)) * 256 + _byte(h, F.lit(k + 1))) % n + 1).cast("string"), width, "0")
    ssn = F.concat(number(0, 665, 3), number(2, 99, 2), number(4, 9999, 4))
    prefix = F.regexp_extract(norm, f"^{KEY_PREFIX}", 0)
    secret = F.concat(prefix, _shaped(F.substring(norm, F.length(prefix) + 1, F.length(norm)), h))
    network = F.regexp_extract(norm, "^[0-9a-f]{1,4}:", 0)  # an IPv6 address keeps its first group
    ipv6 = F.concat(network, _shaped(F.substring(norm, F.length(network) + 1, F.length(norm)), h))
    ip = F.array_join(F.array(*[(_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]), ".")
    ending = F.regexp_extract(norm, r"\.[a-z]{2,24}$", 0)
    email = F.concat(_shaped(F.substring(norm, F.lit(1), F.length(norm) - F.length(ending)), h), ending)
    # A format that has run out gives way: sixteen digits more tell its surrogates apart.
    more = F.when(attempt > TRIES, F.translate(F.substring(h, 1, 16), "abcdef", "012345")).otherwise("")
    ip = F.when(network != "", F.concat(ipv6, more)).otherwise(F.when(attempt > TRIES, F.concat(ip, F.lit("."), more)).otherwise(ip))
    out = F.when(kind == "ip", ip).when(kind == "card", F.concat(card, more)).when(kind == "phone", F.concat(phone, more)).when(kind == "email", F.concat(more, email)).when(kind == "secret", F.concat(secret, more))
    out = out.when(kind == "ssn", F.concat(ssn, more)).when(kind == "iban", F.concat(_iban(norm, shaped), more))
    for script, syllables in SYLLABLES.items():
        surname = F.initcap(F.concat(*[_pick(syllables, _byte(h, F.lit(i))) for i in range(3)], _more(attempt, lambda i, s=syllables: _pick(s, _byte(h, i)))))
        out = out.when(kind == f"surname-{script}", surname)
    for (script, gender), names in GIVEN.items():
        given = F.concat(_pick(names, _byte(h, F.lit(0))), _more(attempt, lambda i, n=names: F.concat(F.lit("-"), _pick(n, _byte(h, i)))))
        out = out.when(kind == f"given-{script}-{gender}", given)
    return out


def _more(attempt: Column, piece: Callable[[Column], Column]) -> Column:
    """One more piece for each failed attempt, so that a finite list runs out of nothing."""
    return F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: piece(i.cast("int") + 8)), "")).otherwise("")


def settle(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, norm, attempt) of those entities whose first surrogate won't do.

    ``entities`` has each (kind, norm) once. A surrogate must differ from those of all others of its
    kind and from all real norms of it. Where it does not, one settled in an earlier round keeps it, or else the smallest norm, unless it is
    real, and the others try again, until no two agree; only these are worked out anew. After ``TRIES`` rounds surrogates get longer, so
    a format that is full, such as that of the shortest emails, does not go on for ever.
    """
    # Few bytes, much to work out: dealt out by number.
    parts = 4 * entities.sparkSession.sparkContext.defaultParallelism
    real = entities.select("kind", F.lower("norm").alias("s"))
    current, settled = entities.select("kind", "norm", F.lit(0).alias("attempt")), None
    while True:
        with_s = current.repartition(parts, "kind", "norm").withColumn("s", F.lower(surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)))
        with_s = keep(with_s, "surrogates")
        held = real if settled is None else real.unionByName(settled.select("kind", "s"))
        tried = with_s.select("kind", "s").distinct()
        taken = held.join(tried, ["kind", "s"], "left_semi").distinct().withColumn("taken", F.lit(True))
        holders = with_s.groupBy("kind", "s").agg(F.min("norm").alias("holder"))
        judged = with_s.join(holders, ["kind", "s"]).join(taken, ["kind", "s"], "left")
        judged = keep(judged.select("kind", "norm", "attempt", "s", (F.col("taken").isNotNull() | (F.col("norm") != F.col("holder"))).alias("again")), "judged")
        discard(with_s)
        done = judged.where("not again").drop("again")
        settled = done if settled is None else settled.unionByName(done)
        if judged.where("again").isEmpty():
            return settled.where("attempt > 0").select("kind", "norm", "attempt")
        current = judged.where("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))


def _render(match: Column, attempts: Column, key: str) -> Column:
    """The replacement of a match in its own format. ``attempts`` maps kind|norm to an attempt above 0."""

    def new(identity: Column) -> Column:
        attempt = F.coalesce(F.element_at(attempts, F.concat_ws("|", identity["kind"], identity["norm"])), F.lit(0))
        return surrogate(identity["kind"], identity["norm"], attempt, key)

    return let(F.transform(identities(match), new), lambda names: _in_format(match, names))


def _in_format(match: Column, names: Column) -> Column:
    """The surrogates of a match in place of what they stand for."""
    kind, title = kind_of(match), _name_parts(match)[0]
    first, last = F.element_at(names, 1), F.element_at(names, -1)

    def sign(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(match, F.lit(1), i), "[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substring(first, before + 1, F.lit(1))).otherwise(c)

    in_format = F.array_join(F.transform(F.split(match, ""), sign), "")
    # What is longer than the format follows it.
    in_format = F.concat(in_format, F.substring(first, F.length(F.regexp_replace(match, "[^0-9A-Z]", "")) + 1, F.length(first)))
    before = F.regexp_extract(match, f"^{_SECRET}", 0)
    return F.when(kind == "name", F.concat(title, F.array_join(names, " "))).when(kind == "secret", F.concat(before, last)).when(kind.isin("card", "phone", "ssn", "iban"), in_format).otherwise(last)


def _number(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", counts_col: str = "pii_counts") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and a map from kind to number in ``counts_col``.

    Emails, addresses, card, phone, account (IBAN) and social security numbers, names and secrets get surrogates that depend on the key
    and on what they refer to: one thing has one surrogate in all texts and spellings, two things of a
    kind never share one, and none is a real one of the corpus. A surname found in a text is also replaced
    where it stands there by itself. Digits and punctuation keep their
    places, cards that satisfy the Luhn sum and IBANs with right check digits still do, IBANs keep their country, keys what tells their kind,
    IPv6 addresses their first group (two spellings of one are two things), names keep title, gender and script, emails their
    last label. Only where a format has run out of surrogates do they get longer.

    Null texts stay null with no counts; empty ones and those without entities stay as they are. Texts are
    searched whole. Repeated rows get equal texts. Where two entities of a kind tie for a surrogate, the one that sorts first
    has it. An empty table gives an empty one. All other columns stay, whatever their names; ``counts_col`` must be free.
    """
    if counts_col in docs.columns:
        raise ValueError(f"{counts_col} is a column already")
    found, entity = column_free_of(docs, "matches"), column_free_of(docs, "entity")
    none_found = F.when(F.col(text_col).isNotNull(), F.array().cast("array<string>"))
    # Kept, so that texts are searched once and not again in each place that uses the matches.
    once = F.when(F.col(text_col).rlike(HINT), F.regexp_extract_all(F.col(text_col), F.lit(ENTITY), F.lit(0))).otherwise(none_found)

    def searched(matches: Column, bare: Column) -> Column:
        # Texts that name somebody are searched again, for that surname wherever it stands.
        again = F.regexp_extract_all(F.col(text_col), F.concat(F.lit(ENTITY), bare), F.lit(0))
        return F.struct(F.when(bare.isNotNull(), again).otherwise(matches).alias("matches"), bare.alias("bare"))

    matched = keep(docs.withColumn(found, let(once, lambda m: let(_bare_surnames(m), lambda bare: searched(m, bare)))), "matched")
    matched = matched.withColumn(entity, F.concat(F.lit(ENTITY), F.col(found)["bare"])).withColumn(found, F.col(found)["matches"])
    entities = matched.select(F.explode(found).alias("m")).distinct().select(F.explode(identities(F.col("m"))).alias("x")).select("x.*").distinct()
    entities = keep(entities, "entities")
    tried = settle(entities, key)

    def rebuilt(attempts: Column) -> Column:
        parts = F.when(F.col(entity).isNull(), F.split(F.col(text_col), ENTITY, -1)).otherwise(F.split(F.col(text_col), F.col(entity), -1))
        new = F.concat(F.transform(found, lambda m: _render(m, attempts, key)), F.array(F.lit("")))
        return F.when(F.size(found) > 0, F.array_join(F.flatten(F.zip_with(parts, new, lambda p, s: F.array(p, s))), "")).otherwise(F.col(text_col))

    none = F.create_map().cast("map<string,int>")
    if tried.isEmpty():
        out = matched.withColumn(text_col, rebuilt(none))
    else:
        # Attempts travel by the hash of the text they are for, and only for texts that need them.
        by_text, mine = column_free_of(docs, "text_hash"), column_free_of(docs, "attempts")
        pairs = matched.where(F.size(found) > 0).select(F.xxhash64(text_col).alias(by_text), F.explode(F.flatten(F.transform(found, identities))).alias("x")).select(by_text, "x.*").distinct()
        entry = F.struct(F.concat_ws("|", "kind", "norm").alias("key"), F.col("attempt").alias("value"))
        maps = pairs.join(tried, ["kind", "norm"]).groupBy(by_text).agg(F.map_from_entries(F.collect_set(entry)).alias(mine))
        out = matched.withColumn(by_text, F.xxhash64(text_col)).join(maps, by_text, "left").withColumn(text_col, rebuilt(F.coalesce(F.col(mine), none)))
    kinds = F.transform(found, kind_of)
    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[_number(kinds, k) for k in KINDS]))
    return out.withColumn(counts_col, F.when(F.col(found).isNotNull(), counts)).select(*docs.columns, counts_col)
