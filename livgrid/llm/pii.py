"""Surrogates for personal data, in DataFrame expressions alone.

One alternation finds e-mail addresses, phone numbers, IPv4 addresses, payment cards (with a right check digit), social
security numbers, IBANs, names after a title, and names that begin with a common given name (GIVEN_NAMES). In a text with
such a name, its words are found wherever else they stand as words of their own. A name without a title whose given name isn't in the
list, and a surname alone in a text that never has it after a title or given name, aren't found.

Each entity has a canonical form (an address in lower case, a number's digits, a name's words one by one), and its
surrogate is derived from SHA-256 of key, kind, canonical form and an attempt: so the same entity gets the same
surrogate everywhere, in whatever format it is written. Surrogates keep the type: separators, country codes and digit
counts stay; cards keep their network digit and IBANs their country, with right check digits; addresses of one
domain keep a common one; names follow script, case and gender. A name's word is one identity over all titles and
places: it is a given name if it ever stands as one, and of the gender of its titles (and of the list of given names), neutral if they differ.
Private and loopback IP addresses go through a keyed permutation of their range without fixed points, so they stay in it and can't run out.

Collision check: the distinct entities of the corpus (pre-aggregated) form a dictionary. Where two have the same surrogate
(names: over all genders, places and scripts), or one is an entity of the corpus, all but the first try again, until none is
left; names and local parts grow with the attempts. Texts are searched once: what is found is written beside them, looked up in the
dictionary by a join that takes frequent entities apart, and put in place.

Defined cases: a null text stays null, an empty one empty; every row gives a row, repeated ones too, and rows with equal or null
ids are treated alike; a column of the output's name is replaced, all others stay, whatever their names; a domain of more than 126 labels,
or with a label of more than 63 characters, isn't an address's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from livgrid.llm.native import spans
from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work, unused

#: Texts with entities, and entities in them, that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_ENTITIES = 100_000, 400_000
MOST_ATTEMPTS = 100
#: Code points of the blocks that texts are cut into, so that putting surrogates in place takes time in proportion to the text.
TEXT_BLOCK = 4096
#: Titles by gender, and common given names by gender.
MALE, FEMALE, NEUTRAL = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "Г-н", "господин", "κ", "κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "г-жа", "Г-жа", "госпожа", "κα", "κυρία"), ("Mx", "Dr", "Prof")
GIVEN_NAMES = {
    "m": "Andrew Anthony Charles Christopher Daniel David Edward George Henry Jack James John Joseph Kevin Mark Matthew Michael Patrick Paul Peter Richard Robert Samuel Stephen Steven Thomas Timothy William "
    "Andreas Christian Dieter Friedrich Günter Hans Heinrich Jürgen Karl Klaus Matthias Stefan Uwe Wolfgang Alain André Antoine Bernard Claude François Frédéric Gérard Jacques Jean Laurent Louis Luc Michel Olivier Philippe Pierre "
    "Alejandro Antonio Carlos Diego Fernando Francisco Javier Jorge José Juan Luis Manuel Miguel Pablo Pedro Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей Γιώργος Γιάννης Δημήτρης Κώστας Νίκος",
    "f": "Alice Amanda Amy Barbara Catherine Christine Elizabeth Emily Emma Hannah Helen Jane Jennifer Jessica Karen Kate Laura Linda Lucy Margaret Mary Nancy Olivia Patricia Rachel Rebecca Ruth Sarah Sophie Susan Victoria "
    "Anna Brigitte Claudia Gisela Greta Heike Ingrid Karin Katharina Monika Petra Sabine Ursula Camille Chantal Françoise Hélène Isabelle Juliette Marie Martine Nathalie Sylvie "
    "Ana Carmen Cristina Dolores Isabel Josefa Lucía María Pilar Rosa Teresa Анна Елена Мария Наталья Ольга Татьяна Ελένη Κατερίνα Μαρία",
}
_PART = r"[\p{L}\p{M}-]++"
#: A name's word: a capital and letters, maybe after a capital with an apostrophe; what follows an apostrophe in lower case isn't its.
_WORD = rf"(?:\p{{Lu}}{_PART}(?:['’]\p{{Lu}}{_PART})?|\p{{Lu}}['’]\p{{Lu}}{_PART})"
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_FIRST_LETTERS = sorted({n[0] for names in GIVEN_NAMES.values() for n in names.split()})
_GIVEN = "|".join(c + "(?:" + "|".join(sorted({n[1:] for names in GIVEN_NAMES.values() for n in names.split() if n[0] == c}, key=lambda n: (-len(n), n))) + ")" for c in _FIRST_LETTERS)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order tried; the first that matches the whole of an entity is its kind.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.-])(?:(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:\+?\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLES}|M(?=\.))\.?\x20{_WORD}(?:\x20{_WORD}){{0,2}}",
    "person": rf"(?<![\p{{L}}\p{{M}}\d'’-])(?=\p{{Lu}})(?:{_GIVEN})(?:\x20{_WORD}){{1,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A quick test that every text with an entity passes.
HINT = rf"@|\d[\d.() +-]{{6}}|[A-Z]{{2}}\d\d|(?:{_TITLES}|M)\.?\x20\p{{Lu}}|(?=\p{{Lu}})(?:{_GIVEN})\x20\p{{Lu}}"
#: Words that may be a name's.
MENTION = rf"(?<![\p{{L}}\p{{M}}\d'’-]){_WORD}(?![\p{{L}}\p{{M}}\d])"
#: Syllables that names are made of, by script; endings of given names by gender, and of surnames.
SYLLABLES = {
    "latin": ("al", "ben", "cor", "da", "el", "fen", "gar", "hal", "is", "jo", "kel", "lor", "mar", "nor", "ol", "per", "quin", "ro", "sel", "tam", "ur", "vel", "wes", "yor", "zan", "bri", "cla", "dri", "gre", "tra", "ste", "pla"),
    "cyrillic": ("ал", "бор", "вер", "гри", "дан", "ел", "жан", "зор", "ил", "кор", "лев", "мар", "ник", "ол", "пет", "рад", "сав", "тим", "ур", "фил", "хар", "цве", "чер", "шар", "юр", "яр", "бла", "дра", "гле", "кра", "ста", "тро"),
    "greek": ("αλ", "βερ", "γαρ", "δημ", "ελ", "ζαν", "ηλ", "θεο", "ιον", "καλ", "λεο", "μαρ", "νικ", "ξεν", "ολ", "πετ", "ροδ", "σοφ", "τιμ", "υλ", "φιλ", "χαρ", "ψαλ", "ων", "βασ", "γρη", "δρα", "κλε", "μελ", "παν", "στα", "τρι"),
}
GIVEN = {
    "latin": {"m": ("us", "an", "or", "ard"), "f": ("a", "ia", "ina", "elle"), "n": ("en", "y", "is", "ey")},
    "cyrillic": {"m": ("ан", "ий", "ор", "ей"), "f": ("а", "ия", "ина", "ена"), "n": ("а", "я", "ь", "ик")},
    "greek": {"m": ("ος", "ης", "ας", "ων"), "f": ("α", "η", "ια", "ω"), "n": ("ι", "ις", "ω", "υ")},
}
SURNAME = {
    "latin": {g: ("son", "berg", "ley", "man") for g in "mfn"},
    "cyrillic": {"m": ("ов", "ев", "ин", "ский"), "f": ("ова", "ева", "ина", "ская"), "n": ("ко", "ук", "ян", "дзе")},
    "greek": {"m": ("ίδης", "άκης", "όπουλος", "ιάδης"), "f": ("ίδου", "άκη", "οπούλου", "ιάδου"), "n": ("ίδη", "άκη", "έα", "ού")},
}


def _number(h: Column, i: int, digits: int = 10) -> Column:
    """The i-th number that a hex digest of 64 digits holds, of so many hex digits."""
    return F.conv(F.substring(h, 1 + i * digits, digits), 16, 10).cast("bigint")


def _digits(h: Column) -> Column:
    """36 decimal digits of a digest."""
    part = lambda i: F.right(F.lpad(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10), 18, "0"), F.lit(12))
    return F.concat(*(part(i) for i in range(3)))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def kind_of(match: Column) -> Column:
    """The kind of a match, null if it is none after all (a number without a right check digit)."""
    tests = [(k, match.rlike(f"^(?:{p})$")) for k, p in KINDS.items()]
    out = F.when(tests[0][1], F.lit(tests[0][0]))
    for k, test in tests[1:]:
        out = out.when(test & (_luhn(digits_of(match)) if k == "card" else F.lit(True)), F.lit(k))
    return out


def _gender(title: Column) -> Column:
    plain = F.regexp_replace(title, r"\.", "")
    male, female = (GIVEN_NAMES[g].split() for g in "mf")
    return F.when(plain.isin(*MALE, "M", *male), "m").when(plain.isin(*FEMALE, *female), "f").otherwise("n")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _word(word: Column, role: Column, gender: Column) -> Column:
    return F.struct(F.concat(F.lit("name_"), _script(word)).alias("kind"), F.lower(word).alias("canon"), role.alias("role"), gender.alias("gender"))


def entities(match: Column, kind: Column) -> Column:
    """An array of structs (kind, canon, role, gender) that a match holds: one, or one for each word of a name."""
    one = lambda canon: F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit("").alias("role"), F.lit("").alias("gender")))
    words = F.split(match, r"\x20")
    names = F.when(kind == "name", F.slice(words, 2, F.size(words) - 1)).otherwise(words)
    gender = _gender(F.element_at(words, 1))
    role = lambda i: F.when(i + 1 == F.size(names), "surname").otherwise("given")
    return (
        F.when(kind.isin("name", "person"), F.transform(names, lambda w, i: _word(w, role(i), gender)))
        .when(kind == "email", one(F.lower(match)))
        .when(kind == "ip", one(match))
        .when(kind == "iban", one(F.regexp_replace(match, " ", "")))
        .when(kind == "phone", one(F.right(digits_of(match), F.lit(10))))
        .otherwise(one(digits_of(match)))
    )


def _chosen(e: Column, kind: Column, values: dict) -> Column:
    """The entry of a nested table (role, script, gender to values) of an entity, as an array."""
    out = F.lit(None).cast("array<string>")
    for (role, script, gender), texts in values.items():
        out = F.when((e["role"] == role if role else F.lit(True)) & kind.endswith(script) & (e["gender"] == gender if gender else F.lit(True)), F.array(*map(F.lit, texts))).otherwise(out)
    return out


def surrogates(e: Column, key: str) -> Column:
    """The canonical form of the surrogate of a struct (kind, canon, role, gender, attempt). In steps, so that digests are computed once."""
    endings = {(role, script, gender): by[script][gender] for role, by in (("given", GIVEN), ("surname", SURNAME)) for script in by for gender in by[script]}
    syllables = {("", script, ""): texts for script, texts in SYLLABLES.items()}

    def digested(e: Column) -> Column:
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), e["kind"], e["canon"], e["attempt"].cast("string")), 256)
        domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(e["canon"], "@", -1)), 256)
        return F.struct(*(e[f].alias(f) for f in ("kind", "canon", "role", "gender", "attempt")), h.alias("h"), F.when(e["kind"] == "email", domain).alias("domain"))

    def numbered(e: Column) -> Column:
        named = e["kind"].startswith("name_")
        return F.struct(*(e[f].alias(f) for f in ("kind", "canon", "attempt", "h", "domain")), _digits(e["h"]).alias("new"), F.when(named, _chosen(e, e["kind"], syllables)).alias("syllables"), F.when(named, _chosen(e, e["kind"], endings)).alias("endings"))

    return F.transform(F.transform(F.transform(F.array(e), digested), numbered), lambda e: _surrogate(e, key))[0]


def _surrogate(e: Column, key: str) -> Column:
    kind, canon, attempt, h, new = e["kind"], e["canon"], e["attempt"], e["h"], e["new"]
    n = F.length(canon)
    return (
        F.when(kind == "email", _email(canon, attempt, h, new, e["domain"]))
        .when(kind == "ip", _ip(canon, h, key))
        .when(kind == "ssn", F.concat((F.pmod(_number(h, 0), F.lit(560)) + 100).cast("string"), F.lpad((F.pmod(_number(h, 1), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(_number(h, 2), F.lit(9999)) + 1).cast("string"), 4, "0")))
        .when(kind == "phone", F.concat((F.pmod(_number(h, 5), F.lit(8)) + 2).cast("string"), F.substr(new, F.lit(2), F.lit(2)), F.when(n >= 10, (F.pmod(_number(h, 4), F.lit(8)) + 2).cast("string")).otherwise(F.substr(new, F.lit(30), F.lit(1))), F.substr(new, F.lit(5), n - 4)))
        .when(kind == "card", _card(F.concat(F.substring(canon, 1, 1), F.substr(new, F.lit(1), n - 2))))
        .when(kind == "iban", _iban(F.substring(canon, 1, 2), _classes(F.substr(canon, F.lit(5)), h, new, True)))
        .otherwise(_name(attempt, h, e["syllables"], e["endings"]))
    )


def _letter(digest: Column, i: Column) -> Column:
    return F.chr(F.lit(97) + F.pmod(F.conv(F.substr(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("bigint"), F.lit(26)))


def _classes(old: Column, h: Column, new: Column, upper: bool) -> Column:
    """Other letters for the letters and other digits for the digits of old."""
    letter = lambda i: F.upper(_letter(h, i)) if upper else _letter(h, i)
    return F.array_join(F.transform(F.split(old, ""), lambda c, i: F.when(c.rlike("[A-Za-z]"), letter(i)).when(c.rlike(r"\d"), F.substr(new, F.pmod(i, F.lit(36)) + 1, F.lit(1))).otherwise(c)), "")


def _email(canon: Column, attempt: Column, h: Column, new: Column, domain: Column) -> Column:
    local = F.concat(F.substring_index(canon, "@", 1), F.when(attempt > 8, F.repeat(F.lit("x"), attempt - 8)).otherwise(""))  # short local parts can run out
    return F.concat(_classes(local, h, new, False), F.lit("@"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _letter(domain, i)), ""), F.lit(".example"))


#: Private and loopback ranges: a pattern, the octets that stay, and half the number of bits that change.
_RANGES = ((r"^(?:10|127)\.", 1, 12), (r"^192\.168\.", 2, 8), (r"^172\.(?:1[6-9]|2\d|3[01])\.", 1, 10))
_ROUNDS = 4


def is_private(canon: Column) -> Column:
    return F.regexp(canon, F.lit("|".join(p for p, *_ in _RANGES)))


def _ip(canon: Column, h: Column, key: str) -> Column:
    octet = lambda i: (F.pmod(_number(h, i), F.lit(254)) + 1).cast("string")
    public = F.pmod(_number(h, 4), F.lit(100)) + 20  # first octets 20 to 119: none of them private
    out = F.concat_ws(".", public.cast("string"), octet(0), octet(1), octet(2))
    for pattern, fixed, half in _RANGES:
        out = F.when(canon.rlike(pattern), _permuted(canon, fixed, half, key)).otherwise(out)
    return out


def _permuted(canon: Column, fixed: int, half: int, key: str) -> Column:
    """An address of the same range: a Feistel network of _ROUNDS rounds, one further, and the network backwards. So it is one to one, and never itself."""
    size = 1 << half
    part = lambda i: F.element_at(F.split(canon, r"\."), i).cast("bigint")
    low = part(3) * 256 + part(4)
    host = low if half == 8 else low + part(2) * 65536 if half == 12 else low + (part(2) - 16) * 65536
    prefix = F.substring_index(canon, ".", fixed)

    def noise(k: Column, x: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("range"), prefix, k.cast("string"), x.cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(size))

    def step(x: Column, k: Column) -> Column:
        left, right = x["l"], x["r"]
        there = F.struct(right.alias("l"), left.bitwiseXOR(noise(k, right)).alias("r"))
        more = F.pmod(left * size + right + 1, F.lit(size * size))
        back = F.struct(right.bitwiseXOR(noise(2 * _ROUNDS - k, left)).alias("l"), left.alias("r"))
        return F.when(k < _ROUNDS, there).when(k == _ROUNDS, F.struct(F.floor(more / size).alias("l"), F.pmod(more, F.lit(size)).alias("r"))).otherwise(back)

    start = F.struct(F.floor(host / size).alias("l"), F.pmod(host, F.lit(size)).alias("r"))
    made = F.aggregate(F.array(*map(F.lit, range(2 * _ROUNDS + 1))), start, step, lambda x: x["l"] * size + x["r"])
    byte = lambda x, i: F.pmod(F.floor(x / 256**i), F.lit(256)).cast("string")
    return F.transform(F.array(made), lambda x: F.concat_ws(".", prefix, *([] if half == 8 else [byte(x, 2) if half == 12 else (F.floor(x / 65536) + 16).cast("string")]), byte(x, 1), byte(x, 0)))[0]


def _card(body: Column) -> Column:
    """body and its check digit."""
    tried = F.transform(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.concat(body, d))
    return F.element_at(F.filter(tried, _luhn), 1)


def _iban(country: Column, bban: Column) -> Column:
    value = lambda acc, c: F.when(c.rlike(r"\d"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    made = F.transform(F.array(bban), lambda b: F.concat(country, F.lpad((98 - F.aggregate(F.split(F.concat(b, country, F.lit("00")), ""), F.lit(0), value)).cast("string"), 2, "0"), b))
    return F.element_at(made, 1)


def _name(attempt: Column, h: Column, syllables: Column, endings: Column) -> Column:
    """Two syllables, one more for each attempt up to 28 (so there is always room), each by a byte of the digest, and an ending."""
    byte = lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    many = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(26)) + 1), lambda i: F.element_at(syllables, F.pmod(byte(i), F.lit(32)) + 1))
    return F.concat(F.array_join(many, ""), F.element_at(endings, F.pmod(byte(F.lit(31)), F.lit(4)) + 1))


def _cased(new: Column, old: Column) -> Column:
    return F.when((F.length(old) > 1) & (F.upper(old) == old), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2))))


def _placed(match: Column, new: Column) -> Column:
    """match with its last digits replaced by the digits of new."""
    skip = F.length(digits_of(match)) - F.length(new)

    def one(c: Column, i: Column) -> Column:
        at = F.length(digits_of(F.substr(match, F.lit(1), i + 1))) - skip
        return F.when(c.rlike(r"\d") & (at >= 1), F.substr(new, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(match, ""), one), "")


def _spaced(match: Column, new: Column) -> Column:
    """new with the blanks of match."""
    return F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")


def replacement(match: Column, kind: Column, new: Column) -> Column:
    """What stands in the text instead of a match: its words' or its own surrogates (an array) in the match's format."""
    first = F.element_at(new, 1)
    words = F.split(match, r"\x20")
    title = F.size(words) - F.size(new)
    name = F.array_join(F.concat(F.slice(words, 1, title), F.zip_with(F.slice(words, title + 1, F.size(new)), new, lambda w, x: _cased(x, w))), " ")
    return F.when(kind.isin("name", "person", "mention"), name).when(kind.isin("card", "phone", "ssn"), _placed(match, first)).when(kind == "iban", _spaced(match, first)).otherwise(first)


def matches(text: Column) -> Column:
    """start, end, g0, kind, parts (kind, canon, role, gender) of the entities of a text, mentions aside."""
    found = F.when(text.rlike(HINT), spans(text, PATTERN))
    kinds = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["g0"].alias("g0"), kind_of(x["g0"]).alias("kind")))
    parts = F.transform(F.filter(kinds, lambda x: x["kind"].isNotNull()), lambda x: F.struct(*(x[f].alias(f) for f in ("start", "end", "g0", "kind")), entities(x["g0"], x["kind"]).alias("parts")))
    return F.coalesce(parts, F.array().cast("array<struct<start:int,end:int,g0:string,kind:string,parts:array<struct<kind:string,canon:string,role:string,gender:string>>>>"))


def rebuilt(text: Column, found: Column, new) -> Column:
    """text with new(m) instead of each m (start, end) of found, which are in order and apart."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / TEXT_BLOCK).cast("int")
        whole = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / TEXT_BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(whole, a - first * TEXT_BLOCK + 1, b - a)).otherwise("")

    def made(x: Column) -> Column:
        blocks, found = x["blocks"], x["found"]
        since = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        pieces = F.transform(found, lambda m, i: F.concat(cut(blocks, since(i), m["start"]), new(m)))
        return F.concat(F.array_join(pieces, ""), cut(blocks, F.element_at(found, -1)["end"], x["n"]))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    one = F.array(F.struct(blocks.alias("blocks"), found.alias("found"), F.length(text).alias("n")))
    return F.when(F.size(found) > 0, F.transform(one, made)[0]).otherwise(text)


def mentions(texts: DataFrame) -> DataFrame:
    """Of texts (row, text, hits) with names: row, start, end, g0, kind, parts of each other place where a word of them stands."""
    named = texts.filter(F.exists("hits", lambda m: m["kind"].isin("name", "person")))
    words = named.select("row", F.explode("hits").alias("m")).filter(F.col("m.kind").isin("name", "person")).select("row", F.explode("m.parts.canon").alias("canon")).distinct()
    # what is found already is blanked out, place for place
    hidden = rebuilt(F.col("text"), F.col("hits"), lambda m: F.repeat(F.lit(" "), m["end"] - m["start"]))
    each = named.select("row", F.explode(spans(hidden, MENTION)).alias("m")).select("row", "m.*", F.lower("m.g0").alias("canon")).join(words, ["row", "canon"], "left_semi")
    return each.select("row", "start", "end", "g0", F.lit("mention").alias("kind"), F.array(_word(F.col("g0"), F.lit(""), F.lit(""))).alias("parts"))


def dictionary(parts: DataFrame, work: Work, key: str) -> DataFrame:
    """kind, canon, out of the distinct entities (kind, canon, role, gender); no two have one out, and none is a canon (but in private ranges,
    which can be full). Each round is over those without a surrogate yet."""
    ever = lambda c, v: F.max((F.col(c) == v).cast("int")) == 1
    role = F.when(ever("role", "given"), "given").otherwise("surname").alias("role")
    gender = F.when(ever("gender", "m") & ~ever("gender", "f"), "m").when(ever("gender", "f") & ~ever("gender", "m"), "f").otherwise("n").alias("gender")
    # entities of one space must differ: names of all kinds are one
    space = F.when(F.col("kind").startswith("name_"), "name").otherwise(F.col("kind"))
    todo = work.write(parts.groupBy("kind", "canon").agg(role, gender).withColumn("space", space), "entities")
    real = todo.select("space", F.col("canon").alias("out"))
    settled = None
    for k in range(MOST_ATTEMPTS):
        made = todo.withColumn("out", surrogates(F.struct("kind", "canon", "role", "gender", F.lit(k).alias("attempt")), key))
        made = work.write(made.withColumn("own", (F.col("kind") == "ip") & is_private(F.col("canon"))), f"made-{k}")
        first = made.groupBy("space", "out").agg(F.min(F.struct(~F.col("own"), "canon", "kind")).alias("first"))
        taken = real.withColumn("real", F.lit(True))
        judged = made.join(first, ["space", "out"]).join(taken, ["space", "out"], "left")
        good = (F.struct("canon", "kind") == F.struct("first.canon", "first.kind")) & (F.col("own") | F.col("real").isNull())
        if settled is not None:
            judged = judged.join(settled.select("space", "out", F.lit(True).alias("gone")), ["space", "out"], "left")
            good = good & F.col("gone").isNull()
        judged = work.write(judged.select("kind", "canon", "role", "gender", "space", "out", good.alias("good")), f"judged-{k}")
        now = judged.filter("good").select("kind", "canon", "space", "out")
        settled = now if settled is None else settled.union(now)
        todo = judged.filter("NOT good").select("kind", "canon", "role", "gender", "space")
        if todo.isEmpty():
            return settled.select("kind", "canon", "out")
    raise RuntimeError("surrogates still collide")


def replace(df: DataFrame, work: Work, key: str, text: str = "text", found: str = "entities") -> DataFrame:
    """df with its texts rewritten, and `found`: structs (kind, start, end in the original text, surrogate) in order."""
    kept = [c for c in df.columns if c != found]
    row, hits = unused(df, "__row"), unused(df, "__hits")
    whole = work.write(df.select(*kept, F.monotonically_increasing_id().alias(row), matches(F.col(text)).alias(hits)), "matched")
    texts = whole.filter(F.size(hits) > 0).select(F.col(row).alias("row"), F.col(text).alias("text"), F.col(hits).alias("hits"))
    each = texts.select("row", F.explode("hits").alias("m")).select("row", "m.start", "m.end", "m.g0", "m.kind", "m.parts").unionByName(mentions(texts))
    parts = each.select("row", "start", "end", "g0", F.col("kind").alias("match"), F.posexplode("parts").alias("i", "p")).select("row", "start", "end", "g0", "match", "i", "p.*")
    parts = work.write(parts, "parts")
    outs = work.write(dictionary(parts.filter("match <> 'mention'").select("kind", "canon", "role", "gender"), work, key), "dictionary")
    made = join_unique(parts.drop("role", "gender"), outs, ["kind", "canon"], work, "outs")
    new = made.groupBy("row", "start").agg(F.first("end").alias("end"), F.first("g0").alias("g0"), F.first("match").alias("match"), F.array_sort(F.collect_list(F.struct("i", "out")))["out"].alias("new"))
    one = F.struct("start", "end", F.when(F.col("match").isin("person", "mention"), "name").otherwise(F.col("match")).alias("kind"), replacement(F.col("g0"), F.col("match"), F.col("new")).alias("surrogate"))
    lists = work.write(new.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("made")), "lists")
    rows, n = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("made")), F.lit(0))).first()
    lists = lists.withColumnRenamed("row", row).withColumnRenamed("made", made_ := unused(whole, "__made"))
    joined = whole.filter(F.size(hits) > 0).join(F.broadcast(lists) if rows <= BROADCAST_ROWS and n <= BROADCAST_ENTITIES else lists, row)
    other = F.array().cast("array<struct<kind:string,start:int,end:int,surrogate:string>>")
    listed = F.transform(made_, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["surrogate"].alias("surrogate")))
    changed = joined.select(*(rebuilt(F.col(text), F.col(made_), lambda m: m["surrogate"]).alias(c) if c == text else F.col(c) for c in kept), listed.alias(found))
    return changed.union(whole.filter(F.size(hits) == 0).select(*kept, other.alias(found)))
