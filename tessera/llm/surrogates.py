"""Keyed surrogates for personal data, in DataFrame functions only.

Detected are e-mail addresses, IPv4 and IPv6 addresses, payment cards (issuer digit and
Luhn check, also among other numbers), telephone numbers, social security
numbers, IBANs, secrets that are assigned (outside quotes with a digit, or right
after the equals sign) or have a known shape, and persons named with a title or a known given
name.  Every entity is reduced to *atoms*, (kind, canonical form): the name
tokens of a person, or the entity itself without its layout.  An atom's surrogate
depends only on the key, the kind, the canonical form and an attempt number, so
mentions of one entity stay alike everywhere.  Layout is carried over: digits
replace digits, letters letters of the same case, given names keep their gender,
name tokens their script.

``attempts`` checks the whole corpus: where two atoms of a kind would get the
same surrogate, or a surrogate occurs as an atom itself, all but the first go to
the next attempt, until none is left.  Only such atoms are looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spotsigs import let
from tessera.plans.workspace import Workspace

#: Atoms beyond their first attempt that are put into the plan as a literal; more are joined.
LITERAL = 10_000
#: Attempts at most; and the one from which a telephone number or IBAN keeps one character less, as there are few of its form.
ROUNDS, FREER = 60, 4

#: Titles and given names by gender.
MALE_TITLES = "Mr Sir Herr Monsieur Señor Sr Don Lord".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Lady".split()
OTHER_TITLES = "Dr Prof Rev Hon".split()
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Hans Peter Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Jacques Luis José Juan Carlos Miguel Иван Сергей Алексей Дмитрий".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Michelle Laura Helen Anna Maria Ursula Monika Sabine Claudia Marie Isabelle Nathalie Sylvie Carmen Ana Lucía Elena Pilar Анна Елена Ольга Мария".split()

_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# every pattern first asks for what is cheap to see at a place: most places have a letter within a word
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,127}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}"
SECRET = r"""(?<=["'])(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}["'])[^"'\s]{6,}(?=["'])|(?<=[=:\s])(?=[^\s"'=:])(?<=[=:]\s{0,3})(?:(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)=)|(?=[^\s"'\d]{0,99}\d)(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}))[^\s"'<>(){}\[\],;&]{6,}+(?![(\[{])|(?=[Ags])(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?!\w)"""
IPV4 = rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
IPV6 = r"(?=[0-9A-Fa-f])(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
IBAN = r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?(?!\w)"
SSN = r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
# all numbers in a row that are parted by one space or hyphen, of 13 digits or more; cards are looked for within
CARD = r"(?=[+\d])(?<![\d.-])(?=\+?\d(?:[ -]?\d){12})\+?\d++(?!\.\d|[\p{L}\p{N}._%+-]{0,127}@)(?:[ -]\d++(?!\.\d|[\p{L}\p{N}._%+-]{0,127}@))*+"
# three groups, or 8 to 15 digits after a plus, or five groups of two digits
PHONE = r"(?=[+(\d])(?<![\w+.-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+[1-9](?:[ .-]?\d|[ .-]?\(\d{1,4}\)){7,14}|0\d(?:[ .-]\d\d){4})(?![\w-])"
#: Words that come right before a person's name.
BEFORE_NAMES = "[Dd]ear|[Cc]ontact|[Nn]ame is|I am|I'm|[Ss]igned by|[Rr]egards,|[Ss]incerely,|[Aa]ttn:|[Nn]ame:|[Cc]ustomer:|[Pp]atient:|[Aa]uthor:|[Ee]mployee:"
_INTRODUCED = rf"(?<=[ \n])(?<=(?<!\w)(?:{BEFORE_NAMES})[ \n])"
PERSON = rf"(?=\p{{Lu}})(?<!\w)(?:(?:{_TITLES})\.? (?:{_NAME})(?: {_NAME})?|(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)}) {_NAME}|{_INTRODUCED}{_NAME} {_NAME})(?!\w)"
#: In this order; of two that match at one place the earlier counts.
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IPV4, "ip6": IPV6, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "person": PERSON}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without a match of this have no entity.
HINT = rf"""[@\d]|::|{_INTRODUCED}\p{{Lu}}|[=:]\s{{0,3}}["']|(?<=\w)=\w|AKIA|gh[pousr]_|sk-|(?=\p{{Lu}})(?<!\w)(?:{'|'.join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *MALE_NAMES, *FEMALE_NAMES])})(?!\w)"""


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def _is_card(digits: Column) -> Column:
    return digits.rlike("^[3-6][0-9]{12,18}$") & (_luhn(digits) == 0)


def _is(kind: str, entity: Column) -> Column:
    return entity.rlike(f"^(?:{KINDS[kind]})$")


def _kind(entity: Column) -> Column:
    """The kind of a match; null for a row of numbers that as a whole is neither a card's nor a telephone's."""
    digits = F.regexp_replace(entity, r"\D", "")
    layout = {"email": entity.contains("@"), "ip": _is("ip", entity), "ip6": _is("ip6", entity), "ssn": _is("ssn", entity), "card": _is("card", entity), "phone": _is("phone", entity), "iban": _is("iban", entity), "person": _is("person", entity) | entity.rlike(f"^{_NAME} {_NAME}$")}
    none = F.lit(None).cast("string")
    kind = F.when(layout["email"], F.lit("email")).when(layout["ip"], F.lit("ip")).when(layout["ip6"], F.lit("ip6")).when(layout["iban"], F.lit("iban")).when(layout["ssn"], F.lit("ssn"))
    kind = kind.when(layout["card"], F.when(_is_card(digits), F.lit("card")).when(layout["phone"], F.lit("phone")).otherwise(none))
    return kind.when(layout["phone"], F.lit("phone")).when(layout["person"], F.lit("person")).otherwise(F.lit("secret"))


def _gender(token: Column) -> Column:
    bare = F.regexp_replace(token, r"\.", "")
    return F.when(bare.isin(MALE_TITLES + MALE_NAMES), F.lit("m")).when(bare.isin(FEMALE_TITLES + FEMALE_NAMES), F.lit("f"))


def _person_atoms(entity: Column) -> Column:
    """Title kept; the last name token is the surname, one before it the given name, with the gender that title or name shows."""

    def of(parts):
        titled = F.regexp_replace(parts[0], r"\.", "").isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
        size = F.size(parts)
        gender = F.coalesce(_gender(parts[0]), _gender(F.get(parts, F.lit(1))), F.lit("x"))

        def atom(token, i):
            kind = F.when((i == 0) & titled, F.lit("title")).when(i == size - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender))
            return F.struct(kind.alias("kind"), token.alias("surface"), F.lower(token).alias("canonical"))

        return F.transform(parts, atom)

    return let(F.split(entity, " "), of)


def _row_atoms(entity: Column) -> Column:
    """Atoms of a row of numbers: what lies in any card of whole numbers in it, and telephone and social security numbers in the rest.

    Cards that overlap become one atom, so that no part of a valid one stays.
    """
    inner = f"(?:{SSN})|(?:{PHONE})"
    atom = lambda kind, surface: F.struct(kind.cast("string").alias("kind"), surface.alias("surface"), F.regexp_replace(surface, r"\D", "").alias("canonical"))

    def rest(piece):
        found = F.regexp_extract_all(piece, F.lit(inner), F.lit(0))
        left = F.transform(F.split(piece, inner, -1), lambda p: atom(F.lit(None), p))
        right = F.transform(found, lambda f: atom(F.when(_is("ssn", f), F.lit("ssn")).otherwise(F.lit("phone")), f))
        return F.filter(F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b))), lambda a: a.isNotNull() & (a["surface"] != ""))

    def of(numbers):
        size = F.size(numbers)

        def end(i):
            digits = lambda k: F.regexp_replace(F.array_join(F.slice(numbers, i + 1, k), ""), r"\D", "")
            lengths = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), size - i)), lambda k: let(digits(k), _is_card))
            return i + F.coalesce(F.array_max(lengths), F.lit(0))

        def cut(ends):
            # a card has at most 19 numbers
            within = lambda i: (i >= 0) & (F.array_max(F.slice(ends, F.greatest(F.lit(1), i - 17), F.least(F.lit(19), F.greatest(F.lit(1), i + 1)))) > i)
            return F.array_join(F.transform(numbers, lambda x, i: F.when(within(i) != within(i - 1), F.concat(F.lit("|"), x)).otherwise(x)), "")

        return let(F.transform(numbers, lambda x, i: end(i)), cut)

    pieces = F.split(let(F.regexp_extract_all(entity, F.lit(r"\+?\d+[ -]?"), F.lit(0)), of), r"\|", -1)
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(atom(F.lit("card"), p))).otherwise(rest(p))))


def _atoms(entity: Column) -> Column:
    """array<struct<kind, surface, canonical>> of a match; kinds null and title are left as they are."""

    def of(kind):
        canonical = F.when(kind.isin("email", "ip6"), F.lower(entity)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity)
        one = F.array(F.struct(kind.alias("kind"), entity.alias("surface"), canonical.alias("canonical")))
        return F.when(kind == "person", _person_atoms(entity)).when(kind.isNull(), _row_atoms(entity)).otherwise(one)

    return let(_kind(entity), of)


def found_atoms(text: Column) -> Column:
    """For each match in a text, in order, its atoms."""
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.coalesce(F.transform(matches, _atoms), F.array().cast("array<array<struct<kind:string,surface:string,canonical:string>>>"))


def _byte(stream: Column, i: Column, below: int) -> Column:
    """A keyed number below a bound, for the i-th place."""
    return (F.conv(F.substring(stream, (i % 60) + 1, F.lit(4)), 16, 10).cast("int") + i * 7) % below


_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo za zo".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε γα γε δα δε δι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
_ENDINGS = {"latin": {"m": "n", "f": "a", "x": "el"}, "cyrillic": {"m": "н", "f": "а", "x": "ель"}, "greek": {"m": "ος", "f": "α", "x": "ελ"}}


def _name(stream: Column, kind: Column, token: Column, attempt: Column) -> Column:
    def made(script: str) -> Column:
        table = F.array(*map(F.lit, _SYLLABLES[script]))
        count = F.when(kind == "surname", F.lit(3)).otherwise(F.lit(2)) + F.least(attempt, F.lit(6)).cast("int")
        body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(table, _byte(stream, i * 4, len(_SYLLABLES[script])))), "")
        ends = _ENDINGS[script]
        return F.concat(body, F.when(kind == "given_m", ends["m"]).when(kind == "given_f", ends["f"]).when(kind == "given_x", ends["x"]).otherwise(""))

    return F.when(token.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(token.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def keyed_hash(message: Column, key: str) -> Column:
    """HMAC-SHA256 of a text as hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an atom's surrogate."""

    def of(stream):
        digit = lambda i: _byte(stream, i, 10).cast("string")
        letter = lambda i: F.char(_byte(stream, i, 26) + 97)
        hexadecimal = canonical.rlike("^[0-9a-f]+$")

        def char(c, i):
            other = F.when(c.rlike(r"\d"), F.when(hexadecimal & (kind == "secret"), F.substring(stream, (i % 60) + 1, F.lit(1))).otherwise(digit(i)))
            other = other.when(c.rlike(r"\p{Lu}"), F.upper(letter(i)))
            return other.when(c.rlike(r"\p{L}"), F.when(hexadecimal & (kind == "secret"), F.substring(stream, (i % 60) + 1, F.lit(1))).otherwise(letter(i))).otherwise(c)

        plain = lambda s, skip=0: F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(i < skip, c).otherwise(char(c, i))), "")
        # the last label of a domain, a telephone number's first digit, a card's issuer and an IBAN's country stay
        email = F.concat(plain(F.regexp_extract(canonical, r"^(.*)\.[^.]*$", 1)), F.regexp_extract(canonical, r"(\.[^.]*)$", 1))
        card = let(plain(F.substring(canonical, F.lit(1), F.char_length(canonical) - 1), 1), lambda s: F.concat(s, ((10 - _luhn(F.concat(s, F.lit("0")))) % 10).cast("string")))
        # check digits of an IBAN: 98 less what its rest, country and two zeros leave by 97, with letters as numbers from 10
        worth = lambda a, c: F.when(c.rlike(r"\d"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
        left = lambda rest: F.aggregate(F.split(F.concat(rest, F.substring(canonical, 1, 2), F.lit("00")), ""), F.lit(0), worth)
        iban = let(F.substring(plain(canonical, 4), 5, 40), lambda rest: F.concat(F.substring(canonical, 1, 2), F.lpad((98 - left(rest)).cast("string"), 2, "0"), rest))
        ip6 = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(stream, (i % 60) + 1, F.lit(1)))), "")
        key_type = F.char_length(F.regexp_extract(canonical, "^(?:AKIA|gh[pousr]_|sk-)", 0))
        ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda c, i: (1 + _byte(stream, i * 5, 254)).cast("string")), ".")
        out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "iban", iban).when(kind == "phone", plain(canonical, F.when(attempt < FREER, 2).otherwise(1)))
        out = out.when(kind == "secret", plain(canonical, key_type))
        return out.when(kind == "surname", _name(stream, kind, canonical, attempt)).when(kind.startswith("given"), _name(stream, kind, canonical, attempt)).otherwise(plain(canonical))

    return let(keyed_hash(F.concat_ws("\u0001", kind, canonical, attempt.cast("string")), key), of)


def _in_layout(kind: Column, surface: Column, other: Column) -> Column:
    """A surrogate in the layout of a mention: separators, case."""

    def cased(value):
        whole = F.when(surface == F.upper(surface), F.upper(value)).when(F.substring(surface, 1, 1) != F.lower(F.substring(surface, 1, 1)), F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 20)))
        return whole.otherwise(value)

    chars = F.split(surface, "")
    digits = lambda: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substring(other, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d.rlike(r"\d"))), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c != " ", F.substring(other, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d != " ")), F.lit(1))).otherwise(c)), "")
    each = F.array_join(F.zip_with(chars, F.split(other, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")
    return F.when(kind.isin("card", "phone", "ssn"), digits()).when(kind == "iban", spaced).when(kind == "email", each).when(kind == "ip6", F.when(surface == F.upper(surface), F.upper(other)).otherwise(other)).when(kind.startswith("given") | (kind == "surname"), cased(other)).otherwise(other)


def attempts(atoms: DataFrame, key: str, workspace: Workspace) -> DataFrame:
    """(kind, canonical, attempt) of the distinct ``atoms`` whose attempt isn't the first.

    Rounds compare all surrogates with each other and with the atoms themselves,
    until all are distinct.  If ROUNDS aren't enough, there are too few surrogates
    of a form, and that is an error.
    """
    known = workspace.save(atoms.distinct())
    state = workspace.save(known.withColumn("attempt", F.lit(0)))
    for _ in range(ROUNDS):
        drawn = state.withColumn("other", surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        shared = drawn.groupBy("kind", "other").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("c")).where("c > 1").select("kind", "other", "first")
        real = drawn.join(known.select("kind", F.col("canonical").alias("other")), ["kind", "other"], "left_semi").select("kind", "canonical", "attempt")
        later = drawn.join(shared, ["kind", "other"]).where(F.struct("attempt", "canonical") != F.col("first")).select("kind", "canonical", "attempt")
        again = workspace.save(real.union(later).distinct())
        if not again.limit(1).count():
            return state.where("attempt > 0")
        state = workspace.save(state.join(again.select("kind", "canonical", F.lit(1).alias("more")), ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise ValueError(f"after {ROUNDS} attempts some entities still have no surrogate of their own")


def replace(docs: DataFrame, text: str = "text", key: str | None = None, workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced by its surrogate.

    ``key`` decides the surrogates; without it a random one is drawn, and two
    calls differ.  A name found with a title or given name is also replaced where
    it, or its given name, stands alone in the same text, also in capitals, and as a whole in small letters.  Of entities that overlap
    the one that begins first counts, of those at one place the earlier of KINDS.
    Local parts of addresses have 128 characters at most (the standard allows 64);
    texts of any length are read whole.  Null texts stay null; texts without
    entities stay as they are; repeated rows are replaced alike.
    """
    workspace, key = workspace or Workspace(docs.sparkSession, "surrogates"), key or secrets.token_hex(16)
    columns = docs.columns
    every = docs.select(F.explode(F.flatten(found_atoms(F.col(text)))).alias("a")).where("a.kind is not null and a.kind <> 'title'").select("a.kind", "a.canonical")
    later = workspace.save(attempts(every, key, workspace))
    name = lambda kind, canonical: F.concat_ws("\u0001", kind, canonical)
    if later.count() <= LITERAL:
        table = {f"{r['kind']}\u0001{r['canonical']}": r["attempt"] for r in later.collect()}
        known = docs.withColumn("_later", F.from_json(F.lit(json.dumps(table)), "map<string,int>"))
    else:
        keyed = docs.withColumn("_hash", F.struct(F.xxhash64(text), F.md5(F.col(text).cast("binary"))))
        own = keyed.select("_hash", F.explode(F.array_distinct(F.transform(F.flatten(found_atoms(F.col(text))), lambda a: F.struct(a["kind"].alias("kind"), a["canonical"].alias("canonical"))))).alias("a"))
        own = own.distinct().select("_hash", "a.kind", "a.canonical").join(later, ["kind", "canonical"])
        own = own.groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("canonical")), "attempt"))).alias("_later"))
        known = keyed.join(own, "_hash", "left").withColumn("_later", F.coalesce("_later", F.from_json(F.lit("{}"), "map<string,int>")))

    def made(atom):
        attempt = F.coalesce(F.try_element_at(F.col("_later"), name(atom["kind"], atom["canonical"])), F.lit(0))
        other = let(surrogate(atom["kind"], atom["canonical"], attempt, key), lambda s: _in_layout(atom["kind"], atom["surface"], s))
        return F.when(atom["kind"].isNull() | (atom["kind"] == "title"), atom["surface"]).otherwise(other)

    def rewritten(atoms):
        surnames = F.array_distinct(F.filter(F.flatten(atoms), lambda a: (a["kind"] == "surname") | a["kind"].startswith("given")))
        pieces = F.split(F.col(text), ENTITY, -1)
        word = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])"))
        # a name token also in capitals, and a whole name in small letters: alone these may be common words
        forms = lambda acc, a: let(made(a), lambda m: F.regexp_replace(F.regexp_replace(acc, word(a["surface"]), m), word(F.upper(a["surface"])), F.upper(m)))
        people = F.filter(F.transform(atoms, lambda m: F.filter(m, lambda a: (a["kind"] == "surname") | a["kind"].startswith("given"))), lambda m: F.size(m) > 1)
        low = lambda m, part: F.lower(F.array_join(F.transform(m, part), " "))
        whole = lambda p: F.aggregate(people, p, lambda acc, m: F.regexp_replace(acc, word(low(m, lambda a: a["surface"])), low(m, made)))
        alone = lambda p: F.aggregate(surnames, whole(p), forms)
        left = F.when(F.size(surnames) > 0, F.transform(pieces, alone)).otherwise(pieces)
        between = lambda m: F.when(F.exists(m, lambda a: a["kind"] == "surname"), F.lit(" ")).otherwise(F.lit(""))
        mended = F.transform(atoms, lambda m: F.call_function("array_join", F.transform(m, made), between(m)))
        return F.array_join(F.zip_with(left, mended, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    new = let(found_atoms(F.col(text)), lambda atoms: F.when(F.size(atoms) > 0, rewritten(atoms)).otherwise(F.col(text)))
    return known.withColumn(text, new).select(columns)
