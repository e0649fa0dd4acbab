"""Surrogates for personal data.  Native column expressions only.

Every detected entity is replaced by a keyed surrogate of its own type, script, gender and format.  Equal
entities (after normalisation) get equal surrogates everywhere, different ones different surrogates.

Numbers and addresses are permuted: the places that may change, each with the size of its alphabet, span all
values of one format, and a keyed Feistel network over them is one to one.  The surrogate is one step along
the permuted order, so nothing is its own surrogate and a format never runs out of room.  Names are invented
and drawn, as real names have no bound.  Surrogates that meet a detected entity, or one of another format, are
drawn again with another key; where entities fill over a quarter of a format they may stand for each other.

A person is replaced name by name: the given name by one of the same script and gender, the others by family
names of the same script; titles and particles stay.  So "Mr. John Smith", "MR JOHN SMITH" and "Mr. Smith's"
agree.  Telephone numbers keep their country code, addresses their range.  Persons are found by their titles
only: no list of names is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop_cut

WORD = r"\p{L}\p{N}"
EMAIL = rf"(?<![{WORD}._%+-])[{WORD}._%+-]++@[{WORD}-]++(?:\.[{WORD}-]++)+"
CARD = rf"(?<![{WORD}])(?:[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{3}}|[0-9]{{13,19}})(?![{WORD}])"
PHONE = rf"(?<![{WORD}+])(?:\+?[0-9]{{1,3}}[ .-]?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}|\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,4}}|(?:1[ .-])?\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}})(?![{WORD}])"
SSN = rf"(?<![{WORD}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{WORD}-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![{WORD}.])(?:{OCTET}\.){{3}}{OCTET}(?![{WORD}]|\.[0-9])"
IPV6 = rf"(?<![{WORD}:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{{1,4}}:){{2,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,5}})(?![{WORD}:.])"
IBAN = rf"(?<![{WORD}])[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![{WORD}])"
#: Titles that tell a gender, and titles that do not.
MALE, FEMALE = "Mr|Mister|Sir|Herr|Señor|Monsieur|Signor|Господин|Κύριος|Κύριε", "Mrs|Ms|Miss|Madam|Lady|Frau|Señora|Señorita|Madame|Mademoiselle|Signora|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Doctor|Professor|Доктор|Профессор"
#: Small words inside a name.  They stay.
PARTICLES = "von|van|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|ten|ter|zu|zum|zur"
TITLES = f"{FEMALE}|{MALE}|{NEUTRAL}"
#: Titles as they are written: plain, in capitals, in small letters.  Their first letters are looked at first.
WRITTEN = "|".join(sorted({form for t in TITLES.split("|") for form in (t, t.upper(), t.lower())}, reverse=True))
TITLE = rf"(?<![{WORD}])(?=[{''.join(sorted({t[0] for t in WRITTEN.split('|')}))}])(?:{WRITTEN})\.?\x20(?:(?i:{PARTICLES})\x20)*(?=\p{{Lu}})"
NAME = rf"(?:(?!(?:{WRITTEN})(?![{WORD}]))(?:\p{{Lu}}\.(?=\x20)|\p{{Lu}}[\p{{L}}\p{{M}}-]*(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}-]+)?))"
PERSON = (
    rf"{TITLE}{NAME}(?:(?:\x20(?i:{PARTICLES})(?=\x20(?:\p{{Lu}}|(?i:{PARTICLES})\x20)))*\x20{NAME}){{0,3}}"
    # a word in small letters: a name if it is one elsewhere
    rf"(?:\x20\p{{Ll}}[\p{{L}}\p{{M}}-]++)?"
)
KINDS = (("email", EMAIL), ("iban", IBAN), ("card", CARD), ("phone", PHONE), ("ssn", SSN), ("ip", IP), ("ipv6", IPV6), ("person", PERSON))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: For texts without a title.
NUMBERS = "|".join(f"(?:{p})" for _, p in KINDS[:-1])
#: Sounds of invented names, and the ends of given and family names.
SOUNDS = {"latin": ("b d f g h j k l m n p r s t v w z ch sh th br tr", "a e i o u ai ei"), "cyrillic": ("б в г д ж з к л м н п р с т ф х ц ч ш", "а е и о у я ю"), "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο ου αι ει")}
ENDS = {
    ("given", "latin", "male"): "o an us er im on ert as", ("given", "latin", "female"): "a ia ina elle ara ette isa une", ("given", "latin", "any"): "e y is il en",
    ("given", "cyrillic", "male"): "ан ей ор ил ир ат", ("given", "cyrillic", "female"): "а ия ина ара ья ея", ("given", "cyrillic", "any"): "е и о",
    ("given", "greek", "male"): "ος ης ας", ("given", "greek", "female"): "α η ια ινη", ("given", "greek", "any"): "ι ω",
    ("family", "latin", ""): "er in ard sen ley mann ot ini ez ow", ("family", "cyrillic", ""): "ов ин ский ко ев ук", ("family", "greek", ""): "ου ιδης ακης ας",
}
#: What a place may change to: the others of its alphabet.
ALPHABETS = {"d": "0123456789", "n": "123456789", "l": "abcdefghijklmnopqrstuvwxyz", "c": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "g": "αβγδεζηθικλμνξοπρστυφχψω", "a": "àáâäèéêëìíîïòóôöùúûüçñ", "h": "0123456789abcdef"}
#: First octets of addresses that are neither private, local nor group ones, nor share their first octet with such.
PLAIN_OCTETS = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
#: Country codes of one and two digits; the others have three.  Fixed values.
COUNTRY = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Leading octets that tell private, local and group addresses.  Fixed values.
RANGES = r"^(10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
#: Rounds of the permutation, and the share of a format's values (one in so many) from which it is crowded.
FEISTEL, CROWDED = 4, 4


def chosen(text: Column, for_titles: Column, for_others: Column) -> Column:
    """The first for texts with a title before a name, the second for others that have a digit or an at sign,
    which every entity but a name has: names are looked for where a title is, which is cheap to tell."""
    return F.when(text.rlike(TITLE), for_titles).when(text.rlike("[0-9@]"), for_others)


def holds(text: Column) -> Column:
    return F.coalesce(chosen(text, text.rlike(ANY), text.rlike(NUMBERS)), F.lit(False))


def kind_of(value: Column) -> Column:
    """The kind of a match.  Whether a name ends where it does depends on what follows: what is no other kind
    is a person."""
    out = None
    for name, pattern in KINDS[:-1]:
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(KINDS[-1][0])


def normal(kind: Column, value: Column) -> Column:
    """What equal entities have in common: digits of numbers (of telephones in full, with the country code),
    lower case of the rest."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = value.startswith("+") | ((F.length(digits) != 10) & ~((F.length(digits) == 11) & digits.startswith("1")))
    phone = F.when(abroad | (F.length(digits) == 11), F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+1"), digits))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.lower(F.replace(value, F.lit(" "), F.lit("")))).when(kind == "ip", value).otherwise(F.lower(value))


def script_of(word: Column) -> Column:
    """The script of a name's letters; nothing where it is none that names can be invented in."""
    return F.when(word.rlike(r"^[\p{IsLatin}\p{M}'’.-]+$"), "latin").when(word.rlike(r"^[\p{IsCyrillic}\p{M}'’.-]+$"), "cyrillic").when(word.rlike(r"^[\p{IsGreek}\p{M}'’.-]+$"), "greek")


def is_name(word: Column) -> Column:
    return ~word.rlike(rf"^(?i:{PARTICLES})$") & script_of(word).isNotNull()


def parts_of(kind: Column, value: Column) -> Column:
    """``struct(i, kind, norm, gender, sure)`` of what is replaced by itself: the names of a person by their
    place among its words, or the whole value.  The last name is the family name, the first of several the
    given.  A last word in small letters is not sure to be a name."""
    words = F.split(value, "\x20")
    gender = F.when(words[0].rlike(rf"^(?i:{FEMALE})\.?$"), "female").when(words[0].rlike(rf"^(?i:{MALE})\.?$"), "male").otherwise("any")
    named = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: (x["i"] > 0) & is_name(x["w"]))
    sure = F.filter(named, lambda x: x["w"].rlike(r"^\p{Lu}"))
    last = F.size(sure) - 1

    def part(x: Column, n: Column) -> Column:
        given = (n == 0) & (last > 0)
        word = F.lower(F.regexp_replace(x["w"], "[.]$", ""))
        what = F.concat(F.when(given, "given:").otherwise("family:"), script_of(x["w"]), F.lit(":"))
        return F.struct(x["i"].alias("i"), what.alias("kind"), word.alias("norm"), F.when(given, gender).alias("gender"), x["w"].rlike(r"^\p{Lu}").alias("sure"))

    whole = F.array(F.struct(F.lit(0).alias("i"), kind.alias("kind"), normal(kind, value).alias("norm"), F.lit(None).cast("string").alias("gender"), F.lit(True).alias("sure")))
    return F.when(kind == "person", F.transform(named, part)).otherwise(whole)


def _digest(secret: str, *parts: Column) -> Column:
    inner = F.sha2(F.concat_ws("\x1f", F.lit(secret), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat(F.lit(secret), inner), 256)


def _number(digest: Column, at: Column | int, modulus: int) -> Column:
    """A number below ``modulus`` from four of the digest's 64 digits."""
    start = F.lit(at) if isinstance(at, int) else at
    part = F.substr(digest, (start * 3) % 60 + 1, F.lit(4))
    return (F.conv(part, 16, 10).cast("long") % modulus).cast("int")


def _words(listed: str) -> Column:
    return F.array(*[F.lit(x) for x in listed.split()])


def _pick(digest: Column, at: Column | int, listed: Column) -> Column:
    return F.element_at(listed, _number(digest, at, 1 << 16) % F.size(listed) + 1)


def _name(digest: Column, draw: Column, kind: Column) -> Column:
    """An invented name in lower case.  Each second draw is a syllable longer, so there is always room."""
    script = F.split(kind, ":")[1]
    consonants, vowels = (F.coalesce(*[F.when(script == n, _words(v[k])) for n, v in SOUNDS.items()]) for k in (0, 1))
    ends = F.coalesce(*[F.when(kind == ":".join(parts), _words(listed)) for parts, listed in ENDS.items()])
    count = F.least(2 + F.floor(draw / 2), F.lit(9)).cast("int")
    syllables = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(_pick(digest, i * 2, consonants), _pick(digest, i * 2 + 1, vowels)))
    return F.concat(F.array_join(syllables, ""), _pick(digest, 0, consonants), _pick(digest, 1, ends))


def luhn_ok(digits: Column) -> Column:
    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + (i % 2))
        return F.when(d > 9, d - 9).otherwise(d)

    figures = F.transform(F.split(F.reverse(digits), ""), weighed)
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(stem: Column) -> Column:
    """The last digit that makes a card number valid."""
    return F.element_at(F.filter(F.array(*[F.lit(d) for d in range(10)]), lambda d: luhn_ok(F.concat(stem, d.cast("string")))), 1)


def _mod_97(text: Column) -> Column:
    """Of digits and small letters, which count as 10 to 35."""
    values = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABETS["d"] + ALPHABETS["l"]), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def places(kind: Column, norm: Column) -> Column:
    """``array<struct(s, a)>``: the symbols of an entity in normal form and the alphabet of each (nothing: it
    stays).  Entities with the same alphabets, and the same symbols where there are none, are a format."""
    octets = F.split(norm, "[.]")
    fixed = F.when(octets[0].isin("169", "172", "192"), 2).when(octets[0].isin("0", "10", "127") | (octets[0].cast("int") > 223), 1).otherwise(0)
    ip = F.transform(octets, lambda o, i: F.struct(o.alias("s"), F.when(i < fixed, F.lit(None)).when(i == 0, "p").otherwise("o").alias("a")))
    code = F.length(F.regexp_extract(norm, COUNTRY, 0))
    invented = norm.rlike("^[+]1[0-9]{3}555[0-9]{4}$")
    # telephone: after the country code; cards: all but the check digit; accounts: after country and check digits
    start = F.when(kind == "phone", code).when(kind == "iban", 4).otherwise(0)
    stop = F.when(kind == "card", F.length(norm) - 1).otherwise(F.length(norm))
    groups = F.instr(norm, ":")
    text = F.when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(norm)

    def letter(c: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), "d")
        for name in "lcga":
            out = out.when(F.lit(ALPHABETS[name]).contains(c), name)
        return out

    def one(c: Column, i: Column) -> Column:
        kept = (i < start) | (i >= stop) | ((kind == "phone") & invented & (i >= 5) & (i < 8)) | ((kind == "ipv6") & (i < groups))
        first = kind.isin("phone", "card") & (i == start)
        own = F.when(kind == "ipv6", F.when(c.rlike("[0-9a-f]"), "h")).when(first, F.when(c != "0", "n")).otherwise(letter(c))
        return F.struct(c.alias("s"), F.when(~kept, own).alias("a"))

    return F.when(kind == "ip", ip).otherwise(F.transform(F.split(text, ""), one))


def domain_places(norm: Column) -> Column:
    """The same for the domain of a mail address: its last label stays."""
    domain = F.substring_index(norm, "@", -1)
    stop = F.length(domain) - F.length(F.substring_index(domain, ".", -1))

    def one(c: Column, i: Column) -> Column:
        own = F.when(c.rlike("[0-9]"), "d")
        for name in "lcga":
            own = own.when(F.lit(ALPHABETS[name]).contains(c), name)
        return F.struct(c.alias("s"), F.when(i < stop, own).alias("a"))

    return F.transform(F.split(domain, ""), one)


def _listed(alphabet: Column) -> Column:
    out = F.when(alphabet == "o", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda n: n.cast("string"))).when(alphabet == "p", F.array(*[F.lit(str(n)) for n in PLAIN_OCTETS]))
    for name, letters in ALPHABETS.items():
        out = out.when(alphabet == name, F.split(F.lit(letters), ""))
    return out


def radix(alphabet: Column) -> Column:
    out = F.when(alphabet == "o", 256).when(alphabet == "p", len(PLAIN_OCTETS))
    for name, letters in ALPHABETS.items():
        out = out.when(alphabet == name, len(letters))
    return out


def _turn(half: Column, by: Column, sign: int) -> Column:
    """Each symbol moved along its alphabet by a number of the digest."""
    return F.transform(half, lambda x, i: F.struct(F.pmod(x["v"] + sign * _number(by, i, 1 << 16), x["m"]).alias("v"), x["m"].alias("m")))


def permuted(rows: DataFrame, source: str, out: str, secret: str, tweak: list[Column]) -> DataFrame:
    """Adds ``out``: the symbols of ``source`` (``places``) one step along a keyed order of their format.

    The order is a Feistel network over the symbols that may change: it is undone after the step, so the
    map is one to one on the format and has no fixed point where anything may change."""

    def keyed(i: int, other: str) -> Column:
        return _digest(secret, *tweak, F.lit(out), F.lit(i), F.size(other), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","))

    free = F.filter(source, lambda x: x["a"].isNotNull())
    coded = F.transform(free, lambda x: F.struct((F.array_position(_listed(x["a"]), x["s"]).cast("int") - 1).alias("v"), radix(x["a"]).alias("m")))
    half = F.ceil(F.size("_x") / 2).cast("int")
    rows = rows.withColumn("_x", coded).withColumns({"_l": F.slice("_x", 1, half), "_r": F.slice("_x", half + 1, F.size("_x") - half)})
    for i in range(FEISTEL):
        mine, other = ("_l", "_r") if i % 2 == 0 else ("_r", "_l")
        rows = rows.withColumn("_d", keyed(i, other)).withColumn(mine, _turn(F.col(mine), F.col("_d"), 1))
    step = F.transform("_l", lambda x, i: F.struct(F.pmod(x["v"] + F.when(i == 0, 1).otherwise(0), x["m"]).alias("v"), x["m"].alias("m")))
    rows = rows.withColumn("_l", step)
    for i in reversed(range(FEISTEL)):
        mine, other = ("_l", "_r") if i % 2 == 0 else ("_r", "_l")
        rows = rows.withColumn("_d", keyed(i, other)).withColumn(mine, _turn(F.col(mine), F.col("_d"), -1))
    rows = rows.withColumn("_x", F.concat("_l", "_r"))
    # the k-th symbol that may change takes the k-th new one
    ranks = F.transform(F.col(source), lambda x, i: F.size(F.filter(F.slice(F.col(source), 1, i + 1), lambda y: y["a"].isNotNull())))
    new = F.zip_with(source, ranks, lambda x, k: F.when(x["a"].isNull(), x["s"]).otherwise(F.element_at(_listed(x["a"]), F.get(F.col("_x"), k - 1)["v"] + 1)))
    return rows.withColumn(out, new).drop("_x", "_l", "_r", "_d")


def drawn_surrogates(rows: DataFrame, secret: str, draw: int) -> DataFrame:
    """Adds ``surrogate`` in normal form: digits for numbers, lower case for the rest."""
    kind, norm = F.col("kind"), F.col("norm")
    # card numbers that miss their check digit by as much are a format, and so on
    rows = permuted(rows, "places", "_main", secret, [kind, F.lit(draw)])
    rows = permuted(rows, "domain", "_dom", secret, [F.lit("domain")])  # one for each domain: relations between addresses stay
    rows = rows.withColumn("_h", _digest(secret, kind, norm, F.lit(draw)))
    text = F.array_join("_main", "")
    stem = F.substr(text, F.lit(1), F.length(text) - 1)
    missed = F.element_at(F.split(norm, ""), -1).cast("int") - _luhn_digit(F.substr(norm, F.lit(1), F.length(norm) - 1))
    card = F.concat(stem, F.pmod(_luhn_digit(stem) + missed, F.lit(10)).cast("string"))
    inner = F.substr(text, F.lit(5))
    off = _mod_97(F.concat(F.substr(norm, F.lit(5)), F.substr(norm, F.lit(1), F.lit(4)))) == 1
    check = F.lpad((98 - _mod_97(F.concat(inner, F.substr(norm, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(off, F.concat(F.substr(norm, F.lit(1), F.lit(2)), check, inner)).otherwise(text)
    mail = F.concat(text, F.lit("@"), F.array_join("_dom", ""), F.lit(".example"))
    name = _name(F.col("_h"), F.lit(draw), kind)
    name = F.when(norm.contains("-"), F.concat_ws("-", name, _name(F.sha2("_h", 256), F.lit(draw), kind))).otherwise(name)
    out = F.when(kind.contains(":"), name).when(kind == "email", mail).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", F.array_join("_main", ".")).otherwise(text)
    return rows.withColumn("surrogate", out).drop("_main", "_dom", "_h")


def _cased(value: Column, surrogate_: Column) -> Column:
    """A name written the way ``value`` is: all capitals, or a capital at each start."""
    capital = F.replace(F.initcap(F.replace(surrogate_, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))
    return F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(surrogate_)).otherwise(capital)


def _like(value: Column, new: Column) -> Column:
    """Letters in the case of the letters at their places; what is beyond stays small."""
    return F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when((i < F.length(value)) & F.substr(value, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def in_format(kind: Column, value: Column, parts: Column) -> Column:
    """``value`` with the surrogates of its ``parts`` (``i, surrogate``) written the way it is: its
    separators, its case."""
    whole = parts[0]["surrogate"]
    spaced = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    # a telephone number without its country code takes the last digits
    figures = F.regexp_replace(whole, "^[+]", "")
    figures = F.substr(figures, F.length(figures) - F.length(spaced) + 1)

    # the k-th digit or letter of the value becomes the k-th of the surrogate
    def place(c: Column, i: Column) -> Column:
        upto = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(figures, upto, F.lit(1))).otherwise(c)

    numbers = F.upper(F.array_join(F.transform(F.split(value, ""), place), ""))

    def word(w: Column, i: Column) -> Column:
        mine = F.get(F.filter(parts, lambda p: p["i"] == i), F.lit(0))["surrogate"]
        initial = w.rlike("[.]$") | (F.length(w) == 1)
        name = F.when(initial, F.concat(F.upper(F.substr(mine, F.lit(1), F.lit(1))), F.when(w.endswith("."), ".").otherwise(""))).otherwise(_cased(w, mine))
        return F.when(mine.isNull(), w).otherwise(name)

    # with no part to replace there is nothing but the value
    person = F.array_join(F.transform(F.split(value, "\x20"), word), " ")
    out = F.when(kind.isin("card", "phone", "ssn", "iban"), numbers).when(kind == "ip", whole).when(kind == "person", person).otherwise(F.when(F.upper(value) == value, F.upper(whole)).otherwise(_like(value, whole)))
    return F.coalesce(out, value)


def gendered(parts: DataFrame) -> DataFrame:
    """``kind, norm`` of distinct parts.  The gender of a given name is what its titles say all over the
    corpus, so that it is one name with and without a title that tells; names of either gender are of none."""
    each = parts.groupBy("kind", "norm").agg(F.min(F.when(F.col("gender") != "any", F.col("gender"))).alias("_a"), F.max(F.when(F.col("gender") != "any", F.col("gender"))).alias("_z"))
    gender = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise("any")
    return each.select(F.col("kind").alias("part"), F.when(F.col("kind").startswith("given:"), F.concat("kind", gender)).otherwise(F.col("kind")).alias("kind"), "norm")


def distinct_surrogates(entities: DataFrame, secret: str, name: str = "pii-map") -> DataFrame:
    """``part, kind, norm, surrogate`` of distinct entities: no two of a kind alike, none a detected entity of
    its kind unless these fill over a quarter of its format, none its own.

    A draw holds if it is no entity, not taken, and its claimant is the first in order.  Permuted draws of
    a format do not clash with each other, so as a rule the first draw holds for nearly all."""
    if "part" not in entities.columns:
        entities = entities.withColumn("part", F.col("kind"))
    family = F.split("kind", ":")[0]  # given names of all genders are told apart
    placed = entities.select("part", "kind", "norm", F.when(~F.col("kind").contains(":"), places(F.col("kind"), F.col("norm"))).alias("places"), F.when(F.col("kind") == "email", domain_places(F.col("norm"))).alias("domain"))
    empty = F.array().cast("array<struct<s:string,a:string>>")
    placed = placed.withColumns({"places": F.coalesce("places", empty), "domain": F.coalesce("domain", empty), "_family": family})
    # of cards a format has one in ten of the values: the check digit, right or as far off
    shaped = F.when(F.col("kind") == "card", F.slice("places", 1, F.size("places") - 1)).otherwise(F.col("places"))
    shape = F.array_join(F.transform(shaped, lambda x: F.coalesce(F.concat(F.lit("\x01"), x["a"]), x["s"])), "\x02")
    room = F.aggregate("places", F.lit(0.0), lambda a, x: a + F.log(F.coalesce(radix(x["a"]), F.lit(1)).cast("double")))
    pending = cut(placed.withColumns({"_shape": shape, "_room": room}), name)
    counts = pending.groupBy("kind", "_shape").agg(F.count("*").alias("_n"), F.first("_room").alias("_size"))
    crowded = counts.where((F.log(F.col("_n").cast("double")) + F.log(F.lit(float(CROWDED))) > F.col("_size")) & ~F.col("kind").contains(":") & (F.col("kind") != "email")).select("kind", "_shape")
    known = pending.select("_family", F.col("norm").alias("surrogate"))
    kept = ["part", "kind", "norm", "surrogate", "_family"]
    full = pending.join(crowded.hint("merge"), ["kind", "_shape"], "left_semi")
    done = cut(drawn_surrogates(full, secret, 0).select(*kept), name)
    pending = cut(pending.join(crowded.hint("merge"), ["kind", "_shape"], "left_anti"), name)
    claims, draw = Window.partitionBy("_family", "surrogate").orderBy("kind", "norm"), 0
    while not pending.isEmpty():
        drawn = cut(drawn_surrogates(pending, secret, draw).withColumn("_claim", F.row_number().over(claims)), name)
        blocked = known.unionByName(done.select("_family", "surrogate"))
        held = drawn.where("_claim = 1").join(blocked.hint("merge"), ["_family", "surrogate"], "left_anti").select(*kept)
        held = cut(held, name)
        done = done.unionByName(held)
        pending = cut(pending.join(held.select("kind", "norm").hint("merge"), ["kind", "norm"], "left_anti"), name)
        drop_cut(drawn)
        draw += 1
    return done.drop("_family")


def replace_private(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with surrogates, and the number of entities of each kind (``n_email`` ...).  Surrogates
    depend on ``secret`` alone, besides what they replace and the draws that clash.

    One row per input row.  Null texts stay null, texts without entities are untouched to the last
    character; repeated rows and copies get the same text; texts of any length are taken whole; of entities
    that draw the same surrogate the first in order keeps it; an empty table gives no rows.  Only texts with entities are shuffled, by a
    hash of the text, so copies share one entry of the lookup and adaptive execution can split them."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some = rows.where(holds(F.col("_text")))
    whole_text = F.col("_text")
    hits = chosen(whole_text, *[F.regexp_extract_all(whole_text, F.lit(p), F.lit(0)) for p in (ANY, NUMBERS)])
    listed = some.select(F.md5(F.col("_text").cast("binary")).alias("_hash"), hits.alias("_hits")).groupBy("_hash").agg(F.first("_hits").alias("_hits"))
    listed = cut(listed, "pii-hits")
    each = listed.select("_hash", F.posexplode("_hits").alias("_i", "_value"))
    each = each.withColumn("kind", kind_of(F.col("_value")))
    each = each.select("_hash", "_i", "_value", F.col("kind").alias("_kind"), F.explode_outer(parts_of(F.col("kind"), F.col("_value"))).alias("_part"))
    each = cut(each.select("_hash", "_i", "_value", "_kind", F.col("_part.i").alias("i"), F.col("_part.kind").alias("part"), "_part.norm", "_part.gender", "_part.sure"), "pii-each")
    parts = each.where("sure").select(F.col("part").alias("kind"), "norm", "gender")
    names = cut(distinct_surrogates(gendered(parts), secret).drop("kind"), "pii-names")
    whole = each.join(names, ["part", "norm"], "left").groupBy("_hash", "_i").agg(F.first("_value").alias("_value"), F.first("_kind").alias("kind"), F.sort_array(F.collect_list(F.struct("i", "surrogate"))).alias("_parts"))  # the words of a name
    new = in_format(F.col("kind"), F.col("_value"), F.col("_parts"))
    written = whole.select("_hash", F.struct("_i", new.alias("new"), "kind").alias("_new"))
    by_text = cut(written.groupBy("_hash").agg(F.sort_array(F.collect_list("_new")).alias("_news")), "pii-texts")  # of one text
    joined = some.withColumn("_hash", F.md5(F.col("_text").cast("binary"))).join(by_text, "_hash")
    pieces = chosen(whole_text, *[F.split(whole_text, p, -1) for p in (ANY, NUMBERS)])
    news = F.concat(F.transform("_news", lambda x: x["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(pieces, news, lambda a, b: F.concat(a, b)), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("_news", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    changed = joined.select(F.col("_key").alias(key), rebuilt.alias(text), *[count(k) for k, _ in KINDS])
    rest = rows.where(~holds(F.col("_text")))
    untouched = rest.select(F.col("_key").alias(key), F.col("_text").alias(text), *[F.lit(0).cast("long").alias(f"n_{k}") for k, _ in KINDS])
    return changed.unionByName(untouched)
