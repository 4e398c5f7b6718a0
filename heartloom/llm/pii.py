"""Personal data: detection and keyed, type-consistent surrogates, in native expressions only.

A surrogate is drawn once for each distinct entity of the corpus, from a secret key, the entity's type and its canonical
form; documents then look their entities up, so an entity has one surrogate wherever it occurs. Letters become letters
of the same script and case, digits become digits, separators stay. A card number keeps its issuer digit, an IBAN its
country, and both whether their check digits are right; a phone number keeps its country code or leading zero, an
e-mail its registered domain, an IPv6 address its first digit, a person the title, particles, hyphens and apostrophes.
A given name gets an ending usual for its gender: that of the titles it is seen with anywhere in the corpus (the more
frequent one), else the one it usually has.

Persons are found after a title, or by a common given name before a capitalised name. A surname of a person found so is
also replaced where it stands alone in the same document, capitalised as a name. Names that stand alone without either
are not found.

No surrogate is shared by two entities of a type or equals a real one: all drawn surrogates are checked against each
other and against all entities on Spark, and those that clash are drawn again. A form that stays too dense after
``OWN_FORM`` draws is widened by letters or digits, so this ends even where all values of a form are entities (a
widened ip or ssn is longer than a valid one). Initials are rotated in their alphabet, which keeps them distinct.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartloom.llm.common import SALT, cut, dealt, hot_keys, small, spread
from heartloom.llm.quality_rules import let

#: Titles and the gender that they tell. Fixed values.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Господин", "Κύριος", "MR", "HERR", "monsieur", "señor", "don"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Lady", "Госпожа", "Κυρία", "MRS", "MS", "FRAU", "MME", "Mademoiselle", "madame", "mademoiselle", "señora", "señorita", "doña"),
    "n": ("Dr", "Prof", "DR", "PROF", "Doctor", "Professor", "doctor", "professor"),
}
#: Common given names that are hardly other words, and their usual gender. Fixed values.
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jeffrey Jacob Nicholas Eric Jonathan Stephen Benjamin Samuel Peter Paul Hans Klaus Jürgen Wolfgang Stefan Andreas Jean Pierre Jacques François Antoine Olivier Laurent José Juan Carlos Luis Javier Miguel Pedro Pablo Diego Fernando Giovanni Giuseppe Marco Ivan Sergei Dmitri Иван Сергей Дмитрий Алексей Γιώργος Γιάννης Δημήτρης Mohammed Ahmed Ali Omar".split(),
    "f": "Mary Maria Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Cynthia Anna Anne Ursula Monika Petra Sabine Claudia Katrin Marie Sophie Camille Isabelle Nathalie Carmen Ana Lucía Elena Isabel Teresa Giulia Francesca Chiara Olga Natalia Svetlana Анна Мария Ольга Елена Μαρία Ελένη Κατερίνα Fatima Aisha".split(),
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_LETTER = r"\p{L}\p{M}"
#: A capitalised word of a name: John, JOHN, McDonald, Jean-Luc, O'Neil, J.
_WORD = rf"\p{{Lu}}[{_LETTER}]*+(?:-[{_LETTER}]++|['’]\p{{Lu}}[{_LETTER}]*+)*+"
_GAP = rf"(?:(?<=(?<![{_LETTER}])\p{{Lu}})\.)?[ \x{{A0}}]{{1,2}}"
#: Particles that stand between the words of a name. Fixed values.
_PARTICLE = r"(?:(?:de|del|della|di|da|dos|das|du|des|la|le|los|van|von|vom|der|den|ter|ten|zu|zum|zur|bin|ibn|al|el|af|av)[ \x{A0}]|[dl]['’])"
_MORE = rf"(?:{_GAP}{_PARTICLE}{{0,3}}+(?!(?:{_TITLE})\b){_WORD})"


def _first_letters(names: list[str]) -> str:
    """An alternation of names that branches by first letter."""
    by = defaultdict(list)
    for x in names:
        by[x[0]].append(x[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


_COMMON = rf"(?=\p{{Lu}})(?iu:{_first_letters(GIVEN['m'] + GIVEN['f'])})(?:-\p{{Lu}}[{_LETTER}]++)?(?![{_LETTER}'’])"

_L = r"A-Za-z0-9\x{C0}-\x{1FFF}\x{2C00}-\x{D7FF}"  # letters and digits of addresses; general punctuation is none
_HEAD = rf"(?<![{_L}])"
_V4 = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"
_V6 = r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]{0,39}+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{1,4}:){0,7}:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:])"
#: Beginnings that only keys have, and the words before an unquoted secret. Fixed values.
_MARKED = r"(?:gh[pousr]_[A-Za-z0-9]{20,}+|AKIA[0-9A-Z]{16}(?![0-9A-Z])|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)"
_BARE = r"(?<=[=:]|[=:] )(?<=(?<![A-Za-z])(?i:token|secret|password|passwd|pwd|api_key|apikey|api-key)\s?[=:]\s?)(?=[^\s\"',;<>]*?\d)[^\s\"',;<>]{6,}+(?<![.)\]])"
_QUOTED = r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey|key)\s{0,3}[=:]\s{0,3}[\"'])[^\"'\s]{6,}+(?=[\"'])"
_HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
#: Types in the order in which they are tried. All parts are linear for the texts they meet: open-ended ones are possessive
#: and begin only where a run begins.
PATTERNS = {
    "email": rf"(?<=(?<![{_L}._%+'-])[._%+'-]{{0,32}})[{_L}][{_L}._%+'-]*+@[{_L}-]{{1,63}}+(?:\.[{_L}-]{{1,63}}){{0,126}}\.(?:[A-Za-z]{{2,24}}|xn--[a-z0-9-]{{2,59}}|[\x{{C0}}-\x{{1FFF}}\x{{2C00}}-\x{{D7FF}}]{{2,24}})",
    "secret": rf"{_QUOTED}|{_HEX}|{_BARE}|(?<![A-Za-z0-9_]){_MARKED}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"{_V4}|{_V6}",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
    r"|(?<![\d.,:/+-])(?<!\d )(?=(?:[ ()/-]{0,2}\d){9,13}(?![ /-]?\d))(?:\(0[1-9]\d{0,4}\)|0[1-9]\d{0,4})(?:[ /-]{1,2}\d{2,8}){1,4}(?!\d)"
    r"|(?<![\d.,:/+-])(?<!\d )00[1-9]\d{0,2}(?:[ -]\d{2,5}){2,4}(?![ -]?\d)",
    # open-ended and possessive: a name is as long as its capitalised words; only a common given name goes over a line end
    "person": rf"(?<![{_LETTER}])(?:(?:{_TITLE})\.?\s{{1,2}}{_PARTICLE}{{0,3}}+(?:{_COMMON}[ \x{{A0}}]?\n[ \x{{A0}}]?)?+{_WORD}{_MORE}*+|{_COMMON}{_MORE}++)",
}
# At most places a look at one or two characters rules all types out.
_DIGITS = rf"(?=[0-9+(])(?:{_V4}|{PATTERNS['card']}|{PATTERNS['ssn']}|{PATTERNS['phone']})"
_OTHERS = rf"{_QUOTED}|{_BARE}|(?=[AEeGgSsXx])(?<![A-Za-z0-9_]){_MARKED}|(?=[0-9A-Fa-f])(?:{_HEX})|(?=[A-Z]{{2}}\d)(?:{PATTERNS['iban']})|{_V6}|{_DIGITS}|(?=[\p{{Lu}}dmps])(?:{PATTERNS['person']})"
ANY = rf"{_HEAD}(?:{PATTERNS['email']})|{_OTHERS}"
#: A run of letters, as a surname may stand alone, or what lies between two.
_RUN = rf"[{_LETTER}]++(?:-[{_LETTER}]++|['’](?=\p{{Lu}})[{_LETTER}]++)*+|[^{_LETTER}]++"

#: Alphabets by script; a letter of one becomes another of it, other letters become Latin ones.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
_ALL = "".join(ALPHABETS)
#: Endings of given names by gender and script, and syllables that names are made of. Fixed values.
ENDINGS = {"m": (("an", "er", "us", "o"), ("ος", "ης", "ας"), ("ан", "ей", "ил")), "f": (("a", "ia", "ina", "elle"), ("α", "η", "ια"), ("а", "ия", "ина")), "n": (("en", "is", "el", "ar"), ("ω", "ις", "ι"), ("ий", "ь", "ель"))}
CONSONANTS = ("bdfgklmnprstvz", "βγδκλμνπρσ", "бвдгклмнпрст")
VOWELS = ("aeiou", "αεηιο", "аеиоу")
#: Country codes of one and two digits; all others have three. Fixed values.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

HEX = "0123456789abcdef"
ROUNDS = 60
#: Draws of an entity's own form; beyond them the form of its surrogate is widened, by more with each draw.
OWN_FORM = 6


def kind(entity: Column) -> Column:
    """The type of a match of ANY; a whole match decides, the order is that of PATTERNS."""
    out = F
    for name, p in PATTERNS.items():
        if name == "secret":  # its context is gone here: a secret is what fits nothing else
            continue
        out = out.when(F.regexp_like(entity, F.lit(f"^(?:{p})$")), F.lit(name))
    return out.otherwise(F.lit("secret"))


def _bare_name(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{_TITLE})\.?\s{{1,2}}", "")


def gender(entity: Column, word: Column) -> Column:
    """m, f or n: what the title tells, else what a common given name usually has."""
    title = F.regexp_extract(entity, rf"^({_TITLE})\.?\s", 1)
    first = F.substring_index(word, "-", 1)
    usual = F.when(first.isin(*(x.lower() for x in GIVEN["m"])), "m").when(first.isin(*(x.lower() for x in GIVEN["f"])), "f").otherwise("n")
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise(usual)


def parts(entity: Column, type_: Column) -> Column:
    """The separately kept entities of a match: (type, canon, gender). A person's last name is a surname, or a given
    name if it stands alone and is a common one; single letters are initials; the others are given names."""
    struct = lambda a, b, g: F.struct(a.alias("type"), b.alias("canon"), g.alias("gender"))
    common = F.lit([x.lower() for x in GIVEN["m"] + GIVEN["f"]])

    def person(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low = F.lower(w)
            t = F.when(F.length(w) == 1, "initial").when((i < F.size(ws) - 1) | (F.size(ws) == 1) & F.array_contains(common, low), "given").otherwise("surname")
            return struct(t, low, F.when(t == "given", gender(entity, low)).otherwise("n"))

        return F.transform(ws, one)

    bare = F.when(type_.isin("card", "phone", "ssn"), F.regexp_replace(entity, r"[^0-9+]", "")).when(type_ == "iban", F.regexp_replace(entity, " ", "")).when(type_.isin("email", "ip"), F.lower(entity)).otherwise(entity)
    return F.when(type_ == "person", let(F.regexp_extract_all(_bare_name(entity), F.lit(_WORD), F.lit(0)), person)).otherwise(F.array(struct(type_, bare, F.lit("n"))))


def _draw(key: str, type_: Column, canon: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that depend on all of the arguments."""
    seed = F.concat_ws("\u0001", F.lit(key), type_, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("\u00010")), 512), F.sha2(F.concat(seed, F.lit("\u00011")), 512))


def _at(draw: Column, i: Column, n: int | Column) -> Column:
    """Number i of a draw, below n."""
    return F.pmod(F.conv(F.substring(draw, F.pmod(i * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 63).cast("int") * 7, n if isinstance(n, Column) else F.lit(n)).cast("int")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda x: x != "")


def _masked(value: Column, draw: Column, keep: Column, hexadecimal: Column) -> Column:
    """value with each letter and digit replaced by one of its own kind, but for the first ``keep`` characters."""
    ends = [sum(map(len, ALPHABETS[: k + 1])) for k in range(len(ALPHABETS))]

    def pick(p: Column, i: Column) -> Column:
        """A character of the alphabet in which place p of _ALL lies."""
        size = F.lit(len(ALPHABETS[-1]))
        start = F.lit(ends[-2])
        for k in range(len(ends) - 2, -1, -1):
            start, size = F.when(p <= ends[k], ends[k - 1] if k else 0).otherwise(start), F.when(p <= ends[k], len(ALPHABETS[k])).otherwise(size)
        return F.substring(F.lit(_ALL), start + _at(draw, i, size) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        low = F.lower(c)
        new = lambda p: F.when(hexadecimal, F.substring(F.lit(HEX), _at(draw, i, 16) + 1, F.lit(1))).otherwise(pick(p, i))
        place = F.when(F.instr(F.lit(_ALL), low) > 0, F.instr(F.lit(_ALL), low)).when(F.regexp_like(c, F.lit(r"\p{L}")), 11).otherwise(0)
        cased = lambda x: F.when(c == low, x).otherwise(F.upper(x))
        return let(place, lambda p: F.when((i < keep) | (p == 0), c).otherwise(let(new(p), cased)))

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column) -> Column:
    """The sum modulo 10 that is 0 if the last digit is right."""
    step = lambda s, x: s + x
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    ds = F.reverse(_chars(digits))
    return F.pmod(F.aggregate(F.transform(ds, lambda x, i: F.when(i % 2 == 1, double(x.cast("int"))).otherwise(x.cast("int"))), F.lit(0), step), F.lit(10))


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder, which is 1 if its check digits are right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_chars(turned), F.lit(0), lambda s, c: F.pmod(s * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int"))


def _checked(new: Column, canon: Column, type_: Column) -> Column:
    """Check digits that are right if those of the entity are."""
    body = F.substring(new, F.lit(1), F.length(new) - 1)
    card = lambda: F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    country, account = F.substring(new, 1, 2), F.substring(new, F.lit(5), F.length(new))
    iban = lambda: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    return F.when((type_ == "card") & (_luhn(canon) == 0), card()).when((type_ == "iban") & (_mod97(canon) == 1), iban()).otherwise(new)


def _name(draw: Column, word: Column, type_: Column, sex: Column) -> Column:
    """A made-up name of word's script, in lower case; given names end as usual for their gender. Hyphens, apostrophes
    and single letters before them stay."""

    def of(script: Column) -> Column:
        consonants, vowels = (F.get(F.lit(list(x)), script) for x in (CONSONANTS, VOWELS))
        ending = F.when(sex == "m", F.get(F.lit(["|".join(x) for x in ENDINGS["m"]]), script)).when(sex == "f", F.get(F.lit(["|".join(x) for x in ENDINGS["f"]]), script)).otherwise(F.get(F.lit(["|".join(x) for x in ENDINGS["n"]]), script))
        pick = lambda letters, i: F.substring(letters, _at(draw, i, F.length(letters)) + 1, F.lit(1))

        def segment(w: Column, j: Column) -> Column:
            at = lambda i: j * 10 + i
            stem = F.array_join(F.transform(F.lit(list(range(7))), lambda i: F.when(i % 2 == 0, pick(consonants, at(i))).otherwise(pick(vowels, at(i)))), "")
            end = let(F.split(ending, r"\|"), lambda x: F.get(x, _at(draw, at(F.lit(8)), F.size(x))))
            tail = F.when(type_ == "given", end).otherwise(F.concat(pick(vowels, at(F.lit(8))), pick(consonants, at(F.lit(9)))))
            return F.when(F.length(w) == 1, w).otherwise(F.concat(stem, tail))

        marks = F.regexp_extract_all(word, F.lit("[-'’]"), F.lit(0))
        return F.array_join(F.zip_with(F.transform(F.split(word, "[-'’]"), segment), marks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

    script = F.when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), 1).when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), 2).otherwise(0)
    return let(script, of)


def _more(draw: Column, canon: Column, n: Column, letters: bool) -> Column:
    """n digits, or letters of canon's script, from the end of a draw, which no short form takes."""
    more = F.substring(draw, F.lit(205), n)
    if not letters:
        return F.translate(more, "abcdef", "012345")
    greek, cyrillic = (F.regexp_like(canon, F.lit(rf"\p{{Is{x}}}")) for x in ("Greek", "Cyrillic"))
    return F.when(greek, F.translate(more, HEX, "αβγδεζηικλμνορστ")).when(cyrillic, F.translate(more, HEX, "абвгдеиклмнопрст")).otherwise(F.translate(more, HEX, "abdefgiklmnorstu"))


def _rotated(key: str, canon: Column) -> Column:
    """A letter a keyed distance on in its alphabet."""
    n = int(hashlib.sha256(key.encode()).hexdigest(), 16)
    turn = lambda x: x[1 + n % (len(x) - 1) :] + x[: 1 + n % (len(x) - 1)]
    return F.translate(canon, _ALL, "".join(map(turn, ALPHABETS)))


def surrogate(key: str, type_: Column, canon: Column, attempt: Column | int, sex: Column | None = None) -> Column:
    """The surrogate of a canonical form, itself canonical. A fixed attempt makes a shorter plan than a column does."""
    tries = F.lit(attempt) if isinstance(attempt, int) else attempt
    name = type_.isin("given", "surname")

    def of(draw: Column) -> Column:
        # the registered domain is kept; what stands before it, the local part included, is not
        host = F.when(type_ == "email", F.regexp_extract(canon, r"(?:@|\.)([^.@]+\.[^.@]+)$", 1)).otherwise("")
        keep = F.when(type_ == "card", 1).when(type_ == "iban", 2).when(type_ == "phone", F.when(F.startswith(canon, F.lit("+")), F.length(F.regexp_extract(canon, COUNTRY, 0))).when(F.startswith(canon, F.lit("0")), 1).otherwise(0))
        keep = keep.when((type_ == "ip") & (F.length(canon) > 6), 1).otherwise(0)
        hexadecimal = (type_ == "ip") | (type_ == "secret") & F.regexp_like(canon, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        masked = _masked(F.substring(canon, F.lit(1), F.length(canon) - F.length(host)), draw, keep, hexadecimal)
        masked = F.when(hexadecimal & (type_ == "secret") & F.regexp_like(canon, F.lit("[A-F]")), F.upper(masked)).otherwise(masked)
        octets = F.array_join(F.transform(F.split(canon, r"\."), lambda x, i: (1 + _at(draw, i, 254)).cast("string")), ".")
        own = F.when(name, _name(draw, canon, type_, sex if sex is not None else F.lit("n"))).when((type_ == "ip") & ~F.contains(canon, F.lit(":")), octets).otherwise(masked)
        if isinstance(attempt, Column) or attempt >= OWN_FORM:
            n = F.least((tries - OWN_FORM + 1) * 2, F.lit(50))
            wide = F.when(name | (type_ == "email"), F.concat(_more(draw, canon, n, True), own)).when(type_ == "secret", F.substring(draw, F.lit(1), F.length(canon) + n))
            own = F.when(tries < OWN_FORM, own).otherwise(wide.otherwise(F.concat(own, _more(draw, canon, n, False))))
        return let(own, lambda x: F.concat(_checked(x, canon, type_), host))

    return F.when(type_ == "initial", _rotated(key, canon)).otherwise(let(_draw(key, type_, canon, tries), of))


def _spread(new: Column, form: Column) -> Column:
    """new's letters and digits set into the places of form's; those for which form has no place follow."""
    ismark = lambda x: F.regexp_like(x, F.lit("^[0-9A-Za-z]$"))

    def of(cs: Column) -> Column:
        placed = F.transform(cs, lambda c, i: F.when(ismark(c), F.substring(new, F.size(F.filter(F.slice(cs, F.lit(1), i + 1), ismark)), F.lit(1))).otherwise(c))
        return F.concat(F.array_join(placed, ""), F.substring(new, F.size(F.filter(cs, ismark)) + 1, F.length(new)))

    return let(_chars(form), of)


def _as_name(s: Column, w: Column) -> Column:
    """A surrogate word in the case of the word it replaces: all capitals, or each part's first."""
    segments = F.transform(F.split(s, "(?<=[-'’])"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return F.when((F.length(w) > 1) & (w == F.upper(w)) | (F.length(w) == 1), F.upper(s)).otherwise(F.array_join(segments, ""))


def _written(entity: Column, type_: Column, new: Column) -> Column:
    """The text that takes an entity's place, of the canonical surrogates of its parts in order."""
    rest = _bare_name(entity)

    def person() -> Column:
        words = F.zip_with(new, F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), _as_name)
        title = F.substring(entity, F.lit(1), F.length(entity) - F.length(rest))
        return F.concat(title, F.array_join(F.zip_with(F.split(rest, _WORD, -1), words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))

    first = F.element_at(new, 1)
    shouted = F.regexp_like(entity, F.lit("^[^a-z]*[A-Z][^a-z]*$"))
    plain = F.when(type_.isin("email", "ip") & shouted, F.upper(first)).when(type_.isin("card", "ssn", "phone", "iban"), _spread(F.regexp_replace(first, r"\+", ""), entity)).otherwise(first)
    return F.when(type_ == "person", person()).otherwise(plain)


def entities(text: Column) -> Column:
    """All matches of ANY in order; none for null. Texts without @ need not be searched for addresses."""
    found = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_OTHERS), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def draws(names: DataFrame, key: str) -> DataFrame:
    """(type, canon, s, attempt): a surrogate for each distinct entity of names (type, canon, and maybe gender).

    A clash is a surrogate shared by two entities of a type, or equal to any entity of that type. Of entities that
    share one, the smallest keeps it; the others are drawn again. Later rounds touch the few open entities only, and
    counts are grouped with map-side partials, so no group is gathered.
    """
    names = names if "gender" in names.columns else names.withColumn("gender", F.lit("n"))
    names = cut(names.filter("canon is not null").dropDuplicates(["type", "canon"]))
    free = names.filter("type = 'initial'").select("type", "canon", surrogate(key, F.col("type"), F.col("canon"), 0).alias("s"), F.lit(0).alias("attempt"))
    left, done = names.filter("type <> 'initial'"), free
    real = names.select("type", F.col("canon").alias("s"))
    for attempt in range(ROUNDS):
        drawn = left.select("type", "canon", surrogate(key, F.col("type"), F.col("canon"), attempt, F.col("gender")).alias("s"))
        first = cut(drawn.groupBy("type", "s").agg(F.min("canon").alias("canon")))
        few = small(first.select("type", "s"))
        taken = real.unionAll(done.select("type", "s")).join(few, ["type", "s"], "left_semi").distinct()
        new = cut(first.join(taken, ["type", "s"], "left_anti").select("type", "canon", "s", F.lit(attempt).alias("attempt")))
        done = done.unionAll(new)
        left = cut(left.join(new.select("type", "canon"), ["type", "canon"], "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates still clash after {ROUNDS} draws")


def clashes(names: DataFrame, key: str) -> DataFrame:
    """(type, canon, attempt) of the entities whose first draw clashes, with a draw that does not."""
    return draws(names, key).filter("attempt > 0").select("type", "canon", "attempt")


def _rewrite(docs: DataFrame, key: str) -> DataFrame:
    """row (docs' columns as a struct), text, and new: the replaced text, the number of entities and their types; null
    where there is no entity.

    Texts are searched for their entities once; distinct entities get their surrogates; only documents that have any
    are rewritten, by a lookup. Documents meet their lookup by a hash of id and text; a hash shared by two documents
    does no harm, for a lookup may hold more than is asked.
    """
    text = F.col("text").cast("string")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("k"))
    found = cut(held.select("k", F.explode(F.array_distinct(entities(F.col("text")))).alias("e")))
    each = found.select("e").distinct().withColumn("kind", kind(F.col("e")))
    each = cut(each.select("e", "kind", F.posexplode(parts(F.col("e"), F.col("kind"))).alias("i", "p")).select("e", "kind", "i", "p.*"))
    votes = each.groupBy("type", "canon").agg(F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f"))
    new = draws(votes.select("type", "canon", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender")), key)
    subs = each.join(new.select("type", "canon", "s"), ["type", "canon"]).groupBy("e", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("ps"))
    subs = cut(subs.select("e", "kind", _written(F.col("e"), F.col("kind"), F.col("ps.s")).alias("new")))
    counts = cut(found.groupBy("e").agg(F.count("*").alias("n")))
    hot = hot_keys(counts, "e", counts.agg(F.sum("n")).first()[0] or 0)
    # surnames that may stand alone: of each entity the last word that is one, as a name is written, and its surrogate
    last = each.filter("type = 'surname' and length(canon) > 1").join(new.select("type", "canon", "s"), ["type", "canon"]).groupBy("e").agg(F.max_by(F.struct("canon", "s"), "i").alias("p"))
    subs = cut(subs.join(last, "e", "left"))
    met = dealt(found, hot, "e", "k").join(spread(subs, hot, "e"), ["e", SALT])
    maps = met.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("e", F.struct("new", "kind")))).alias("map"), F.array_distinct(F.collect_set("p")).alias("last"))
    maps = maps.withColumn("last", F.map_from_entries(F.array_distinct(F.transform("last", lambda p: F.struct(p["canon"], p["s"])))))

    def alone(gap: Column) -> Column:
        """A gap's text with the known surnames in it replaced, and their number."""

        def of(words: Column) -> Column:
            known = lambda w: F.coalesce(F.map_contains_key(F.col("last"), F.lower(w)) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))), F.lit(False))
            return F.struct(F.array_join(F.transform(words, lambda w: F.when(known(w), _as_name(F.element_at(F.col("last"), F.lower(w)), w)).otherwise(w)), "").alias("text"), F.size(F.filter(words, known)).alias("n"))

        return let(F.regexp_extract_all(gap, F.lit(_RUN), F.lit(0)), of)

    def rebuilt(es: Column) -> Column:
        gaps = F.split(F.col("text"), ANY, -1)
        some = F.when(F.cardinality("last") > 0, F.transform(gaps, alone)).otherwise(F.transform(gaps, lambda g: F.struct(g.alias("text"), F.lit(0).alias("n"))))

        def of(gs: Column) -> Column:
            subs = F.transform(es, lambda e: F.element_at(F.col("map"), e))
            whole = F.array_join(F.zip_with(gs["text"], subs["new"], lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
            more = F.aggregate(gs["n"], F.lit(0), lambda s, x: s + x)
            return F.struct(whole.alias("text"), (F.size(es) + more).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(subs["kind"])), ",").alias("types"))

        return let(some, of)

    done = held.join(maps, "k", "left")
    return done.select("row", "text", F.when(F.col("map").isNotNull(), let(entities(F.col("text")), rebuilt)).alias("new"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with every detected entity replaced; text and, where there is one, n_chars change, other columns stay.

    Null texts stay null; empty texts and those without entities stay as they are. Very long texts are searched whole,
    in time linear in their length. Repeated rows and equal entities get equal results; a null doc_id is no obstacle;
    extra columns are kept, whatever their names; an empty table gives an empty table. Replacing twice with one key
    gives surrogates of surrogates, not the entities.
    """
    text = F.coalesce("new.text", "text")

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(F.col("new").isNull(), F.col("row").getField(c)).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c)
        return F.col("row").getField(c).alias(c)

    return _rewrite(docs, key).select(*map(column, docs.columns))


def report(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of docs: doc_id, n_entities, types (distinct, sorted, comma-joined), and the replaced text.

    A null text stays null and has no entities; empty and very long texts, ties, repeated rows, null ids, extra columns
    and empty tables are as in ``pseudonymise``.
    """
    done = _rewrite(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    return done.select("row.doc_id", F.coalesce("new.text", "text").alias("text"), F.coalesce("new.n", F.lit(0)).cast("long").alias("n_entities"), F.coalesce("new.types", F.lit("")).alias("types"))
