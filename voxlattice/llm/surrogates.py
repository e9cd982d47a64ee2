"""Surrogates for personal data: each entity is replaced by another of the same type and format, chosen by a key.

An entity's free characters (digits, hexadecimal digits, letters of either case, octets of an address) count as one
whole number, which a keyed permutation of all numbers of that size maps to the surrogate; check digits follow from the
rest. Texts are rewritten in one pass, without a join.

A name is its given name and its surname, each with a surrogate of its own: so "Mr. Smith", "Dr. John Smith" and, once a
text has named him in full with a title, "John Smith" stay one man, and families keep a common surname; so do further
parts of a name ("John Fitzgerald Kennedy"). A title and one word are a surname; Miss, Sr, Dr and Prof need a dot then.
Names of a script without a list get letters of that script. Given names
have a surrogate of the same script and gender. The gender of a full name is what its titles say anywhere in the corpus,
or else what its given name is known for, or else none (a neutral name); titles that disagree count as none. Names are
drawn by hash from a list, then, as they collide, from syllables, of which there are more with every draw.

Collisions are checked over the whole corpus: surrogates (and originals) are grouped, and an entity whose surrogate is
another's surrogate or itself occurs in the corpus draws again under the next key, until none is left. A format that the
corpus fills so far that this does not end (short numbers, most of which occur) takes one permutation for all its
entities: they stay distinct, though a surrogate may be another's original. Entities that drew again, and names whose
gender their titles tell, are broadcast while their counted number is small, and joined to the documents they occur in
beyond that.

Coreference: an entity written in several ways (spaces, case, digits of another script) has one surrogate, written in
each of these ways. Defined results: null texts stay null, empty ones empty; equal rows get equal texts; an empty table
gives no rows; all columns stay; a column named like the count is replaced."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed

#: Entities that drew again, up to which they are broadcast (under 100 bytes each).
BROADCAST_REDRAWN = 100_000
#: Entities that one task draws surrogates for.
ENTITIES_A_TASK = 2000

#: Titles by gender, given names by script and gender, syllables of names and endings of given ones.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "госпожа", "г-жа"],
    "m": ["Mr", "Monsieur", "Herr", "Señor", "Sr", "господин", "г-н"],
    "n": ["Dr", "Prof", "д-р"],
}
GIVEN = {
    "latin": {
        "f": ["Alice", "Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Nora", "Paula", "Sophie"],
        "m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "James", "Lucas", "Martin", "Oscar", "Peter"],
        "n": ["Alex", "Charlie", "Jules", "Kim", "Lou", "Noel", "Robin", "Sam"],
    },
    "cyrillic": {
        "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
        "m": ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"],
        "n": ["Валя", "Женя", "Саша", "Слава"],
    },
}
SYLLABLES = {
    "latin": ["bar", "ben", "dal", "del", "fen", "gor", "hal", "kel", "lan", "mar", "nor", "pel", "ran", "sal", "tor", "vin"],
    "cyrillic": ["бар", "вел", "гор", "дан", "кар", "лан", "мар", "нов", "пет", "рин", "сав", "тор"],
}
ENDINGS = {
    "latin": {"f": ["a", "ina", "elle"], "m": ["o", "us", "ik"], "n": ["e", "i", "in"]},
    "cyrillic": {"f": ["а", "ина", "ия"], "m": ["ий", "ей", "ик"], "n": ["е", "о", "и"]},
}
_ALPHABETS = {"d": "0123456789", "x": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "b": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}

_TITLE_WORDS = {t.lower(): g for g, titles in TITLES.items() for t in titles}
#: A part of a name: letters, also joined by hyphens and apostrophes, without a possessive.
_WORD = r"[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*"
_TITLED = rf"(?<!\w)(?P<title>{'|'.join(t for titles in TITLES.values() for t in titles)})\.? "
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?P<token>(?<!\w)(?:gh[pousr]_|[spr]k[-_](?:live_|test_|proj-)?)[0-9A-Za-z]{16,}(?!\w))"
    r"|(?P<secret>\b(?i:password|passwd|pwd|token|secret|api_key)(?:\s*[=:]\s*)[\"']?(?P<secret_value>[0-9A-Za-z_\-+/]{8,}))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<intl>(?<![\w+])(?=\+(?:[ .()-]{0,2}\d){8,15}(?![ .-]?\d))\+\d{1,3}(?:[ .-]?\(?\d{2,12}\)?){1,5}(?!\w))"
    r"|(?P<card>(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?![\d]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"
    r"|(?<![\w:.])(?=[a-fA-F:]*\d)(?:[0-9a-fA-F]{4}:|(?:[0-9a-fA-F]{1,4}:){2,6})(?::[0-9a-fA-F]{1,4}){1,6}(?![\w:]))"
    rf"|(?P<name>{_TITLED}(?P<given>{_WORD}) (?P<surname>{_WORD})(?!\w))"
)
KINDS = ("email", "key", "token", "secret", "ip", "phone", "intl", "card", "ssn", "iban", "ip6", "name")
#: What tells a token's kind, and stays.
_PREFIX = re.compile(r"gh[pousr]_|[spr]k[-_](?:live_|test_|proj-)?")
#: A title and one word, and one more word of a name.
_SHORT = re.compile(rf"(?<!\w)(?P<title>{'|'.join(t for titles in TITLES.values() for t in titles)})(?P<dot>\.?) (?P<surname>{_WORD})(?!\w)")
_NEXT = re.compile(rf" (?P<surname>{_WORD})(?!\w)")
#: Without a dot, these also stand before words that name nobody.
_LOOSE = {"Miss", "Sr", "Dr", "Prof"}
#: Every entity holds or follows one of these, or begins with a title or a key's prefix; the pattern is tried around them alone.
_SIGN = re.compile(r"[@\d=:]")
_BEGIN = re.compile(rf"(?:{'|'.join(t for titles in TITLES.values() for t in titles)})\.? (?=(?P<rest>{_WORD} {_WORD})?)|AKIA|gh[pousr]_|(?<!\w)[spr]k[-_]")
_AROUND = 80


def _digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _part(word: str) -> str:
    """One way to write a part of a name, whatever its case and apostrophes."""
    return word.replace("’", "'").capitalize()


def _upper(word: str) -> bool:
    """Whether a word can be a name: in a script with case, it begins with a capital."""
    return not word[0].islower()


def canonical(kind: str, match: re.Match) -> str:
    """One text for all ways to write an entity. A template follows a bar where the format is part of the entity."""
    text = match[kind]
    if kind in ("phone", "intl", "card", "ssn"):
        digits = _digits(text)
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "ip":
        return ".".join(str(int(_digits(x))) for x in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "secret":
        return match["secret_value"]
    if kind == "name":
        return f"{_part(match['given'])} {_part(match['surname'])}"
    return text.lower() if kind in ("email", "ip6") else text


def _reaches(text: str):
    """The stretch that an entity around each mark can take, but for the rest of the words at its ends."""
    for m in _SIGN.finditer(text):
        begin, end = m.span()
        if text[begin] in "=:":  # a secret stands behind any amount of white space
            while begin and text[begin - 1].isspace():
                begin -= 1
            while end < len(text) and text[end].isspace():
                end += 1
        yield max(0, begin - _AROUND), min(len(text), end + _AROUND)
    for m in _BEGIN.finditer(text):
        yield m.start(), max(m.end(), m.end("rest"))


def _windows(text: str):
    """Stretches of the text that hold all entities whole, from white space to white space."""
    begin = end = stop = -1
    for a, b in sorted(_reaches(text)):
        if a > end and begin >= 0:
            end = stop = _word_end(text, end)
        if begin >= 0 and a <= end:
            end = max(end, b)
            continue
        if begin >= 0:
            yield begin, end
        while a > max(0, stop) and not text[a - 1].isspace():
            a -= 1
        begin, end = a, b
    if begin >= 0:
        yield begin, _word_end(text, end)


def _word_end(text: str, at: int) -> int:
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def find(text: str | None):
    """(kind, canonical form, match) of each entity, in order. Kind "name" is a titled full name."""
    for begin, end in _windows(text) if text else ():
        while match := _PATTERN.search(text, begin, end):
            kind, begin = next(k for k in KINDS if match[k] is not None), match.end()
            if kind == "name" and not (_upper(match["given"]) and _upper(match["surname"])):
                continue
            if kind == "iban" and not _iban(match["iban"].replace(" ", "")):
                begin = match.start() + 4  # what follows may be a number of another kind
                continue
            yield kind, canonical(kind, match), match


def titled(text: str | None) -> list[tuple[str, str, re.Match, int, int]]:
    """(kind, canonical form, match, begin, end) of what find() tells, of further parts of a full name ("surname": each has
    a surrogate of its own), and of names of a title and one word ("surname")."""
    out, found = [], list(find(text))
    for i, (kind, entity, match) in enumerate(found):
        out.append((kind, entity, match, *match.span()))
        end, limit = match.end(), found[i + 1][2].start() if i + 1 < len(found) else len(text)
        while kind == "name" and (more := _NEXT.match(text, end)) and more["surname"][0].isupper() and more["surname"].lower() not in _TITLE_WORDS and more.end() <= limit:
            end = more.end()
            out.append(("surname", _part(more["surname"]), more, more.start("surname"), end))
    spans = iter([(begin, end) for *_, begin, end in out])
    begin, end = next(spans, (0, -1))
    for m in _SHORT.finditer(text) if text else ():
        while 0 <= end <= m.start():
            begin, end = next(spans, (0, -1))
        if 0 <= begin < m.end() and end >= 0 or not _upper(m["surname"]) or len(m["surname"]) < 2 or m["surname"].lower() in _TITLE_WORDS:
            continue
        if m["dot"] or m["title"] not in _LOOSE:
            out.append(("surname", _part(m["surname"]), m, *m.span()))
    return sorted(out, key=lambda x: x[3])


def mentions(text: str | None) -> list[tuple[str, str, re.Match, int, int]]:
    """(kind, canonical form, match, begin, end) of all that is replaced, in order. A text that names someone in full with
    a title also names them without it ("name") or by a title and the surname ("surname"), in any case; of a name of more
    parts, also by the first and the last."""
    out = titled(text)
    full: dict[str, str] = {}
    for i, (kind, entity, _, _, end) in enumerate(out):
        if kind == "name":
            full.setdefault(entity, entity)
            last = None
            for k, word, m, begin, stop in out[i + 1 :]:
                if k != "surname" or m.re is not _NEXT or begin != end + 1:
                    break
                last, end = word, stop
            if last:
                full.setdefault(f"{entity.split(' ')[0]} {last}", entity)
    if not full:
        return out
    either = lambda words: "|".join(sorted({re.escape(w).replace("'", "['’]") for w in words}))
    given, surname = (either(x.split(" ")[i] for x in full) for i in (0, 1))
    begins = r"(?=[^\W\d_a-z])"
    again = rf"(?<!\w){begins}(?P<name>(?P<given>(?i:{given})) {begins}(?P<surname>(?i:{surname})))(?!\w)"
    short = rf"{_TITLED}{begins}(?P<surname>(?i:{surname}))(?!\w)"
    taken = sorted((begin, end) for *_, begin, end in out)

    def free(m: re.Match) -> bool:
        at = bisect(taken, (m.start(), m.start()))
        return not any(a < m.end() and m.start() < b for a, b in taken[max(0, at - 1) : at + 1])

    more = [("name", full[canonical("name", m)], m, *m.span()) for m in re.finditer(again, text) if canonical("name", m) in full and _upper(m["given"]) and _upper(m["surname"]) and free(m)]
    taken = sorted([*taken, *((begin, end) for *_, begin, end in more)])
    more += [("surname", _part(m["surname"]), m, *m.span()) for m in re.finditer(short, text) if _upper(m["surname"]) and free(m)]
    return sorted(out + more, key=lambda x: x[3])


def _iban(text: str) -> bool:
    """Whether its check digits hold."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _round(key: bytes, number: int, size: int) -> int:
    return int.from_bytes(hmac.digest(key, number.to_bytes((number.bit_length() + 7) // 8 + 1, "big"), hashlib.sha256)[:24], "big") % size


def permute(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size): a four-round Feistel net over a square, walked until it is inside."""
    side = max(2, int(size**0.5) + 1)
    while side * side < size:
        side += 1
    for _ in range(1 << 20):
        left, right = divmod(number, side)
        for turn in range(4):
            left, right = right, (left + _round(key + bytes([turn]), right, side)) % side
        number = left * side + right
        if number < size:
            return number
    raise RuntimeError("a walk without end")


def _walk(text: str, kinds: str, key: bytes, fits) -> str:
    """`text` with the characters that `kinds` marks replaced (a letter of _ALPHABETS; '-' stays), as `fits` asks. The text
    itself fits, so the walk along its cycle ends."""
    at = [i for i, k in enumerate(kinds) if k != "-"]
    number, size = 0, 1
    for i in at:
        letters = _ALPHABETS[kinds[i]]
        number, size = number * len(letters) + letters.index(text[i]), size * len(letters)
    key = key + kinds.encode() + bytes(c.encode()[0] for c, k in zip(text, kinds, strict=True) if k == "-")
    while True:
        number = permute(number, size, key)
        rest, out = number, list(text)
        for i in reversed(at):
            rest, k = divmod(rest, len(_ALPHABETS[kinds[i]]))
            out[i] = _ALPHABETS[kinds[i]][k]
        if fits("".join(out)):
            return "".join(out)


def _octets(text: str, key: bytes) -> str:
    """An address whose parts are of the same length, and in or out of range, as before."""
    ranges = [(0, 9), (10, 99), (100, 255), (256, 999)]
    parts = [int(x) for x in text.split(".")]
    own = [next((a, b) for a, b in ranges if a <= p <= b) for p in parts]
    number, size = 0, 1
    for p, (a, b) in zip(parts, own, strict=True):
        number, size = number * (b - a + 1) + p - a, size * (b - a + 1)
    number, out = permute(number, size, key + repr(own).encode()), []
    for a, b in reversed(own):
        number, p = divmod(number, b - a + 1)
        out.append(str(a + p))
    return ".".join(reversed(out))


def shape(kind: str, entity: str) -> str:
    """The format within which an entity's surrogates lie: entities of one shape are permuted among themselves."""
    if kind == "ip":
        return ".".join(str(sum(int(x) > top for top in (9, 99, 255))) for x in entity.split("."))
    if kind == "email":
        local, _, domain = entity.partition("@")
        first, dot, rest = domain.partition(".")
        return f"{_kinds(local)}@{_kinds(first)}{dot}{rest}"
    if kind == "iban":
        return entity[:2] + _kinds(entity[4:])
    if kind == "intl":
        return f"{entity[:3]}{len(entity)}"
    if kind == "token":
        return _PREFIX.match(entity)[0] + _kinds(entity)
    return _kinds(entity) if kind in ("secret", "ip6") else str(len(entity))


def surrogate(kind: str, entity: str, secret: bytes, attempt: int = 0) -> str:
    """The surrogate's canonical form."""
    key = hmac.digest(secret, f"{kind}|{attempt}".encode(), hashlib.sha256)[:16]
    if kind in ("given", "surname"):
        return _name(kind, entity, key, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        first, dot, rest = domain.partition(".")
        return _walk(entity, _kinds(local) + "-" + _kinds(first) + "-" * len(dot + rest), key, lambda x: True)
    if kind == "key":
        return _walk(entity, "----" + "u" * 16, key, lambda x: True)
    if kind == "intl":  # the first digits tell the country
        return _walk(entity, "---" + "d" * (len(entity) - 3), key, lambda x: True)
    if kind == "token":
        fixed = _PREFIX.match(entity).end()
        return _walk(entity, "-" * fixed + _kinds(entity[fixed:]), key, lambda x: True)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", entity):
            return _walk(entity, "x" * len(entity), key, lambda x: True)
        return _walk(entity, _kinds(entity), key, lambda x: True)
    if kind == "ip":
        return _octets(entity, key)
    if kind == "ip6":
        return _walk(entity, "".join("-" if c == ":" else "x" for c in entity), key, lambda x: True)
    if kind == "iban":
        body = _walk(entity[4:], _kinds(entity[4:]), key + entity[:2].encode(), lambda x: True)
        return f"{entity[:2]}{98 - int(''.join(str(int(c, 36)) for c in f'{body}{entity[:2]}00')) % 97:02d}{body}"
    if kind == "card":  # the last digit is as far from the check digit as before
        check = lambda x: next(d for d in range(10) if _luhn(x + str(d)))
        body = _walk(entity[:-1], "-" + "d" * (len(entity) - 2), key, lambda x: True)
        return body + str((check(body) + int(entity[-1]) - check(entity[:-1])) % 10)
    if kind == "phone":
        national = len(entity) - 10
        plan = "-" * national + "ddd" + ("---" if entity[national + 3 : national + 6] == "555" else "ddd") + "dddd"
        return _walk(entity, plan, key, lambda x: (x[national] >= "2") == (entity[national] >= "2"))
    return _walk(entity, "d" * len(entity), key, lambda x: True)


def _kinds(text: str) -> str:
    return "".join("d" if c in _ALPHABETS["d"] else "a" if c in _ALPHABETS["a"] else "b" if c in _ALPHABETS["b"] else "-" for c in text)


def _script(word: str) -> str | None:
    """A script with listed names and syllables, or none."""
    if re.search("[а-яё]", word.lower()):
        return "cyrillic"
    return "latin" if any(c.isalpha() and ord(c) < 0x250 for c in word) else None


@lru_cache(256)
def _neighbours(letter: str) -> str:
    """The letters of a letter's script, about: those of its block, without marks, all small where the script has case."""
    at = ord(letter)
    first, size = next(((a, n) for a, n in ((0x4E00, 20902), (0xAC00, 11172)) if a <= at < a + n), (at & ~0x7F, 128))
    script = unicodedata.name(letter, "").split(" ")[0]
    found = [c for c in map(chr, range(first, first + size)) if c.isalpha() and c == c.lower() and (size > 128 or unicodedata.normalize("NFD", c) == c and unicodedata.name(c, "").startswith(script))]
    return "".join(found) or letter


def _in_script(word: str, key: bytes, attempt: int) -> str:
    """A word of as many letters, and one more for every other draw, of the same script."""
    number, out = int.from_bytes(hmac.digest(key, word.encode(), hashlib.sha512), "big"), []
    letters = [c for c in word.lower() if c.isalpha()]
    for c in letters + letters[-1:] * (attempt // 2):
        number, at = divmod(number, len(_neighbours(c)))
        out.append(_neighbours(c)[at])
    return "".join(out).capitalize()


def default_gender(name: str) -> str:
    """What a full name's given name is known for: f, m or n."""
    given = name.partition(" ")[0]
    return next((g for g, names in GIVEN.get(_script(given), {}).items() if given in names), "n")


def _name(kind: str, entity: str, key: bytes, attempt: int) -> str:
    """Surnames: four syllables and one more for every other draw. Given names (given|gender): the list first, then one
    syllable more with every draw and an ending of the gender."""
    word, bar, gender = entity.partition("|")
    script = _script(word)
    if script is None:
        return _in_script(word, key, attempt) + bar + gender
    number = int.from_bytes(hmac.digest(key, entity.encode(), hashlib.sha256), "big")
    tail = ""
    if kind == "given":
        listed, endings = GIVEN[script][gender], ENDINGS[script][gender]
        if not attempt:
            return f"{listed[number % len(listed)]}|{gender}"
        number, at = divmod(number, len(endings))
        tail, count = endings[at], 1 + attempt
    else:
        count = 4 + attempt // 2
    parts = []
    for _ in range(count):
        number, at = divmod(number, len(SYLLABLES[script]))
        parts.append(SYLLABLES[script][at])
    return "".join(parts).capitalize() + tail + bar + gender


def _written(kind: str, match: re.Match, new: str) -> str:
    """The surrogate the way the entity was written: separators, case and the script of digits stay."""
    text = match[kind]
    if kind == "secret":
        a, b = match.span("secret_value")
        a, b = a - match.start(), b - match.start()
        return text[:a] + new + text[b:]
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text, new, strict=True)) if len(text) == len(new) else new
    if kind == "ip":
        return ".".join(_fill(o, n.rjust(len(o), "0")) for o, n in zip(text.split("."), new.split("."), strict=True))
    if kind in ("iban", "ip6"):  # spaces and case stay
        each = iter(new)
        return "".join(c if c == " " else n.upper() if c.isupper() and (n := next(each)) else next(each) if not c.isupper() else n for c in text)
    return _fill(text, new) if kind in ("phone", "intl", "card", "ssn") else new


def _fill(text: str, digits: str) -> str:
    """The digits put in for the text's last ones."""
    each = iter(_digits(text)[: max(0, sum(map(str.isdigit, text)) - len(digits))] + digits)
    return "".join(chr(ord(c) - unicodedata.digit(c) + int(next(each))) if c.isdigit() else c for c in text)


def rewrite(text: str | None, secret: bytes, odd: dict[tuple[str, str], str]) -> tuple[str | None, int]:
    """The text with all entities replaced, and how many there were. odd: the draw of entities that drew again, and the
    gender of names whose titles tell more than their given names."""
    parts, at, n = [], 0, 0
    case = lambda old, x: x.upper() if old.isupper() and len(old) > 1 else x
    drawn = lambda kind, entity: _cached(kind, entity, secret, int(odd.get((kind, entity), 0)))
    for kind, entity, match, begin, end in mentions(text):
        if kind in ("name", "surname"):
            surname = _part(match["surname"])
            new = case(match["surname"], drawn("surname", surname))
            begin = match.start("surname")
            if kind == "name":
                gender = odd.get(("name", entity)) or default_gender(entity)
                given = drawn("given", f"{_part(match['given'])}|{gender}").partition("|")[0]
                begin, new = match.start("given"), f"{case(match['given'], given)} {new}"
        else:
            new = _written(kind, match, drawn(kind, entity))
        parts += [text[at:begin], new]
        at, n = end, n + 1
    return (text if not n else "".join([*parts, text[at:]])), n


_cached = lru_cache(1 << 13)(surrogate)


def entities(docs: DataFrame, text_col: str) -> DataFrame:
    """The different (kind, entity, told) of a corpus; each task sends each of its own once. told: the gender of a title."""

    def run(batches):
        seen: set[tuple[str, str, str]] = set()
        for part in batches:
            new = {(k, e, _TITLE_WORDS[m["title"].lower()] if k == "name" else "") for t in part["text"] for k, e, m, *_ in titled(t)} - seen
            seen = (seen | new) if len(seen) < 50_000 else new
            yield pd.DataFrame(sorted(new), columns=["kind", "entity", "told"])

    return docs.select(F.col(text_col).alias("text")).mapInPandas(freed(run), "kind string, entity string, told string").distinct()


def genders(found: DataFrame) -> DataFrame:
    """name, gender of all full names: what their titles say, if they agree, or else what the given name is known for."""
    known = F.pandas_udf(lambda names: names.map(default_gender), "string")
    told = found.where("kind = 'name'").groupBy(F.col("entity").alias("name")).agg(F.max((F.col("told") == "f").cast("int")).alias("f"), F.max((F.col("told") == "m").cast("int")).alias("m"))
    usual = known("name")
    return told.select("name", usual.alias("usual"), F.when(F.col("f") + F.col("m") == 2, "n").when(F.col("f") == 1, "f").when(F.col("m") == 1, "m").otherwise(usual).alias("gender"))


def replace_entities(docs: DataFrame, secret: bytes, text_col: str = "text", count_col: str = "n_replaced", redraws: int = 20) -> DataFrame:
    """The columns of docs with surrogates in their text, and how many entities were replaced."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    raw = scratch.stage(entities(docs, text_col), "raw")
    names = scratch.stage(genders(raw), "names")
    split = F.split("name", " ")
    parts = names.select(F.lit("given").alias("kind"), F.concat_ws("|", split[0], "gender").alias("entity")).unionByName(names.select(F.lit("surname").alias("kind"), split[1].alias("entity")))
    found = scratch.stage(raw.where("kind != 'name'").select("kind", "entity").unionByName(parts).distinct(), "entities")
    tasks = max(1, -(-found.count() // ENTITIES_A_TASK))

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, secret, a) for k, e, a in zip(kind, entity, attempt, strict=True)])

    drawn = found.repartition(tasks, "kind", "entity").withColumn("attempt", F.lit(0))
    drawn = scratch.stage(drawn.withColumn("surrogate", draw("kind", "entity", "attempt")), "draw0")
    for turn in range(1, redraws + 1):
        first = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("uses"), F.min(F.struct("attempt", "entity")).alias("owner"))
        originals = scratch.read("entities").select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("occurs"))
        again = drawn.join(first, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        # Of several with one surrogate, the one that drew it earliest keeps it.
        clash = F.coalesce("occurs", F.lit(False)) | ((F.col("uses") > 1) & (F.col("owner")["entity"] != F.col("entity")))
        marked = scratch.stage(again.select("kind", "entity", "attempt", "surrogate", clash.alias("clash")), f"marked{turn}")
        clashes = marked.where("clash").count()
        if not clashes:
            break
        kept, redone = marked.where("not clash").select("kind", "entity", "attempt", "surrogate"), marked.where("clash").select("kind", "entity", "attempt")
        # Names always find room; other formats, once they have had their draws, take one permutation for all of a shape.
        crowded = ~F.col("kind").isin("given", "surname") & (F.col("attempt") >= redraws - 1)
        if turn >= redraws - 1 and redone.where(crowded).count():
            formed = F.pandas_udf(lambda kind, entity: pd.Series([shape(k, e) for k, e in zip(kind, entity, strict=True)]), "string")("kind", "entity")
            full = redone.where(crowded).select("kind", formed.alias("shape")).distinct()
            whole = scratch.stage(found.withColumn("shape", formed).join(full, ["kind", "shape"]).select("kind", "entity"), "crowded")
            settled = whole.withColumn("attempt", F.lit(-1)).withColumn("surrogate", draw("kind", "entity", "attempt"))
            rest = lambda rows: rows.join(whole, ["kind", "entity"], "left_anti")
            kept, redone = scratch.stage(rest(kept).unionByName(settled), "settled"), rest(redone)
        redone = redone.repartition(max(1, -(-clashes // ENTITIES_A_TASK)), "kind", "entity").withColumn("attempt", F.col("attempt") + 1)
        redone = redone.withColumn("surrogate", draw("kind", "entity", "attempt"))
        drawn = scratch.stage(kept.unionByName(redone.select("kind", "entity", "attempt", "surrogate")), f"draw{turn}")
    odd = drawn.where("attempt != 0").select("kind", "entity", F.col("attempt").cast("string").alias("odd"))
    told = names.where("gender != usual").select(F.lit("name").alias("kind"), F.col("name").alias("entity"), F.col("gender").alias("odd"))
    odd = scratch.stage(odd.unionByName(told), "redrawn")
    return _rewritten(docs, odd, scratch, secret, text_col, count_col)


def asked(text: str | None) -> set[tuple[str, str]]:
    """What rewrite() may look up for a text."""
    out = set()
    for kind, entity, match, *_ in titled(text):
        out.add((kind, entity))
        if kind == "name":
            out |= {("given", f"{_part(match['given'])}|{g}") for g in "fmn"} | {("surname", _part(match["surname"]))}
    return out


def _rewritten(docs: DataFrame, odd: DataFrame, scratch: Scratch, secret: bytes, text_col: str, count_col: str) -> DataFrame:
    n = odd.count()
    if n <= BROADCAST_REDRAWN:
        few = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["odd"] for r in odd.collect()})

        @F.pandas_udf("text string, n long")
        def one(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, secret, few.value) for t in text], columns=["text", "n"])

        return _replaced(docs, one(F.col(text_col)), text_col, count_col)

    @F.pandas_udf("array<struct<kind: string, entity: string>>")
    def inside(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "entity": e} for k, e in sorted(asked(t))] for t in text])

    @F.pandas_udf("text string, n long")
    def many(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        known = [{(x["kind"], x["entity"]): x["odd"] for x in (o if o is not None else [])} for o in own]
        return pd.DataFrame([rewrite(t, secret, k) for t, k in zip(text, known, strict=True)], columns=["text", "n"])

    # Equal texts hold equal entities: the text's digest joins each document with those of its entities that drew again.
    keyed = docs.withColumn("_digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    held = keyed.select("_digest", F.explode(inside(F.col(text_col))).alias("e")).select("_digest", "e.*").distinct()
    own = held.join(odd, ["kind", "entity"]).groupBy("_digest").agg(F.collect_list(F.struct("kind", "entity", "odd")).alias("_own"))
    own = scratch.stage(own, "own")
    return _replaced(keyed.join(own, "_digest", "left"), many(F.col(text_col), F.col("_own")), text_col, count_col, docs.columns)


def _replaced(docs: DataFrame, done: Column, text_col: str, count_col: str, columns: list[str] | None = None) -> DataFrame:
    columns = [c for c in columns or docs.columns if c != count_col]
    out = docs.withColumn("_done", done)
    return out.select(*[F.col("_done.text").alias(c) if c == text_col else F.col(c) for c in columns], F.col("_done.n").alias(count_col))
