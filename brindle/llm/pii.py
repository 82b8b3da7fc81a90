"""Personal data replaced by keyed surrogates of the same type and format.

An entity's characters are read as one number in a mixed base (a place for each letter or digit that may
change) and that number moves one step along a keyed cycle through exactly the numbers of its format. Such a permutation gives
different entities different surrogates, none its own, and the same entity the same one in every document, with no table
of the corpus's entities to build or to send; a check over the distinct entities confirms it. Names go by
permuted lists of the same script and gender, and by permuted letters where no list has them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, checkpointed, without
from brindle.session import kept

ROUNDS = 6
FEW = 1_024  # lists of digits up to which their order is written out

# Given names by script and gender.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sofia Elena Clara Alice Sarah Marta Lucia Ines Claire Camille Louise Carmen Paula Greta Ingrid Heidi Nora Eva Lena Jane Mary Susan Karen Linda Emily".split(),
    ("latin", "m"): "John Peter Paul Thomas David Daniel Martin Lucas Hugo Louis Pierre Jean Jules Carlos Juan Diego Pablo Javier Hans Klaus Otto Karl Jonas Felix Max James Robert Michael William George".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Нина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Павел Олег Игорь".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Mme Mlle Madame Frau Sra Señora Doña г-жа Госпожа κα Κυρία".split(),
    "m": "Mr Sir M Monsieur Herr Sr Señor Don г-н Господин κ Κύριος".split(),
    "": "Dr Prof".split(),
}
# The letters of each script that a surrogate may take, vowels apart.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}

_CAP = "[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я]"
_LOW = "[a-zß-öø-ÿā-žά-ώа-џ]"
_PART = f"(?:{_CAP}['’](?={_CAP}))?(?:{_CAP}{_LOW}+(?:{_CAP}{_LOW}+)*|{_CAP}{{2,}})(?!{_CAP}|{_LOW})"  # Smith, McDonald, O'Brien, SMITH
_INITIALS = rf"{_CAP}\.(?:[ -]?{_CAP}\.)*"
_PARTICLE = "(?:van|von|vom|zu|zum|zur|der|den|ten|ter|de|del|della|di|da|das|do|dos|du|des|la|le|los|las|el|al|bin|ibn|af|av|y|e)[ ]|(?:d|l)['’]"
_NAME_WORD = f"(?:{_INITIALS}|{_PART}(?:-{_PART})*)"
_NAME = f"(?:{_PARTICLE}){{0,4}}{_NAME_WORD}"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))



def _any_of(words: list[str]) -> str:
    """A pattern of any of the words, tried by their first letters."""
    first = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))})" for c in first)


_GIVEN = _any_of([n for v in NAMES.values() for n in v])
_GIVEN_CAPS = _any_of([n.upper() for v in NAMES.values() for n in v])
_HEX = "[0-9A-Fa-f]{1,4}"
_GAP = r"[ \u00a0\u202f./-]"
_NATIONAL = r"(?<![\d.,/+-])(?!\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})"  # no number grouped as a card's
_OTHER = r"(?:\d{1,3}\.){3}\d|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|\d{4}[ -]\d{6}[ -]\d{5}|\d{13}|\d{3}-\d{2}-\d{4}"  # what a phone number's groups don't run into
_STEP = f"(?:{_GAP}(?!{_OTHER}))?"
_KEYWORD = "api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwd|password|passphrase|pwd"

#: What issuers put before their keys; the key behind it is the secret. Fixed values.
_ISSUED = (
    r"(?:AKIA|ASIA|ABIA|ACCA)(?=[0-9A-Z]{16}(?![0-9A-Za-z]))|gh[oprsu]_(?=[A-Za-z0-9]{20})|github_pat_(?=\w{20})|glpat-(?=[\w-]{16})|xox[abeoprs]-(?=[A-Za-z0-9-]{10})"
    r"|[prs]k_(?:live|test)_(?=[A-Za-z0-9]{10})|sk-(?=[A-Za-z_-]*\d)(?=[\w-]{20})|AIza(?=[\w-]{30})|npm_(?=[A-Za-z0-9]{30})|hf_(?=[A-Za-z0-9]{20})|eyJ(?=[\w-]{8,}\.[\w-]{4})"
)
_HAN = "[\u4e00-\u9fff]"

# In the order in which they are tried at one place.
ENTITIES = re.compile(
    rf"""
      (?P<email> (?<![\w.+-]) [\w][\w.+-]{{0,63}} @ (?:[\w-]{{1,63}}\.){{1,8}}(?:xn--[A-Za-z0-9-]{{2,59}}|[^\W\d_]{{2,24}}) \b )
    | (?P<token> (?=[AGefghnprsx])(?<![A-Za-z0-9_])(?:{_ISSUED})(?P<body>[\w-]+(?:\.[\w-]+)*) )
    | (?P<bearer> (?=[Bb])(?<!\w)(?i:bearer)[ ]{{1,4}}(?P<borne>(?=[\w.~+/-]*\d)[\w.~+/-]{{7,}}[\w~+/-]=*) )
    | (?P<login> (?<=://)[^\s/@:"'<>]{{0,128}}:(?P<password>[^\s/@"'<>]{{1,256}})(?=@) )
    | (?P<iban>  (?=[A-Za-z])\b(?:[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?|[A-Za-z]{{2}}\d{{2}}(?:[ ]?[A-Za-z0-9]{{4}}){{3,7}}(?:[ ]?[A-Za-z0-9]{{1,3}})?)\b )
    | (?P<ip>    (?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d) )
    | (?P<ip6>   (?=[0-9A-Fa-f:])(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX} | (?:{_HEX}(?::{_HEX}){{0,6}})?::{_HEX}(?::{_HEX}){{0,6}} | {_HEX}(?::{_HEX}){{0,6}}::)(?![\w:]|\.\d) )
    | (?P<phone> (?=[\d+(])(?<!\w)(?:(?<![\d+])\+1{_GAP}?(?:\(\d{{3}}\)|\d{{3}}){_GAP}?\d{{3}}{_GAP}?\d{{4}}(?!\d) | (?<![\d+])\+3[34]{_GAP}?(?:\(0\){_GAP}?)?\d(?:{_GAP}?\d){{8}}(?!\d)
               | (?:(?<![\d+])\+|{_NATIONAL}00(?=[1-9]))\d{{1,3}}{_STEP}(?:\(\d{{1,5}}\){_STEP})?\d(?:{_STEP}\d){{5,13}}(?!\d|\.\d)
               | {_NATIONAL}0[1-9](?:{_GAP}?\d{{2}}){{4}}(?!\d)
               | {_NATIONAL}0[1-9]\d{{1,3}}{_GAP}\d{{3,8}}(?:{_STEP}\d{{2,5}})?(?!\d|\.\d) | {_NATIONAL}0[1-9]\d{{8,10}}(?!\d)
               | {_NATIONAL}[6-9]\d{{2}}(?:(?:{_GAP}\d{{3}}){{2}}|(?:{_GAP}\d{{2}}){{3}})(?!\d|[.,-]\d)
               | (?<!\d)\(\d{{3}}\)[ ]?\d{{3}}-\d{{4}}(?!\d) | (?<!\d)(?:\d[ -]?)?\(\d{{2,5}}\)[ ]?(?:\d{{5,8}}|\d{{3,4}}(?:[ -](?!{_OTHER})\d{{2,4}}){{1,3}})(?!\d|\.\d)
               | (?<![\d.,-])(?:1[ .-])?\d{{3}}(?P<gap>[ .-])\d{{3}}(?P=gap)\d{{4}}(?!\d|[.-]\d)) )
    | (?P<ssn>   (?=\d)(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]) )
    | (?P<card>  (?=\d)(?<!\d)\d(?:[ -]?\d){{12,18}}(?!\d) )
    | (?P<secret> (?=[AaPpSsTt])(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:{_KEYWORD})(?i:[_-]?(?:key|value|id|hash))?(?![A-Za-z0-9_])["']?[ ]{{0,4}}(?:=>|:=|[=:])[ ]{{0,4}}
                 (?: "(?P<double>(?:[^"\\\n]|\\.){{8,}})" | '(?P<single>(?:[^'\\\n]|\\.){{8,}})'
                   | ["']?(?P<value>(?:[^\s"'<>,;&]|[,;&](?!\s|\w+["']?[=:]|$)){{7,}}[^\s"'<>,;&.:)\]}}]) ) )
    | (?P<named> (?={_CAP}|[κг])\b(?:{_TITLE})\b\.?[ ] (?P<name>{_NAME}(?:[ ]{_NAME})*|{_HAN}{{1,4}}) )
    | (?P<styled> (?={_HAN})(?<!{_HAN})(?P<bearing>{_HAN}{{1,3}})(?=先生|女士|小姐) )
    | (?P<given> (?={_CAP})(?<!\w)(?:(?:{_GIVEN})(?!\w)(?:-{_PART})*(?:[ ]{_NAME})*|(?:{_GIVEN_CAPS})(?:[ ]{_NAME})+) )
    """,
    re.VERBOSE,
)
#: A text without any of these can hold none of the entities.
_HINT = re.compile(rf"[0-9@]|(?=[SsTtPpKk])(?i:secret|token|passw|passphrase|pwd|key)|(?=[先女小])(?:先生|女士|小姐)|::|(?={_CAP}|[κг])\b(?:{_TITLE}|{_GIVEN}|{_GIVEN_CAPS})\b")
#: Words that may repeat one of a name.
_CAPITALISED = re.compile(rf"(?<!\w)(?:{_CAP}['’](?={_CAP}))?{_CAP}\w+")
TYPES = ("email", "iban", "ip", "phone", "ssn", "card", "secret", "name", "mention")


def entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(type, start, end) of each entity, from left to right and never overlapping. A mention is a capitalised word anywhere in a text that is also one of a name found in that text."""
    found = list(_entities(text))
    words = {w.casefold() for kind, a, b in found if kind == "name" for w in _words(text[a:b])}
    if not words:
        yield from found
        return
    at = 0
    for entity in (*found, ("", len(text), len(text))):
        for m in _CAPITALISED.finditer(text, at, entity[1]):
            if m[0].casefold() in words:
                yield "mention", *m.span()
        if entity[0]:
            yield entity
        at = entity[2]


def _words(name: str) -> list[str]:
    """The words of a name that tell its bearer: no initials and no particles."""
    return [m[0] for m in _CAPITALISED.finditer(name)]


def _entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """The entities that show by themselves."""
    at = 0 if text and _HINT.search(text) else None
    while at is not None and (m := ENTITIES.search(text, at)):
        kind, at = m.lastgroup, max(m.end(), m.start() + 1)
        if kind == "iban" and m[0] != m[0].upper() and not _is_iban(m[0]):
            at = m.start() + 1  # words and numbers of another kind: whatever else they hold is looked for
            continue
        if kind in ("secret", "double", "single", "value"):
            span = m.span(next(g for g in ("double", "single", "value") if m[g] is not None))
            if any(map(_changes, text[span[0] : span[1]])):  # a row of asterisks hides its secret already
                yield "secret", *span
        elif kind in ("token", "body", "bearer", "borne", "login", "password"):
            span = m.span(next(g for g in ("body", "borne", "password") if m[g] is not None))
            if any(map(_changes, text[span[0] : span[1]])):
                yield "secret", *span
        elif kind in ("styled", "bearing"):
            yield "name", *m.span("bearing")
        elif kind in ("named", "name"):
            yield "name", *m.span("name")
        elif kind == "given":
            yield "name", *m.span()
        elif kind in ("phone", "gap"):
            yield "phone", *m.span()
        elif kind == "ip6":
            if _is_ip6(m["ip6"]):
                yield "ip", *m.span()
        elif kind != "email" or any(map(_changes, m["email"].rpartition(".")[0])):
            yield kind, *m.span()


def _changes(c: str) -> bool:
    """Whether a surrogate may have another character in this one's place."""
    return c.isalnum() if c.isascii() else len(c.lower()) == 1 and bool(_block(c.lower()))


def _is_iban(text: str) -> bool:
    """Whether the check number is right."""
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _is_ip6(text: str) -> bool:
    """An address that isn't one of all hosts (::, ::1), nor two words of code about ::."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return int(address) > 1 and any(c.isdigit() for c in text)


@lru_cache(4096)
def _block(c: str) -> str:
    """The letters or digits around one that isn't ASCII, in lower case; empty where cases don't pair one to one."""
    kind, start = unicodedata.category(c), ord(c) // 128 * 128
    near = "".join(x for x in map(chr, range(max(start, 128), start + 128)) if unicodedata.category(x) == kind and len(x.upper()) == 1 and x.upper().lower() == x)
    return near if c in near else ""


@lru_cache(512)
def _cycle(key: bytes, tag: str, size: int) -> tuple[list[int], list[int]]:
    """The numbers below ``size`` in an order that the key and the tag give, and the place of each."""
    order = sorted(range(size), key=lambda i: (hashlib.blake2b(f"{tag}|{size}|{i}".encode(), key=key).digest(), i))
    place = [0] * size
    for at, i in enumerate(order):
        place[i] = at
    return order, place


class Surrogates:
    """The surrogates under a key."""

    def __init__(self, key: bytes):
        self.key = key
        self.lists = {k: (v, {n.casefold(): i for i, n in enumerate(v)}) for k, v in NAMES.items()}
        self.listed = {n.casefold() for v in NAMES.values() for n in v}

    def _number(self, tag: str, value: int, modulus: int) -> int:
        digest = hashlib.blake2b(f"{tag}|{value}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(digest + hashlib.blake2b(digest, key=self.key, digest_size=32).digest()) % modulus

    def permuted(self, tag: str, digits: list[int], bases: list[int]) -> list[int]:
        """Other digits in the same bases: a permutation of all such lists, keyed by tag, that leaves none of them as it is if there are two or more.

        It is one step on one cycle through all lists: that of their keyed order if they are few, else that of a Feistel network (there, one on, and back).
        """
        if not digits:
            return []
        size = math.prod(bases)
        if size <= FEW:
            value = 0
            for d, b in zip(digits, bases):
                value = value * b + d
            order, place = _cycle(self.key, tag, size)
            value, out = order[(place[value] + 1) % size], []
            for b in reversed(bases):
                value, d = divmod(value, b)
                out.append(d)
            return out[::-1]
        cut = len(bases) // 2
        sizes, halves = [1, 1], [0, 0]
        for i, (d, b) in enumerate(zip(digits, bases)):
            h = i >= cut
            sizes[h], halves[h] = sizes[h] * b, halves[h] * b + d
        self._feistel(tag, halves, sizes, 1)
        on, halves[1] = divmod(halves[1] + 1, sizes[1])
        halves[0] = (halves[0] + on) % sizes[0]
        self._feistel(tag, halves, sizes, -1)
        out = []
        for i in range(len(bases) - 1, -1, -1):
            h = i >= cut
            halves[h], d = divmod(halves[h], bases[i])
            out.append(d)
        return out[::-1]

    def _feistel(self, tag: str, halves: list[int], sizes: list[int], sign: int) -> None:
        """One round in turn adds to each half what a hash makes of the other; a sign of -1 takes the rounds back."""
        for r in range(ROUNDS)[::sign]:
            h = r % 2
            halves[h] = (halves[h] + sign * self._number(f"{tag}|{r}|{sizes}", halves[1 - h], sizes[h])) % sizes[h]

    def _by_class(self, tag: str, text: str, alphabet_of) -> str:
        """Each character that alphabet_of gives an alphabet is permuted within it; the others and the cases of letters stay."""
        places = [(i, a, a.index(c.lower())) for i, c in enumerate(text) if (a := alphabet_of(c))]
        shape = "".join("?" if alphabet_of(c) else c.lower() for c in text)
        new = self.permuted(f"{tag}|{shape}", [d for _, _, d in places], [len(a) for _, a, _ in places])
        out = list(text)
        for (i, a, _), d in zip(places, new):
            out[i] = a[d].upper() if text[i].isupper() else a[d]
        return "".join(out)

    @staticmethod
    def _plain(c: str) -> str:
        """Digits, and ASCII letters whatever their case."""
        return "0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else ""

    @staticmethod
    def _spoken(c: str) -> str:
        """Vowels and consonants of a script; letters beyond its plain ones stay as they are."""
        low = c.lower()
        return next((part for letters in LETTERS.values() for part in letters if low in part), "") if len(low) == 1 else ""

    def _digits(self, kind: str, text: str, keep: int = 0) -> str:
        """The digits of a number, without regard to how it is spaced; the first ``keep`` stay."""
        at = [i for i, c in enumerate(text) if "0" <= c <= "9"]
        have = [int(text[i]) for i in at]
        new = have[:keep] + self.permuted(f"{kind}|{have[:keep]}|{len(at)}", have[keep:], [10] * len(have[keep:]))
        out = list(text)
        for i, d in zip(at, new):
            out[i] = str(d)
        return "".join(out)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        mark = lambda c: self._plain(c) or self._spoken(c) or ("" if c.isascii() or len(c.lower()) != 1 else _block(c.lower()))
        return f"{self._by_class('local', local, mark)}@{'.'.join(self._by_class('label', x, mark) for x in name.split('.'))}.{top}"

    def iban(self, text: str) -> str:
        packed = text.replace(" ", "")
        body = self._by_class(f"iban|{packed[:2].upper()}", packed[4:], lambda c: "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz")
        check = 98 - int("".join(str(int(c, 36)) for c in body + packed[:2] + "00")) % 97
        if not _is_iban(text):
            check = int(packed[2:4])  # a wrong check number stays as wrong as it was found
        new = iter(f"{packed[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def ip(self, text: str) -> str:
        """Another address; the shares of leading octets that private networks have stay."""
        if ":" in text:
            return self._ip6(text)
        octets = [int(x) for x in text.split(".")]
        keep = 1 if octets[0] in (10, 127) else 2 if (octets[0], octets[1]) == (192, 168) else 0
        new = self.permuted(f"ip|{octets[:keep]}", octets[keep:], [256] * (4 - keep))
        while not keep and (new[0] in (10, 127) or (new[0], new[1]) == (192, 168)):
            new = self.permuted("ip|[]", new, [256] * 4)  # walks on until it is a public address again
        return ".".join(map(str, octets[:keep] + new))

    def _ip6(self, text: str) -> str:
        """Groups of zeros stay, the others become others, so that :: stands where it stood."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        have = [g - 1 for g in groups if g]
        new = self.permuted(f"ip6|{[bool(g) for g in groups]}", [d for g in have for d in divmod(g, 257)], [255, 257] * len(have))
        rest = iter([a * 257 + b + 1 for a, b in zip(new[::2], new[1::2])])
        return re.sub("[0-9A-Fa-f]+", lambda m: m[0] if not int(m[0], 16) else f"{next(rest):0{len(m[0]) if m[0][0] == '0' else 1}{'X' if m[0].isupper() else 'x'}}", text)

    def phone(self, text: str) -> str:
        """Other digits, however they are spaced; the digits stay that tell an international (+, 00) or national (0, a Spanish first digit) number."""
        digits = [c for c in text if c.isdigit()]
        keep = 1 if text[0] == "+" else 3 if digits[:2] == ["0", "0"] else 2 if digits[0] == "0" else int(len(digits) == 9)
        return self._digits("phone", text, keep)

    def ssn(self, text: str) -> str:
        return self._digits("ssn", text)

    def card(self, text: str) -> str:
        """Another number; one with a right check digit gets a right one, and one without gets none."""
        have = [c for c in text if c.isdigit()]
        good = _luhn(have)
        digits = [int(c) for c in have]
        while True:
            digits = self.permuted(f"card|{len(have)}", digits, [10] * len(digits))
            if _luhn([str(d) for d in digits]) == good:
                break
        new = iter(digits)
        return "".join(str(next(new)) if c.isdigit() else c for c in text)

    def secret(self, text: str) -> str:
        """Hex stays hex, letters keep their case; at each place an alphabet of its own kind."""
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            return self._by_class("hex", text, lambda c: "0123456789abcdef") if text == text.lower() else self._by_class("hex", text.lower(), lambda c: "0123456789abcdef").upper()
        places = [(i, a, a.index(c)) for i, c in enumerate(text) if (a := next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), "") or self._other(c))]
        new = self.permuted("secret|" + "".join("?" if c.isalnum() else c for c in text), [d for _, _, d in places], [len(a) for _, a, _ in places])
        out = list(text)
        for (i, a, _), d in zip(places, new):
            out[i] = a[d]
        return "".join(out)

    @staticmethod
    def _other(c: str) -> str:
        """The letters of its kind and case around one that isn't ASCII."""
        low = c.lower()
        return "" if c.isascii() or len(low) != 1 else _block(low).upper() if c.isupper() else _block(low)

    def name(self, text: str) -> str:
        """Given names that a list has become others of its list; other words get other letters, vowels for vowels, and never a listed name. Particles stay."""
        return re.sub(rf"{_CAP}[^\W\d_]*|{_HAN}+", lambda m: self._word(m[0]), text)

    mention = name

    def _word(self, word: str) -> str:
        low = word.casefold()
        for (script, g), (names, at) in self.lists.items():
            if low in at:
                new = names[self.permuted(f"name|{script}|{g}", [at[low]], [len(names)])[0]]
                return new.upper() if word.isupper() else new
        script = "latin"
        for c in word:
            found = unicodedata.name(c, "").split(" ")[0].lower()
            if found in LETTERS:
                script = found
                break
        letters = self._spoken if any(map(self._spoken, word)) else lambda c: _block(c.lower()) if not c.isascii() and len(c.lower()) == 1 else ""
        new = word
        while True:
            new = self._by_class(f"word|{script}", new, letters)
            if new.casefold() not in self.listed:
                return new

    def canonical(self, kind: str, text: str) -> str:
        """What all mentions of one entity have in common."""
        if kind in ("phone", "card", "ssn"):
            return "+" * text.startswith("+") + "".join(c for c in text if c.isdigit())
        if kind == "ip":
            return ipaddress.IPv6Address(text).compressed if ":" in text else ".".join(str(int(x)) for x in text.split("."))
        return text.replace(" ", "").upper() if kind == "iban" else text if kind == "secret" else text.lower()

    def of(self, kind: str, text: str) -> str:
        return getattr(self, kind)(text)


def _luhn(digits: list[str]) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_FOUND = pa.list_(pa.struct([("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))
_REPLACED = pa.struct([("text", pa.string()), ("counts", pa.list_(pa.int64())), ("found", _FOUND)])


def _replacer(key: bytes):
    """A function from texts to the texts with their surrogates, the mentions of each type, and the distinct entities with their surrogates in canonical form: all from one search."""

    @arrow_function(_REPLACED)
    def replace(texts: pa.Array) -> pa.Array:
        s, out = Surrogates(key), []
        for text in texts.to_pylist():
            parts, at, counts, seen = [], 0, [0] * len(TYPES), {}
            for kind, a, b in entities(text):
                entity = text[a:b]
                new = s.of(kind, entity)
                parts += [text[at:a], new]
                at = b
                counts[TYPES.index(kind)] += 1
                seen[kind, s.canonical(kind, entity)] = s.canonical(kind, new)
            found = [{"type": kind, "entity": e, "surrogate": new} for (kind, e), new in seen.items()]
            out.append({"text": text if not parts else "".join([*parts, text[at:]]), "counts": counts, "found": found})
        return pa.array(out, _REPLACED)

    return replace


def mapping(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(type, entity, surrogate): each distinct entity of the corpus in its canonical form, with its surrogate's."""
    bounded_batches(docs.sparkSession)
    return _mapped(docs.select(_replacer(key)(F.col(f"`{text_col}`")).alias("done")).select("done.found"))


def _mapped(done: DataFrame) -> DataFrame:
    return done.select(F.inline("found")).distinct()


def collisions(pairs: DataFrame) -> DataFrame:
    """(type, of, n, first, last): surrogates that stand for more than one entity, entities with more than one surrogate, and entities that are their own (n = 1)."""
    two = pairs.groupBy("type", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first"), F.max("entity").alias("last")).where("n > 1")
    twice = pairs.groupBy("type", "entity").agg(F.count("*").alias("n"), F.min("surrogate").alias("first"), F.max("surrogate").alias("last")).where("n > 1")
    same = pairs.where("surrogate = entity").select("type", F.col("entity").alias("of"), F.lit(1).cast("long").alias("n"), F.col("entity").alias("first"), F.col("surrogate").alias("last"))
    return two.select("type", F.col("surrogate").alias("of"), "n", "first", "last").union(twice.select("type", F.col("entity").alias("of"), "n", "first", "last")).union(same)


def _keys(key: bytes, attempts: int) -> Iterator[bytes]:
    """The key, then others derived from it."""
    yield key
    for attempt in range(1, attempts):
        yield hashlib.blake2b(f"attempt {attempt}".encode(), key=key, digest_size=32).digest()


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", attempts: int = 4) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced, and a column n_<type> with the number of mentions for each type.

    Each text is searched once. The rows with their surrogates are written as Parquet in the shared folder, and only their lists of entities are read for the check:
    no two entities may share a surrogate, none may have two and none may be its own. Where one does, all is done again under a key derived from this one.
    Lengths stay, but for addresses (ip) and listed names. A null text stays null and has no entities, repeated rows stay repeated, no rows give no rows; columns named n_<type> are replaced.
    """
    bounded_batches(docs.sparkSession)
    out = without(docs, [f"n_{t}" for t in TYPES])
    place = {c: f"c{i}" for i, c in enumerate(out.columns) if c != text_col}  # Parquet takes no two names that differ in case alone
    for tried in _keys(key, attempts):
        got = out.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()], _replacer(tried)(F.col(f"`{text_col}`")).alias("done"))
        done = kept(got.select(*place.values(), "done.*"))
        if collisions(checkpointed(_mapped(done))).isEmpty():
            columns = [F.col(place.get(c, "text")).alias(c) for c in out.columns]
            return done.select(*columns, *[F.col("counts")[i].cast("long").alias(f"n_{t}") for i, t in enumerate(TYPES)])
    raise RuntimeError("surrogates collide under every key that was tried")
