"""PII surrogates: keyed, type-consistent replacements of detected entities.

An entity's surrogate depends on its kind, its normalised text and a secret key, so the same entity gets
the same surrogate in every document. Numbers and letters go through a keyed permutation of all strings
of the same format (a Feistel network), so different entities of a format can't meet; e-mail addresses
keep their marks and top-level domain, phone numbers their country code, card numbers their length and
check digit, tokens their alphabet and case, and names their script, their capitals and the gender of
their title.

A last name is an entity of its own. It has one surrogate, which stands for it wherever it is: alone, and
at the end of every whole name. Given names come from lists, and a permutation can hit an entity that
really occurs. So the surrogates of all distinct entities of the corpus are checked against one another
and against the entities themselves, last names before whole names; whatever clashes takes its next
candidate (a whole name other given names) until nothing does. Where a format has no room left, its
entities go back to one permutation, which keeps them distinct though some are names of others. The
changed ones, a few of all, are looked up when texts are rewritten; everything else is computed where it
is needed.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import discard, join_hot, materialize, prepare, tasks_for, workdir

#: Changed surrogates sent to all tasks at most; beyond that, each document is joined with its own.
BROADCAST_CHANGED = 100_000
#: Entities that one task makes surrogates of.
ENTITIES = 4_000
#: Rounds of candidates at most; a format that clashes for STALLED rounds without getting better is full.
ROUNDS, STALLED = 40, 3
#: Candidates of a given name that come from a list; later ones are permutations of its letters.
LISTED = 3
#: The attempt that stands for the one permutation of a full format.
FULL = -1

#: Titles by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Doña", "г-жа", "госпожа"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Don", "г-н", "господин"],
    "n": ["Dr", "Prof", "Professor", "Mx"],
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): ["Ada", "Alma", "Carla", "Clara", "Diana", "Elena", "Emma", "Greta", "Hanna", "Ines", "Julia", "Laura", "Lena", "Maria", "Nina", "Olga", "Petra", "Rosa", "Sara", "Vera"],
    ("latin", "m"): ["Adam", "Albert", "Carlos", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Noah", "Oscar", "Paul", "Robert", "Simon", "Tomas", "Victor"],
    ("latin", "n"): ["Alex", "Andrea", "Ashley", "Charlie", "Dana", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Robin", "Sam", "Sascha", "Taylor", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Полина", "София"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Лев", "Максим", "Олег", "Павел"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава", "Шура"],
}

#: Country codes of two digits; those that begin with 1 or 7 have one digit, all others three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

_GENDER = {t.casefold(): g for g, titles in TITLES.items() for t in titles}
#: As above or in capitals.
_TITLES = sorted({y for x in TITLES.values() for t in x for y in (t, t.upper())}, key=lambda t: (-len(t), t))
_TITLE = "|".join(map(re.escape, _TITLES))
_INITIALS = r"(?:[^\W\d_a-zа-я]\.-?)+"
_NAME = rf"(?:{_INITIALS} ?){{0,3}}[^\W\d_a-zа-я][^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: Beginnings of keys that are not hexadecimal, and what follows.
KEYS = {
    "AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "ghp_": "[A-Za-z0-9]{36,255}", "gho_": "[A-Za-z0-9]{36,255}", "ghu_": "[A-Za-z0-9]{36,255}",
    "ghs_": "[A-Za-z0-9]{36,255}", "ghr_": "[A-Za-z0-9]{36,255}", "github_pat_": "[A-Za-z0-9_]{22,255}", "glpat-": "[A-Za-z0-9_-]{20,64}",
    "AIza": "[A-Za-z0-9_-]{35}", "xoxb-": "[A-Za-z0-9-]{10,255}", "xoxp-": "[A-Za-z0-9-]{10,255}", "sk_live_": "[A-Za-z0-9]{16,255}",
}
_KEY = "|".join(f"{re.escape(k)}{v}" for k, v in KEYS.items())
#: The kinds of entities, in order of precedence where they overlap.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]*[\w+%-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")),
    ("key", re.compile(rf"(?<![0-9A-Za-z])(?:{_KEY})(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:))(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("card", re.compile(r"(?<![\d])(?:\d[ -]?){12,18}\d(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)")),
    ("phone", re.compile(r"(?<![\w.-])(?:1 )?[2-9]\d\d \d{3} \d{4}(?!\d| \d|[.-]\d)")),
    ("name", re.compile(rf"(?<!\w)(?P<title>{_TITLE})\.? +(?P<name>{_NAME}(?: {_NAME}){{0,2}})")),
]


_DIGIT = re.compile("[0-9]")
#: Quick test for texts that may hold a title; it starts at capitals only, but for the Cyrillic ones.
_ANY_TITLE = re.compile(rf"(?:[A-ZÀ-Ý](?<!\w\w)|[гГ])(?:{'|'.join(sorted({re.escape(t[1:]) for t in _TITLES}))})\.? +[^\W\d_a-zа-я]")


def _around_at(pattern: re.Pattern, text: str):
    """Matches of the e-mail pattern, looked for in the unbroken characters around each ``@`` only."""
    at, done = text.find("@"), 0
    while at >= 0:
        start, end = at, at
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        yield from pattern.finditer(text, start, end)
        done, at = end, text.find("@", end)


_SIXTEEN = re.compile(r"(?:\d[ -]?){15}\d(?!\d)")


def _valid_parts(pattern: re.Pattern, text: str, least: int, valid, at: int):
    """(start, end, plain form) of what is valid: matches, or else their first groups of characters, ``least`` or more.

    Of parts, one of 16 characters comes first, as most card numbers have, then the longest; a card number of another
    length gives way to a valid 16-digit number that begins inside it. Where no part is valid, the next group may begin one.
    """
    while m := pattern.search(text, at):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"[^ -]+", m[0])]
        spans = [(m.start(), b, re.sub("[ -]", "", text[m.start() : b])) for _, b in reversed(groups)]
        parts = sorted((x for x in spans[1:] if len(x[2]) >= least), key=lambda x: len(x[2]) != 16)
        found = next((x for x in spans[:1] + parts if valid(x[2])), None)
        if valid is luhn and found and found[1] != m.end() and len(found[2]) != 16:
            inside = (_SIXTEEN.match(text, a) for a, _ in groups[1:] if a < found[1])
            found = next(((*x.span(), y) for x in inside if x and luhn(y := re.sub("[ -]", "", x[0]))), found)
        if found:
            yield found
        at = found[1] if found else groups[1][0] if len(groups) > 1 else m.end()


def _iban(plain: str) -> bool:
    return bool(re.match(r"[A-Z]{2}\d\d", plain)) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ipv6(text: str) -> str | None:
    """The shortest form of an address with a digit, other than the loopback."""
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return str(found) if _DIGIT.search(text) and not found.is_loopback else None


def _plain_name(name: str) -> str:
    """A name in capitals as it is written otherwise."""
    if any(c.islower() for c in name):
        return name
    return re.sub(r"[^\W\d_]+", lambda m: m[0][0] + m[0][1:].lower(), name)


def country_code(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def _phone(text: str) -> str:
    """The digits after a plus; a number without country code is one of +1."""
    digits = re.sub(r"\D", "", text)
    return f"+{digits}" if text.startswith("+") or len(digits) == 11 else f"+1{digits}"


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of all entities, in order and without overlaps.

    A card number needs a valid check digit; an IBAN needs a valid checksum; where what looks like one is not
    valid, groups of characters before or after are left out. A name is what follows a title: ``l:`` and a last
    name, or gender, colon and whole name. Of several titles of a name the first that tells a gender counts.
    Other mentions of a titled person's whole name or last name count too. Spaces and marks of phone numbers,
    and capitals of names and e-mail addresses, make no difference.
    """
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str, normal: str) -> None:
        k = bisect(taken, (start, end))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
            taken.insert(k, (start, end))
            found.append((start, end, kind, normal))

    people: dict[str, str] = {}
    spellings: dict[str, str] = {}
    titled: list[tuple[int, int]] = []
    digits = _DIGIT.search(text)
    for kind, pattern in PATTERNS:
        if kind == "email":
            matches = _around_at(pattern, text)
        elif kind == "key":
            matches = pattern.finditer(text) if any(x in text for x in KEYS) else ()
        elif kind in ("card", "iban"):
            at = max(0, digits.start() - 128) if digits else len(text)
            for start, end, plain in _valid_parts(pattern, text, *((13, luhn) if kind == "card" else (15, _iban)), at):
                add(start, end, kind, plain)
            continue
        elif kind == "name":
            matches = pattern.finditer(text) if _ANY_TITLE.search(text) else ()
        else:
            matches = pattern.finditer(text, max(0, digits.start() - 128)) if digits else ()
        for m in matches:
            if kind == "name":
                name, gender = _plain_name(m["name"]), _GENDER[m["title"].casefold()]
                if people.get(name, "n") == "n":
                    people[name] = gender
                spellings.setdefault(m["name"], name)
                titled.append(m.span("name"))
            elif kind == "ipv6":
                if normal := _ipv6(m[0]):
                    add(*m.span(), kind, normal)
            elif kind == "phone":
                add(*m.span(), kind, _phone(m[0]))
            else:
                add(*m.span(), kind, m[0].lower() if kind in ("email", "secret") else m[0])

    def named(name: str) -> str:
        return f"{people[name]}:{name}" if " " in name else f"l:{name}"

    for start, end in titled:
        add(start, end, "name", named(spellings[text[start:end]]))
    mentions = {spelling: named(name) for spelling, name in spellings.items()}
    for spelling, name in spellings.items():
        if " " in name:
            mentions.setdefault(spelling.rpartition(" ")[2], f"l:{name.rpartition(' ')[2]}")
    if mentions:
        every = "|".join(re.escape(x) for x in sorted(mentions, key=len, reverse=True))
        for m in re.finditer(rf"(?<!\w)(?:{every})(?!\w)", text):
            add(*m.span(), "name", mentions[m[0]])
    return sorted(found)


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key

    def _number(self, tweak: str, size: int) -> int:
        return int.from_bytes(hmac.new(self.key, tweak.encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big") % size

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size): four Feistel rounds, walked until they land in the range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for turn in range(4):
                left, right = right, left ^ self._number(f"{tweak}|{size}|{turn}|{right}", 1 << half)
            value = left << half | right
            if value < size:
                return value

    def format_preserving(self, text: str, tweak: str) -> str:
        """Letters and digits permuted together among all strings of the same pattern; all else stays."""
        alphabets = [_alphabet(c) for c in text]
        pattern = "".join(a[0] if a else c for a, c in zip(alphabets, text, strict=True))
        value, size = 0, 1
        for a, c in zip(alphabets, text, strict=True):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        value = self.permute(value, size, f"{tweak}|{pattern}")
        out = list(text)
        for k in range(len(text) - 1, -1, -1):
            if alphabets[k]:
                value, x = divmod(value, len(alphabets[k]))
                out[k] = alphabets[k][x]
        return "".join(out)

    def of(self, kind: str, normal: str, attempt: int = 0, family: str | None = None) -> str:
        """The surrogate of a normal form, itself in normal form; ``family`` is that of a whole name's last name."""
        tweak = f"{kind}|{attempt}"
        if kind == "email":
            local, _, domain = normal.rpartition("@")
            labels = domain.split(".")
            host = ".".join([self.format_preserving(x, f"domain|{attempt}") for x in labels[:-1]] + labels[-1:])
            return f"{self.format_preserving(local, tweak)}@{host}"
        if kind == "ip":
            a = [int(x) for x in normal.split(".")]
            value = self.permute(a[0] << 24 | a[1] << 16 | a[2] << 8 | a[3], 1 << 32, tweak)
            return ".".join(str(value >> k & 255) for k in (24, 16, 8, 0))
        if kind == "ipv6":
            return str(ipaddress.IPv6Address(self.permute(int(ipaddress.IPv6Address(normal)), 1 << 128, tweak)))
        if kind == "key":
            start = next(x for x in KEYS if normal.startswith(x))
            return start + self.format_preserving(normal[len(start) :], f"{tweak}|{start}")
        if kind == "card":
            body = normal[0] + self.format_preserving(normal[1:-1], tweak)
            return next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if kind == "iban":
            body = self.format_preserving(normal[4:], tweak)
            check = 98 - int("".join(str(int(c, 36)) for c in body + normal[:2] + "00")) % 97
            return f"{normal[:2]}{check:02d}{body}"
        if kind == "secret":
            value = self.permute(int(normal, 16), 16 ** len(normal), tweak)
            return f"{value:0{len(normal)}x}"
        if kind == "phone":
            code = "+" + country_code(re.sub(r"\D", "", normal))
            return code + self.format_preserving(normal[len(code) :], f"{tweak}|{code}")
        if kind == "name":
            gender, _, name = normal.partition(":")
            *parts, last = name.split(" ")
            if gender == "l":
                return self.format_preserving(last, f"family|{attempt}")
            given = [self._given(gender, x, attempt, k) for k, x in enumerate(parts)]
            return " ".join([*given, family or self.format_preserving(last, "family|0")])
        return self.format_preserving(normal, tweak)

    def _given(self, gender: str, name: str, attempt: int, place: int) -> str:
        if name.endswith(".") or not 0 <= attempt < LISTED:
            return self.format_preserving(name, f"given|{attempt}|{place}")
        names = GIVEN["cyrillic" if re.search("[а-яА-Я]", name) else "latin", gender]
        return names[self._number(f"given|{attempt}|{place}|{name}", len(names))]


def form_of(kind: str, normal: str, family: str | None) -> str:
    """What surrogates of a kind that could be equal have in common: the format, or of a whole name the new last name."""
    if family is not None:
        return family
    if kind in ("ip", "ipv6", "secret"):
        return str(len(normal) if kind == "secret" else 0)
    return "".join(a[0] if (a := _alphabet(c)) else c for c in normal)


def _alphabet(c: str) -> str | None:
    """The characters of a kind with c: digits, or letters of its script and case."""
    for letters in _ALPHABETS:
        if c in letters:
            return letters
    return None


_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)


def _shaped(original: str, kind: str, surrogate: str) -> str:
    """A surrogate in the spacing and case in which the text has the original."""
    if kind in ("card", "iban"):
        left = iter(surrogate)
        return "".join(next(left) if c.isalnum() else c for c in original)
    if kind == "phone":
        digits = [c for c in surrogate if c.isdigit()][-sum(map(str.isdigit, original)) :]
        return "".join(digits.pop(0) if c.isdigit() else c for c in original)
    if kind in ("email", "secret", "name") and original.isupper():
        return surrogate.upper()
    return surrogate


def entities(text: str | None) -> set[tuple[str, str]]:
    """(kind, normal form) of the entities of a text, last names of whole names among them."""
    found = {x[2:] for x in detect(text or "")}
    return found | {("name", f"l:{n.rpartition(' ')[2]}") for k, n in found if k == "name" and " " in n}


def _entity_rows(batches):
    for batch in batches:
        found = sorted({x for text in batch.column(0).to_pylist() for x in entities(text)})
        columns = list(zip(*found, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "normal"])


_CANDIDATE = "kind string, normal string, family string, attempt int, form string, surrogate string"


def _surrogate_rows(key: bytes):
    def run(batches):
        made = Surrogates(key)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            form = pa.array([form_of(k, n, f) for k, n, f, _ in rows], pa.string())
            out = pa.array([made.of(k, n, a, f) for k, n, f, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form, out], ["kind", "normal", "family", "attempt", "form", "surrogate"])

    return run


def _settled(rows: DataFrame, key: bytes, folder: str) -> DataFrame:
    """(kind, normal, attempt, surrogate) of distinct rows(kind, normal, family): no two of a kind alike, none an entity.

    Of those that clash all but the smallest take their next candidate, and every one whose surrogate is an
    entity itself. Formats in which that comes to no end go back to one permutation each.
    """
    parts = tasks_for(rows.count(), ENTITIES)

    def made(chosen: DataFrame, attempt) -> DataFrame:
        dealt = chosen.select("kind", "normal", "family", attempt.cast("int").alias("attempt")).repartition(parts, "kind", "normal")
        return dealt.mapInArrow(_surrogate_rows(key), _CANDIDATE)

    plain = F.when(F.col("kind") == "name", F.substring("normal", 3, 1 << 30)).otherwise(F.col("normal"))
    real = materialize(rows.select("kind", plain.alias("surrogate"), F.lit(True).alias("real")).distinct(), f"{folder}/real")
    rows, fewest, stalled = materialize(made(rows, F.lit(0)), f"{folder}/candidates-0"), None, 0
    for turn in range(1, ROUNDS + 1):
        place = F.row_number().over(W.Window.partitionBy("kind", "surrogate").orderBy("attempt", "normal"))
        marked = rows.withColumn("place", place).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("place") > 1) | F.col("real").isNotNull()
        names = [x.split()[0] for x in _CANDIDATE.split(", ")]
        marked = materialize(marked.select(*names, clash.alias("clash")), f"{folder}/checked-{turn}")
        left = marked.filter("clash").count()
        if not left:
            return marked
        stalled = stalled + 1 if fewest is not None and left >= fewest else 0
        fewest = left if fewest is None else min(left, fewest)
        if stalled == STALLED:
            break
        moved = made(marked.filter("clash"), F.col("attempt") + 1)
        rows = materialize(marked.filter("not clash").drop("clash").union(moved), f"{folder}/candidates-{turn}")
    full = marked.filter("clash").select("kind", "form").distinct()
    again = made(marked.join(full, ["kind", "form"], "left_semi"), F.lit(FULL))
    return materialize(marked.drop("clash").join(full, ["kind", "form"], "left_anti").select(*names).union(again), f"{folder}/full")


def assign_surrogates(texts: DataFrame, key: bytes, folder: str) -> DataFrame:
    """(kind, normal, surrogate, changed) of all distinct entities of texts(text).

    A whole name after titles without a gender is the person of that name after titles of one gender, if
    the corpus has these. ``changed`` says that the surrogate isn't what the entity alone would give.
    """
    found = materialize(texts.select("text").mapInArrow(_entity_rows, "kind string, normal string").distinct(), f"{folder}/found")
    whole = (F.col("kind") == "name") & ~F.col("normal").startswith("l:")
    plain = _settled(found.filter(~whole).withColumn("family", F.lit(None).cast("string")), key, f"{folder}/plain")
    names = found.filter(whole).select("normal", F.substring("normal", 1, 1).alias("gender"), F.substring("normal", 3, 1 << 30).alias("name"))
    of = {g: F.max(F.when(F.col("gender") == g, True)).alias(g) for g in "fm"}
    known = names.groupBy("name").agg(*of.values()).filter("f is null or m is null").select("name", F.expr("if(f, 'f', if(m, 'm', 'n'))").alias("g"))
    person = F.when(F.col("gender") == "n", F.concat(F.coalesce("g", "gender"), F.lit(":"), "name")).otherwise(F.col("normal"))
    names = materialize(names.join(known, "name", "left").select("normal", person.alias("person")), f"{folder}/names")
    people = names.select(F.lit("name").alias("kind"), F.col("person").alias("normal")).distinct()
    people = materialize(people.withColumn("last", F.concat(F.lit("l:"), F.substring_index(F.col("normal"), " ", -1))), f"{folder}/people")
    last = plain.filter("kind = 'name'").select(F.col("normal").alias("last"), F.col("surrogate").alias("family"), F.col("attempt").alias("of_last"))
    people = materialize(join_hot(people, last, "last", F.col("normal"), f"{folder}/hot-last").drop("last"), f"{folder}/people-named")
    chosen = _settled(people.select("kind", "normal", "family"), key, f"{folder}/whole")
    chosen = chosen.select(F.col("normal").alias("person"), "surrogate", "attempt").join(people.select(F.col("normal").alias("person"), "of_last"), "person")
    named = names.join(chosen, "person").select(
        F.lit("name").alias("kind"), "normal", "surrogate", ((F.col("attempt") != 0) | (F.col("of_last") != 0) | (F.col("person") != F.col("normal"))).alias("changed")
    )
    return plain.select("kind", "normal", "surrogate", (F.col("attempt") != 0).alias("changed")).union(named)


def _rewrite(key: bytes, changed):
    def run(batches):
        made, cache = Surrogates(key), {}
        common = changed.value if changed else {}
        for batch in batches:
            texts, kinds, counts = [], [], []
            own_lists = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for text, own in zip(batch.column(1).to_pylist(), own_lists, strict=True):
                spans = detect(text or "")
                moved = {(x["kind"], x["normal"]): x["surrogate"] for x in own or ()}
                parts, at = [], 0
                for start, end, kind, normal in spans:
                    if len(cache) > 100_000:
                        cache.clear()
                    if (kind, normal) not in cache:
                        cache[kind, normal] = common.get((kind, normal)) or made.of(kind, normal)
                    new = moved.get((kind, normal)) or cache[kind, normal]
                    parts += [text[at:start], _shaped(text[start:end], kind, new)]
                    at = end
                texts.append(None if text is None else "".join(parts) + text[at:])
                counts.append(len(spans))
                kinds.append(sorted({k for _, _, k, _ in spans}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
                ["doc_id", "text", "n_entities", "kinds"],
            )

    return run


def surrogate_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds): every row's text with all entities replaced.

    Null texts stay null and texts without entities stay as they are. Null doc_ids and repeated rows each
    come back, rewritten alike; an entity has the same surrogate in all of them. Of entities that clash the
    smallest normal form stays (ties can't be: they are distinct). Very long texts are searched whole. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = workdir(spark, "pii")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    changed = materialize(assign_surrogates(texts, key, folder).filter("changed").select("kind", "normal", "surrogate"), f"{folder}-changed")
    discard(spark, folder)
    schema = "doc_id long, text string, n_entities long, kinds array<string>"
    if changed.count() <= BROADCAST_CHANGED:
        known = {(r.kind, r.normal): r.surrogate for r in changed.toLocalIterator()}
        return texts.mapInArrow(_rewrite(key, spark.sparkContext.broadcast(known)), schema)
    return _joined_rewrite(texts, changed, key, folder)


def _found_rows(batches):
    for batch in batches:
        rows = [(h, k, n) for h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, n in {x[2:] for x in detect(t or "")}]
        names, types = ["mark", "kind", "normal"], [pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _joined_rewrite(texts: DataFrame, changed: DataFrame, key: bytes, folder: str) -> DataFrame:
    """Where too many surrogates were changed to broadcast: each text is joined with those of its own, a frequent text in parts."""
    marked = texts.withColumn("mark", F.xxhash64("text"))
    found = marked.select("mark", "text").mapInArrow(_found_rows, "mark long, kind string, normal string").distinct()
    own = found.join(changed, ["kind", "normal"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "normal", "surrogate")).alias("own"))
    own = materialize(own, f"{folder}-own")
    rows = join_hot(marked, own, "mark", F.col("doc_id"), f"{folder}-hot", "left").select("doc_id", "text", "own")
    return rows.mapInArrow(_rewrite(key, None), "doc_id long, text string, n_entities long, kinds array<string>")
