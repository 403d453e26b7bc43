"""PII (operator 7): keyed surrogates of the same type and format.

Entities found: e-mail addresses, telephone numbers, IPv4 addresses, payment cards, bank
account numbers (IBAN), social security numbers, secrets (long hexadecimal strings) and
names of persons: after a title or a phrase of introduction, or with a listed given name.
Family names met so are entities wherever else in the text they stand alone.

A surrogate comes from a keyed permutation of the entity's canonical form: letters in lower
case, no blanks or punctuation of format.  Its characters are permuted by a Feistel network,
each modulo the size of its own class (digit, vowel or consonant of a script); then case,
blanks and punctuation are put back.  So a surrogate has the type, script, length and format
of its entity, and an entity has one surrogate however it is written (coreference).  The name
and the host of an address are permuted apart, so hosts stay shared; country codes, top-level
domains and issuer digits stay; listed given names turn into given names of the same gender
and script; card and IBAN check digits stay valid if they were.  A permutation being
one-to-one, different entities have different surrogates; :func:`collisions` checks that over
a whole table by grouped aggregation.  Whoever has the key can undo the replacement: it is a
required argument, to be kept secret.

Cases: null texts stay null, empty texts empty; very long texts are read whole; texts without
an entity are unchanged to the byte; where patterns overlap the first in order of ``PATTERNS``
at the leftmost place counts; repeated rows get equal texts; an empty table gives an empty
result; carried columns keep their values, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import map_arrow, slices, staged

ROUNDS = 6

#: Common given names by script and gender; each row permutes within itself.
#: Callers with longer lists pass them as ``given_names``.
GIVEN_NAMES = [
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Mark Peter Paul Hans Karl Jean Pierre Luis Carlos Juan José Antonio Marco Ahmed Mohammed Ali Omar Raj Arjun Rahul Amit Wei Hiroshi Kenji".split(),
    "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Anna Maria Julia Claire Sophie Marie Carmen Lucia Ana Laura Emma Olivia Giulia Fatima Aisha Leila Priya Ananya Deepa Mei Ling Yuki Sakura Ingrid Heike".split(),
    "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "Γιώργος Νίκος Κώστας Δημήτρης".split(),
    "Μαρία Ελένη Κατερίνα Σοφία".split(),
]
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña".split()
INTRODUCTIONS = ["my name is", "My name is", "je m'appelle", "Je m'appelle", "ich heiße", "Ich heiße", "me llamo", "Me llamo"]
#: Country calling codes of one and of two digits; the others have three.
CODES_1 = {"1", "7"}
CODES_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_CLASSES = [
    "0123456789",
    "aeiouy", "AEIOUY",
    "bcdfghjklmnpqrstvwxz", "BCDFGHJKLMNPQRSTVWXZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŸŒ",
    "çñß", "ÇÑ",
    "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ",
    "бвгджзйклмнпрстфхцчшщъь", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ",
    "αεηιουω", "ΑΕΗΙΟΥΩ",
    "βγδζθκλμνξπρστφχψς", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7))),
    "".join(map(chr, range(0x4E00, 0x9FA6))),
]
_PLACE = {c: (number, i) for number, letters in enumerate(_CLASSES) for i, c in enumerate(letters)}
_HEX = "0123456789abcdef"

_UPPER = r"[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я]"
_NAME = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)*"
PATTERNS: dict[str, str] = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d+])(?:\d{4}[ \-]?){3}\d{1,7}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w+])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-.]*\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]*\d)",
}


class Finder:
    """Entities of a text, by the patterns and the listed given names."""

    def __init__(self, given_names: list[list[str]] = GIVEN_NAMES):
        self.listed = {name: (row, i) for row, names in enumerate(given_names) for i, name in enumerate(names)}
        given = "|".join(sorted(self.listed, key=len, reverse=True))
        titles, intro = "|".join(TITLES), "|".join(map(re.escape, INTRODUCTIONS))
        person = rf"(?<!\w)(?:(?:{titles})\.? {_NAME}(?: {_NAME})?|(?:{given}) {_NAME})(?!\w)"
        self.introduced = re.compile(rf"(?<!\w)(?:{intro}) ({_NAME}(?: {_NAME})?)")
        self.any = re.compile("|".join(f"(?P<{k}>{p})" for k, p in {**PATTERNS, "person": person}.items()))
        # every pattern needs an @, a digit, a long run of hexadecimal letters, a title or a listed name
        self.hint = re.compile(rf"@|\d|[a-f]{{32}}|[A-F]{{32}}|(?<!\w)(?:{titles}|{given})(?!\w)|{intro}")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Begin, end and type of each entity, in order."""
        if not self.hint.search(text):
            return []
        found = [(m.start(), m.end(), m.lastgroup) for m in self.any.finditer(text)]
        found += [(m.start(1), m.end(1), "person") for m in self.introduced.finditer(text)]
        families = {
            w
            for a, b, kind in found
            if kind == "person"
            for w in text[a:b].split(" ")[1:]
            if w not in self.listed and w.rstrip(".") not in _TITLE and len(w) > 2
        }
        if families:
            again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})(?!\w)")
            found += [(m.start(), m.end(), "person") for m in again.finditer(text)]
        kept, end = [], 0
        for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= end:
                kept.append((a, b, kind))
                end = b
        return kept


_TITLE = set(TITLES)


class Surrogates:
    """Keyed, format-preserving permutations by type of entity."""

    def __init__(self, key: str, given_names: list[list[str]] = GIVEN_NAMES):
        self.given = given_names
        self.listed = {name: (row, i) for row, names in enumerate(given_names) for i, name in enumerate(names)}
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _stream(self, label: str, count: int) -> list[int]:
        out: list[int] = []
        for block in range(-(-count // 8)):
            digest = hashlib.blake2b(f"{label}|{block}".encode(), key=self.key).digest()
            out += [int.from_bytes(digest[i : i + 8], "big") for i in range(0, 64, 8)]
        return out[:count]

    def permute(self, label: str, digits: list[int], sizes: list[int]) -> list[int]:
        """A permutation of the digit strings with these sizes; ``label`` chooses it."""
        half = len(digits) // 2
        parts, radix = [digits[:half], digits[half:]], [sizes[:half], sizes[half:]]
        for turn in range(ROUNDS):
            own, other = turn % 2, 1 - turn % 2
            noise = self._stream(f"{label}|{sizes}|{turn}|{parts[other]}", len(parts[own]))
            parts[own] = [(x + n) % r for x, n, r in zip(parts[own], noise, radix[own])]
        return parts[0] + parts[1]

    def letters(self, label: str, text: str) -> str:
        """``text`` with the characters of known classes permuted, the rest in place."""
        at = [i for i, c in enumerate(text) if c in _PLACE]
        places = [_PLACE[text[i]] for i in at]
        shape = "".join("\0" if c in _PLACE else c for c in text) + str([n for n, _ in places])
        new = self.permute(f"{label}|{shape}", [i for _, i in places], [len(_CLASSES[n]) for n, _ in places])
        out = list(text)
        for i, (number, _), value in zip(at, places, new):
            out[i] = _CLASSES[number][value]
        return "".join(out)

    def email(self, text: str) -> str:
        name, _, domain = text.lower().rpartition("@")
        host, _, suffix = domain.rpartition(".")
        return f"{self.letters('name of address', name)}@{self.letters('host', host)}.{suffix}"

    def secret(self, text: str) -> str:
        new = self.permute("secret", [_HEX.index(c) for c in text.lower()], [16] * len(text))
        return "".join(_HEX[i] for i in new)

    def ip(self, text: str) -> str:
        return ".".join(map(str, self.permute("ip", [int(x) for x in text.split(".")], [256] * 4)))

    def card(self, text: str) -> str:
        """The first digit (kind of issuer) stays, and so does the distance to the check digit."""
        digits = [int(c) for c in text if c.isdigit()]
        body = digits[:1] + self.permute(f"card{digits[0]}", digits[1:-1], [10] * (len(digits) - 2))
        return "".join(map(str, [*body, (_luhn(body) + digits[-1] - _luhn(digits[:-1])) % 10]))

    def iban(self, text: str) -> str:
        """Country stays; check digits keep their distance to the right ones."""
        text = text.replace(" ", "")
        head, tail = text[:2], text[4:]
        new = self.letters("iban" + head, tail)
        check = (_iban_check(head, new) + int(text[2:4]) - _iban_check(head, tail)) % 97
        return f"{head}{check:02d}{new}"

    def phone(self, text: str) -> str:
        """The digits; a country code after a plus sign stays."""
        digits = "".join(c for c in text if c.isdigit())
        size = 0
        if text.startswith("+"):
            size = 1 if digits[0] in CODES_1 else 2 if digits[:2] in CODES_2 else 3
        return digits[:size] + self.letters("phone" + digits[:size], digits[size:])

    def ssn(self, text: str) -> str:
        return self.letters("ssn", text.replace("-", ""))

    def person(self, text: str) -> str:
        """Word by word, so a surname alone keeps its surrogate; titles stay."""
        return " ".join(self._name(w) for w in text.split(" "))

    def _name(self, word: str) -> str:
        if word.rstrip(".") in _TITLE:
            return word
        if word in self.listed:
            row, i = self.listed[word]
            names = self.given[row]
            order = sorted(range(len(names)), key=lambda k: self._stream(f"given|{row}|{k}", 1))
            return names[order[(order.index(i) + 1) % len(order)]]
        new = self.letters("name", word)
        while new in self.listed or new in _TITLE:  # such a word has another meaning: walk on along the cycle
            new = self.letters("name", new)
        return new

    def of(self, kind: str, text: str) -> str:
        """The surrogate in the format of ``text``."""
        new = getattr(self, kind)(text)
        return new if kind in ("ip", "person") else _formatted(text, new)


def canonical(kind: str, text: str) -> str:
    """What an entity is, apart from its format."""
    if kind in ("email", "secret"):
        return text.lower()
    if kind == "phone":
        return ("+" if text[0] == "+" else "") + "".join(c for c in text if c.isdigit())
    return "".join(c for c in text if c.isalnum()) if kind in ("card", "iban", "ssn") else text


def _formatted(text: str, new: str) -> str:
    """The characters of ``new`` in the places, cases and punctuation of ``text``."""
    if len(new) == len(text):
        return "".join(n.upper() if t.isupper() else n for t, n in zip(text, new))
    left = iter(new)
    return "".join(next(left) if c.isalnum() else c for c in text)


def _luhn(body: list[int]) -> int:
    """The check digit of the digits before it."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(body)))
    return -total % 10


def _iban_check(head: str, tail: str) -> int:
    digits = "".join(str(int(c, 36)) for c in tail.replace(" ", "") + head + "00")
    return (98 - int(digits) % 97) % 97


def entities(text: str, finder: Finder) -> list[tuple[str, str]]:
    """Type and string of each entity, in order."""
    return [(kind, text[a:b]) for a, b, kind in finder.spans(text)]


def replace(text: str, finder: Finder, surrogates: Surrogates, known: dict) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and type, canonical form and canonical surrogate of each entity."""
    parts, found, at = [], [], 0
    for a, b, kind in finder.spans(text):
        key = (kind, text[a:b])
        if key not in known:
            new = surrogates.of(*key)
            known[key] = (new, (kind, canonical(*key), canonical(kind, new)))
        parts += [text[at:a], known[key][0]]
        found.append(known[key][1])
        at = b
    return ("".join([*parts, text[at:]]) if found else text), found


def with_surrogates(
    docs: DataFrame,
    key: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    given_names: list[list[str]] = GIVEN_NAMES,
    report: str | None = None,
) -> DataFrame:
    """``docs`` with entities of ``text_col`` replaced, and ``n_entities``.

    ``report`` names a column to add: the different ``kind, entity, surrogate`` of the row.
    """
    made = {text_col.lower(), "n_entities"} | ({report.lower()} if report else set())
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias(text_col))
    schema = T.StructType([*source.schema, T.StructField("n_entities", T.LongType())])
    row = pa.struct([(n, pa.string()) for n in ("kind", "entity", "surrogate")])
    if report:
        fields = [T.StructField(f.name, T.StringType()) for f in row]
        schema = schema.add(report, T.ArrayType(T.StructType(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, surrogates, known = Finder(given_names), Surrogates(key, given_names), {}
        for batch in slices(batches, len(carried)):
            if len(known) > 100_000:
                known.clear()
            texts, counts, reports = [], [], []
            for text in batch.column(len(carried)).to_pylist():
                new, found = replace(text, finder, surrogates, known) if text else (text, [])
                texts.append(new)
                counts.append(len(found))
                reports.append([dict(zip(("kind", "entity", "surrogate"), x)) for x in sorted(set(found))])
            columns = [batch.column(i) for i in range(len(carried))]
            columns += [pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(reports, pa.list_(row))] if report else []), names=schema.fieldNames()
            )

    return source.transform(map_arrow, run, schema)


def collisions(table: DataFrame) -> DataFrame:
    """Of ``kind, entity, surrogate``: surrogates of several entities, and entities with several surrogates."""
    pairs = table.select("kind", "entity", "surrogate").distinct()
    both = pairs.select("kind", F.lit("surrogate").alias("side"), F.col("surrogate").alias("value")).unionByName(
        pairs.select("kind", F.lit("entity").alias("side"), F.col("entity").alias("value"))
    )
    return both.groupBy("kind", "side", "value").agg(F.count("*").alias("n")).where("n > 1")


def met_again(table: DataFrame) -> DataFrame:
    """Surrogates that are also real entities of the table (expected of small spaces: given names, short numbers)."""
    real = table.select("kind", F.col("entity").alias("surrogate")).distinct()
    return table.select("kind", "surrogate").distinct().join(real, ["kind", "surrogate"])


def checked_surrogates(docs: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """:func:`with_surrogates`, written to the shared folder and checked for collisions over all rows."""
    done = staged(with_surrogates(docs, key, keep=keep, report="__entities"), "surrogates")
    clash = collisions(done.select(F.explode("__entities").alias("e")).select("e.*")).first()
    if clash is not None:
        raise ValueError(f"the {clash['side']} {clash['value']!r} of type {clash['kind']} is not unique")
    return done.drop("__entities")
