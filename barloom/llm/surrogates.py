"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Every surrogate is a keyed permutation of the values of one format, so distinct entities keep distinct
surrogates, the same entity has the same one wherever and however it is written, and no entity stands for
itself: with f a Feistel network over the M values of the format, x goes to f'(f(x) + 1 mod M), one cycle
over all values. Separators, letter case and country codes stay as they were, check digits stay valid, and
addresses stay within their range (private, loopback, public). Given names of the lists go to names of the
same list (one gender, one script), names for either gender to others of them; other names change vowels for
vowels and consonants for consonants, keep their last letter, and step over the listed names; under a title
that tells a gender, such a given name has another surrogate for each gender. Letters beyond the alphabets
change within their block of the code table and their kind.

A person is found by a title before the name or by a listed given name before another name. Where a text
has one, each further whole word that equals a part of the name has the part's surrogate. Other names stay,
and so do names in scripts without capitals. Card numbers and IBANs are found if their check digits hold.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, texts_of

#: Given names by gender (none: of either) and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Clara Diana Elena Elizabeth Emma Eva Fatima Hannah Helen Irene Jennifer Jessica Julia Karen Laura Linda Lisa Lucy Maria Marie Mary Monika Nora Olivia Patricia Paula Petra Priya Rosa Sabine Sarah Sofia Susan Teresa Ursula Vera Yuki".split(),
    ("m", "latin"): "Adam Ahmed Albert Anton Bruno Carlos Daniel David Edward Felix Frank George Hans Henry Hugo James Jean John Joseph Juan Jürgen Karl Klaus Louis Lucas Mark Martin Michael Mohammed Oscar Paul Peter Pierre Raj Richard Robert Stefan Thomas William Wolfgang".split(),
    ("", "latin"): "Alex Andrea Chris Jamie Kim Robin Sasha Taylor Wei Yan".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Людмила Мария Наталья Нина Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Андрей Борис Виктор Дмитрий Иван Игорь Кирилл Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("f", "greek"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γιώργος Γιάννης Δημήτρης Κώστας Νίκος Παύλος".split(),
}
#: Titles before a name, with the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Country calling codes of one and two digits; all others have three.
_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Address ranges that keep to themselves, as (first address, bits).
_RANGES = ((0x00000000, 8), (0x0A000000, 8), (0x7F000000, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0A80000, 16))

#: Letters that stand for each other.
_ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûüýÿ", "ßçñðþæøœ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")
_HEX = "0123456789abcdef"
_OF = {c: a for a in _ALPHABETS for c in a}
_KNOWN = {n.lower(): (g, n) for g, names in GIVEN.items() for n in names}

_UPPER = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x590) if chr(c).isupper())
_NUMERIC = re.compile(
    r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?i:(?:token|key|secret|password|passwd)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/-]{12,})"
    r"|(?<!\w)(?P<hex>[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<!\w)(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r"|(?<!\w)(?P<card>[2-6]\d{3}(?:[ -]\d{4}){3}|[2-6]\d{12,18})(?!\w)"
)
_BARE = re.compile(rf"(?<!\w)[{_UPPER}][\w'’-]*\w")
#: Words that are no part of a name though they may stand after one.
_COMMON = set("and are as at but by for from had has have if in is it its not of on or our that the their then there these they this to was were what when where which who why with would you your".split())
_DIGIT = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"(?i:token|key|secret|passw)|[a-f]{32}|[A-F]{32}")


@lru_cache(10_000)
def _alphabet(c: str) -> str | None:
    """The lower-case letters and digits that may stand for one; None for all other characters."""
    if c in _OF or not c.isalpha() or c != c.lower():
        return _OF.get(c)
    kind, first = unicodedata.category(c), ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(first, first + 256)) if x not in _OF and unicodedata.category(x) == kind and x == x.lower() and x == unicodedata.normalize("NFC", x))


def _feistel(key: bytes, tweak: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced network over enough bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        a, b = x >> half, x & low
        for r in range(9, -1, -1) if back else range(10):
            raw = hashlib.blake2b(f"{tweak}|{r}|{size}|{a if back else b}".encode(), key=key, digest_size=64).digest()
            while len(raw) * 8 < half:
                raw += hashlib.blake2b(raw, key=key, digest_size=64).digest()
            if back:
                a, b = (b ^ int.from_bytes(raw, "big")) & low, a
            else:
                a, b = b, (a ^ int.from_bytes(raw, "big")) & low
        x = a << half | b
        if x < size:
            return x


def _cycle(key: bytes, tweak: str, x: int, size: int) -> int:
    """A permutation of range(size) in one cycle: nothing stays where it is if there are two values."""
    return _feistel(key, tweak, (_feistel(key, tweak, x, size) + 1) % size, size, back=True)


def _permute(key: bytes, kind: str, text: str, alphabets: list[str | None]) -> str:
    """Characters with an alphabet change within it, all others stay; a permutation of all texts of this form."""
    size, x = 1, 0
    for c, own in zip(text, alphabets):
        if own:
            size, x = size * len(own), x * len(own) + own.index(c)
    if size < 2:
        return text
    tweak = kind + "|" + "".join(c if not own else own[0] for c, own in zip(text, alphabets))
    x, out = _cycle(key, tweak, x, size), []
    for c, own in zip(reversed(text), reversed(alphabets)):
        if own:
            x, k = divmod(x, len(own))
            c = own[k]
        out.append(c)
    return "".join(reversed(out))


def _digits(key: bytes, kind: str, text: str) -> str:
    return _permute(key, kind, text, ["0123456789"] * len(text))


def _refill(shape: str, digits: str) -> str:
    own = iter(digits)
    return re.sub(r"\d", lambda _: next(own), shape)


def _case(like: str, text: str) -> str:
    if like.isupper():
        return text.upper()
    return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(like, text))


def _luhn(digits: str) -> int:
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    """The remainder that check digits fix; letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _checked(kind: str, text: str) -> bool:
    """Whether the check digits hold, where the kind has them."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return _luhn(digits[:-1]) == int(digits[-1])
    return kind != "iban" or _mod97(text.replace(" ", "")) == 1


def canonical(kind: str, text: str, genders: tuple[str, ...] = ()) -> str:
    """What is the same for every spelling of an entity."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "person":
        return text.lower() + "|" + ",".join(genders)
    return text.replace(" ", "") if kind == "iban" else text.lower() if kind in ("email", "hex") else text


class Surrogates:
    """The surrogate of an entity under one secret key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.pools = {}
        for group, names in GIVEN.items():
            self.pools[group] = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=self.key).digest())
        self.of = lru_cache(100_000)(self._of)

    def number(self, kind: str, text: str, genders: tuple[str, ...]) -> int:
        """A keyed number of the entity, the same for every spelling."""
        raw = hashlib.blake2b(f"{kind}|{canonical(kind, text, genders)}".encode(), key=self.key, digest_size=8).digest()
        return int.from_bytes(raw, "big", signed=True)

    def _of(self, kind: str, text: str, genders: tuple[str, ...] = ()) -> str:
        """genders: of each word of a person."""
        if kind == "person":
            own = iter([*genders, *[""] * len(text)])
            return re.sub(r"[^\s]+", lambda m: self.name(m[0], next(own)), text)
        if kind in ("phone", "ssn"):
            digits = re.sub(r"\D", "", text)
            code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3]) if text.startswith("+") else ""
            return _refill(text, code + _digits(self.key, f"{kind}{code}", digits[len(code) :]))
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            body = digits[0] + _digits(self.key, kind + digits[0], digits[1:-1])
            return _refill(text, body + str(_luhn(body)))
        if kind == "ip":
            return self.address(text)
        if kind == "email":
            local, domain = text.rsplit("@", 1)
            *labels, top = domain.lower().split(".")
            new = _permute(self.key, "email", local.lower(), [_alphabet(c) for c in local.lower()])
            host = ".".join(_permute(self.key, "host", x, [_alphabet(c) for c in x]) for x in labels)
            return _case(local, new) + "@" + host + "." + top
        low = text.lower()
        if kind == "hex" or re.fullmatch(r"[0-9a-f]{32,}", low) and (text == low or text == text.upper()):
            new = _permute(self.key, "hex", low, [_HEX] * len(low))
            return new if text != text.upper() else new.upper()
        ranges = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else None for c in text]
        if kind == "iban":
            plain = [(c, a) for c, a in zip(text, ranges) if c != " "]
            body = _permute(self.key, kind + text[:2], "".join(c for c, _ in plain[4:]), [a for _, a in plain[4:]])
            check = 98 - _mod97(text[:2] + "00" + body)
            own = iter(f"{text[:2]}{check:02d}{body}")
            return re.sub(r"[^ ]", lambda _: next(own), text)
        return _permute(self.key, "secret", text, ranges)

    def address(self, text: str) -> str:
        """Within its own range; a public address steps over all the others."""
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        held = next(((first, bits) for first, bits in _RANGES if x >> 32 - bits == first >> 32 - bits), None)
        if held:
            first, bits = held
            x = first | _cycle(self.key, f"ip{first}", x & (1 << 32 - bits) - 1, 1 << 32 - bits)
        else:
            x = _cycle(self.key, "ip", x, 1 << 32)
            while any(x >> 32 - bits == first >> 32 - bits for first, bits in _RANGES):
                x = _cycle(self.key, "ip", x, 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def name(self, word: str, gender: str = "") -> str:
        low = word.lower()
        if low in _KNOWN:
            group, own = _KNOWN[low]
            pool = self.pools[group]
            step = 1 if group[0] else 1 + ("", "m", "f").index(gender)  # a name for either gender has one surrogate for each
            new = pool[(pool.index(own) + step) % len(pool)]
            return new.upper() if word.isupper() and len(word) > 1 else new
        own = [_alphabet(c) for c in low]
        if len([a for a in own if a]) > 2:
            own[-1] = None
        new = low
        while True:
            new = _permute(self.key, "name" + gender, new, own)
            if new not in _KNOWN:
                return _case(word, new)


def _persons(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, gender that the title tells) of the names among a text's capitalised words."""
    k, n = 0, len(words)
    joined = lambda i: i + 1 < n and words[i + 1][0] == words[i][1] + 1 and text[words[i][1]] == " " and text[slice(*words[i + 1])].lower() not in _COMMON
    while k < n:
        s, e = words[k]
        word, last = text[s:e], k
        if word in TITLES and k + 1 < n and text[e : words[k + 1][0]] in (" ", ". "):
            last = k + 2 if joined(k + 1) else k + 1
            yield words[k + 1][0], words[last][1], TITLES[word]
        elif word.lower() in _KNOWN and word in (_KNOWN[word.lower()][1], word.upper()) and joined(k):
            last = k + 1
            yield s, words[last][1], ""
        k = last + 1


def _first_gender(word: str, title: str) -> str:
    """The gender of a given name: its own, or what the title tells."""
    known = _KNOWN.get(word.lower())
    return known[0][0] or title if known else title


def entities(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, genders of a person's words) of the entities of a text, in order and without overlap."""
    taken = []
    if _DIGIT.search(text) or _NO_DIGIT.search(text):
        taken = [(m.start(m.lastgroup), m.end(m.lastgroup), m.lastgroup, ()) for m in _NUMERIC.finditer(text) if _checked(m.lastgroup, m[m.lastgroup])]
    words = [m.span() for m in _BARE.finditer(text)]
    numbers, persons, parts = taken[:], [], {}
    for s, e, title in _persons(text, words):
        if text[e - 2 : e] in ("'s", "’s"):
            e -= 2
        if not _overlaps(numbers, s, e):
            own = text[s:e].split()
            genders = (_first_gender(own[0], title), "") if len(own) > 1 else ("",)
            persons.append((s, e, "person", genders))
            for word, gender in zip(own, genders):
                parts.setdefault(_plain(word), gender)
    if persons:
        for word in _COMMON & parts.keys():
            del parts[word]
        taken = sorted(numbers + persons)
        for s, e in words:
            if text[e - 2 : e] in ("'s", "’s"):
                e -= 2
            for a, b in [(s, e)] if _plain(text[s:e]) in parts else [(s + k.start(), s + k.end()) for k in re.finditer(r"\w+", text[s:e])]:
                if text[a].isupper() and _plain(text[a:b]) in parts and not _overlaps(taken, a, b):
                    persons.append((a, b, "person", (parts[_plain(text[a:b])],)))
    return sorted(numbers + persons)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text."""
    return [x[:3] for x in entities(text)]


def _plain(word: str) -> str:
    """The part of a name that a word stands for: without a possessive, in lower case."""
    return re.sub("['’]s$", "", word, flags=re.I).lower()


def _overlaps(spans: list[tuple], s: int, e: int) -> bool:
    """Whether one of these spans, in order and without overlap, meets s to e."""
    k = bisect_left(spans, (e,))
    return k > 0 and spans[k - 1][1] > s


def replace(text: str, made: Surrogates) -> tuple[str, list[tuple[int, int, str, str, int]]]:
    """The text with surrogates, and (start, end, kind, surrogate, number of the entity) of what they replace."""
    parts, spans, at = [], [], 0
    for s, e, kind, genders in entities(text):
        new = made.of(kind, text[s:e], genders)
        parts += [text[at:s], new]
        spans.append((s, e, kind, new, made.number(kind, text[s:e], genders)))
        at = e
    return "".join([*parts, text[at:]]), spans


_CELLS = {"start": pa.int32(), "end": pa.int32(), "kind": pa.string(), "surrogate": pa.string(), "entity": pa.int64()}
_SPANS = pa.list_(pa.struct(list(_CELLS.items())))


def pseudonymize(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text with surrogates, entities array<struct<start, end, kind, surrogate, entity>>) of every row.

    Offsets are those of the original text, in code points; entity is a keyed number that all spellings share. A null
    text stays null and has no entities; null keys and repeated rows keep their rows; an empty table gives none. Whole
    texts are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("surrogates")
        made = Surrogates(secret)
        for batch in batches:
            own = [(None, []) if t is None else replace(t, made) for t in texts_of(batch.column(1))]
            spans = [[dict(zip(_CELLS, s)) for s in x[1]] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in own], pa.string()), pa.array(spans, _SPANS)], names=["key", "text", "entities"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text string, entities array<struct<start: int, end: int, kind: string, surrogate: string, entity: bigint>>").withColumnRenamed("key", key)


def collisions(replaced: DataFrame) -> DataFrame:
    """The collision check: (kind, surrogate, n) of surrogates that stand for several entities; none if all is well.

    Both aggregations combine before they shuffle, so an entity that a third of the documents hold is one row a task.
    """
    seen = replaced.select(F.explode("entities").alias("e")).select("e.kind", F.lower("e.surrogate").alias("surrogate"), "e.entity").distinct()
    digits = F.when(F.col("kind").isin("phone", "card", "ssn"), F.regexp_replace("surrogate", r"\D", "")).otherwise(F.col("surrogate"))
    own = seen.select("kind", digits.alias("surrogate"), "entity").distinct()
    return own.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
