"""PII surrogates: keyed, type-consistent replacements.

Entities are found in whole texts and brought to a canonical form, so that spellings
of one entity (``+1 (499) 555-6503`` and ``499-555-6503``, ``Ann@x.org`` and
``ann@x.org``) are one entity everywhere: coreference holds within a text and across the
corpus.  The surrogate of a canonical form is drawn by a keyed permutation of the
entity's own domain (a Feistel network over mixed radix digits with HMAC-SHA256,
walked on until it lands inside the domain):

* phone numbers keep country code, punctuation and grouping, and stay dialable
  patterns; card numbers keep the issuer digit and pass the Luhn test; IPv4 addresses
  stay in the public range (private ones in their private range); e-mail addresses,
  secrets, social security numbers and bank account numbers keep the shape of each
  character (letter, digit, case), the latter also valid check digits;
* person names keep gender, script (Latin, Cyrillic) and letter case: a given name
  becomes a given name of the same gender and script (from a list apart from the names that
  are searched for), a surname a surname of the same script.  ``Mr. John Smith`` and a later ``Smith`` get one surname.

A permutation keeps different originals apart within one domain.  The collision check
covers the rest: over all distinct entities of a family (all names of a script;
secrets with hex digests; else one kind), a surrogate that equals any original, or the
surrogate of another entity, is drawn again under the next attempt number, which also
widens names, e-mail addresses and secrets, until no conflict is left.  Domains that
can't widen (addresses, phone, card and social security numbers) and are over a quarter
full are permuted as one cycle: surrogates are distinct and differ from their own
original, but may equal another one.  A given name without a known gender takes the one
that another mention in the corpus tells.  Attempts are joined back to the documents that hold
entities; documents without any pass through untouched.

Defined results: a null text stays null; empty texts and texts without an entity are
unchanged; very long texts are searched whole; of overlapping matches the earlier, then the longer one counts; repeated
rows get equal replacements; further columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, text_udf

#: Session setting that holds the secret key; without it every application draws its own.
KEY_SETTING = "spark.rivulet.surrogates.key"

# Honorifics by gender and given names by gender and script.
HONORIFICS = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Mademoiselle", "Frau", "Señora", "Señorita", "Sra", "Srta",
          "Signora", "Госпожа", "Г-жа"),
    "m": ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Herrn", "Señor", "Sr", "Signor", "Господин", "Г-н"),
    "x": ("Dr", "Prof", "Professor", "Доктор", "Профессор"),
}
GIVEN = {
    ("f", "latin"): ("Alice", "Barbara", "Charlotte", "Diana", "Elizabeth", "Emily", "Frances", "Helen", "Isabel", "Jennifer",
                     "Julia", "Katherine", "Laura", "Linda", "Margaret", "Maria", "Martha", "Mary", "Patricia", "Rachel",
                     "Sarah", "Sophie", "Susan", "Victoria"),
    ("m", "latin"): ("Albert", "Andrew", "Anthony", "Charles", "Daniel", "David", "Edward", "Frank", "George", "Henry",
                     "James", "John", "Joseph", "Kenneth", "Mark", "Michael", "Patrick", "Paul", "Peter", "Richard",
                     "Robert", "Stephen", "Thomas", "William"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга",
                        "Светлана", "Татьяна"),
    ("m", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел",
                        "Сергей", "Юрий"),
}
#: What given names become: none of these is one of ``GIVEN``, so a corpus full of those leaves them free.
REPLACEMENTS = {
    ("f", "latin"): ("Adele", "Agnes", "Amelia", "Beatrice", "Bridget", "Caroline", "Cecilia", "Clara", "Cora", "Daphne",
                     "Edith", "Eleanor", "Esther", "Eva", "Florence", "Gloria", "Harriet", "Hazel", "Ingrid", "Irene",
                     "Josephine", "Lucy", "Lydia", "Mabel", "Miriam", "Nora", "Olive", "Pauline", "Rosalind", "Ruth",
                     "Stella", "Ursula"),
    ("m", "latin"): ("Adrian", "Alan", "Arthur", "Basil", "Benjamin", "Bernard", "Clement", "Conrad", "Cyril", "Dennis",
                     "Edmund", "Felix", "Francis", "Gerald", "Gilbert", "Harold", "Hugo", "Jerome", "Julian", "Lawrence",
                     "Leonard", "Martin", "Maurice", "Neil", "Oliver", "Oscar", "Philip", "Ralph", "Simon", "Theodore",
                     "Victor", "Walter"),
    ("f", "cyrillic"): ("Алла", "Алина", "Валентина", "Варвара", "Дарья", "Жанна", "Зинаида", "Ксения", "Лариса", "Любовь",
                        "Марина", "Надежда", "Нина", "Полина", "Раиса", "Софья"),
    ("m", "cyrillic"): ("Антон", "Аркадий", "Вадим", "Валерий", "Василий", "Виктор", "Геннадий", "Георгий", "Денис", "Игорь",
                        "Кирилл", "Леонид", "Максим", "Олег", "Роман", "Фёдор"),
}
GENDER = {n.casefold(): kind for listed in (GIVEN, REPLACEMENTS) for kind, names in listed.items() for n in names}
#: Surnames are spelled from syllables: a large domain for each script.
SYLLABLES = {
    "latin": ("bar", "ben", "cal", "dor", "fen", "gar", "hol", "ker", "lan", "mar", "nor", "pel", "quin", "ros", "sel", "tal",
              "ver", "wen", "yar", "zel"),
    "cyrillic": ("бар", "вол", "гор", "дам", "зар", "кал", "лан", "мар", "нор", "пол", "рос", "сав", "тар", "фед", "хар", "чер"),
}
SURNAME_LENGTH = 4
#: Attempt number of the entities of a filled domain.
CYCLE = -1

_TITLES = tuple(sorted({h for hs in HONORIFICS.values() for h in hs}, key=len, reverse=True))
_GIVEN_NAMES = tuple(n for names in GIVEN.values() for n in names)
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
#: What names a secret; its value reaches to the closing quote, or without quotes to white space.
_LABEL = r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key))[\"']?\s{0,3}[=:]\s{0,3}"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(_LABEL + r"(?P<q>[\"'])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n]){8,})(?P=q)")),
    ("secret", re.compile(_LABEL + r"[\"']?+(?P<v>(?:[^\s\"']|[\"'](?![\s,;:)\]}>]|\Z)){8,}(?<![.,;:!?)\]}>\"']))")),
    ("hex", re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,31}[a-f])(?=[0-9a-f]{0,31}[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])")),
    ("card", re.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?!-?[0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9-])")),
)
#: Literals without which a kind's patterns can't match: plain searches spare most texts the patterns.
NEEDS = {"email": ("@",), "secret": ("=", ":", "AKIA", "ASIA")}
#: Words without one of which no name pattern can match (an opening mark may precede).
_TRIGGERS = frozenset(mark + word for mark in ("", "(", "[", '"', "'", "“", "„", "«", "‘", "—", "-", "/")
                      for word in (*_TITLES, *[t + "." for t in _TITLES], *_GIVEN_NAMES))
_DIGIT, _HEX = re.compile(r"[0-9]"), re.compile(r"[0-9a-f]+")

Span = tuple[int, int, str, str]


# --- keyed permutation -----------------------------------------------------------

def _round(key: bytes, label: str, i: int, half: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{label}|{i}|{half}".encode(), "sha256")[:16], "big")


def permute(value: int, size: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network, walked until inside."""
    if size < 2:
        return value
    half = max(2, 1 << -(-(size - 1).bit_length() // 2))
    while True:
        a, b = divmod(value, half)
        for i in reversed(range(8)) if back else range(8):
            a, b = ((b - _round(key, label, i, a)) % half, a) if back else (b, (a + _round(key, label, i, b)) % half)
        value = a * half + b
        if value < size:
            return value


def cycle(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation that is one cycle: no value keeps its place, also not if walked into a part of the range."""
    return permute((permute(value, size, key, label, True) + 1) % size, size, key, label)


def _shape(text: str, key: bytes, label: str, move=permute) -> str:
    """Permute all strings of the same character shape (digits, lower and upper letters)."""
    # letters of other alphabets become ASCII letters: none of the original's stays
    text = "".join(c if c.isascii() or not c.isalnum() else chr((65 if c.isupper() else 97) + ord(c) % 26) for c in text)
    kinds = [("0", 10) if c.isdigit() and c.isascii() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z"
             else (c, 1) for c in text]
    value, size = 0, 1
    for c, (base, n) in zip(text, kinds):
        if n > 1:
            value, size = value * n + ord(c) - ord(base), size * n
    value = move(value, size, key, label + "".join(k for k, _ in kinds))
    out = []
    for base, n in reversed(kinds):
        if n > 1:
            value, r = divmod(value, n)
            out.append(chr(ord(base) + r))
        else:
            out.append(base)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Luhn sum modulo 10 (0: valid)."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_PRIVATE = ((10, 8), (172 << 4 | 1, 12), (192 << 8 | 168, 16), (127, 8), (169 << 8 | 254, 16), (0, 8))


def _ip_block(value: int) -> tuple[int, int] | None:
    return next(((p, b) for p, b in _PRIVATE if value >> (32 - b) == p), None)


# --- detection ---------------------------------------------------------------------

def _canonical(kind: str, s: str) -> str | None:
    """The form that all spellings of an entity share; None if it isn't one after all."""
    if kind == "email":
        return s.lower()
    if kind == "card":
        d = re.sub(r"[^0-9]", "", s)
        return d if 13 <= len(d) <= 19 and luhn(d) == 0 and len(set(d)) > 1 else None
    if kind == "ip":
        parts = [int(p) for p in s.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 and any(parts) else None
    if kind == "ssn":
        d = s.replace("-", "")
        return d if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else None
    if kind == "iban":
        c = s.replace(" ", "")
        return c if 15 <= len(c) <= 34 and _mod97(c) == 1 else None
    if kind == "phone":
        d = re.sub(r"[^0-9]", "", s)
        if s.startswith("+1") and len(d) == 11:
            d = d[1:]
        elif s.startswith("+"):
            return "+" + d if 8 <= len(d) <= 15 else None
        return d if 9 <= len(d) <= 11 else None
    if kind == "secret":
        return s if any(c.isalnum() for c in s) else None
    return s


def _script(s: str) -> str:
    return "cyrillic" if "Ѐ" <= s[0] <= "ӿ" else "latin"


def _names(text: str) -> list[Span]:
    found: list[Span] = []
    surnames: set[str] = set()
    if _TRIGGERS.isdisjoint(text.split()):
        return found
    titles = [t for t in _TITLES if t + " " in text or t + ". " in text]
    given = [n for n in _GIVEN_NAMES if n + " " in text]
    matches = []
    if titles:
        matches += re.finditer(rf"(?<!\w)(?P<t>{'|'.join(map(re.escape, titles))})\.? (?P<n>{_NAME}(?: {_NAME})*)", text)
    if given:
        matches += re.finditer(rf"(?<!\w)(?P<t>)(?P<n>(?:{'|'.join(given)})(?: {_NAME})+)(?!\w)", text)
    for m in matches:
        gender = next((g for g, hs in HONORIFICS.items() if m.group("t") in hs), "x")
        at = m.start("n")
        words = m.group("n").split(" ")
        for k, w in enumerate(words):
            known = GENDER.get(w.casefold())
            if k < len(words) - 1 or known and len(words) == 1:
                g = gender if gender != "x" else known[0] if known else "x"
                found.append((at, at + len(w), f"given:{g}:{_script(w)}", w.casefold()))
            else:
                surnames.add(w)
                found.append((at, at + len(w), f"surname:{_script(w)}", w.casefold()))
            at += len(w) + 1
    if surnames:                                             # later mentions by surname alone
        alone = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(surnames)))})(?![\w-])")
        found += [(m.start(), m.end(), f"surname:{_script(m.group())}", m.group().casefold()) for m in alone.finditer(text)]
    return found


def detect(text: str | None) -> list[Span]:
    """(start, end, type, canonical) of all entities of a text, in order, not overlapping."""
    if not text:
        return []
    found: list[Span] = []
    digits = _DIGIT.search(text) is not None
    # all kinds but e-mail addresses and secrets in words hold a digit
    for kind, pattern in PATTERNS:
        if not (any(n in text for n in NEEDS[kind]) if kind in NEEDS else digits):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            c = _canonical(kind, text[a:b])
            if c is not None:
                found.append((a, b, "hex" if kind == "secret" and _HEX.fullmatch(c) else kind, c))
    found += _names(text)
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[Span] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


# --- surrogates ----------------------------------------------------------------------

def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement under one attempt number."""
    label = f"{kind}|{attempt}|"
    move = cycle if attempt == CYCLE else permute
    if kind == "card":
        n = len(canonical) - 2
        body = canonical[0] + f"{move(int(canonical[1:-1]), 10 ** n, key, label + canonical[0] + str(n)):0{n}d}"
        return body + str(-luhn(body + "0") % 10)
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, canonical.split("."))), "big")
        block = _ip_block(value)
        if block:
            bits = 32 - block[1]
            value = block[0] << bits | move(value & (1 << bits) - 1, 1 << bits, key, label + str(block))
        else:
            while True:                                      # a walk of the permutation inside public unicast space
                public = value >> 24 < 224
                value = move(value, 1 << 32, key, label)
                if not _ip_block(value) and (value >> 24 < 224) == public:
                    break
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "iban":
        body = _shape(canonical[4:], key, label + canonical[:2])
        return canonical[:2] + f"{98 - _mod97(canonical[:2] + '00' + body):02d}" + body
    if kind == "hex":
        n = len(canonical)
        return f"{permute(int(canonical, 16), 16 ** n, key, label + str(n)):0{n}x}"
    if kind == "secret" and canonical[:4] in ("AKIA", "ASIA") and len(canonical) == 20:
        value = permute(int(canonical[4:], 36), 36 ** 16, key, label + canonical[:4])
        return canonical[:4] + "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[value // 36 ** i % 36] for i in range(16))
    if kind in ("ssn", "phone"):
        out = canonical
        while True:                                          # stay inside the domain of valid numbers
            out = _shape(out, key, label, move) if out[0] != "+" else out[:3] + _shape(out[3:], key, label + out[:3], move)
            if kind == "ssn" and _canonical("ssn", f"{out[:3]}-{out[3:5]}-{out[5:]}") is None:
                continue
            if kind == "phone" and len(out) == 10 and out[0] != "+" and canonical[0] > "1" and canonical[3] > "1" \
                    and (out[0] < "2" or out[3] < "2"):
                continue
            return out
    if kind == "email":
        name, _, domain = canonical.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_shape(name, key, label + domain)}{_longer(canonical, attempt, key)}@{_shape(host, key, 'host|' + top)}.{top}"
    if kind.startswith("given:"):
        _, gender, script = kind.split(":")
        kinds = [(gender, script)] if gender != "x" else [("m", script), ("f", script)]
        names = [n for k in kinds for n in REPLACEMENTS[k]]
        known = [n.casefold() for k in kinds for n in GIVEN[k]]          # fewer than their replacements
        at = known.index(canonical) if canonical in known else _round(key, "given", 0, hash_int(canonical)) % len(names)
        name = names[permute(at, len(names), key, label)].casefold()
        if attempt:                                          # more people than names: a second part, longer every time
            name += "-" + "".join(_spell(hash_int(f"given|{attempt}|{canonical}", key), SYLLABLES[script], 1 + attempt))
        return name
    if kind.startswith("surname:"):
        script = kind.split(":")[1]
        parts = SYLLABLES[script]
        return "".join(_spell(hash_int(f"{attempt}|{canonical}", key), parts, SURNAME_LENGTH + attempt))
    return _shape(canonical, key, label) + _longer(canonical, attempt, key)


def hash_int(s: str, key: bytes = b"") -> int:
    return int.from_bytes(hmac.digest(key or b"-", s.encode(), "sha256")[:16], "big")


def _spell(value: int, parts: tuple[str, ...], n: int) -> list[str]:
    out = []
    for _ in range(n):
        value, r = divmod(value, len(parts))
        out.append(parts[r])
    return out


def _longer(canonical: str, attempt: int, key: bytes) -> str:
    """Letters that widen the domain of a shape: none at first, one more with every attempt."""
    return "".join(_spell(hash_int(f"shape|{attempt}|{canonical}", key), tuple("abcdefghijklmnopqrstuvwxyz"), attempt))


def render(kind: str, original: str, form: str) -> str:
    """Lay the canonical form of a surrogate into the original's format and case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(re.sub(r"[^0-9]", "", form))
        keep = max(0, len(re.sub(r"[^0-9]", "", original)) - len(re.sub(r"[^0-9]", "", form)))
        out = []
        for c in original:
            if c.isdigit():
                out.append(c if keep > 0 else next(digits))
                keep -= 1
            else:
                out.append(c)
        return "".join(out)
    if kind == "iban" and " " in original:
        letters = iter(form)
        return "".join(c if c == " " else next(letters) for c in original)
    if kind == "email" or kind.startswith(("given:", "surname:")):
        if original.isupper():
            return form.upper()
        if original[0].isupper():
            return "-".join(p[:1].upper() + p[1:] for p in form.split("-")) if kind != "email" else form[0].upper() + form[1:]
    return form


def rewrite(text: str, spans: list[tuple[int, int, str, str, int]], key: bytes) -> str:
    out, at = [], 0
    for start, end, kind, canonical, attempt in sorted(spans):
        out += [text[at:start], render(kind, text[start:end], _drawn(kind, canonical, attempt, key))]
        at = end
    return "".join([*out, text[at:]])


@lru_cache(maxsize=50_000)
def _drawn(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    return surrogate(kind, canonical, attempt, key)


# --- the Spark job -----------------------------------------------------------------------

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
                      T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType())])
_FOUND = T.StructType([T.StructField("spans", T.ArrayType(_SPAN))])
_PLACE = T.StructType([T.StructField("family", T.StringType()), T.StructField("domain", T.StringType()),
                       T.StructField("size", T.DoubleType())])
_FORM = T.StructType([T.StructField("form", T.StringType())])
_TEXT = T.StructType([T.StructField("text", T.StringType())])


def _finder(text: str):
    def make():
        names = _SPAN.names
        return lambda texts: [([dict(zip(names, s)) for s in detect(t)],) for t in texts]
    return text_udf(make, _FOUND)(text)["spans"]


def family(kind: str) -> str:
    """Kinds whose forms may equal each other share a family, within which surrogates are kept apart."""
    if kind.startswith(("given:", "surname:")):
        return "name:" + kind.rsplit(":", 1)[1]
    return "secret" if kind == "hex" else kind


def domain(kind: str, canonical: str) -> tuple[str | None, float | None]:
    """Name and size of the fixed domain that holds an entity and its surrogate; no name if it widens."""
    if kind == "ip":
        block = _ip_block(int.from_bytes(bytes(map(int, canonical.split("."))), "big"))
        return f"ip|{block}", float(1 << (32 - block[1] if block else 31))
    if kind == "card":
        return f"card|{canonical[0]}|{len(canonical)}", float(10 ** (len(canonical) - 2))
    if kind in ("ssn", "phone"):
        fixed = canonical[:3] if canonical[0] == "+" else ""
        return f"{kind}|{fixed}|{len(canonical)}", float(10 ** (len(canonical) - len(fixed)))
    return None, None


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, drawn): entities that aren't drawn as ``kind`` with attempt 0.

    ``drawn`` is the kind to draw from: a given name whose gender no title tells has the gender
    that the corpus knows for it (the first of two).
    """
    def make():
        return lambda kinds, forms, tries: [(surrogate(k, c, a, key),) for k, c, a in zip(kinds, forms, tries)]

    def place():
        return lambda kinds, forms: [(family(k), *domain(k, c)) for k, c in zip(kinds, forms)]
    draw = text_udf(make, _FORM)("kind", "canonical", "attempt")["form"]
    originals = scratch(entities.select("kind", "canonical").distinct(), "surrogates-entities")
    told = (originals.filter(F.col("kind").rlike("^given:[fm]:"))
            .groupBy(F.col("canonical").alias("c"), F.substring_index("kind", ":", -1).alias("script")).agg(F.min("kind").alias("drawn")))
    unsure = originals.filter(F.col("kind").startswith("given:x:"))
    alias = scratch(unsure.join(told, (F.col("canonical") == F.col("c")) & (F.substring_index("kind", ":", -1) == F.col("script")))
                    .select(F.col("kind").alias("told_kind"), F.col("canonical").alias("told_name"), "drawn"), "surrogates-aliases")
    own = originals.join(alias, (F.col("kind") == F.col("told_kind")) & (F.col("canonical") == F.col("told_name")), "left_anti")
    placed = scratch(own.withColumn("at", text_udf(place, _PLACE)("kind", "canonical")).select("kind", "canonical", "at.*"),
                     "surrogates-places")
    # a domain over a quarter full is permuted as one cycle: distinct, and none keeps its own form
    full = scratch(placed.filter("domain is not null").groupBy(F.col("domain").alias("d"))
                   .agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("s")).filter(F.col("n") * 4.0 > F.col("s")).select("d"),
                   "surrogates-full")
    cycled = placed.join(full, F.col("domain") == F.col("d"), "left_semi").select("kind", "canonical", F.lit(CYCLE).alias("attempt"))
    drawn = scratch(placed.join(full, F.col("domain") == F.col("d"), "left_anti").select("family", "kind", "canonical")
                    .withColumn("attempt", F.lit(0)).withColumn("form", draw), "surrogates-drawn")
    while True:
        # of entities that share a surrogate, one keeps it: the one settled first, then the smallest
        owner = drawn.groupBy("family", "form").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("own"),
                                                    F.count(F.lit(1)).alias("n"))
        shared = (drawn.join(owner.filter("n > 1").select(F.col("family").alias("k"), F.col("form").alias("f"),
                                                          F.col("own.canonical").alias("keeper"), F.col("own.kind").alias("keeps")),
                             (F.col("family") == F.col("k")) & (F.col("form") == F.col("f")))
                  .filter((F.col("canonical") != F.col("keeper")) | (F.col("kind") != F.col("keeps"))).select("kind", "canonical"))
        taken = drawn.join(placed.select(F.col("family").alias("k"), F.col("canonical").alias("f")),
                           (F.col("family") == F.col("k")) & (F.col("form") == F.col("f")), "left_semi").select("kind", "canonical")
        again = scratch(shared.union(taken).distinct(), "surrogates-again")
        if again.isEmpty():
            break
        left = again.select(F.col("kind").alias("k"), F.col("canonical").alias("c"), F.lit(True).alias("redo"))
        marked = drawn.join(left, (F.col("kind") == F.col("k")) & (F.col("canonical") == F.col("c")), "left")
        kept = marked.filter("redo is null").select("family", "kind", "canonical", "attempt", "form")
        redone = (marked.filter("redo").select("family", "kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
                  .withColumn("form", draw))
        drawn = scratch(kept.unionByName(redone), "surrogates-drawn")
    tries = drawn.filter("attempt > 0").select("kind", "canonical", "attempt").union(cycled)
    named = alias.join(tries, (F.col("drawn") == F.col("kind")) & (F.col("told_name") == F.col("canonical")), "left").select(
        F.col("told_kind").alias("kind"), F.col("told_name").alias("canonical"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "drawn")
    return tries.withColumn("drawn", F.col("kind")).unionByName(named)


_own_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of ``KEY_SETTING``, or one drawn at random for this application.

    A permutation under a published key could be undone by anyone, so there is no default.
    Surrogates that must be equal from run to run need the setting.
    """
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given.encode()
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def replace(docs: DataFrame, text: str = "text", key: bytes | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; all other columns pass through.

    The key is the session's (``session_key``) unless given.  With ``count`` a column of that
    name holds the number of replaced mentions.
    """
    key = key or session_key(docs.sparkSession)
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    marked = docs.select(whole, F.col(f"`{text}`").alias("text")).withColumn("spans", _finder("text"))
    clean = marked.filter(F.coalesce(F.size("spans"), F.lit(0)) <= 0)
    hits = scratch(marked.filter(F.size("spans") > 0).select(F.monotonically_increasing_id().alias("row"), "doc", "text", "spans"),
                   "surrogates-hits")
    mentions = hits.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    again = attempts(mentions.select("kind", "canonical"), key).select(
        F.col("kind").alias("k"), F.col("canonical").alias("c"), "attempt", "drawn")
    redrawn = (mentions.join(again, (F.col("kind") == F.col("k")) & (F.col("canonical") == F.col("c")))
               .groupBy(F.col("row").alias("r"))
               .agg(F.collect_list(F.struct("start", "attempt", "drawn")).alias("redo")))   # bounded by one document's mentions

    def make():
        def run(texts, spans, redo):
            out = []
            for t, ss, rs in zip(texts, spans, redo):
                tries = {r["start"]: (r["drawn"], r["attempt"]) for r in rs or ()}
                out.append((rewrite(t, [(s["start"], s["stop"], kind, s["canonical"], attempt) for s in ss
                                        for kind, attempt in [tries.get(s["start"], (s["kind"], 0))]], key),))
            return out
        return run
    done = hits.join(redrawn, hits.row == redrawn.r, "left").select(
        "doc", text_udf(make, _TEXT)("text", "spans", "redo")["text"].alias("text"), F.size("spans").alias("n"))

    def finished(df, new_text, n):
        cols = [new_text.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
        return df.select(*cols, *([n.cast("int").alias(count)] if count else []))
    return finished(clean, F.col("text"), F.lit(0)).union(finished(done, F.col("text"), F.col("n")))
