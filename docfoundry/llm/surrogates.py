"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct for distinct values.

A value's surrogate is the image under a keyed permutation of all values of its shape, one that maps nothing to itself. So the
same value has the same surrogate in every document, two values never share one, and no table of values has to be gathered.
collisions() checks this over a whole corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b, shake_256
from math import ceil, isqrt, prod
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

# Given names by script and gender, honorifics by gender.
GIVEN = {
    ("latin", "female"): "Alice Anna Carla Clara Diana Elena Emma Eva Ingrid Julia Laura Lena Maria Marta Nina Nora Olga Paula Sara Sofia Teresa Vera".split(),
    ("latin", "male"): "Adam Alan Boris Carl David Erik Felix Frank Hans Hugo Ivan James John Karl Leo Louis Mark Oscar Paul Peter Simon Thomas".split(),
    ("cyrillic", "female"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "male"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Юрий".split(),
    ("greek", "female"): "Άννα Ελένη Ειρήνη Μαρία Σοφία Χριστίνα".split(),
    ("greek", "male"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
HONORIFICS = {"female": "Mrs Ms Miss Frau Mme Señora Госпожа Κυρία".split(), "male": "Mr Herr Señor Господин Κύριος".split(), "": "Dr Prof Doctor Professor Доктор Профессор".split()}
ALPHABETS = {
    "digit": "0123456789",
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
HEX = "0123456789abcdef"
SOUNDS = {k: (v, "".join(c for c in ALPHABETS[k] if c not in v)) for k, v in {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}.items()}
SCRIPTS = {"latin": (0xDF, 0x180), "greek": (0x390, 0x3CF), "cyrillic": (0x430, 0x530)}


def _marked(script: str, vowels: bool) -> str:
    """The letters of a script with marks, or outside its plain alphabet, that have one capital letter each."""
    first, last = SCRIPTS[script]
    letters = [c for c in map(chr, range(first, last)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c and c not in ALPHABETS[script]]
    return "".join(c for c in letters if (normalize("NFD", c)[0] in SOUNDS[script][0]) == vowels)


MARKED = {k: tuple(m for m in (_marked(k, True), _marked(k, False)) if len(m) > 1) for k in SCRIPTS}
CLASS_OF = {c: m for ms in MARKED.values() for m in ms for c in m}

_CAPITAL = "[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿĀ-ž]+"
_CYRILLIC = "[А-ЯЁ][а-яё]+"
_GREEK = "[Α-ΩΆ-Ώ][α-ωά-ώΐΰ]+"
_TITLE = rf"(?:{'|'.join(h for hs in HONORIFICS.values() for h in hs)})"
_PARTS = [rf"(?:[A-Z]['’])?(?:{_CAPITAL})+(?:-(?:{_CAPITAL})+)*", rf"{_CYRILLIC}(?:-{_CYRILLIC})*", rf"{_GREEK}(?:-{_GREEK})*"]
_INITIALS = [r"[A-ZÀ-ÖØ-Þ]\.", r"[А-Я]\.", r"[Α-Ω]\."]
# Words before a name that has no title.
_CUES = r"(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:?|[Dd]ear|[Ss]igned:?|[Aa]uthor:|[Rr]egards,|[Ss]incerely,)"
_GIVEN = "|".join(sorted({n for names in GIVEN.values() for n in names}))
KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth[_-]?key)\b\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/.-]{8,})",
    "hex": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "card": r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![\w-])(?!\.[0-9])",
    "ip": r"(?<![\w.])(?<!ersion )(?<!ersion: )(?<!elease )(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])",
    "phone": r"(?<![\w.])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{3,4}){2}(?!\w)|(?<![\w.])\+[0-9]{1,3}[ .-]?[0-9]{1,3}(?:[ .-][0-9]{2}){4}(?!\w)|(?<![\w.])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "name": rf"\b{_TITLE}\.?(?: {_TITLE}\.?)* (?!{_TITLE}\b)(?P<name>{'|'.join(f'(?:(?:{p}|{i}) ){{0,2}}{p}' for p, i in zip(_PARTS, _INITIALS))})(?!\w)",
    # without a title: after a cue, or where a listed given name comes first; two parts at least
    "untitled": rf"(?:\b{_CUES}\s+(?P<untitled>{'|'.join(f'{p} (?:(?:{p}|{i}) )?{p}' for p, i in zip(_PARTS, _INITIALS))})|(?<!\w)(?P<listed>(?:{_GIVEN}) (?:{'|'.join(f'(?:(?:{p}|{i}) )?{p}' for p, i in zip(_PARTS, _INITIALS))})))(?!\w)",
}
_FOUND = {k: re.compile(v) for k, v in KINDS.items()}
_TAKEN = "\uffff"  # stands over what is found already; no pattern matches it
_HINT = re.compile(rf"[0-9]{{2}}|@|[=:]|\b(?:{_TITLE})\b|\b{_CUES}|\b(?:{_GIVEN})\b")
_WORD = re.compile(rf"(?<!\w)(?:(?:{'|'.join(_PARTS)})(?!\w)|{'|'.join(_INITIALS)})")


_BLOCK = 256  # characters that are permuted at once; longer values are cut into blocks


def _round(key: bytes, tweak: str, k: int, x: int, size: int) -> int:
    """A keyed number for x, wider by 128 bits than range(size), so that its remainders reach all of it alike."""
    said = f"{tweak}|{k}|{x:x}|{size:x}".encode()
    return int.from_bytes(shake_256(len(key).to_bytes(2, "big") + key + said).digest(16 + (size.bit_length() + 7) // 8), "big")


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): six Feistel rounds over a grid just larger, walked until inside."""
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for k in reversed(range(6)) if back else range(6):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * _round(key, tweak, k, left, b)) % b
            else:
                left = (left + sign * _round(key, tweak, k, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def moved(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) without a fixed point, for any size over 1."""
    if size < 2:
        return x
    step = 1 + _round(key, tweak, 99, 0, size) % (size - 1)
    return permute((permute(x, size, key, tweak) + step) % size, size, key, tweak, back=True)


def _class(c: str, hexadecimal: bool, sounds: bool) -> str:
    low = c.lower()
    if hexadecimal and low in HEX:
        return HEX
    for name, letters in ALPHABETS.items():
        if low in letters:
            return next((s for s in SOUNDS.get(name, ()) if low in s), letters) if sounds else letters
    return CLASS_OF.get(low, "") if len(low) == 1 else ""


def shaped(s: str, key: bytes, tweak: str, hexadecimal: bool = False, sounds: bool = False) -> str:
    """s with each character replaced by one of its class, case kept; distinct texts of one shape stay distinct.

    A long text is cut into blocks of like length. Each is permuted under the shape of the whole and under what stood before it, so the
    blocks can be told one after the other, and no two texts share an image.
    """
    kinds = [_class(c, hexadecimal, sounds) for c in s]
    shape = blake2b(".".join(k[:2] or c.lower() for c, k in zip(s, kinds)).encode(), key=key, digest_size=16).hexdigest()
    step = ceil(len(s) / ceil(len(s) / _BLOCK)) if s else 1
    before, out = blake2b(key=key, digest_size=16), []
    for at in range(0, len(s), step):
        out.append(_block(s[at : at + step], kinds[at : at + step], key, f"{tweak}|{shape}|{before.hexdigest() if at else ''}"))
        before.update(s[at : at + step].encode())
    return "".join(out)


def _block(s: str, kinds: list[str], key: bytes, tweak: str) -> str:
    size = prod(len(k) for k in kinds if k)
    x = 0
    for c, k in zip(s, kinds):
        if k:
            x = x * len(k) + k.index(c.lower())
    y = moved(x, size, key, tweak)
    out = []
    for c, k in zip(reversed(s), reversed(kinds)):
        if not k:
            out.append(c)
            continue
        y, i = divmod(y, len(k))
        out.append(k[i].upper() if c.isupper() else k[i])
    return "".join(reversed(out))


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def _into(pattern: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def _name(full: str, key: bytes) -> str:
    """The surrogates of a name's parts: a part has the same one wherever it stands, so that mentions of a person stay together."""
    out = []
    for part in full.split(" "):
        script = next((k for k, p in (("cyrillic", _CYRILLIC), ("greek", _GREEK)) if re.match(p[: p.index("]") + 1], part)), "latin")
        pools = {g: GIVEN[script, g] for g in ("female", "male")}
        if own := [g for g, names in pools.items() if part in names]:
            names = pools[own[0]]
            part = names[moved(names.index(part), len(names), key, f"given|{script}|{own[0]}")]
        else:
            while True:  # stays outside the lists, so that no two parts meet
                part = shaped(part, key, "family", sounds=True)
                if not any(part in names for names in pools.values()):
                    break
        out.append(part)
    return " ".join(out)


@lru_cache(10_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """What stands for a value; equal values in another case or format get the same letters and digits."""
    digits = "".join(c for c in value if c in ALPHABETS["digit"])
    if kind == "email":
        name, _, host = value.rpartition("@")
        labels = host.split(".")
        return f"{shaped(name, key, kind)}@{'.'.join([*(shaped(x, key, 'host') for x in labels[:-1]), labels[-1]])}"
    if kind in ("secret", "hex"):
        return shaped(value, key, "secret", hexadecimal=all(c.lower() in HEX for c in value))
    if kind == "ip":
        x = 0
        for part in value.split("."):
            x = 256 * x + int(part)
        x = moved(x, 1 << 32, key, kind)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone":
        keep = len(digits) - min(10, len(digits) - (1 if value[0] == "+" else 0))
        return _into(value, digits[:keep] + shaped(digits[keep:], key, kind))
    if kind == "card":
        if _luhn(digits):
            body = shaped(digits[:-1], key, "card")
            return _into(value, body + next(c for c in ALPHABETS["digit"] if _luhn(body + c)))
        while _luhn(digits := shaped(digits, key, "other card")):
            pass
        return _into(value, digits)
    if kind == "iban":
        account = shaped(value[4:], key, f"iban|{value[:2]}")
        return value[:2] + _iban_check(value[:2], account) + account
    return _name(value, key) if kind == "name" else shaped(value, key, kind)


def _is_secret(before: str, value: str) -> bool:
    """A value without digits is one after a password's key, and after any key with an equals sign or a quote."""
    return bool(re.search("[0-9]", value) or "=" in before or before[-1] in "\"'" or before.lower().startswith("passw"))


def _mentions(rest: str, parts: set[str], gender: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """Runs of the parts of names that are found in a text already, wherever they stand; an initial counts beside another part only."""
    runs: list[list[re.Match]] = []
    for m in _WORD.finditer(rest):
        if m.group() in parts:
            if runs and rest[runs[-1][-1].end() : m.start()] == " ":
                runs[-1].append(m)
            else:
                runs.append([m])
    return [(r[0].start(), r[-1].end(), "name", gender.get(r[-1].group(), "")) for r in runs if any(not m.group().endswith(".") for m in r)]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of each entity of a text, in order. Kinds are sought in the order of KINDS, each in what is left;
    last, every other mention of the parts of a name that a title has shown."""
    if not _HINT.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    rest = text
    for kind, pattern in _FOUND.items():
        own = []
        for m in pattern.finditer(rest):
            a, b = m.span(m.lastgroup or 0)
            value = rest[a:b]
            if kind == "iban" and _iban_check(value[:2], value[4:]) != value[2:4] or kind == "secret" and not _is_secret(m.group()[: a - m.start()], value) or kind == "card" and value.isdigit() and len(value) != 16 and not _luhn(value):
                continue
            gender = next((g for g, hs in HONORIFICS.items() if m.group().split(" ")[0].rstrip(".") in hs), "") if kind == "name" else ""
            own.append((a, b, "name" if kind == "untitled" else kind, gender))
        if own:
            left, at = [], 0
            for a, b, *_ in own:
                left += [rest[at:a], _TAKEN * (b - a)]
                at = b
            rest = "".join([*left, rest[at:]])
        found += own
    if names := [(text[a:b].split(" "), gender) for a, b, kind, gender in found if kind == "name"]:
        found += _mentions(rest, {p for ps, _ in names for p in ps}, {ps[-1]: gender for ps, gender in reversed(names)})
    return sorted(found)


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    out, at, entities = [], 0, []
    for a, b, kind, _ in find(text):
        value = text[a:b]
        new = surrogate(kind, value, key)
        entities.append({"kind": kind, "start": a, "length": b - a, "surrogate": new, "original": blake2b(f"{kind}|{value}".encode(), key=key, digest_size=12).hexdigest()})
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), entities


_ENTITY = "struct<kind:string,start:int,length:int,surrogate:string,original:string>"


def pseudonymise(text: Column, key: str) -> Column:
    """A struct of the text with surrogates and the entities found (kind, start, length, surrogate, keyed digest of the original).

    A null text stays null and has no entities; a text without entities stays as it is.
    """
    secret = blake2b(key.encode(), digest_size=32).digest()

    @F.arrow_udf(f"struct<text:string,entities:array<{_ENTITY}>>")
    def done(texts: pa.Array) -> pa.Array:
        got = [(None, []) if t is None else replace(t, secret) for t in texts.to_pylist()]
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string()), ("original", pa.string())])
        return pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.list_(item))], ["text", "entities"])

    return done.asNondeterministic()(text)


def pii(docs: DataFrame, key: str = "corpus key", check: bool = False) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities of every document, one row for each row.

    Texts are taken whole. A null text stays null and an empty one empty, both without entities; a null id stays null; repeated rows get
    the same surrogates. Extra columns, whatever their names, are not read; an empty table gives none back. With `check` the rows are
    written to the shared folder first, and it is an error if collisions() finds any among them.
    """
    p = bounded_batches(docs).select("doc_id", pseudonymise(F.col("text"), key).alias("p"))
    p = p.select("doc_id", "p.text", F.size("p.entities").alias("n_entities"), "p.entities")
    if not check:
        return p
    p = materialise(p, "surrogates")
    if faults := collisions(p).limit(10).collect():
        raise RuntimeError(f"surrogates collide: {faults}")
    return p


def replace_in(docs: DataFrame, key: str = "corpus key") -> DataFrame:
    """The documents with surrogates in their text and all other columns as they are; n_chars, if present, counts the new text.

    Null and empty texts and null ids stay; repeated rows stay, and stay alike; an empty table gives none back.
    """
    out = bounded_batches(docs).withColumn("text", pseudonymise(F.col("text"), key).getField("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for two originals, and originals with two surrogates, in what pii() returned; none are expected.

    Formats of one value (case, punctuation) count as originals of their own, and so do their surrogates.
    """
    e = found.select(F.explode("entities").alias("e")).select("e.kind", "e.surrogate", "e.original").distinct()
    shared = e.groupBy("kind", F.col("surrogate").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("fault", F.lit("shared"))
    split = e.groupBy("kind", F.col("original").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("fault", F.lit("split"))
    return shared.unionByName(split)
