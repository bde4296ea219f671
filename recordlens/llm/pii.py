"""Personal data in plain and disguised form, with offsets into the original text.

Base spans come from plain patterns. For disguises, transducers rewrite the text (look-alike characters, spelled
digits, spelled or bracketed "at" and "dot") while keeping, for every written character, the source characters it
stands for. The same patterns run over the rewritten text, and what they find is mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import freed, text_slices

# Kinds in the order they are reported.
KINDS = ("email", "ip", "card", "phone")
SPAN_SCHEMA = "array<struct<kind:string,start:long,end:long,value:string,base:boolean>>"

# ---------------------------------------------------------------------------------------------
# Base patterns. Each finds what the leftmost greedy search for the plain pattern finds, in linear time.

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the plain identifiers, by kind and start; matches that fail their check are dropped."""
    out = [(0, a, b) for a, b in find_emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------------------------------------
# Transducers.

# Characters that look like ASCII ones but don't decompose to them.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ı": "i", "ɡ": "g", "。": ".", "․": ".", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
UNSEEN = "­​‌‍⁠﻿"
# Digits spelled in English, German, French and Spanish.
SPELLED = {
    0: "zero null zéro cero", 1: "one eins un uno", 2: "two zwei deux dos", 3: "three drei trois tres",
    4: "four vier quatre cuatro", 5: "five fünf cinq cinco", 6: "six sechs seis", 7: "seven sieben sept siete",
    8: "eight acht huit ocho", 9: "nine neun neuf nueve",
}
# Words for the signs.
AT_WORDS = "at arobase arroba"
DOT_WORDS = "dot punkt point punto"
# Words that name no host in running text.
NO_HOST = "the a an this that le la les un une der die das ein el los"

# Words that name no mailbox before a spelled "at" and an address written as usual, as in "find us at example.com".
NO_MAILBOX = (
    "us me him her them it you we they i he she be is are was were been look looking looked available hosted found find visit visiting online here "
    "there site website page live based located read more see seen listed published posted online out up down back home now today not and or but "
    "directly information details contact email mail reach held stay start starts started work works working worked arrived arrive"
)

_VALUE = {w: str(d) for d, ws in SPELLED.items() for w in ws.split()}
_ANY_DIGIT = "|".join(sorted(_VALUE, key=len, reverse=True))
_AT, _DOT = AT_WORDS.replace(" ", "|"), DOT_WORDS.replace(" ", "|")
_NO_HOST = NO_HOST.replace(" ", "|")
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_DOT_FORM = rf"(?:\s{{0,3}}{_OPEN}(?:{_DOT}|\.){_CLOSE}\s{{0,3}}|\s{{1,3}}(?:{_DOT})\s{{1,3}})"
# Runs of at least four digits, spelled ones or a mix, with a "plus" before them.
_RUN = (
    rf"(?:\bplus[\s-]{{1,3}})?(?<![^\W_])(?:{_ANY_DIGIT}|[0-9])(?:[\s,-]{{1,3}}(?:{_ANY_DIGIT}|[0-9])(?![^\W_])){{3,}}"
)
# Four parts of one to three digits, spelled or not, with dots written out between them.
_PART = rf"(?:[0-9]{{1,3}}(?![^\W_])|(?:{_ANY_DIGIT}|[0-9])(?:[\s,-]{{1,3}}(?:{_ANY_DIGIT}|[0-9])(?![^\W_])){{0,2}}(?![^\W_]))"
_QUAD = rf"(?<![^\W_]){_PART}(?:{_DOT_FORM}{_PART}){{3}}"
# A host as usual, perhaps with its last dots written out, at the end of a spelled "at".
_HOST = rf"(?!(?:{_NO_HOST})\b)[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,4}}(?:\.[a-z]{{2,24}}(?![\w-])|\.[a-z0-9-]{{1,63}}{_DOT_FORM}[a-z0-9-])"
_NO_MAILBOX = frozenset(NO_MAILBOX.split())
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_REWRITE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}(?:{_AT}|@){_CLOSE}\s{{0,3}}"
    rf"|\s{{1,3}}(?:{_AT})\s{{1,3}}(?=(?!(?:{_NO_HOST})\b)[a-z0-9-]{{1,63}}{_DOT_FORM}[a-z0-9-]))"
    rf"|(?P<near>\s{{1,3}}(?:{_AT})\s{{1,3}}(?={_HOST}))|(?P<quad>{_QUAD})"
    rf"|(?P<dot>{_DOT_FORM})|(?P<run>{_RUN})",
    re.IGNORECASE,
)
_QUAD_PIECE = re.compile(rf"(?P<dot>{_DOT_FORM})|{_ANY_DIGIT}|[0-9]", re.IGNORECASE)
_PIECE = re.compile(rf"plus|{_ANY_DIGIT}|[0-9]", re.IGNORECASE)

# What makes a text worth rewriting, for the vectorised test. It holds of every text in which a transducer changes
# anything: a character that folds (any beyond Latin-1 counts, and the Latin-1 ones that do), a sign in brackets, a spelled
# dot, a spelled "at" before a host, four digits of which one is spelled, or four digits after "plus". RE2's \s is not Python's.
_S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"
_E = rf"(?:{_ANY_DIGIT}|[0-9])"
_GAP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0},-]{1,3}"
_FOUR = "|".join(_GAP.join(rf"(?:{_ANY_DIGIT})" if i == k else _E for i in range(4)) for k in range(4))
WORTH = (
    rf"(?i)[^\x00-\x{{ff}}\n]|[\x{{a0}}\x{{aa}}\x{{ad}}\x{{b2}}\x{{b3}}\x{{b9}}\x{{ba}}]"
    rf"|[\[({{<]{_S}{{0,3}}(?:{_AT}|@|{_DOT}|\.){_S}{{0,3}}[\])}}>]|{_S}(?:{_DOT}){_S}|{_S}(?:{_AT}){_S}{{1,3}}[a-z0-9-]{{1,63}}\.[a-z0-9-]"
    rf"|{_FOUR}|plus[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}-]{{1,3}}{_GAP.join([_E] * 4)}"
)


@lru_cache(maxsize=8192)
def plain_character(c: str) -> str:
    """The ASCII character that ``c`` stands for, nothing if it has no width, else itself."""
    if c in UNSEEN:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None and unicodedata.category(c) == "Nd":
        return str(digit)
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat.isascii() else c


class Rewritten:
    """A text with, for every character, the stretch of source characters behind it, and whether it was rewritten."""

    def __init__(self, text: str, starts: list[int], ends: list[int], changed: list[bool]):
        self.text, self.starts, self.ends, self.changed = text, starts, ends, changed


def fold_characters(text: str) -> Rewritten:
    """Look-alikes to ASCII, characters without width removed."""
    out, starts, ends, changed = [], [], [], []
    for i, c in enumerate(text):
        p = c if c < "\x80" else plain_character(c)
        if p:
            out.append(p)
            starts.append(i)
            ends.append(i + 1)
            changed.append(p != c or (bool(ends[:-1]) and ends[-2] != i))
    return Rewritten("".join(out), starts, ends, changed)


def _is_mailbox(text: str, a: int, b: int) -> bool:
    """Whether a spelled "at" between ``a`` and ``b`` parts a mailbox from a host and is no word of a sentence."""
    name = _BEFORE_AT.search(text, max(0, a - 64), a).group().lower()
    # "at noon.The next" is the end of a sentence.
    host = re.match(r"[A-Za-z0-9.-]+", text[b : b + 330]).group().rstrip(".-")
    last = host.rsplit(".", 1)[-1]
    return bool(name.strip("._%+-")) and name not in _NO_MAILBOX and (last.islower() or last.isupper() or not last.isalpha())


def spell_out(r: Rewritten) -> Rewritten:
    """Spelled digits to digits, and disguised signs to signs."""
    out, starts, ends, changed = [], [], [], []

    def copy(a: int, b: int) -> None:
        out.append(r.text[a:b])
        starts.extend(r.starts[a:b])
        ends.extend(r.ends[a:b])
        changed.extend(r.changed[a:b])

    def write(c: str, a: int, b: int, new: bool = True) -> None:
        out.append(c)
        starts.append(r.starts[a])
        ends.append(r.ends[b - 1])
        changed.append(new)

    done = 0
    for m in _REWRITE.finditer(r.text):
        a, b = m.span()
        copy(done, a)
        done = b
        if m.lastgroup == "run":
            pieces = list(_PIECE.finditer(r.text, a, b))
            if all(len(p.group()) == 1 for p in pieces):
                copy(a, b)  # plain digits: nothing is spelled
                continue
            for p in pieces:
                word = p.group().lower()
                write("+" if word == "plus" else _VALUE.get(word, word), *p.span(), len(word) > 1)
        elif m.lastgroup == "quad":
            for p in _QUAD_PIECE.finditer(r.text, a, b):
                word = p.group().lower()
                write("." if p["dot"] else _VALUE.get(word, word), *p.span(), len(word) > 1)
        elif m.lastgroup == "near" and not _is_mailbox(r.text, a, b):
            copy(a, b)
        else:
            write("." if m.lastgroup == "dot" else "@", a, b)
    copy(done, len(r.text))
    return Rewritten("".join(out), starts, ends, changed)


def find_disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of identifiers that only the rewritten text shows, none of them inside a base span of its kind."""
    r = spell_out(fold_characters(text))
    out = []
    for kind, a, b in find_base(r.text):
        if not any(r.changed[a:b]):
            continue
        start, end = r.starts[a], r.ends[b - 1]
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            out.append((kind, start, end))
    return out


# ---------------------------------------------------------------------------------------------


def _spans(texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, bool]]]]:
    """(row, [(kind, start, end, base)]) of the rows that have any."""
    texts = pc.fill_null(texts, "")
    plain = pc.match_substring_regex(texts, "[0-9@]")
    worth = pc.match_substring_regex(texts, WORTH)
    for i in pc.indices_nonzero(pc.or_(plain, worth)).to_pylist():
        text = texts[i].as_py()
        base = find_base(text) if plain[i].as_py() else []
        more = find_disguised(text, base) if worth[i].as_py() else []
        if base or more:
            yield i, sorted([(*s, True) for s in base] + [(*s, False) for s in more])


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``documents`` (doc_id, text).

    ``spans`` are structs (kind, start, end, value, base) in the order of kind and start, in code points, end
    exclusive; ``base`` marks those of the plain patterns. Base spans of one kind don't overlap; a disguised one may hold
    a base one of its kind (the part of a disguise that a plain pattern sees), but never lies inside one. A null or empty text has none. Rows that repeat a doc_id, or have none, each keep
    their row; other columns are left out. Whole texts are searched.
    """
    kind_type = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                texts = part.column("text")
                for i, spans in _spans(texts):
                    text = texts[i].as_py()
                    found[i] = [
                        {"kind": KINDS[k], "start": a, "end": b, "value": text[a:b], "base": base}
                        for k, a, b, base in spans
                    ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind_type)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, spans {SPAN_SCHEMA}"
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of :func:`find_pii` replaced by its kind in brackets, as in ``[EMAIL]``.

    Overlapping spans are replaced as one, named after the first. ``n_chars``, where there is such a column, counts
    the new text. All other columns and all rows stay; a null text stays null.
    """
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text")
                changed: dict[int, str] = {}
                for i, spans in _spans(texts):
                    text, out, done = texts[i].as_py(), [], 0
                    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            out += [text[done:a], f"[{KINDS[k].upper()}]"]
                        done = max(done, b)
                    changed[i] = "".join(out) + text[done:]
                if changed:
                    values = texts.to_pylist()
                    for i, t in changed.items():
                        values[i] = t
                    at = part.schema.get_field_index("text")
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
                    n = part.schema.get_field_index("n_chars")
                    if n >= 0:
                        sizes = part.column(n).to_pylist()
                        for i, t in changed.items():
                            sizes[i] = len(t)
                        part = part.set_column(n, part.schema.field(n), pa.array(sizes, part.schema.field(n).type))
                yield part

    return documents.mapInArrow(freed(run), schema)
