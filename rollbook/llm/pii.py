"""Format-preserving pseudonyms for personal data: validated values are permuted within their format by a keyed Feistel network.

A value always becomes the same other value of its kind, so equal values stay linked across documents, and no table of values is
kept or shuffled: each row is rewritten in its own task.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from rollbook.llm.kernels import text_chunks
from rollbook.llm.shared import texts

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOW, HIGH = "0123456789", "01", "23456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Kinds in the order in which they are tried at a place. Words and longer numbers around a value are no part of it.
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"),
    ("date", r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?![\w/-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d{5,14})(?![\w-])"),
)
_ALL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS), re.ASCII)
_EACH = {k: re.compile(p, re.ASCII) for k, p in PATTERNS}
_KINDS = tuple(_EACH)
_NUMBER = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}")
_GOES_ON = re.compile(r"[\w-]", re.ASCII)
#: Issuers with the lengths of their cards: a number like these is rather a card than the end of a phone number and more.
_USUAL_CARD = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12}|(?:35|6\d)\d{14,17}")
#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")


def feistel(left, right, left_size, right_size, key, tweak):
    """A permutation of pairs (left below left_size, right below right_size): each half in turn adds a keyed function of the other."""
    for r in range(ROUNDS):
        half, size = (right, left_size) if r % 2 == 0 else (left, right_size)
        seed = hmac.new(key, f"{tweak}:{r}:{half}:{left_size}:{right_size}".encode(), hashlib.sha256).digest()
        step = int.from_bytes(seed, "big") % size
        if r % 2 == 0:
            left = (left + step) % left_size
        else:
            right = (right + step) % right_size
    return left, right


def permute_number(value, size, key, tweak):
    """A permutation of the numbers below size: steps outside are walked on until one lies inside."""
    side = max(1, int(size ** 0.5))
    other = -(-size // side)
    while True:
        a, b = feistel(*divmod(value, other), side if side * other >= size else side + 1, other, key, tweak)
        value = a * other + b
        if value < size:
            return value


def permute_characters(characters, alphabets, key, tweak):
    """Characters, each within its alphabet; the two halves of the string are the halves of the network."""
    middle = len(characters) // 2
    if middle == 0:
        return alphabets[0][permute_number(alphabets[0].index(characters[0]), len(alphabets[0]), key, tweak)] if characters else ""

    def number(chars, alphas):
        value, size = 0, 1
        for c, a in zip(chars, alphas):
            value, size = value * len(a) + a.index(c), size * len(a)
        return value, size

    def back(value, alphas):
        out = []
        for a in reversed(alphas):
            value, k = divmod(value, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    left, left_size = number(characters[:middle], alphabets[:middle])
    right, right_size = number(characters[middle:], alphabets[middle:])
    left, right = feistel(left, right, left_size, right_size, key, tweak)
    return back(left, alphabets[:middle]) + back(right, alphabets[middle:])


def luhn_sum(digits):
    """Sum of the digits of a number without its check digit, every other one doubled from the right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return total


def refill(shape, characters, wanted=str.isdigit):
    """The shape with its wanted characters replaced one by one."""
    rest = iter(characters)
    return "".join(next(rest) if wanted(c) else c for c in shape)


def _digits(value):
    return [c for c in value if c in DIGITS]


def valid_card(digits):
    """Whether a number begins like an issuer's, has a card's length and passes its check digit."""
    return bool(13 <= len(digits) <= 19 and re.match(r"[3-6]|2[2-7]", digits) and (luhn_sum(digits[:-1]) + int(digits[-1])) % 10 == 0)


def valid_ssn(digits):
    """Whether a number of nine digits can be issued: neither area 000, 666 or 900 and above, nor group 00, nor serial 0000."""
    area, group, serial = "".join(digits[:3]), "".join(digits[3:5]), "".join(digits[5:])
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def card_end(text, start, usual=False):
    """Where the longest valid card that begins here ends, or None."""
    number = _NUMBER.match(text, start)
    end = number.end() if number else start
    digits = "".join(_digits(text[start:end]))
    while len(digits) >= 13:
        if not _GOES_ON.match(text, end) and valid_card(digits) and not (usual and not _USUAL_CARD.fullmatch(digits)):
            return end
        digits = digits[:-1]
        end -= 1 if text[end - 2] in DIGITS else 2
    return None


def pseudonym(kind, value, key):
    """Another valid value of the kind in the same format, or None where the value is not valid."""
    if kind == "email":
        local, domain = value.split("@")
        chars = [c for c in local if c.isalnum()]
        alphabets = [DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER for c in chars]
        return refill(local, permute_characters(chars, alphabets, key, kind), str.isalnum) + "@" + domain
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        a, b, c, d = map(int, parts)
        left, right = feistel(a << 8 | b, c << 8 | d, 1 << 16, 1 << 16, key, kind)
        return ".".join(map(str, (left >> 8, left & 255, right >> 8, right & 255)))
    if kind == "date":
        try:
            numbers = list(map(int, re.split(r"\D", value)))
            form = "%Y-%m-%d" if value[4] == "-" else f"%d{value[2]}%m{value[5]}%Y" if numbers[1] <= 12 else f"%m{value[2]}%d{value[5]}%Y"
            day = datetime.datetime.strptime(value, form).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        while True:  # a day written day first must be read day first again
            day = FIRST_DAY + permute_number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, kind)
            found = datetime.date.fromordinal(day)
            if not form.startswith("%m") or found.day > 12:
                return found.strftime(form)
    digits = _digits(value)
    if kind == "ssn":
        if not valid_ssn(digits):
            return None
        while True:  # numbers that are not issued are walked on
            digits = list(permute_characters(digits, [DIGITS] * 9, key, kind))
            if valid_ssn(digits):
                return refill(value, digits)
    if kind == "card":
        if not valid_card("".join(digits)):
            return None
        kept = 2 if digits[0] == "2" else 1
        body = "".join(digits[:kept]) + permute_characters(digits[kept:-1], [DIGITS] * (len(digits) - 1 - kept), key, kind)
        return refill(value, body + str(-luhn_sum(body) % 10))
    if not 8 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\d*", value[1:]).group()) if value[0] == "+" else 0
    if code > 3:  # no separator behind the country code
        code = _COUNTRY.match(value, 1).end() - 1
    kept, own = digits[:code], digits[code:]
    alphabets = [DIGITS] * len(own)
    if len(own) == 10:  # area and exchange of this length don't begin with 0 or 1 where they didn't before
        for k in (0, 3):
            alphabets[k] = LOW if own[k] in LOW else HIGH
    return refill(value, "".join(kept) + permute_characters(own, alphabets, key, kind))


def values(text, replaced):
    """(kind, start, end, new) of the values of a text, from left to right.

    Where the longest candidate at a place fails its check, shorter cards and the other kinds are tried there; then the search goes
    on one character further, as a value may begin inside the candidate. An address that does not exist is passed over whole.
    """
    at = 0
    while m := _ALL.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        new = replaced(kind, m.group())
        if kind == "ip" and new is None:
            at = end
            continue
        if kind == "card" and new is None and (shorter := card_end(text, start)):
            end, new = shorter, replaced(kind, text[start:shorter])
        for other in _KINDS[_KINDS.index(kind) + 1:] if new is None else ():
            if m := _EACH[other].match(text, start):
                kind, end = other, m.end()
                if (new := replaced(kind, m.group())) is not None:
                    break
        # A phone number must not take the first digits of a card.
        if kind == "phone" and new is not None and any((card_end(text, k, usual=True) or 0) > end for k in range(start + 1, end)):
            new = None
        if new is None:
            at = start + 1
        else:
            yield kind, start, end, new
            at = end


def rewrite(text, replaced):
    """The text with its values replaced, and the spans of the values (kind, start, end) in code points of the input."""
    parts, spans, at = [], [], 0
    for kind, start, end, new in values(text, replaced):
        parts += [text[at:start], new]
        spans.append({"kind": kind, "start": start, "end": end})
        at = end
    return ("".join([*parts, text[at:]]) if spans else text), spans


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def pseudonymise(docs, key, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id, text with pseudonyms, spans (kind, start, end) of the values in the input.

    Kinds are those of PATTERNS. Card numbers must begin like an issuer's and pass their check digit, and keep doing so; social
    security numbers must be ones that are issued; addresses and dates must exist, the part of an address before the @ has 64
    characters at most; what is not valid stays as it is, but valid values inside it are found. Phone numbers that begin with + need no separators.
    Of an e-mail address the part before the @ changes. Phone numbers keep their country code.
    A null text stays null, an empty one empty; repeated rows give repeated rows; an empty table gives no rows. Texts are read
    whole. Other columns are not read. key is a secret of any length: the same key gives the same pseudonyms.
    """
    if not key:
        raise ValueError("Give a key.")
    secret = key.encode() if isinstance(key, str) else bytes(key)

    def run(batches):
        replaced = lru_cache(maxsize=100_000)(lambda kind, value: pseudonym(kind, value, secret))
        for batch in batches:
            present = batch.column(1).is_valid()
            for i, j, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                telling = ((data >= 48) & (data <= 57)) | (data == 64)
                count = np.concatenate([[0], np.cumsum(telling)])[offsets]
                new, spans = [], []
                for r in range(j - i):
                    text, found = raw[offsets[r]:offsets[r + 1]].decode(), []
                    if count[r + 1] > count[r]:
                        text, found = rewrite(text, replaced)
                    new.append(text if present[i + r].as_py() else None)
                    spans.append(found)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(new, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    source = texts(docs, id_col, text_col, null_as_empty=False)
    return source.mapInArrow(run, T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)),
    ]))
