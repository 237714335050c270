"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` schemes and
identifier cues (``token``, ``password``, ``iban`` ...). Deterministic local parsers then expand
each anchor to the left and right, and validate what they found. A text without anchors costs the
pass and nothing else; a parser never looks at a character more than a few times, so the work is
linear in the text.

Kinds, in the order in which spans are listed: ``email``, ``ip``, ``card``, ``phone`` (the base
kinds: leftmost, non-overlapping per kind, a match that fails its check is dropped without another
try), then ``url`` (scheme, ``://``, then characters other than blanks, quotes and brackets),
``secret`` (a cue, ``=`` or ``:``, then 8 or more token characters, quoted or not), ``account`` (an IBAN of its country's length
whose remainder modulo 97 is 1, with or without a cue; or a cue, words such as ``number`` or ``no``, then 8 to 34
capitals and digits with a digit, in one run or in groups with single blanks or hyphens between), and what a failed base match hides: ``card_part`` (whole
groups of a longer digit chain that make a card) and ``phone_part`` (the first whole groups of a
longer run that make a phone number). Offsets are code points, end exclusive.

Defined cases: null and empty texts have no spans; very long texts are read whole; repeated rows
give repeated results; only ``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "secret", "account", "card_part", "phone_part")

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL = frozenset(_ALNUM + "._%+-")
_LABEL = frozenset(_ALNUM + "-")
_DIGITS = frozenset("0123456789")
_PHONE = frozenset("0123456789 ().-")
_SCHEME = frozenset(_ALNUM + "+.-")
_URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>[]{}|\\^`")
_TOKEN = frozenset(_ALNUM + "+/=_.-")
_ACCOUNT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")
_ACCOUNT_CUES = ("iban", "account", "acct")
_ACCOUNT_WORDS = frozenset(("number", "numbers", "num", "no", "nos", "nr", "is", "code", "id"))
#: Lengths of IBANs by country (fixed values of the registry).
_IBAN = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    found.add_word("://", ("url", 3))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for kind, cues in (("secret", _SECRET_CUES), ("account", _ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_ANCHORS = None


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _email(text: str, at: int, after: int):
    """Span round an at-sign: the local part back to ``after`` at most, two or more domain labels."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels, i = len(text), 0, 0, at + 1
    while True:
        begin = i
        while i < n and text[i] in _LABEL:
            i += 1
        if i == begin:
            break
        labels, end = labels + 1, i
        if i == n or text[i] != ".":
            break
        i += 1
    return (start, end) if labels > 1 else None


def _dotted(text: str, start: int):
    """A chain ``digits(.digits)*`` from its first digit: the parts' spans and where the chain ends."""
    n, parts, i = len(text), [], start
    while True:
        begin = i
        while i < n and text[i] in _DIGITS:
            i += 1
        parts.append((begin, i))
        if i + 1 < n and text[i] == "." and text[i + 1] in _DIGITS:
            i += 1
        else:
            return parts, i


def _ips(text: str, parts: list[tuple[int, int]]):
    """Each four parts of a chain are a match; it counts if no part is above 255."""
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        if all(e - s < 4 or not text[s:e].lstrip("0")[3:] for s, e in four) and all(
                int(text[s:e].lstrip("0")[:4] or "0") <= 255 for s, e in four):
            yield four[0][0], four[3][1]


def _card(text: str, start: int):
    """The chain of digits with single blanks or hyphens between; its digits and its end."""
    n, i, digits = len(text), start, []
    while True:
        digits.append(text[i])
        i += 1
        if i < n and text[i] in _DIGITS:
            continue
        if i + 1 < n and text[i] in " -" and text[i + 1] in _DIGITS:
            i += 1
            continue
        return digits, i


def _card_parts(text: str, start: int, end: int):
    """Cards among the groups of a chain: from each group on, the first 16 to 19 digits that pass, without overlaps."""
    groups, i = [], start
    while i < end:
        j = i
        while j < end and text[j] in _DIGITS:
            j += 1
        groups.append((i, j))
        i = j + 1
    k = 0
    while k < len(groups):
        digits, last, found = "", k, None
        while last < len(groups) and len(digits) < 20:
            digits += text[groups[last][0]:groups[last][1]]
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found = last
                break
            last += 1
        if found is None:
            k += 1
        else:
            yield groups[k][0], groups[found][1]
            k = found + 1


def _phone_part(text: str, plus: int, end: int):
    """The longest start of a run that ends before a blank and has 8 to 15 digits."""
    count, best = 0, None
    for i in range(plus + 1, end):
        count += text[i] in _DIGITS
        if count > 15:
            break
        if 8 <= count and text[i] in _DIGITS and (i + 1 == end or text[i + 1] == " "):
            best = i + 1
    return best


def _phone(text: str, plus: int):
    """From a plus sign to the last digit of the run that follows, if 8 to 15 digits come out."""
    n, i = len(text), plus + 2
    if i >= n or text[plus + 1] not in _DIGITS:
        return None
    while i < n and text[i] in _PHONE:
        i += 1
    while i > plus + 3 and text[i - 1] not in _DIGITS:
        i -= 1
    if i <= plus + 3:
        return None
    count = sum(c in _DIGITS for c in text[plus:i])
    return (plus, i, 8 <= count <= 15)


def _url(text: str, mark: int, after: int):
    start = mark
    while start > after and text[start - 1] in _SCHEME:
        start -= 1
    while start < mark and not text[start].isalpha():
        start += 1
    end = mark + 3
    while end < len(text) and text[end] not in _URL_STOP:
        end += 1
    while end > mark + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end) if start < mark and end > mark + 3 else None


def _secret(text: str, cue_end: int):
    n, i = len(text), cue_end
    while i < n and text[i] in " \"'":
        i += 1
    if i == n or text[i] not in "=:":
        return None
    i += 1
    while i < n and text[i] in " \"'":
        i += 1
    start = i
    while i < n and text[i] in _TOKEN:
        i += 1
    return (start, i) if i - start >= 8 else None


def _iban(text: str, start: int):
    """An IBAN from its country code on: single blanks or hyphens may part it, length and check digits must hold."""
    want, n, i, found = _IBAN.get(text[start:start + 2]), len(text), start, []
    if want is None or start and text[start - 1].isalnum():
        return None
    while i < n and len(found) < want:
        if text[i] in _ACCOUNT:
            found.append(text[i])
        elif text[i] not in " -" or text[i - 1] not in _ACCOUNT:
            return None
        i += 1
    if len(found) < want or i < n and text[i].isalnum() or not (found[2] in _DIGITS and found[3] in _DIGITS):
        return None
    return (start, i) if int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1 else None


def _account(text: str, cue_end: int):
    n, i, words = len(text), cue_end, 0
    while True:
        gap = i
        while i < n and text[i] in " :#.=-" and i < gap + 8:
            i += 1
        if (span := _iban(text, i)) is not None:   # NO is a country, too
            return span
        end = i
        while end < n and end < i + 8 and text[end].isalpha():
            end += 1
        if words == 3 or i == gap or text[i:end].lower() not in _ACCOUNT_WORDS:
            break
        i, words = end, words + 1
    start, count, end, group = i, 0, i, 0
    while True:
        begin = i
        while i < n and text[i] in _ACCOUNT:
            i += 1
        group = i - begin
        # a further group holds a digit, is whole and does not make the number too long; else the number ended before it
        if begin > start and (count + group > 34 or not any(c in _DIGITS for c in text[begin:i]) or i < n and text[i].isalnum()):
            break
        count, end = count + group, i
        if i + 1 < n and text[i + 1] in _ACCOUNT and (text[i] == "-" or text[i] == " " and group <= 6):
            i += 1
            continue
        break
    good = 8 <= count <= 34 and any(c in _DIGITS for c in text[start:end])
    return (start, end) if good and (end == n or text[end] not in _LABEL) else None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind's in order and without overlaps."""
    global _ANCHORS
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    out: dict[str, list[tuple[int, int]]] = {}
    email_end = chain_end = card_end = phone_end = url_end = secret_end = account_end = 0
    for last, (kind, width) in _ANCHORS.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= chain_end:
                parts, chain_end = _dotted(text, at)
                if len(parts) > 3:
                    out.setdefault("ip", []).extend(_ips(text, parts))
            if at >= card_end:
                digits, card_end = _card(text, at)
                if 16 <= len(digits) <= 19 and _luhn("".join(digits)):
                    out.setdefault("card", []).append((at, card_end))
                elif len(digits) > 16 and (parts := list(_card_parts(text, at, card_end))):
                    out.setdefault("card_part", []).extend(parts)
            # the first of an IBAN's two check digits
            if at >= account_end + 2 and text[at - 2:at] in _IBAN and (span := _iban(text, at - 2)) is not None:
                out.setdefault("account", []).append(span)
                account_end = span[1]
        elif kind == "@":
            if (span := _email(text, at, email_end)) is not None:
                out.setdefault("email", []).append(span)
                email_end = span[1]
        elif kind == "+":
            if at >= phone_end and (span := _phone(text, at)) is not None:
                phone_end = span[1]
                if span[2]:
                    out.setdefault("phone", []).append(span[:2])
                elif (end := _phone_part(text, at, span[1])) is not None:
                    out.setdefault("phone_part", []).append((at, end))
        elif kind == "url":
            if at >= url_end and (span := _url(text, at, url_end)) is not None:
                out.setdefault("url", []).append(span)
                url_end = span[1]
        elif kind == "secret":
            if at >= secret_end and (span := _secret(text, last + 1)) is not None:
                out.setdefault("secret", []).append(span)
                secret_end = span[1]
        elif at >= account_end and (span := _account(text, last + 1)) is not None:
            out.setdefault("account", []).append(span)
            account_end = span[1]
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans.get(k, ()))


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans are replaced once, as the first."""
    flat = sorted((s, -e, k) for k, found in spans.items() for s, e in found)
    parts, at = [], 0
    for s, e, k in flat:
        if s >= at:
            parts += [text[at:s], f"[{k.upper()}]"]
            at = -e
        elif -e > at:
            at = -e
    return "".join([*parts, text[at:]])


_SPANS_SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                 "n_other long")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in small_batches(batches, "text"):
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            spans = find_spans(text)
            for col, kind in zip(cols, BASE_KINDS):
                col.append(len(spans.get(kind, ())))
            base = listed(spans, BASE_KINDS) if spans else ""
            cols[4].append(hashlib.sha256(base.encode()).hexdigest() if base else empty)
            cols[5].append(listed(spans, KINDS) if spans else "")
            cols[6].append(sum(len(v) for k, v in spans.items() if k not in BASE_KINDS))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of the base spans and all spans."""
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return thin.mapInArrow(_scan, _SPANS_SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced by its kind; other columns are kept.

    ``n_chars`` is set to the new length. Null texts stay null.
    """
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else (redact(t, spans) if (spans := find_spans(t)) else t))

    text = clean(docs["text"].cast("string"))
    cols = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    out = docs.select(*cols)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
