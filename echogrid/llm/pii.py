"""Personal data by anchor expansion.

One Aho-Corasick automaton walks a text and reports anchors: at-signs, plus
signs, digits, address schemes and words that announce an identifier.  From an
anchor a deterministic parser reads to the left and right, finds the boundaries
and validates what lies between.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as words

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = DIGITS | LETTERS | {"-"}
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
URL = LABEL | frozenset("._~:/?#[]@!$&'()*+,;=%")
HOST = URL - frozenset("/?#")
URL_TAIL = frozenset(".,;:!?'()[]&*")  # not counted in at the end of an address
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss", "smb", "ldap", "jdbc", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp")
CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "reisepass", "pasaporte", "passeport", "ssn")
CUE_JOINTS = ("number", "num", "nummer", "numéro", "numero", "número", "nr", "no", "n°", "id", "is", "#", ":", "=", ".", "-", " ")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", *DIGITS):
        found.add_word(mark, (mark if mark in "@+" else "0", 1))
    found.add_word("://", ("://", 3))
    for kind, cues in (("account", CUES), ("iban", ("iban",))):
        for cue in cues:
            for shape in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(shape, (kind, len(shape)))
    found.make_automaton()
    return found


def _run(body: str, at: int, held: frozenset) -> int:
    """End of the run of ``held`` characters that starts at ``at``."""
    n = len(body)
    while at < n and body[at] in held:
        at += 1
    return at


def email(body: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; it begins no earlier than ``floor``."""
    start = at
    while start > floor and body[start - 1] in LOCAL:
        start -= 1
    end = _run(body, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while body[end : end + 1] == "." and (after := _run(body, end + 1, LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def numbers_with_dots(body: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of four dotted numbers each, taken from the left of the chain at ``at``, that are all at most 255; and the chain's end."""
    parts = [(at, _run(body, at, DIGITS))]
    while body[parts[-1][1] : parts[-1][1] + 1] == "." and (after := _run(body, parts[-1][1] + 1, DIGITS)) > parts[-1][1] + 1:
        parts.append((parts[-1][1] + 1, after))
    small = [len(v := body[a:b].lstrip("0")) < 4 and int(v or 0) <= 255 for a, b in parts]
    found = [(parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4) if all(small[k : k + 4])]
    return found, parts[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def card(body: str, at: int) -> tuple[bool, int]:
    """Whether the digits from ``at``, single blanks or hyphens between them, are a card number; and their end."""
    end = _run(body, at, DIGITS)
    while body[end : end + 1] in (" ", "-") and (after := _run(body, end + 1, DIGITS)) > end + 1:
        end = after
    digits = body[at:end].replace(" ", "").replace("-", "") if end - at < 64 else ""
    return 14 <= len(digits) <= 19 and luhn(digits), end


def phone(body: str, at: int) -> tuple[bool, int] | None:
    """Whether the number behind the plus sign at ``at`` has 10 to 15 digits, and its end; None if there is none."""
    if body[at + 1 : at + 2] not in DIGITS:
        return None
    end = _run(body, at + 2, PHONE)
    while end > at + 3 and body[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return 10 <= sum(c in DIGITS for c in body[at:end]) <= 15, end


def url(body: str, at: int) -> tuple[int, int] | None:
    """The address around "://" at ``at``: a known scheme, a host with a dot, and what follows it."""
    start = at
    while start > 0 and at - start < 12 and body[start - 1] in LETTERS:
        start -= 1
    if body[start:at].lower() not in SCHEMES or (start and body[start - 1] in LABEL):
        return None
    # only the host is read before it is judged, so that a run of failing schemes is read once
    stop = _run(body, at + 3, HOST)
    tail = _run(body, stop, URL_TAIL)
    whole = body[tail : tail + 1] not in URL  # nothing but the host is left of the address
    if whole:
        stop = _untailed(body, at + 3, stop)
    labels = body[at + 3 : stop].rpartition("@")[2].partition(":")[0].split(".")
    if len(labels) < 2 or not all(x and not set(x) - LABEL for x in labels):
        return None
    return start, stop if whole else _untailed(body, at + 3, _run(body, stop, URL))


def _untailed(body: str, floor: int, end: int) -> int:
    while end > floor and body[end - 1] in URL_TAIL:
        end -= 1
    return end


def iban(body: str, at: int) -> tuple[int, int] | None:
    """The account number behind the cue that ends at ``at``: country, check digits, blanks between groups of four, remainder 1."""
    start = at
    while start < at + 16 and body[start : start + 1] in (" ", ":", "=", "#", "."):
        start += 1
    end, held, best = start, "", None
    while len(held) < 34 and end < len(body):
        c = body[end]
        if c in DIGITS or c in LETTERS:
            held += c.upper()
            end += 1
            if 15 <= len(held) and held[:2].isalpha() and held[2:4].isdigit() and (body[end : end + 1] not in LABEL or end == len(body)):
                turned = "".join(str(int(x, 36)) for x in held[4:] + held[:4])
                best = (start, end) if int(turned) % 97 == 1 else best
        elif c == " " and len(held) % 4 == 0 and held:
            end += 1
        else:
            break
    return best


def account(body: str, at: int, length: int) -> tuple[int, int] | None:
    """The number of 6 to 18 digits behind a cue word, over at most four joints such as "no", "#" or ":"."""
    if at > length and body[at - length - 1] in LABEL:
        return None
    for _ in range(6):
        low = body[at : at + 8].lower()
        joint = next((j for j in CUE_JOINTS if low.startswith(j)), None)
        if joint is None:
            break
        at += len(joint)
    end = _run(body, at, DIGITS | {"-"})
    while end > at and body[end - 1] == "-":
        end -= 1
    digits = sum(c in DIGITS for c in body[at:end])
    return (at, end) if 6 <= digits <= 18 and body[at : at + 1] in DIGITS and body[end : end + 1] not in LABEL - {"-"} | {"_"} else None


def find(anchors: ahocorasick.Automaton, body: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start, then kind; ends are exclusive, in code points.

    Base kinds do not overlap within a kind.  A span of another kind that
    overlaps a base span is left out, save an address around one.
    """
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    mail_end = ip_end = card_end = phone_end = url_end = 0
    for last, (kind, length) in anchors.iter(body):
        at = last + 1 - length
        if kind == "0":
            if at >= ip_end:
                spans, ip_end = numbers_with_dots(body, at)
                base += [(a, 1, b) for a, b in spans]
            if at >= card_end:
                good, card_end = card(body, at)
                if good:
                    base.append((at, 2, card_end))
        elif kind == "@":
            if span := email(body, at, mail_end):
                mail_end = span[1]
                base.append((span[0], 0, span[1]))
        elif kind == "+":
            if at >= phone_end and (number := phone(body, at)):
                phone_end = number[1]
                if number[0]:
                    base.append((at, 3, phone_end))
        elif kind == "://":
            if at >= url_end and (span := url(body, at)):
                url_end = span[1]
                more.append((span[0], 4, span[1]))
        elif span := iban(body, last + 1) if kind == "iban" else account(body, last + 1, length):
            more.append((span[0], 5 if kind == "iban" else 6, span[1]))
    # the farthest end of the base spans up to each, to tell in one look whether any overlaps
    base.sort()
    begun, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for start, kind, end in sorted(set(more)):
        before = bisect_left(begun, end)
        if kind == 4 or not before or reach[before - 1] <= start:
            base.append((start, kind, end))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(base)]


def spans(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row, then ``spans``, an array of (kind, start, end).

    Every whole text is read, once: a null or empty one has no spans, a long
    one takes time in proportion.  Rows that repeat have the same spans each; an
    empty table gives no rows.
    """
    rows, names, fields = words.carried(docs, text_col, carry)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for part in words.slices(batches, "body"):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(anchors, body)] if body else [] for body in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(names[c]) for c in carry), pa.array(found, kind)], [*names.values(), "spans"])

    found = rows.mapInArrow(run, ", ".join([*fields, "spans array<struct<kind:string,start:long,end:long>>"]))
    return words.uncarried(found, names, "spans")


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of ``kinds`` as text, "kind:start:end" joined by commas."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
