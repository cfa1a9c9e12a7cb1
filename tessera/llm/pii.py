"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, URL schemes and identifier cues in
one pass; from each anchor a deterministic local parser grows the span to its boundaries and
validates it. Base kinds are email, ip, card and phone; cues, schemes and colons add iban, ssn,
account, login (a URL with user and password), ipv6, street (a house's address) and secret (a token
or password after its name).
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks, columns_first

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "login", "ipv6", "street", "secret")
BASE = 4
HEXADECIMAL = frozenset("0123456789ABCDEFabcdef")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"[ :#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?: ?(?:no|number|nr)\b\.?)?[ :#=]{0,3}([0-9]{6,17})(?![0-9])", re.IGNORECASE)
LOGIN = re.compile(r"[^\s/?#:@]++:[^\s/?#@]++@[A-Za-z0-9.-]+")  # possessive: linear for any length
#: possessive: linear for any length
SECRET = re.compile(r"""(?: is\b)?["']?[ :=]{1,4}["']?([A-Za-z0-9+/_.~=-]{12,}+)""")
HEX6 = re.compile(r"[0-9A-Fa-f:]++")
NUMBER = re.compile(r"[0-9]{1,5}[A-Za-z]?,? ")
NAME = re.compile(r"[A-Z][A-Za-z.'-]*")
#: Words that name an identifier, in lower case, and the kind that follows them.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security number": "ssn", "account": "account", "acct": "account", "token": "secret", "secret": "secret",
    "password": "secret", "passwd": "secret", "api key": "secret", "api_key": "secret", "apikey": "secret", "access key": "secret", "access_key": "secret",
}
#: Words that end a street's name, in lower case.
STREETS = (" street", " avenue", " road", " lane", " drive", " boulevard", " square")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word(":", ("ipv6", 1))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    for street in STREETS:
        a.add_word(street, ("street", len(street)))
    for scheme in SCHEMES:
        a.add_word(scheme, ("login", len(scheme)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_ok(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def ipv6_ok(text: str) -> bool:
    """Eight groups of at most four hex digits, or fewer with one double colon for the rest; with a digit, so that a::b of words is none."""
    sides = text.split("::")
    groups = [[g for g in side.split(":")] if side else [] for side in sides]
    n = sum(map(len, groups))
    return any(c.isdigit() for c in text) and len(sides) <= 2 and all(1 <= len(g) <= 4 for side in groups for g in side) and (n == 8 if len(sides) == 1 else 2 <= n <= 7)


def street_start(text: str, at: int) -> int | None:
    """Where an address begins whose street's name ends at `at`: one to four capitalised words after a house number; None for none."""
    words = 0
    while words < 5 and at > 0:
        start = text.rfind(" ", max(0, at - 30), at) + 1
        if start == 0:
            start = max(0, at - 30) if at <= 30 else -1
        if start < 0:
            return None
        if words and (m := NUMBER.match(text, start)) and m.end() == at + 1:
            return start if start == 0 or not text[start - 1].isalnum() else None
        if not (m := NAME.match(text, start)) or m.end() != at:
            return None
        words += 1
        at = start - 1
    return None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end), sorted; offsets are code points. Null or empty: none.

    Anchors are found in any case, on a copy with ASCII letters lowered, which has the same offsets.
    """
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    email_from = ip_from = card_from = run_end = added_from = six_from = secret_from = 0
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (what, size) in automaton().iter(lowered):
        at = last - size + 1
        if what == "digit":
            if at < run_end:
                continue
            run_end = RUN.match(text, at).end()
            if at >= ip_from and run_end < len(text) and text[run_end] == "." and (m := IP.match(text, at)):
                ip_from = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                    found.append((at, 1, m.end()))
            if at >= card_from and (m := CARD.match(text, at)):
                card_from = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        elif what == "at":
            start = at
            while start > email_from and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_from = m.end()
                found.append((start, 0, m.end()))
        elif what == "plus":
            if (m := PHONE.match(text, at)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((at, 3, m.end()))
        elif what == "login":
            if last + 1 >= added_from and (m := LOGIN.match(text, last + 1)):
                added_from = m.end()
                found.append((at, 7, m.end()))
        elif what == "ipv6":
            if at < six_from:
                continue
            start = at
            while start > six_from and text[start - 1] in HEXADECIMAL:
                start -= 1
            six_from = HEX6.match(text, at).end()
            end = six_from - 1 if text[six_from - 1] == ":" and text[six_from - 2 : six_from] != "::" else six_from
            outside = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
            if end - start <= 39 and outside and ipv6_ok(text[start:end]):
                found.append((start, KINDS.index("ipv6"), end))
        elif what == "street":
            if (last + 1 == len(text) or not text[last + 1].isalpha()) and text[at + 1].isupper() and (start := street_start(text, at)) is not None:
                found.append((start, KINDS.index("street"), last + 1))
        elif what == "secret":
            if last + 1 >= secret_from and (m := SECRET.match(text, last + 1)):
                secret_from = m.end()
                value = m[1].rstrip(".")
                if len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                    found.append((m.start(1), KINDS.index("secret"), m.start(1) + len(value)))
        elif (at == 0 or not text[at - 1].isalnum()) and last + 1 >= added_from:
            m = (IBAN if what == "iban" else SSN if what == "ssn" else ACCOUNT).match(text, last + 1)
            if m and (what == "account" or (iban_ok if what == "iban" else ssn_ok)(m[1])):
                added_from = m.end(1)
                found.append((m.start(1), KINDS.index(what), m.end(1)))
    found.sort()
    return found


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span (overlapping ones merged, named for the first) replaced by [KIND]."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds) of every row; null text is empty.

    Repeated rows and null ids each give their own row; an empty table gives none; texts count whole at
    any length; columns other than doc_id and text are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in chunks(batches, "text", 1 << 20):
            found = [find(t) for t in b.column("text").to_pylist()]
            base = [[x for x in f if x[1] < BASE] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(BASE)]
            digest = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, pa.array([joined(f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind; all columns and rows stay, null and empty texts as they are."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in docs.schema])

    def run(batches):
        for b in chunks(batches, "text", 1 << 20):
            i = b.schema.get_field_index("text")
            texts = pa.array([redact(t, find(t)) for t in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if j == i else c for j, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return detect(columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
