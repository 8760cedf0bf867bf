"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the cue words of account
identifiers. A deterministic parser for each kind expands an anchor to the boundaries of a candidate and validates it.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Anchors of each parser.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://", "tel:")
CUES = ("iban", "ssn", "account", "acct", "passport", "social security", "routing", "tax id", "swift", "konto", "cuenta", "compte")
#: Fixed patterns, each matched at one place only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9._~:/?#@!$&'()*+,;=%\[\]-]+")
#: A value has LONGEST letters and digits at most; the repetitions end beyond that, so that a long run isn't read again and again.
LONGEST = 34
ACCOUNT = re.compile(r"[\x20#:.]*(?:(?:no|number|nr|id)[\x20#:.]*)?([A-Z]{0,2}[0-9][A-Z0-9]{0,35}(?:[\x20-][A-Z0-9]{2,35}){0,18})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits hold."""
    return len(text) >= 15 and text[:2].isalpha() and text[2:4].isdigit() and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in "0123456789":
        automaton.add_word(word, (word, "digit"))
    automaton.add_word("@", ("@", "at"))
    automaton.add_word("+", ("+", "plus"))
    for word in SCHEMES:
        automaton.add_word(word, (word, "scheme"))
    for word in CUES:
        for form in {word, word.title(), word.upper()}:
            automaton.add_word(form, (form, "cue"))
    automaton.make_automaton()
    return automaton


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in order."""
    found = []
    email_end = ip_end = card_end = phone_end = url_end = 0
    for last, (word, what) in automaton.iter(text):
        at = last - len(word) + 1
        if what == "digit":
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                digits = "".join(DIGITS.findall(m[0]))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, card_end))
            if at >= ip_end:
                if m := IP.match(text, at):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                        found.append((at, 1, ip_end))
                else:
                    ip_end = DIGITS.match(text, at).end()
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif what == "plus":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                    found.append((at, 3, phone_end))
        elif what == "scheme":
            if at >= url_end and (at == 0 or not text[at - 1].isalnum()) and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)'"))
                if end > last + 2:
                    url_end = end
                    found.append((at, 4, end))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
            value = re.sub("[^A-Z0-9]", "", m[1])
            if sum(c.isdigit() for c in value) >= 8 and len(value) <= LONGEST and (not value[:2].isalpha() or iban(value)):
                found.append((m.start(1), 5, m.end(1)))
    return sorted(set(found))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text, in code points with exclusive ends.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` are of these four kinds; ``spans`` also has the kinds
    ``url`` and ``account``; ``n_added`` counts those. A null or empty text has none; a null id stays null; repeated rows
    are all kept; an empty table gives no rows; other columns are ignored. Texts of any length are read whole.
    """

    def run(batches):
        automaton = anchors()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    spans = scan(text, automaton) if text else []
                    base = [s for s in spans if s[1] < 4]
                    counts = [sum(s[1] == k for s in base) for k in range(4)]
                    out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(run), schema)
