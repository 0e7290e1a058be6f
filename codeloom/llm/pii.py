"""Operator 3: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits and identifier cues. Deterministic local
parsers expand each anchor to the boundaries of an address or number and validate it. The four base kinds are those
of their defining patterns, leftmost and non-overlapping per kind; every parser moves forward only, so that a long
text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds: validated bank account numbers, identifiers after a cue, log-in parts of addresses.
ADDED = ("iban", "account", "login")
KINDS = BASE + ADDED

# Character classes and patterns of the base kinds (possessive where that can't change a match).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
AFTER_CUE = re.compile(r"(?:\x20?(?:no\.?|nr\.?|number|nummer|num\.?|id|#))?\x20?[:#=]?\x20?([A-Z]{0,3}[0-9][0-9-]{4,20}[0-9])(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/?#@:<>\"']++:[^\s/?#@<>\"']++@")
CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "social security")


@lru_cache(None)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "@")
    found.add_word("://", "s")
    for d in "0123456789":
        found.add_word(d, "d")
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, "c")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def small(part: str) -> bool:
    """At most 255, however many zeros come first."""
    bare = part.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def iban_holds(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed."""
    out = []
    email = ip = card = phone = iban = cue_end = 0  # where the next match of each kind may start
    for at, kind in anchors().iter(text):
        if kind == "d":
            if at >= ip:
                if m := IP.match(text, at):
                    ip = m.end()
                    if all(map(small, m.groups())):
                        out.append(("ip", at, ip))
                else:  # no later start within this run of digits can match either
                    ip = DIGITS.match(text, at).end()
            if at >= card and (m := CARD.match(text, at)):
                card = m.end()
                # Length first: a very long match needs no digit sum.
                if card - at <= 37 and 12 <= len(x := digits_of(m[0])) <= 19 and luhn(x):
                    out.append(("card", at, card))
            if at > phone and text[at - 1] == "+":
                if m := PHONE.match(text, at - 1):
                    phone = m.end()
                    if 9 <= len(digits_of(m[0])) <= 15:
                        out.append(("phone", at - 1, phone))
            if at >= max(iban, 2) and text[at - 1].isupper() and text[at - 2].isupper() and not (at > 2 and text[at - 3].isalnum()):
                if (m := IBAN.match(text, at - 2)) and iban_holds(m[0]):
                    iban = m.end()
                    out.append(("iban", at - 2, iban))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append(("email", start, email))
        elif kind == "s":
            if m := LOGIN.match(text, at + 1):
                out.append(("login", at + 1, m.end() - 1))
        elif at >= cue_end and (m := AFTER_CUE.match(text, at + 1)):
            cue_end = m.end(1)
            if len(digits_of(m[1])) >= 6:
                out.append(("account", m.start(1), cue_end))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its first kind in brackets."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, base_sha256, spans of every row.

    Null and empty texts have no spans (counts 0, the digest of the empty string); equal rows and null ids give a row
    each; an empty table gives none; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, every = [[] for _ in BASE], [], []
        for i in range(batch.num_rows):
            spans = spans_of(batch.column(1)[i].as_py() or "")
            own = [s for s in spans if s[0] in BASE]
            for k, c in zip(BASE, counts, strict=True):
                c.append(sum(s[0] == k for s in own))
            base.append(hashlib.sha256(written(own).encode()).hexdigest())
            every.append(written(spans))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())],
            [id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans"],
        )

    return by_batch(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text with personal data replaced by the name of its kind.

    Null and empty texts stay; repeated rows stay, one by one; an empty table stays empty; other columns of any name and
    with nulls come back as they were; texts are taken whole, however long.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [batch.column(at)[i].as_py() for i in range(batch.num_rows)]
        new = [t if not t else redacted(t, s) if (s := spans_of(t)) else t for t in texts]
        columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return by_batch(docs, work, schema)
