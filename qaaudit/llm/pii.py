"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes and cues of identifiers.  From each anchor a local
parser expands to the item's boundaries and validates it.  Numeric kinds start at digits or a plus sign and
are matched by the fixed patterns.  All positions are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_stats import beside_rows, per_text

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account", "secret"]
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match never starts inside a run of digits; said so, a long run is tried once and not at each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SCHEMES = ["http://", "https://", "ftp://"]
#: Words that announce an identifier, by the kind of what follows.
CUES = {
    "account": ["iban", "account number", "account no", "account", "acct", "passport", "ssn", "tax id", "customer id", "user id"],
    "secret": ["password", "passwd", "secret", "api key", "api_key", "apikey", "access_key", "token"],
}
KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?")
GAP = re.compile(r"(?:[\x20\t]*(?:is|no\.?|number|nr\.?|=|:|#|-))?[\x20\t]*[\"']?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"[A-Z]{0,4}[0-9](?:[\x20-]?[0-9]|[A-Z]){4,33}(?![0-9A-Za-z])")
SECRET = re.compile(r"[A-Za-z0-9_+/=-]{8,}")
Span = tuple[int, int, str]


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", (1, "email"))
    found.add_word("AKIA", (4, "key"))
    for s in SCHEMES:
        for form in (s, s.upper()):
            found.add_word(form, (len(s), "url"))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (len(cue), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if start < at and domain else None


def iban(compact: str) -> bool:
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """The identifier behind a cue that ends at ``at``: an IBAN with right check digits, or 5 to 20 digits in one item."""
    begin = GAP.match(text, at).end()
    m = IBAN.match(text, begin)
    if m and iban(m[0].replace(" ", "")):
        return m.span()
    m = ACCOUNT.match(text, begin)
    return m.span() if m and 5 <= sum(c.isdigit() for c in m[0]) <= 20 else None


def secret_at(text: str, at: int) -> tuple[int, int] | None:
    """The value behind a cue and an equals sign or colon; it has a digit."""
    gap = GAP.match(text, at)
    if not re.search("[=:]", gap[0]):
        return None
    m = SECRET.match(text, gap.end())
    return m.span() if m and any(c.isdigit() for c in m[0]) else None


def url_at(text: str, at: int, begin: int) -> tuple[int, int] | None:
    """The address behind the scheme text[begin:at], up to white space, quotes or angle brackets; trailing punctuation is not part of it."""
    host = HOST.match(text, at)
    if not host or "." not in host[0]:
        return None
    end = re.compile(r"[^\s<>\"'`]*").match(text, at).end()
    while end > host.end() and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return begin, max(end, host.end())


def spans(text: str | None) -> list[Span]:
    """All (start, end, kind) of a text, by start, then kind as listed in ``KINDS``; none in a null or empty text."""
    if not text:
        return []
    out: list[Span] = []
    floor = {k: 0 for k in KINDS}

    def take(kind: str, found: tuple[int, int] | None) -> None:
        if found and found[0] >= floor[kind]:
            out.append((*found, kind))
            floor[kind] = found[1]

    for end, (length, kind) in _anchors().iter(text):
        begin = end + 1 - length
        if kind == "email":
            take("email", email_at(text, end, floor["email"]))
        elif begin and (text[begin - 1].isalnum()):
            continue
        elif kind == "key":
            take("secret", m.span() if (m := KEY.match(text, begin)) else None)
        elif kind == "url":
            take("url", url_at(text, end + 1, begin))
        elif not text[end + 1 : end + 2].isalpha():
            take(kind, (account_at if kind == "account" else secret_at)(text, end + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], rank[s[2]], s[1]))


def redacted(text: str | None) -> str | None:
    """The text with every found item replaced by its kind in brackets; overlapping items become one, named by the first."""
    if not text or not (found := spans(text)):
        return text
    parts, done = [], 0
    for start, end, kind in found:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """items array<struct<start, end, kind>> of every row, beside its id; an empty array where nothing is found.

    Null and empty texts have no items, repeated rows get equal items, an empty table gives no rows.  A very long text is
    read once, in time in proportion to its length.
    """
    kind = "items array<struct<start: int, end: int, kind: string>>"
    return per_text(docs, kind, lambda texts: [[[{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in texts]], ids)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with texts redacted; all columns and rows stay, n_chars (where there is one) follows the text.

    Null and empty texts stay as they are; texts without personal data stay unchanged.
    """
    made, own = beside_rows(docs, "redacted string", lambda texts: [[redacted(t) for t in texts]])
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("redacted").eqNullSafe(F.col("whole")), own["n_chars"]).otherwise(F.char_length("redacted").cast(kind))
    return made.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as one string.

    A row of its own for every row of ``found``; without items the counts are 0, the spans empty and the hash that of the empty string.
    """
    item = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("items", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("items", lambda x: x["kind"].isin(*BASE))
    return found.select(
        *(ids or ["doc_id"]),
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, item), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("items", item), ",").alias("spans"),
    )
