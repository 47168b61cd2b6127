"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus-signs, digits, URL schemes and
identifier cues. Around each anchor a local parser expands to the boundaries of
an e-mail address, a network address, a card, a phone number, a URL that names
a user, or an account number, and validates it. The automaton is linear in the
text; a parser never looks at a character run again once it has consumed it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from vanflow.llm.base import keyed, map_rows, type_of

# Kinds in their order, identifier cues.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
CUES = ("iban", "account no", "account number", "acct", "passport", "ssn", "social security", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER_URL = re.compile(r"://[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+[^\s<>\"]*")
_ACCOUNT = re.compile(r"[ :#.=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])")
_RANK = {kind: i for i, kind in enumerate(KINDS)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+":
        found.add_word(mark, mark)
    for digit in "0123456789":
        found.add_word(digit, "0")
    found.add_word("://", "/")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
            found.add_word(form, "#")
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _iban(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every validated span, by start and then kind; code points, end exclusive."""
    spans: list[tuple[int, str, int]] = []
    email_from = ip_from = card_from = account_from = url_from = 0
    for at, anchor in _ANCHORS.iter(text):
        if anchor == "@":
            start = at
            while start > email_from and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                spans.append((start, "email", domain.end()))
                email_from = domain.end()
        elif anchor == "0":
            if at >= ip_from:
                chain = _DOTTED.match(text, at)
                ip_from, parts, start = chain.end(), chain.group().split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(map(_octet, four)):
                        spans.append((start, "ip", end))
                    start = end + 1
            if at >= card_from:
                chain = _SPACED.match(text, at)
                card_from = chain.end()
                digits = chain.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, "card", card_from))
        elif anchor == "+":
            number = _PHONE.match(text, at)
            if number and 9 <= sum("0" <= c <= "9" for c in number.group()) <= 15:
                spans.append((at, "phone", number.end()))
        elif anchor == "/":
            found = _USER_URL.match(text, at - 2) if at - 2 >= url_from else None
            if found:
                start = at - 2
                while start > url_from and at - start < 16 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at - 2:
                    spans.append((start, "url", found.end()))
                    url_from = found.end()
        elif at >= account_from:
            found = _ACCOUNT.match(text, at + 1)
            if found:
                number = found.group(1)
                bare = number.replace(" ", "").replace("-", "")
                if not (bare[:2].isalpha() and bare[2:4].isdigit() and len(bare) >= 15) or _iban(bare):
                    spans.append((found.start(1), "account", found.end(1)))
                    account_from = found.end(1)
    return sorted(spans, key=lambda s: (s[0], _RANK[s[1]]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts per base kind, a digest of the base spans and all spans.

    A null text counts as empty; repeated rows are answered each; an empty
    table gives no rows; further columns are ignored. No shuffle.
    """
    source = keyed(docs, id_col, text_col)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account")}
            for text in batch["text"]:
                spans = find(text or "")
                base = [s for s in spans if s[1] in BASE_KINDS]
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[1] == kind for s in spans))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            yield {"doc_id": batch["doc_id"], **out}

    return map_rows(
        source, work,
        f"doc_id {type_of(source, 'doc_id')}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string, n_url long, n_account long",
    )
