"""Personal data by anchor expansion.

An Aho-Corasick automaton streams through a text once and finds anchors: at-signs, plus signs before digits, digits,
schemes and words that announce an identifier.  A parser for each kind of anchor reads to both sides from
there, finds where an address or a number begins and ends, and checks it (parts, length, check digits).
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.kernels import tidy

#: Kinds of the contract in its order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("login", "iban", "ssn", "account", "passport")
#: Schemes whose user part is personal, and what announces an identifier (in any case), by kind.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "imap://", "smtp://")
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security no."),
    "account": ("account number", "account no.", "account no", "acct no.", "acct no", "acct."),
    "passport": ("passport number", "passport no.", "passport no", "passport"),
}
_DIGITS, _ALNUM = frozenset(string.digits), frozenset(string.ascii_letters + string.digits)
_LOCAL, _DOMAIN = _ALNUM | set("._%+-"), _ALNUM | {"-"}
_PHONE = _DIGITS | set(" ().-")
_USER = _ALNUM | set("._~%!$&'()*+,;=:-")
_NAME = _ALNUM | {"_"}
#: What stands behind an anchor that is not named like its kind.
_KIND = {"at": "email", "plus": "phone", "scheme": "login"}
_NO = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, int, int]  # start, number of the kind, end


def run_of(text: str, at: int, of: frozenset) -> int:
    """Where the characters of a set that start at a place end."""
    while at < len(text) and text[at] in of:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email(text: str, at: int, since: int) -> tuple[int, int] | None:
    """Around an at-sign, from since on: a local part, and labels of which there are two at least."""
    a = at
    while a > since and text[a - 1] in _LOCAL:
        a -= 1
    b = run_of(text, at + 1, _DOMAIN)
    if a == at or b == at + 1:
        return None
    end = b
    while end < len(text) and text[end] == "." and (c := run_of(text, end + 1, _DOMAIN)) > end + 1:
        end = c
    return (a, end) if end > b else None


def ip(text: str, at: int) -> tuple[int, bool]:
    """(end, sound) of a chain of digit groups with dots that starts here: four groups make an address."""
    parts, end = [], at
    while True:
        b = run_of(text, end, _DIGITS)
        parts.append(text[end:b])
        if len(parts) == 4 or b + 1 >= len(text) or text[b] != "." or text[b + 1] not in _DIGITS:
            return b, len(parts) == 4 and all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts)
        end = b + 1


def card(text: str, at: int) -> tuple[int, bool]:
    """(end, sound) of a chain of digits, each after one blank or hyphen at most, that starts here."""
    digits, end = [text[at]], at + 1
    while end < len(text):
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, 14 <= len(digits) <= 19 and luhn("".join(digits))


def phone(text: str, at: int) -> tuple[int, int] | None:
    """A number that starts with the plus sign here, followed by a digit."""
    run = run_of(text, at + 2, _PHONE)
    while run > at + 3 and text[run - 1] not in _DIGITS:
        run -= 1
    if run <= at + 3:
        return None
    return (at, run) if 10 <= sum(c in _DIGITS for c in text[at:run]) <= 15 else None


def login(text: str, at: int) -> tuple[int, int] | None:
    """The user part of an address whose scheme ends here, with a password: user:word@host."""
    b = run_of(text, at, _USER)
    colon = text.find(":", at, b)
    return (at, b) if at < colon < b - 1 and b + 1 < len(text) and text[b] == "@" and text[b + 1] in _ALNUM else None


def iban(v: str) -> bool:
    """Country, check digits and number leave 1 by 97, letters counted from 10 on."""
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def ssn(v: str) -> bool:
    """No group of zeros, no area 666 or from 900 on."""
    return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"


def account(v: str) -> bool:
    return 6 <= sum(c in _DIGITS for c in v) <= 17


def passport(v: str) -> bool:
    return 6 <= len(v) <= 9


#: By kind: where a value that starts after a cue ends, and whether it is one.
_VALUES: dict[str, tuple[re.Pattern, Callable[[str], bool]]] = {
    "iban": (re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"), iban),
    "ssn": (re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![A-Za-z0-9_])"), ssn),
    "account": (re.compile(r"[0-9]+(?:-[0-9]+)*(?![A-Za-z0-9_])"), account),
    "passport": (re.compile(r"[A-Z]{0,2}[0-9]{4,9}(?![A-Za-z0-9_])"), passport),
}
#: Between a cue and its value: blanks, then one of : # =, then blanks.
_BETWEEN = re.compile(r"[ \t]*[:#=]?[ \t]*")


def announced(text: str, kind: str, at: int, end: int) -> tuple[int, int] | None:
    """The value that the cue of a kind from at to end announces; letters and digits do not touch the cue."""
    if (at and text[at - 1] in _NAME) or (text[end - 1] in _NAME and end < len(text) and text[end] in _NAME):
        return None
    ends, sound = _VALUES[kind]
    m = ends.match(text, _BETWEEN.match(text, end).end())
    return m.span() if m and sound(m.group()) else None


def automaton() -> ahocorasick.Automaton:
    """Anchors with what they stand for; of cues that end alike the longest is told."""
    a = ahocorasick.Automaton()
    for d in string.digits:
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    a.add_word("@", ("at", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for kind, words in CUES.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans by start, then kind as listed.  Each parser goes over a character a bounded number of times.

    Every kind keeps where its last match ended, sound or not: matches of a kind do not overlap, and what
    fails its check is not read again from its middle.
    """
    low = text.replace("İ", "I").lower()  # the one letter whose small form is two characters long
    done = dict.fromkeys(("ip", "card", "at", "plus", "scheme", *CUES), 0)
    out: list[Span] = []
    for last, (what, size) in anchors.iter(low):
        at, end = last + 1 - size, last + 1
        if what == "digit":
            for kind, read in (("ip", ip), ("card", card)):
                if at >= done[kind]:
                    done[kind], sound = read(text, at)
                    if sound:
                        out.append((at, _NO[kind], done[kind]))
            continue
        if what == "at":
            got = email(text, at, done[what]) if at >= done[what] else None
        elif what == "plus":
            got = phone(text, at)
        elif what == "scheme":
            got = login(text, end)
        else:
            got = announced(text, what, at, end)
        if got and got[0] >= done[what]:
            out.append((got[0], _NO[_KIND.get(what, what)], got[1]))
            done[what] = got[1]
    out.sort()
    return out


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("no", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    for b in batches:
        rows = []
        for x in b.column(1):
            t = x.as_py()
            rows.append([{"start": s, "no": n, "end": e, "kind": KINDS[n]} for s, n, e in find(t, anchors)] if t else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "found"])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and found, an array of (start, no, end, kind) by start, then kind; code points, end exclusive.

    Rows are read alone and whole, in one narrow pass that is linear in a text's length.  Null and empty
    texts have no spans; repeated rows get equal ones, an empty table an empty result.  Other columns are not
    read, whatever their names.
    """
    made = "doc_id long, found array<struct<start:int,no:int,end:int,kind:string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(tidy(_spans), made)


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in square brackets; of spans that overlap the first, then the longest, counts."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["back"]).alias("at"), more.alias("out")))

    cut = F.aggregate(order, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, cut).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and spans as text."""
    say = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(say(F.filter("found", lambda s: s["no"] < len(BASE))), 256).alias("base_sha256"), say(F.col("found")).alias("spans"))
