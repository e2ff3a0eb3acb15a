"""Labelled strings for the secret models: made by rule, so that everyone trains on the same ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

# Words of ordinary names.
NAMES = """get set make load save read write open close find list sort merge split parse format print build start stop run check test update delete insert select
create remove add user account name address email phone order item price total count number index value key table column row field record file path folder
image video page site link title text word line block group node tree graph edge list map queue stack cache buffer stream server client request response
session token header body query filter report result error warning message event handler listener factory manager service provider controller model view
data date time year month day hour minute second start end first last next previous current default global local public private static abstract
transaction log backup config setting option version release build target source input output left right top bottom width height color size north south
average maximum minimum temperature population household income education school hospital station region country city street river mountain winter summer
by from with without into over under between and or not all any each of for on in at to the element tag names case number docker image latest www example com
https http org net html json xml csv the quick brown article chapter section introduction history language science nature music football market election
Der die das und mit von Straße haus garten arbeit zeit jahr monat schule wasser le la les des avec pour dans maison jardin ville année travail""".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "base62": LETTERS + LETTERS.upper() + "0123456789", "base64url": LETTERS + LETTERS.upper() + "0123456789-_", "upper": LETTERS.upper() + "0123456789",
    "lower": LETTERS + "0123456789", "letters": LETTERS + LETTERS.upper(), "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": LETTERS.upper() + "234567",
}
HELD_OUT = 4  # every fourth string of each kind chooses the margin and measures it; ordinary ones of other words


def _draws(seed: str) -> Iterator[int]:
    """Even draws below 2**16 that follow from the seed."""
    turn = 0
    while True:
        digest = hashlib.sha256(f"{seed}:{turn}".encode()).digest()
        yield from (int.from_bytes(digest[i:i + 2], "big") for i in range(0, len(digest), 2))
        turn += 1


def random_string(number: int) -> str:
    """A string of 16 to 64 even draws from one of the alphabets."""
    draw = _draws(f"random {number}")
    alphabet = list(ALPHABETS.values())[number % len(ALPHABETS)]
    return "".join(alphabet[next(draw) % len(alphabet)] for _ in range(16 + next(draw) % 49))


def ordinary_string(number: int) -> str:
    """A name of 16 characters or more: words joined as in code, slugs, hosts, files and versions, often with numbers."""
    draw = _draws(f"ordinary {number}")
    known = [n for i, n in enumerate(NAMES) if (i % HELD_OUT == HELD_OUT - 1) == (number % HELD_OUT == HELD_OUT - 1)]
    word = lambda: "".join(c for c in known[next(draw) % len(known)] if c.isascii())
    year, month, day = 1990 + next(draw) % 45, 1 + next(draw) % 12, 1 + next(draw) % 28
    endings = ["", "", "", str(next(draw) % 10), str(next(draw) % 1000), f"{year}", f"{year}-{month:02}-{day:02}", f"{year}_{month:02}_{day:02}", f"{year}{month:02}{day:02}",
               f"v{next(draw) % 10}", f"v{next(draw) % 10}-{next(draw) % 20}-{next(draw) % 20}", "12345678", "0001", "final", "copy-2"]
    style, parts = next(draw) % 8, [word().lower()]
    if style == 7:  # rules and fillers
        return (LETTERS + LETTERS.upper() + "0123456789-_-_")[next(draw) % 66] * (16 + next(draw) % 40)
    while sum(map(len, parts)) < 14 + next(draw) % 16:
        parts.append(word().lower())
    end = endings[next(draw) % len(endings)]
    if style == 0:
        return "_".join([*parts, end]).strip("_")
    if style == 1:
        return "-".join([*parts, end.replace("_", "-")]).strip("-")
    if style == 2:
        return parts[0] + "".join(p.title() for p in parts[1:]) + end.replace("-", "").replace("_", "")
    if style == 3:
        return "".join(p.title() for p in parts) + end.replace("-", "").replace("_", "")
    if style == 4:
        return "_".join(parts).upper() + ("_" + end.upper() if end else "")
    if style == 5:
        return "".join(parts) + end
    return "-".join(["https", "www", *parts, "com", end]).strip("-")


def labelled(count: int = 6000) -> list[tuple[str, bool]]:
    """(string, is random): ``count`` of each kind."""
    out = []
    for i in range(count):
        out.append((random_string(i), True))
        out.append((ordinary_string(i), False))
    return out


def parted(samples: list[tuple[str, bool]]) -> tuple[list, list]:
    """The part that trains and the part that is held out."""
    train, held = [], []
    for i, s in enumerate(samples):
        (held if i // 2 % HELD_OUT == HELD_OUT - 1 else train).append(s)
    return train, held

