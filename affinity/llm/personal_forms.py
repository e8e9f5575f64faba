"""Labelled lines for the field of ``personal_data``: forms of personal data that the rules miss, and what only looks like it.

Lines are made by rule: a carrier sentence whose ``#`` is replaced by a value of a form.  In a form ``d`` is a random
digit, ``x`` a random hexadecimal digit, ``w`` a random name; all else stands as it is.  A form of a card gets a last
digit by which its checksum holds, or one by which it fails.
"""

from __future__ import annotations

import random

#: Forms by kind (fixed values); ``""`` are values that are no personal data.
FORMS = {
    "phone": ["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "(0dd) ddddddd", "1-ddd-ddd-dddd", "00dd dd ddddddd", "0dd ddd dddd",
              "ddd ddd dddd", "(ddd)ddd-dddd", "0ddd/ddddddd", "1 (ddd) ddd dddd", "0ddd-ddddddd"],
    "card": ["dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd", "dddd_dddd_dddd_dddd", "dddd/dddddd/ddddd", "dddd.dddddd.ddddd", "dddd:dddd:dddd:dddd"],
    "email": ["w@localhost", "w.w@w", "w_w@w", "wdd@w", "w@w-w", "w-w@wdd", "w+w@w"],
    "ip": ["fe80::x", "2dd1:db8::xxxx:dd:dddd", "fe80::dxx:xxxx:xxxx:xxxx", "2ddd:xxxx:xxxx:dd::d", "fd00:dd:xx::d",
           "2ddd:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:dddd"],
    "bad card": ["dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd", "dddd_dddd_dddd_dddd", "dddd dddd dddd dddd", "dddd/dddddd/ddddd", "dddd:dddd:dddd:dddd"],
    "": ["20dd-0d-1d", "1d/0d/20dd", "1d:dd", "1d:dd:dd", "ddd-dd-dddd", "DEdd dddd dddd dddd dddd dd", "d.dd.d", "10.0.0.9dd", "dd.dd", "$dd.dd",
         "d,ddd,ddd", "dddddd", "978-d-dd-dddddd-d", "dd-dd", "SN-dddd-dd", "@w", "@wdd", "@w_w", "@wddd", "@w.w", "d:d", "dd.dddd,dd.dddd", "(ddd)", "(dd)", "(dddd)", "(d)", "dd%", "19dd", "#ddddd",
         "xd:xd:xd:xd:xd:xd", "dd:xd:dx:xd", "xd:xx:dd:xx:xd:xd:xd", "dddxdx", "ddd.dd.dddd", "dd x dd", "wd", "v2.d", "ddd-ddd", "400-ddd-dd", "1d.0d.20dd"],
}
CARRIERS = {
    "phone": ["call # now", "Phone: #", "my number is # today", "tel #, ask for Ann", "reach us at # or by post", "fax # for orders", "text me on #."],
    "card": ["card # please", "paid with #", "Card: #", "charge it to # today", "her credit card # was used", "number on the card: #."],
    "email": ["write to # soon", "mail #", "Contact: #", "send the file to #, thanks", "from # this morning", "cc # too."],
    "ip": ["host # is up", "ping #", "Address: #", "connected from # again", "the server at # failed", "blocked #."],
    "": ["on # at noon", "version # of it", "order # was sent", "about # items", "Total: #", "page # says so", "price # each", "chapter #.", "thanks # for that",
         "born # in Rome", "serial #, model B", "room # upstairs"],
    "any": ["see # below", "# is listed", "the entry reads #", "note: # (old)", "we found # there", "it says #, I think", "use #"],
}
NAMES = ["jane", "smith", "info", "team", "office", "root", "mailhost", "intranet", "server", "anna", "lee", "sales", "corp", "desk"]


def _checksum(digits: list[int]) -> int:
    return (sum(digits[::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10


def value(form: str, kind: str, rng: random.Random) -> str:
    """A value of the form; a card's checksum holds, a bad card's fails."""
    out = "".join(str(rng.randrange(1, 10)) if c == "d" else rng.choice("0123456789abcdef") if c == "x" and kind != "card" else
                  rng.choice(NAMES) if c == "w" else c for c in form)
    if kind.endswith("card"):
        digits = [int(c) for c in out if c.isdigit()]
        digits[-1] = (digits[-1] - _checksum(digits)) % 10
        out = out[:-1] + str(digits[-1] if kind == "card" else (digits[-1] + rng.randrange(1, 10)) % 10)
    return out


def labelled_lines(copies: int = 2, seed: int = 11, carriers=lambda at: True, table=None) -> list[tuple[str, str, int, int]]:
    """``(text, kind or "", start, end)``: every form in every carrier of its kind and of any, ``copies`` values each.

    Bad cards stand in the carriers of cards, all other values without personal data in those of every kind once more.
    ``carriers`` chooses by number within their list, ``table`` replaces ``FORMS`` (for tests on unseen ones).
    """
    rng, out = random.Random(seed), []
    for kind, shapes in (table or FORMS).items():
        own = "card" if kind == "bad card" else kind
        places = [c for name in (own, "any") for at, c in enumerate(CARRIERS[name]) if carriers(at)]
        if not kind:
            places += [c for name in ("phone", "card", "email", "ip") for at, c in enumerate(CARRIERS[name]) if carriers(at)][::3]
        for form in shapes:
            for carrier in places:
                for _ in range(copies):
                    text, at = value(form, kind, rng), carrier.index("#")
                    out.append((carrier.replace("#", text), "" if own != kind else kind, at, at + len(text)))
    return out
