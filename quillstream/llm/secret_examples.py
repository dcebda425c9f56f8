"""Labelled findings for the secret network: made keys and tokens, and hard negatives, in varied surroundings.

Tables rarely label secrets, and what the base patterns find shows one way of writing them alone. Examples are made
from a seed, so every run learns from the same ones.
"""

from __future__ import annotations

import random
import string

_LETTERS, _UPPER, _LOWER, _DIGITS = string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase, string.digits
_BASE62, _BASE64, _URL64, _BASE32 = _LETTERS + _DIGITS, _LETTERS + _DIGITS + "+/", _LETTERS + _DIGITS + "-_", _UPPER + "234567"
_PREFIXES = ("", "", "", "key-", "sk_live_", "pk_test_", "ghp_", "glpat-", "xoxb-", "SG.", "AIza", "npm_", "ya29.", "rk_", "tok_", "v1.")
_SECRET_LEFT = ("key ", "API key: ", "Authorization: Bearer ", "export KEY=", "credential ", "aws_access_id = ", "client_id: ", "signed with ", "auth=", "use ", "sig ", '"', "'", "(", "id=")
_PLAIN_LEFT = ("see ", "file ", "at ", "from ", "http://", "https://", "order ", "card ", "mail ", "call ", "version ", "page ", "in ", "(", '"', "no. ", "user@", "a.b@", "dated ", "path ", "id=")
_VOWELS, _CONSONANTS = "aeiou", "bcdfghklmnprstvw"


def _text(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def word(rng: random.Random, least: int = 2, most: int = 11) -> str:
    """A word of some language, made of syllables."""
    n = rng.randint(least, most)
    out = ""
    while len(out) < n:
        out += rng.choice(_CONSONANTS) * (rng.random() < 0.8) + rng.choice(_VOWELS) + rng.choice(_CONSONANTS + "    ").strip()
    return out[:n]


def secret(rng: random.Random) -> str:
    """A key or token of 16 to 100 key characters with a digit in it."""
    kind = rng.randrange(9)
    if kind < 3:
        body = _text(rng, _BASE62, rng.randint(16, 64))
    elif kind == 3:
        body = _text(rng, _BASE64, rng.choice((24, 32, 40, 44, 64, 88))) + rng.choice(("", "=", "=="))
    elif kind == 4:
        body = _text(rng, _URL64, rng.randint(22, 86))
    elif kind == 5:
        body = _text(rng, _BASE32, rng.choice((16, 20, 26, 32, 52)))
    elif kind == 6:
        body = _text(rng, "0123456789ABCDEF" if rng.random() < 0.5 else "0123456789abcdef", rng.choice((16, 20, 22, 32, 40, 64)))
    elif kind == 7:
        body = "eyJ" + ".".join(_text(rng, _URL64, rng.randint(14, 40)) for _ in range(3))
    else:
        body = _text(rng, _LOWER + _DIGITS, rng.randint(16, 48))
    out = rng.choice(_PREFIXES) + body if kind in (0, 1, 2, 4, 8) else body
    return out if any(c in _DIGITS for c in out) else out[:-1] + rng.choice(_DIGITS)


def plain(rng: random.Random) -> str:
    """A run of 16 or more key characters with a digit in it that is no secret: numbers, dates, hosts, paths, names."""
    number = lambda: str(rng.randrange(10 ** rng.randint(1, 5)))
    name = lambda: rng.choice((word, word, lambda r: word(r).capitalize(), lambda r: word(r).upper()))(rng)
    kind = rng.randrange(10)
    if kind == 0:
        out = _text(rng, _DIGITS, rng.randint(16, 24))
    elif kind == 1:
        out = "-".join(_text(rng, _DIGITS, 4) for _ in range(rng.choice((4, 5))))
    elif kind == 2:
        out = f"{rng.randint(1950, 2039)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice((f"T{rng.randrange(24):02d}", f"_{rng.randrange(24):02d}-{rng.randrange(60):02d}", "-"))
    elif kind in (3, 4):
        out = ".".join([name().lower() + number()[: rng.randrange(3)], *(word(rng, 3) for _ in range(rng.randint(1, 3))), rng.choice(("com", "org", "net", "io", "de", "example.com", "co.uk"))])
    elif kind in (5, 6):
        out = "/".join(rng.choice((name, name, number))() for _ in range(rng.randint(3, 7))) + rng.choice(("", ".html", ".pdf", ".txt", "/"))
    elif kind == 7:
        out = rng.choice("-_.").join(rng.choice((name, name, number))() for _ in range(rng.randint(3, 6))) + rng.choice(("", ".py", ".csv", ".log", ".jpg"))
    elif kind == 8:
        out = ".".join(number() for _ in range(rng.randint(4, 7))) + rng.choice(("", "-beta", "-rc1", "+build"))
    else:
        out = rng.choice(("-", "=", "_", ".", "0", "1", "x", "ab", "12")) * rng.randint(8, 40)
    while len(out) < 16 or not any(c in _DIGITS for c in out):
        out += rng.choice("-._/") + number()
    return out


def examples(n: int, seed: int = 20) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, whether it is a secret) of n examples, half of either kind."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        label = k % 2 == 0
        found = secret(rng) if label else plain(rng)
        before = " ".join(word(rng) for _ in range(rng.randrange(6)))
        after = " ".join(word(rng) for _ in range(rng.randrange(5)))
        lead = rng.choice(_SECRET_LEFT if label else _PLAIN_LEFT) if rng.random() < 0.4 else ""
        left = (before + " " if before else "") + lead
        while left and left[-1] in _BASE64 + "-_.=":  # the candidate begins here
            left += rng.choice((" ", '"', ":", "(", "\n"))
        out.append((left + found + rng.choice(("", " ", ", ", '" ', ")\n")) + after if rng.random() < 0.8 else left + found, len(left), len(left) + len(found), label))
    return out
