"""Made-up personal data in forms that fixed patterns miss, and numbers that are none, for training a field on them."""

from __future__ import annotations

import random

EMAIL, IP, CARD, PHONE = range(4)
WORDS = "call me at or see the office of your order from our house now and then reach us under this line for more about it on page with total due by ask".split()


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def checked(body: str) -> str:
    """The digits with a check digit by Luhn's rule."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def card_number(rng: random.Random, valid: bool = True) -> str:
    number = checked(_digits(rng, rng.choice((15, 15, 15, 14)), "3456"))
    return number if valid else number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def groups_of(number: str, sizes: tuple[int, ...], between: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(number[at : at + n])
        at += n
    return between.join(out)


def email(rng: random.Random) -> str:
    at, dot = rng.choice((("[at]", "."), ("(at)", "."), (" @ ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("{at}", "{dot}"), ("[AT]", "[DOT]")))
    local = _name(rng) + rng.choice(("", ".", "_", "-")) + rng.choice((_name(rng), _digits(rng, rng.randint(1, 3))))
    host = dot.join([_name(rng), *[_name(rng)] * (rng.random() < 0.3), rng.choice(("com", "org", "net", "de", "fr", "io"))])
    return local + at + host


def ip(rng: random.Random) -> str:
    if rng.random() < 0.5:
        dot = rng.choice(("[.]", "(.)", " . ", "[dot]", "(dot)"))
        return dot.join(str(rng.randint(0, 255)) for _ in range(4))
    parts = [f"{rng.getrandbits(16):{rng.choice(('x', '04x'))}}" for _ in range(8)]
    if rng.random() < 0.6:
        return ":".join(parts)
    n = rng.randint(1, 3)
    return ":".join(parts[:n]) + "::" + ":".join(parts[-rng.randint(1, 3) :])


def card(rng: random.Random) -> str:
    number = card_number(rng)
    sizes = (4, 4, 4, 4) if len(number) == 16 else (4, 6, 5)
    return groups_of(number, sizes, rng.choice((".", "/", "_", "  ", " - ", "\u2013", " . ", ",", "--", ":")))


def phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3, "23456789"), _digits(rng, 3, "23456789"), _digits(rng, 4)
    pairs = " ".join(_digits(rng, 2) for _ in range(4))
    return rng.choice((
        f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} {b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"001 {a} {b} {c}", f"001-{a}-{b}-{c}",
        f"0{_digits(rng, 2, '1234')}/{_digits(rng, 7)}", f"0{_digits(rng, 3, '1234')}-{_digits(rng, 6)}", f"0{rng.randint(1, 9)} {pairs}", f"0{rng.randint(1, 9)}.{pairs.replace(' ', '.')}", f"0{rng.randint(1, 9)}-{pairs.replace(' ', '-')}",
        f"+49 (0){_digits(rng, 2, '1234')}/{_digits(rng, 7)}", f"0049 {_digits(rng, 2, '1234')} {_digits(rng, 7)}", f"({_digits(rng, 3)}) {_digits(rng, 7)}",
    ))


def none(rng: random.Random) -> str:
    """Numbers that are no personal data of these kinds."""
    y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 31)
    n = lambda k, first="123456789": _digits(rng, k, first)
    wrong = card_number(rng, valid=False)
    return rng.choice((
        f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02d}-{d:02d} {m:02d}:{d:02d}:{d:02d}", f"{y}-{m:02d}-{d:02d}T{m:02d}:{d:02d}:00Z", f"{m:02d}:{d:02d}:{d:02d}", f"{y}-{y + 5}",
        f"{n(1)},{n(3)}.{n(2)}", f"{n(2)}.{n(2)}", f"{n(3)},{n(3)},{n(3)}", f"{n(1)}.{n(1)}.{n(2)}", f"v{n(1)}.{n(2)}", f"{n(9)}", f"{n(10)}", f"{n(8)}", f"{n(12)}", f"{n(13)}", f"#{n(7)}",
        f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(2)}-{n(4)}-{n(2)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(5)}-{n(4)}", f"{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(1)} {n(2)} {n(3)} {n(2)}", f"{n(3)} {n(3)} {n(3)} {n(3)}",
        f"{n(2)}.{n(4)}, {n(1)}.{n(4)}", f"{rng.getrandbits(32):08x}-{rng.getrandbits(16):04x}-{rng.getrandbits(16):04x}-{rng.getrandbits(48):012x}", ":".join(f"{rng.getrandbits(8):02X}" for _ in range(6)), f"{rng.getrandbits(160):040x}", f"{rng.getrandbits(128):x}",
        f"DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", groups_of(wrong, (4, 4, 4, 4), rng.choice((" ", "-", ".", "/"))), wrong, f"{n(3)}/{n(3)}", f"{n(1)}x{n(2)}={n(3)}", f"pp. {n(3)}-{n(3)}", f"{n(3)}.{rng.randint(300, 999)}.{n(1)}.{n(2)}",
        f"@{_name(rng)}{n(2)}", f"{n(2)} @ {n(2)}", f"{n(3)}[{n(2)}]", f"({n(1)}) {n(3)}", f"{n(4)} ({n(4)})", f"A{n(2)}-{n(4)}-{n(3)}", f"{n(4)}-{n(4)}-{n(4)}", f"{n(6)}-{n(4)}",
    ))


def examples(count: int, seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their true spans: `count` that hold one, some beside further numbers, and `count` that hold none."""
    rng, out = random.Random(seed), []
    words = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))
    makers = (email, ip, card, phone)
    for k in range(count):
        kind = (EMAIL, IP, CARD, CARD, PHONE, PHONE)[k % 6]
        span = makers[kind](rng)
        left, right = words(), words()
        left += rng.choice((" ", " ", " ", ": ", " (")) if left else ""
        right = rng.choice((" ", " ", ". ", ", ", ") ")) + right if right else rng.choice(("", ".", "!"))
        if kind in (CARD, PHONE) and rng.random() < 0.35:
            # Further digits beside it: patterns take all of them together and then find their number wrong.
            if kind == CARD:
                number = card_number(rng)
                span = rng.choice((number, groups_of(number, (4, 4, 4, 4) if len(number) == 16 else (4, 6, 5), " ")))
            side = rng.choice((f"{rng.randint(1, 12):02d}/{rng.randint(24, 40)}", str(rng.randint(1990, 2040)), f"{rng.randint(100, 999)}", f"{rng.randint(1, 99)}"))
            if rng.random() < 0.7:
                right = f" {side}{right}"
            else:
                left = f"{left}{side} " if left.endswith((" ", "(")) or not left else f"{left} {side} "
        out.append((left + span + right, [(len(left), len(left) + len(span), kind)]))
    for _ in range(count):
        out.append((" ".join(x for x in (words(), none(rng), words()) if x) + rng.choice(("", ".", ",")), []))
    return out
