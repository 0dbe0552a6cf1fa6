"""Planted keys of each character class are found whole; entropy spans by brute force."""

import math
import random
import re
from collections import Counter

import pytest

from flowbook.llm import secret_scan

AWS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + LETTERS.upper() + "0123456789"


def entropy_spans(text):
    return [(s, e) for s, k, e in secret_scan.find_spans(text) if secret_scan.KINDS[k] == "entropy"]


def brute(text):
    """Whole candidates with a window over the limit of its class that touches a part that is no plain one."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s, odd = m[0], [False] * len(m[0])
        free = re.sub(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])", lambda u: "-" * 36, s)
        for p in re.finditer("[A-Za-z0-9]+", free):
            if not re.fullmatch("[0-9]+|[0-9]{1,4}[a-z]{1,2}|[a-z]*([A-Z]+[a-z]{2,})*[A-Z]*[0-9]{0,4}", p[0]):
                odd[p.start():p.end()] = [True] * len(p[0])
        for i in range(len(s) - 19):
            w = s[i:i + 20]
            limit = 4.0 if re.fullmatch("[0-9]+", w) else 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 3.6 if w.isalnum() else 3.8
            if any(odd[i:i + 20]) and -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) >= limit - 1e-9:
                out.append(m.span())
                break
    return out


def test_aws_example_key():
    for text in (AWS, f"aws_secret_access_key = {AWS}", f"x {AWS} y"):
        at = text.index(AWS)
        assert entropy_spans(text) == [(at, at + 40)]
        assert AWS[20:] not in secret_scan.redact(text, secret_scan.find_spans(text))


@pytest.mark.parametrize("chars, n", [("0123456789abcdef", 32), ("0123456789ABCDEF", 32), ("0123456789ABCDEF", 40), (ALNUM, 32), (ALNUM + "+/", 40), (ALNUM + "-_", 43)])
def test_random_keys_are_found_whole(chars, n):
    dice = random.Random(n + len(chars))
    keys = ["".join(dice.choices(chars, k=n)) for _ in range(2000)]
    hits = [entropy_spans(f"see {k}, here") for k in keys]
    assert all(h in ([], [(4, 4 + n)]) for h in hits)
    assert sum(map(bool, hits)) >= 0.99 * len(keys)


def test_a_run_of_one_character_hides_no_key():
    key = "q8Zr2LmX0vT7bNc4KdPw9sYh"
    for text in (f"{key}======", f"//////{key}", f"{key}aaaaaaaa"):
        assert entropy_spans(text) == [(0, len(text))]
    for text in ("a1" + "x" * 30, "=" * 40, "-" * 20 + "see-the-3d-model" + "-" * 20):
        assert entropy_spans(text) == []


@pytest.mark.parametrize("text", [
    "files/123e4567-e89b-12d3-a456-426614174000/index", "blog/2019/05/17/how-to-read-a-long-title", "org/apache/spark/sql/catalyst/SparkPlanInfo2", "myHTTPServerRequestHandlerFactory"])
def test_allowed_parts(text):
    assert entropy_spans(text) == []


def test_brute_force():
    dice = random.Random(5)
    parts = [AWS, "word", "Path", "2024", "3d", "DEADBEEF01", "======", "123e4567-e89b-12d3-a456-426614174000", "a1" * 9]
    for _ in range(3000):
        text = "".join(dice.choice(["".join(dice.choices(dice.choice(["0123456789abcdef", "0123456789ABCDEF", ALNUM, LETTERS, "01", "xy1/"]), k=dice.randint(1, 30))), dice.choice(parts), dice.choice(" /-_=+,"), dice.choice(" /-_=+,")])
                       for _ in range(dice.randint(1, 9)))
        assert entropy_spans(text) == brute(text), text
