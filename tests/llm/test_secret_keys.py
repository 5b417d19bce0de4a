"""Random keys of several alphabets and lengths, in several contexts; long runs, and keys that a fixed pattern covers in part."""

import random
import string
import uuid

import pytest

from puckspark.llm import secrets

NOVELTY = secrets.Novelty()
CONTEXTS = {
    "code": "def connect(host, port=443):\n    session = Session(host, port, timeout=30)\n    for attempt in range(5):\n        if session.ping():\n"
            "            return session\nclient.auth(private ",
    "prose": "The meeting was moved to Thursday because several people were travelling, and the minutes have been sent to everyone. "
             "Please remember that the old door code no longer works; your new access credential is ",
    "json": '{"id": 1882, "region": "eu-west-1", "enabled": true, "tags": ["a", "b"], "credential": "',
    "short": "private ",
}
ALPHABETS = {
    "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "alnum": string.ascii_lowercase + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}


def found(text):
    known = secrets.base_spans(text)
    return secrets.novel_spans(text, known, NOVELTY)


def recall(context, make, n=40):
    hits = 0
    for _ in range(n):
        key = make()
        while not (any(c.isdigit() for c in key) and any(c.isalpha() for c in key)):
            key = make()
        hits += found(f"{context}{key} ;") == [(len(context), len(context) + len(key), "novel")]
    return hits / n


@pytest.mark.parametrize("context", CONTEXTS)
def test_random_keys_are_found(context):
    dice = random.Random(3)
    got = {("uuid", 36): recall(CONTEXTS[context], lambda: str(uuid.UUID(int=dice.getrandbits(128))))}
    for name, letters in ALPHABETS.items():
        for n in (16, 20, 40, 64, 128):
            got[name, n] = recall(CONTEXTS[context], lambda: "".join(dice.choices(letters, k=n)))
    print(context, got)
    assert all(v >= (0.95 if n >= 36 else 0.75) for (_, n), v in got.items()), got


def test_names_are_not_found():
    for name in ("get_connection_timeout_default_value1", "session-timeout-default-value-30", "authorizationpointerconfiguration2", "0000000000000000000000000000000A"):
        assert found(f"{CONTEXTS['code']}{name} ;") == [], name


@pytest.mark.parametrize("n", [512, 520, 600, 1200, 5000])
def test_long_keys_are_found_whole(n):
    key = "".join(random.Random(n).choices(string.ascii_letters + string.digits + "+/", k=n))
    assert found(f"{CONTEXTS['code']}{key} ;") == [(len(CONTEXTS["code"]), len(CONTEXTS["code"]) + n, "novel")]
    assert found(f"{CONTEXTS['code']}{'value1' * (n // 6)} ;") == []
    assert found(f"the picture {key} ;") == []


def test_keys_that_a_pattern_covers_in_part():
    key = "Zq7Rw2LxV9pT" + "0f3a9c1e5b7d2846af01c9e3" + "Kd4WnY8sMh6G"
    text = f"the private {key} ;"
    assert secrets.base_spans(text) == [(24, 48, "hex")] and found(text) == [(12, 12 + len(key), "novel")]
    for covered in (f"the private {key[12:36]} ;", f"the private my_token={key[:12]}{key[36:]} ;"):
        assert secrets.base_spans(covered) and found(covered) == []
