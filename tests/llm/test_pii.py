import random

from tidewatch.llm import pii

SCHEMA = "doc_id long, text string"


def test_permutation_is_a_keyed_cycle():
    for size in (2, 3, 10, 97, 1000):
        p = pii.Permutation(b"k", "t", size)
        assert sorted(map(p.forward, range(size))) == list(range(size))
        assert all(p.back(p.forward(x)) == x and p.step(x) != x and p.step(p.step(x), -1) == x for x in range(size))
        seen, x = set(), 0
        while x not in seen:
            seen.add(x)
            x = p.step(x)
        assert len(seen) == size
    assert [pii.Permutation(b"a", "t", 10**9).forward(x) for x in range(9)] != [pii.Permutation(b"b", "t", 10**9).forward(x) for x in range(9)]


VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "3782 822463 10005"],
    "date": ["2024-02-29", "29/02/2024", "12/31/1999", "01.01.1900", "2099/12/31"],
    "address": ["0.0.0.0", "255.255.255.255", "97.51.17.173"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+49 30 1234567"],
    "social": ["123-45-6789"],
    "email": ["und.34@mail7.example.com", "a@b.co", "A_b+c@x-y.org"],
    "account": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "API_KEY: 'Ab0Ab0Ab0Ab0Ab0Ab0'"],
}
INVALID = ["4111111111111112", "0000000000000000", "2023-02-29", "30/30/2024", "256.1.1.1", "1.2.3", "1.2.3.4.5", "000-45-6789", "GB83 WEST 1234 5698 7654 32", "Version 2.0.", "item 12345", "@home", "9" * 40, 'token = "onlyletterswithoutdigits"']


def test_values_keep_their_format_and_can_be_read_back():
    own = pii.Pseudonyms(b"key")
    for kind, values in VALID.items():
        for value in values:
            text = f"Text, {value}, and {value}!"
            new, counts = own.replace(text)
            assert counts == {kind: 2}, (value, counts)
            assert len(new) == len(text) or kind == "address"
            assert value not in new and own.replace(new)[1] == counts, (value, new)
            assert own.replace(new, -1)[0] == text
    for value in INVALID:
        assert own.replace(f"Text, {value}, end") == (f"Text, {value}, end", {})


def test_equal_values_stay_linked_whatever_their_layout():
    own = pii.Pseudonyms(b"key")
    assert own.replace("4111 1111 1111 1111")[0].replace(" ", "") == own.replace("4111111111111111")[0]
    a, b = own.replace("2024-02-29")[0], own.replace("29/02/2024")[0]
    assert a.split("-") == b.split("/")[::-1]
    rng = random.Random(3)
    seen = {own.replace(f"{rng.randrange(256)}.{i % 256}.{i // 256}.7")[0] for i in range(400)}
    assert len(seen) == 400


def test_rows(spark):
    rows = [(1, "call 97.51.17.173"), (2, None), (3, ""), (4, "call 97.51.17.173"), (4, "call 97.51.17.173"), (None, "x"), (5, "word " * 50_000 + "97.51.17.173"), (6, "7" * 100_000), (7, "a." * 50_000 + "@")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kinds", "1 AS n_values")
    got = {(r.doc_id, r.text[:40] if r.text else r.text, r.n_values, r.kinds) for r in pii.pseudonymise(df, b"key").collect()}
    new = pii.Pseudonyms(b"key").replace("97.51.17.173")[0]
    assert {(1, f"call {new}", 1, "address:1"), (2, None, 0, ""), (3, "", 0, ""), (4, f"call {new}", 1, "address:1"), (None, "x", 0, ""), (6, "7" * 40, 0, "")} <= got
    assert pii.pseudonymise(df, b"key").count() == len(rows)
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA), b"key").collect() == []


def test_secrets_of_any_length_and_with_dots_are_hidden():
    own, rng = pii.Pseudonyms(b"key"), random.Random(4)
    wide, narrow = pii.string.ascii_letters + pii.string.digits + "_-", "0123456789abcdef"
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    signed = "eyJhbGciOiJIUzI1NiJ9." + made(90, wide) + "." + made(43, wide)
    for secret in (signed, "a1." + made(20, wide), *(made(n, wide) for n in (96, 97, 200, 256, 257, 5000)), *(made(n, narrow) for n in (200, 257, 512, 20_000)), "1" * 300 + "z" + "2" * 20, "=" * 300 + "a1"):
        text = f'Text, access_key = "{secret}" and token: "{secret}"!'
        new, counts = own.replace(text)
        assert counts == {"secret": 2} and len(new) == len(text)
        out = new.split('"')[1]
        assert new.split('"')[3] == out and own.replace(new, -1)[0] == text
        assert (set(out) <= set(narrow)) == (set(secret) <= set(narrow))
        changing = [(a, b) for a, b in zip(secret, out, strict=True) if a.isalnum()]
        assert out != secret and (len(changing) < 20 or sum(a == b for a, b in changing) < len(changing) / 4)
    for text in ('token = "' + "a" * 300 + '"', 'token = "' + "a1" * 50_000, 'token = "short.1"'):
        assert own.replace(text) == (text, {})
