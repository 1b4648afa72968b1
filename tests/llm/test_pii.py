import datetime as dt
import random
import re

import pytest

from skein.llm import pii as P

KEY = b"test"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to a.b+c@mail.example.org please", [("email", "a.b+c@mail.example.org")]),
        ("x_y at inbox dot test, z [at] post [dot] example, q (at) post.example, m @ desk.example", [("email", "x_y at inbox dot test"), ("email", "z [at] post [dot] example"), ("email", "q (at) post.example"), ("email", "m @ desk.example")]),
        ("Call (702) 555-0192 or 617-555-0143 ext. 16", [("phone", "(702) 555-0192"), ("phone", "617-555-0143 ext. 16")]),
        ("+44 20 7946 0591; 07700 900992; 06 39 98 69 37; +33 (0)1 99 00 92 71; 0049-171-3920058; 13035550190", [("phone", x) for x in ("+44 20 7946 0591", "07700 900992", "06 39 98 69 37", "+33 (0)1 99 00 92 71", "0049-171-3920058", "13035550190")]),
        ("dial two one two five five five zero one eight nine", [("phone", "two one two five five five zero one eight nine")]),
        ("my SSN 997-33-9035, passport no. FJ 153 1681, national ID #63.880.158-6, DNI 15815477A", [("id_number", x) for x in ("997-33-9035", "FJ 153 1681", "63.880.158-6", "15815477A")]),
        ("Home is 1323 NE Hobnail Road! PO Box 7085. Birkenhofweg 25, 32377 Halden. 58 avenue du Vieux Puits, 25296 Halden", [("address", x) for x in ("1323 NE Hobnail Road", "PO Box 7085", "Birkenhofweg 25, 32377 Halden", "58 avenue du Vieux Puits, 25296 Halden")]),
        ("My name is Mrs O'Dallan. Regards, Søren Y. Nakashiro. Kudos to Trelawnick, Xiomara! Hi Caspian, hello", [("name", x) for x in ("Mrs O'Dallan", "Søren Y. Nakashiro", "Trelawnick, Xiomara", "Caspian")]),
        ("Grace van der Hest never called me", [("name", "Grace van der Hest")]),
        ("Саll mе оn ０７７００ ９００６４６", [("phone", "07700 900646")]),
    ],
)
def test_finds(text, want):
    assert [(s.kind, s.value) for s in P.find(text)] == want


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  ", "Mark my words, April in Jackson, then Charlotte. Will grace period apply on GHTVJB. St. patrick day rush.",
        "Order 0471779554 total $1306, bag tag 0242170383, Reference 20-0454295482, Claim 82-3-13, flight 8237 on 12/05/2023 at 12:38pm",
        "4 of the market hall rules apply. Unit 38 on level 24. Seat 12C terminal 30, gate B17", "We can help. ^MS\nYour request was passed on. ^KN",
        "@VelaAir ask @row9416, see https://t.example/3W58T2 or www.a.b/c@d", "Hi there, Hello team, ask for us, my colleague somehow missed it, the agent was rude",
    ],
)
def test_leaves_alone(text):
    assert P.find(text) == [] and P.redact(text, KEY) == text


def test_the_rest_of_the_text_stays():
    t = "Тоо bad​, ｃａｌｌ 702 555 0192 or me@x.example — Thanks"
    spans = P.find(t)
    out = P.redact(t, KEY)
    keep = [t[a:b] for a, b in zip([0, *(s.end for s in spans)], [*(s.start for s in spans), len(t)], strict=True)]
    assert len(spans) == 2 and all(k in out for k in keep)
    assert [x[: x.index(" ")] for x in re.findall(r"\[[^\]]*\]", out)] == ["[PHONE", "[EMAIL"] and re.sub(r"\[[^\]]*\]", "", out) == "".join(keep)


def test_equal_values_stay_linked():
    a, b, c = (P.redact(t, KEY) for t in ("+1 212 555 0185", "(212) 555-0185", "two one two five five five zero one eight five"))
    assert a == b == c != P.redact("(212) 555-0186", KEY)
    assert P.redact("mail X@Y.example", KEY) == P.redact("mail x@y.example", KEY)
    assert P.redact("(212) 555-0185", b"other") != b


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Call +1 (212) 555-0185 ext 12", "PHONE", "+1 2125550185 x12"), ("Call 212-555-0185 x 99", "PHONE", "+1 2125550185 x99"), ("Call +33 1 99 00 92 71", "PHONE", "+33 199009271"), ("Call +49 199 009271", "PHONE", "+49 199009271"),
        ("Call 06 39 98 69 37", "PHONE", "+33 639986937"), ("Call 07700 900992", "PHONE", "+44 7700900992"), ("my SSN 123-45-6789", "ID_NUMBER", "123456789"), ("my SSN 997-33-9035", "ID_NUMBER", "997339035"), ("DNI 12345678Z", "ID_NUMBER", "12345678Z"),
        ("I was born on 3 March 1987 in Halden", "DATE", "1987-03-03"), ("DOB: 02/28/1990", "DATE", "1990-02-28"),
    ],
)
def test_the_key_brings_the_value_back(text, kind, value):
    out = P.redact(text, KEY, P.find(text, births=True))
    shown = re.search(r"\[[^\]]*\]", out).group()
    assert shown.startswith(f"[{kind} ") and P.revealed(shown, KEY) == value and value not in shown and P.revealed(shown, b"other") != value
    inner = shown[len(kind) + 2 : -1]
    assert len(inner) == len(value) and (kind == "DATE" or inner.split(" ")[0] == value.split(" ")[0] or kind == "ID_NUMBER")
    if kind == "ID_NUMBER":
        assert P._valid_id(inner) == P._valid_id(value)


def test_unequal_numbers_stay_unequal():
    texts = ["+1 (212) 555-0185 ext 12", "+1 (212) 555-0185 ext 99", "+1 (212) 555-0185", "+33 2125550185", "+49 2125550185"]
    assert len({P.redact(t, KEY) for t in texts}) == 5
    assert P.redact("flight on 12/05/2023, born free", KEY, P.find("flight on 12/05/2023, born free", births=True)) == "flight on 12/05/2023, born free"
    assert len(P.tag("a", KEY, "name")) == 24


@pytest.mark.parametrize(("text", "want"), [("Please contact John Smith", ["John Smith"]), ("I am Peter Jones and my bag is gone", ["Peter Jones"]), ("Name: Alice Brown", ["Alice Brown"]), ("I am Very Angry. Please contact Customer service", []), ("Rue de Rivoli 12, Paris", ["Rue de Rivoli 12, Paris"]), ("Aadhaar 2345 6789 0123", ["2345 6789 0123"])])
def test_cues_beyond_the_usual(text, want):
    assert [s.value for s in P.find(text)] == want


def test_feistel_is_a_permutation():
    for n in range(1, 4):
        seen = {tuple(P.feistel([int(c) for c in f"{x:0{n}d}"], 10, KEY, "t")) for x in range(10**n)}
        assert len(seen) == 10**n
    rng = random.Random(8)
    for _ in range(300):
        v = "".join(rng.choice("AB19-zQ 0.") for _ in range(rng.randint(0, 20)))
        p = P.pseudonym(v, KEY, "t")
        assert P.pseudonym(p, KEY, "t", back=True) == v and [c.isdigit() for c in p] == [c.isdigit() for c in v] and [c.isupper() for c in p] == [c.isupper() for c in v]
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=37 * i) for i in range(1900)]
    moved = [P.permuted_date(d, KEY) for d in days]
    assert len(set(moved)) == len(days) and [P.permuted_date(d, KEY, back=True) for d in moved] == days


def test_columns(spark):
    df = spark.createDataFrame([("a", "x@y.example", "clash"), ("b", None, None), ("c", "", "z"), ("d", "word " * 20_000 + "x@y.example", "z")], "id string, text string, kinds string")
    got = {r.id: (r.redacted, r.kinds) for r in P.with_pii(df, "text", KEY).collect()}
    assert got["a"][1] == ["email"] and got["b"] == (None, []) and got["c"] == ("", []) and got["d"][1] == ["email"]
    assert P.with_pii(df.limit(0), "text", KEY).count() == 0
