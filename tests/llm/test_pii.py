import hashlib
import re

from phrasemill.llm import pii


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _brute(t):
    """Base spans with Python's own engine."""
    out = []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "nothing", "mail a.b@c-d.example, and x@y", "é🙂 a@b.co a@b.co-_x@y.org", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 99999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111", "+1 (555) 123-4567 or +12 or +1234567890123456", "call +49 30 1234567, now", "iban DE89 3704 0044 0532 0130 00 end",
    "DE89370400440532013001", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "0" * 2000, "a" * 2000 + "@", "+" * 2000, "x@" * 2000 + "y.z", "1.1." * 500, "12 " * 500 + "z 4111111111111111",
]


def test_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string")
    for r in pii.spans_digest(df).collect():
        want = _brute(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in pii.BASE)
        assert r.n_iban == (1 if r.doc_id == 10 else 0)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 🙂 +1 (555) 123-4567!"), (2, None), (3, "clean 12"), (4, "4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] or 🙂 [PHONE]!", 2: None, 3: "clean 12", 4: "[CARD]"}
    assert pii.redact(df.where("false")).count() == 0


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(1, "my card: 4111111111111111"), (2, "number 4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: r.pii[0].score for r in pii.find(df).collect()}
    assert got[1] > got[2]


def test_very_long_texts(spark):
    """Python's engine takes quadratic time on these, the operator must not."""
    texts = ["0" * 200_000, "a" * 200_000 + "@", "a" * 200_000 + "@b.co", "12 " * 50_000 + "z 4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_card) for r in pii.spans_digest(df).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (0, 1)}
