import hashlib
import re

from tests.llm.fixtures import AWKWARD, table, words
from weirgate.llm import pii

# The contract's patterns, applied as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(PLAIN.items())
             for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return sorted(found)


TEXTS = [
    "mail a.b+c@mail.example.com, x@y@z.com; a@b.c_d@e.f @x.y a@b a@@b.c é@ü.de z@a-.b..c",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.0004 10.0.0.1.10.0.0.2 999999.1.1.1 ٣.1.2.3.4",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 and 4012888888881881x 5500000000000004 4 1 1 1",
    "+1 (988) 555-2485 +44.20.7946.0958 +1 +123456789012345678 ++1 555 123 4567 (+49 30 123456)",
    "\U0001f600 naïve +1 (988) 555-2485 中文 me@host.example.org 42.144.35.254 4041894974608795",
    "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433 iban DE89370400440532013000",
    "my ssn is 123-45-6789, plain 123-45-6789 elsewhere far away from it all in a long stretch of words 219-09-9999",
    "routing number 021000021 but 021000021 without a word and 021000022",
    "1" * 2_000 + " " + "7.7." * 500 + "a" * 2_000 + "@" + "b" * 2_000,
    " ".join(words(200_000, 1)) + " +1 (988) 555-2485 x@y.zz",
]


def test_base_spans_match_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + AWKWARD
    got = pii.digest(pii.find_spans(table(spark, rows, clash=True).repartition(3))).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1]) for r in rows}
    for r in got:
        base = want[r.doc_id]
        joined = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_added_kinds_need_their_checks():
    kinds = [[(k, t[s:e]) for k, s, e, _ in pii.scored(t) if k not in pii.BASE] for t in TEXTS[5:8]]
    assert kinds[0] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert kinds[1] == [("ssn", "123-45-6789")] * 2  # the second is still near the word
    assert kinds[2] == [("routing", "021000021")] * 2


def test_context_raises_the_score():
    alone, near = (pii.scored(t)[0][3] for t in ("see 10.0.0.1 there", "ip address 10.0.0.1"))
    assert alone < near


def test_empty_table(spark):
    assert pii.digest(pii.find_spans(table(spark, []))).collect() == []
