"""Base spans against plain patterns, and what is learned from planted surroundings."""

import hashlib
import re

import numpy as np
import pytest

from verdictlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), order, m.end()))
    return sorted(out)


TEXTS = [
    None, "", " ", "a@b", "a@b.c_d@e.f-g.h", "x.y+z@a-b.co.uk.", "@b.c", "a@@b.c d@e..f", "né@mail.de ü@x.y",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "0000001.2.3.04", "1.2.3 .4", "v1.2.3.4x",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111", "5", "79927398713 799273987130",
    "+1 (377) 555-0271", "+1--2", "++49 30 1234567.", "+123456789012345678", "+1 555 0000000 +2 555 1111111",
    "😀 +1 (377) 555-0271 😀 a@b.cd", "1" * 3000 + "@" + "a" * 3000, "1-" * 2000, "+" * 500 + "1", "9." * 800, "a.b@c." * 50,
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text or "") == brute(text)


def test_base_spans_equal_plain_patterns_on_noise():
    rng = np.random.default_rng(4)
    for alphabet in ("1.", "1 -+", "a@.-_%", "12@.+ ()-a", "0123456789 -"):
        for _ in range(400):
            text = "".join(rng.choice(list(alphabet), 60))
            assert pii.base_spans(text) == brute(text)


def planted(prose):
    """Documents in which phones follow 'reach me at' and addresses 'write to'; some are in forms that only surroundings tell."""
    rows, want = [], {}
    for k in range(30):
        rows.append((k, f"{prose(20, k)} reach me at +1 (377) 555-{1000 + 7 * k} {prose(9, 100 + k)} write to ann{k}@mail{k}.org soon"))
    for k in range(30, 36):
        text = f"{prose(15, k)} reach me at 030 555 {2000 + 3 * k} {prose(8, k)}"
        rows.append((k, text))
        start = text.index("030")
        want[k] = f"phone:{start}:{start + 12}"
    text = f"{prose(5, 1)} write to bob (at) posteo (dot) net soon"
    rows.append((40, text))
    want[40] = f"email:{text.index('bob')}:{text.index(' soon')}"
    # The same forms elsewhere stay alone.
    rows += [(50, f"{prose(9, 2)} between 1990-1995 and 2001-2004 look at the dot com {prose(5, 3)}"), (51, f"{prose(9, 4)} 030 555 9999 {prose(5, 5)}")]
    # A learned number is known elsewhere.
    text = f"{prose(7, 6)} 030 555 2090 {prose(7, 7)}"
    rows.append((60, text))
    start = text.index("030")
    want[60] = f"phone:{start}:{start + 12}"
    return rows, want


def test_surroundings_find_unseen_identifiers(spark, table, prose):
    rows, want = planted(prose)
    rows += [(None, rows[0][1]), (None, None), (3, rows[3][1]), (70, "")]
    got = pii.personal_data(table(rows)).collect()
    assert len(got) == len(rows)
    for r, text in zip(sorted(got, key=lambda r: str(r.doc_id)), [t for _, t in sorted(rows, key=lambda r: str(r[0]))], strict=True):
        base = brute(text)
        told = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in base)
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == o for _, k, _ in base) for o in range(4)]
            assert r.spans == want.get(r.doc_id, told) and r.n_added == (r.doc_id in want)
    assert pii.personal_data(table(rows).limit(0)).count() == 0


def test_copies_of_one_text_teach_nothing(spark, table, prose):
    text = f"{prose(9, 1)} ring us on +1 (377) 555-1000 {prose(9, 2)}"
    rows = [(k, text) for k in range(50)] + [(90, f"{prose(9, 3)} ring us on 030 555 2000 {prose(4, 4)}")]
    got = {r.doc_id: r.n_added for r in pii.personal_data(table(rows)).collect()}
    assert set(got.values()) == {0}


def test_word_runs_are_counted_over_all_texts(spark, table):
    rows = [(1, "to be, or not To Be"), (2, "be to be"), (3, None), (4, "to")]
    name = int(pii.named_runs(np.array([pii.token_hash("to"), pii.token_hash("be")], dtype=np.uint64), 2)[0])
    alone = int(pii.named_runs(np.array([pii.token_hash("to")], dtype=np.uint64), 1)[0])
    wanted = spark.createDataFrame([(name,), (alone,), (5,)], "name bigint")
    for bits in (1 << 10, 1 << 6):
        got = {r.name: r.total for r in pii.occurrences(table(rows), "text", wanted, bits).collect()}
        assert got == {name: 3, alone: 4}
