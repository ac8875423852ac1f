"""PII: base spans against Python's re on odd texts, and telling terms on a small corpus."""

import hashlib
import math
import random
import re

import pytest

from tessera.llm import pii

#: The stated patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


TEXTS = [
    "", None, "a@b.c_d@e.f.g x@y", "..a@b.c.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111 1111 1111",
    "+1 (736) 555-2678 +12 +123 ++1234567890", "+1 ))))) 2", "𝔘𝔫 é@x.de a.b+c@é.de 😀 me@ho-st.co.uk.", "+49 30 1234567\n+1.2.3.4.5.6.7.8", "9" * 5000, "a" * 5000 + "@", "4012888888881881 5555555555554444 12.12.12.12@a.b",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab1234567890.@+-  ()\n_é😀") for _ in range(rng.randrange(5, 120))) for _ in range(400)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q@r.st", None, None), (3, TEXTS[3], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, kind int")
    return texts, pii.digest(pii.find(docs)).collect()


def test_base_spans(found):
    texts, rows = found
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = brute("q@r.st" if r.doc_id is None else texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, want)
        assert r.spans == joined or r.spans.startswith(joined + ",")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PLAIN]


def test_telling_terms(spark):
    rows = [(i, f"Line {i} says Zorblax called boss@corp.example today and {i} went on.\nOther words here.") for i in range(4)]
    rows += [(10 + i, f"Plain words today and other things called {i}") for i in range(30)] + [(99, "Then Zorblax came."), (50, "x boss@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs, generalise=0.8, remove=0.95)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert "term_general" in got[0].spans and got[0].n_email == 1 and got[10].n_terms == 0
    at = rows[-2][1].index("Zorblax")
    assert f":{at}:{at + 7}" in got[99].spans  # named without the address, and still tells it
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(found).collect()}
    assert "boss@" not in clean[0] and "[EMAIL]" in clean[0] and "Zorblax" not in clean[0] + clean[99] and clean[10] == rows[4][1]


def test_empty(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_terms_of_whole_documents(spark):
    """A name above its value, on lines that are equal in different documents, tells it; words of near copies don't."""
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(26))
    rows = [(i, f"Signed by Quillfeather.\nSubject {own(i)}.\nContact: 4111 1111 1111 1111") for i in range(6)]
    rows += [(100 + i, f"Signed by nobody.\nSubject of contact matter {i}") for i in range(400)]
    rows += [(600 + i, "Rare lumpfish and other sprattles swim in the quibbling brook for days on end.\nMail me@brook.example" + "\nend" * i) for i in range(6)]
    rows += [(700, "A lonely thimblerig wrote from 10.1.2.3 once.")]
    got = {r.doc_id: r.clean_text for r in pii.sanitise(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all("Quillfeather" not in got[i] and "[CARD]" in got[i] and own(i) in got[i] for i in range(6))
    assert got[100] == rows[6][1] and "thimblerig" in got[700] and "lumpfish" in got[600]


def test_many_spans_in_one_long_text(spark):
    rng = random.Random(4)
    parts = [rng.choice([f"a{i}@b{i}.org", f"10.{i % 256}.3.{i % 300}", f"+49 30 {1000000 + i}", "4111 1111 1111 1111", "words, between 𝔘 them"]) for i in range(6000)]
    text = "; ".join(parts)
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = brute(text)
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and len(want) > 4000


def test_scores_against_a_direct_count(spark):
    """Every term that a direct count over documents finds telling is marked, and no other."""
    rng = random.Random(11)
    common = [f"com{chr(97 + i)}" for i in range(20)]
    values = [f"u{k}@mail.example" for k in range(6)]
    rows = []
    for i in range(240):
        words = rng.sample(common, 6) + [f"own{chr(97 + i // 26)}{chr(97 + i % 26)}x{chr(97 + k)}" for k in range(12)]
        if i % 8 < 6 and i < 80:
            k = i % 6
            words += [values[k]] + [f"tell{'abcdef'[k]}"] * (rng.random() < 0.9) + [f"half{'abcdef'[k]}"] * (rng.random() < 0.5)
        if rng.random() < 0.02:
            words.append("halfa")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {s.value: s.kind for r in found for s in r.extra}
    terms = {i: {t for t in re.sub(PLAIN["email"], " ", text).lower().split() if re.search("[a-z]", t)} for i, text in rows}
    holders = {v: {i for i, t in rows if v in t.split()} for v in values}
    pairs = {(t, v) for v, ids in holders.items() for i in ids for t in terms[i] if len(ids) > 1}
    n, want = len(rows), {}
    fact = lambda x: math.lgamma(x + 1)
    for t, v in pairs:
        n_t, n_e, both = sum(t in x for x in terms.values()), len(holders[v]), sum(t in terms[i] for i in holders[v])
        k, a, b = both - 1, n_e - 1, n_t - 1
        log_chance = fact(a) + fact(b) + fact(n - 1 - k) - fact(k) - fact(a - k) - fact(b - k) - fact(n - 1)
        disclosure = math.log(both * n / (n_t * n_e)) / math.log(n / n_e)
        if log_chance <= math.log(pii.CHANCE / len(pairs)) and disclosure >= pii.GENERALISE:
            want[t] = max(want.get(t, 0), disclosure)
    assert got == {t: "term_removed" if d >= pii.REMOVE else "term_general" for t, d in want.items()} and len(got) >= 6
