import hashlib
import math
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import pii, support

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute_force(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if valid(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


HARD = [
    "mail a.b@c.d_e@f.gh and x@y and .@-.- é@z.com",
    "a@b.c.1.2.3.4 1.2.3.4@x.y 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111@x.com 4111  1111 1111 1111 378282246310005",
    "+1 (377) 555-0271 +12345678901234567 +1234567890 ++1.234.567.890x +1 2",
    "漢字 \U0001f600 x@y.zz 漢字 +49 30 1234567 é 10.0.0.1.",
    "9" * 5000 + " " + "a" * 5000 + "@" + "b" * 10 + ". " + "a@b.cd " * 300,
    "1.2.3 .4.5.6.7 1..2.3.4 1.2.3.4.",
]


def of(spark, documents, **options):
    return pii.Sanitiser(spark.createDataFrame(documents, SCHEMA), **options)


def test_base_spans_match_brute_force(spark):
    documents = rows(HARD) + [(100 + i, *d[1:]) for i, d in enumerate(odd_documents())]
    got = of(spark, documents).spans().select("id", pii.written(F.filter("spans", lambda s: s["kind"] < 4)).alias("s")).collect()
    assert {r.id: r.s for r in got} == {d[0]: brute_force(d[1]) for d in documents}


def names():
    """Texts in which one rare name always stands by one address, and common words anywhere."""
    texts = [f"{prose(i, 30)} ask Zorblax at zb@mail.example now {prose(100 + i, 30)}" for i in range(4)]
    texts += [f"{prose(200 + i, 50)} {'call +1 377 555 0271 ' if i % 7 == 0 else ''}{prose(300 + i, 20)}" for i in range(200)]
    return rows(texts)


def test_terms_that_disclose_an_entity_are_spans(spark):
    documents = names()
    got = {r.id: r.spans for r in of(spark, documents).spans().select("id", pii.written(F.col("spans")).alias("spans")).collect()}
    for doc_id, text, *_ in documents[:4]:
        assert f"term:{text.index('Zorblax')}:{text.index('Zorblax') + 7}" in got[doc_id]
    words = {text[int(a) : int(b)].lower() for doc_id, text, *_ in documents for k, a, b in (s.split(":") for s in got[doc_id].split(",") if s) if k == "term"}
    assert words <= {"zorblax", "ask", "at", "now", "call"}  # none of the common words


TERM = regex.compile(pii.TERM)


def told_by(text):
    """Entities with their groups, and occurrences of terms, of a text."""
    entities, taken = set(), []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            if valid(kind, m[0]):
                name = m[0].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m[0])
                entities |= {f"{kind}:{name}", f"{kind}/{name.split('@')[1] if kind == 'email' else name.rsplit('.', 1)[0] if kind == 'ip' else name[:6]}"}
                taken.append(m.start())
    return entities, [m for m in TERM.finditer(text) if not any(m.start() <= at < m.end() for at in taken)]


def tied_in(text, terms):
    """Terms that are part of an e-mail address of their text, or that such an address is made of."""
    found, names = set(), [m[0].split("@")[0].lower() for m in PATTERNS["email"].finditer(text)]
    parts = {p for name in names for p in regex.split(r"[^\p{L}]+", name) if len(p) >= 3}
    whole = {regex.sub(r"[^\p{L}]", "", name) for name in names}
    for i, m in enumerate(terms):
        if m[0].lower() in parts:
            found.add(m[0].lower())
        if i + 1 < len(terms):
            a, b = m[0], terms[i + 1][0]
            capital = a[0] != a[0].lower() and b[0] != b[0].lower() and terms[i + 1].start() - m.end() <= 2
            a, b = a.lower(), b.lower()
            if capital and whole & {a + b, a[0] + b, a[0] + b[0]}:
                found |= {a, b}
    return found


def disclosed(documents, threshold=0.9, evidence=10.0):
    """(text, start, end) of all terms that the module's rules make spans, by plain counting."""
    texts = [d[1] or "" for d in documents]
    n, copies = len(texts), Counter(texts)
    told = {t: told_by(t) for t in copies}
    n_t = Counter(w for t in texts for w in {m[0].lower() for m in TERM.finditer(t)})
    n_e, both, shown, ties = Counter(), Counter(), Counter(), set()
    for t, (entities, terms) in told.items():
        for e in entities:
            n_e[e] += copies[t]
            for w in {m[0].lower() for m in terms}:
                both[e, w] += copies[t]
                shown[e, w] += 1
            ties |= {(e, w) for w in tied_in(t, terms)}
    inside, anywhere = set(), set()
    for (e, w), n_te in both.items():
        pmi, ic = math.log(n_te * n / n_t[w] / n_e[e]), math.log(n / n_e[e])
        if ic > 0 and pmi / ic >= threshold and ((e, w) in ties or shown[e, w] >= 2 and shown[e, w] * pmi >= evidence):
            inside.add((e, w))
            if shown[e, w] >= 2 and shown[e, w] * pmi >= evidence and 2 * n_te > n_t[w]:
                anywhere.add(w)
    return {(t, m.start(), m.end()) for t, (entities, terms) in told.items() for m in terms if (w := m[0].lower()) in anywhere or any((e, w) in inside for e in entities)}


def test_disclosure_matches_brute_force_by_broadcast_and_by_shuffle(spark):
    texts = [d[1] for d in names()] + [f"{prose(500 + i, 12)} Zorblax {prose(600 + i, 9)}" for i in range(2)]  # named without the address
    texts += [f"Marta Quendil {prose(700, 9)} mq@one.example, {prose(701, 9)}", f"Twice {prose(702, 9)} on@one.example Twice", f"Jan Okbert, {prose(703, 8)} j.okbert@two.example", f"Ada Zweig {prose(704, 8)} x.adazweig9@six.example zweig"]
    texts += [f"dishname {prose(900 + i, 9)} q{i}w@host{i}.example dishname{i} dishname{i}" for i in range(20)]  # rare and repeated, but no evidence
    texts += [None, "", texts[0], texts[0], texts[7]] + [f"host{i} at 10.1.2.{i} by Netzwerk {prose(800 + i, 12)}" for i in range(4)]
    documents = rows(texts)
    want = disclosed(documents)
    assert {t[a:b] for t, a, b in want} >= {"Zorblax", "Marta", "Quendil", "Okbert", "Netzwerk"} and not any(t[a:b].startswith(("dish", "Twice")) for t, a, b in want) and any("zb@" not in t and t[a:b] == "Zorblax" for t, a, b in want)
    for most in (200_000, 0):
        got = {r.id: r.spans for r in of(spark, documents, broadcast_rows=most).spans().select("id", F.filter("spans", lambda s: s["kind"] == 4).alias("spans")).collect()}
        assert {(texts[i], s.start, s.end) for i, spans in got.items() for s in spans} == want


def test_sanitised_replaces_terms_everywhere_and_bears_clashing_columns(spark):
    texts = [d[1] for d in names()] + [f"{prose(500, 12)} Zorblax {prose(600, 9)}"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    for c in ("_th", "th", "_spans", "spans", "extra", "terms", "hits", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    for most in (200_000, 0):
        out = pii.Sanitiser(docs, broadcast_rows=most).sanitised()
        found = out.collect()
        assert out.columns == docs.columns and len(found) == len(texts) and not any("Zorblax" in r.text or "zb@" in r.text for r in found)


def test_terms_are_found_in_the_whole_text_of_an_entity(spark):
    """Far from the mention, further on in the text, and behind a number that is no entity."""
    texts = [f"Zorblax {prose(i, 60)} zb@mail.example {prose(50 + i, 60)} (Zorblax) {prose(90 + i, 9)}" for i in range(4)]
    texts += [f"{prose(10 + i, 30)} Quendil 1984, 4111 1111 1111 1111 {prose(20 + i, 30)}" for i in range(4)]
    documents = rows(texts + [prose(200 + i, 60) for i in range(200)] + ["john.smith@x.example"] * 2)
    got = {r.id: r.spans for r in of(spark, documents).spans().select("id", pii.written(F.col("spans")).alias("spans")).collect()}
    for doc_id, text, *_ in documents:
        terms = [s for s in got[doc_id].split(",") if s.startswith("term")]
        assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("Zorblax|Quendil", text)} <= set(terms)
    out = [r.text for r in of(spark, documents).sanitised().collect()]
    assert len(out) == len(texts) + 202 and not any("Zorblax" in t or "Quendil" in t for t in out)


def test_sanitised_texts_hold_no_base_span(spark):
    documents = rows(HARD[:5]) + names()
    out = of(spark, documents).sanitised()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in out.where("doc_id >= 5 or doc_id < 5").collect()}
    assert all("zb@mail" not in t and "555 0271" not in t for t in texts.values() if t)


def test_overlapping_spans_become_one(spark):
    text = "x 4111 1111 1111 1111@x.com y"
    out = of(spark, rows([text])).sanitised().first().text
    assert "1111" not in out and out.startswith("x [") and out.endswith("] y")


def test_empty_and_digest(spark):
    assert of(spark, []).spans().count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_running_sums_of_long_arrays(spark):
    lengths = [(i * 7) % 5 for i in range(1000)]
    got = spark.createDataFrame([(lengths,), ([],)], "v array<int>").select(support.running_sums(F.col("v"))).collect()
    assert got[0][0] == [sum(lengths[:i]) for i in range(1000)] and got[1][0] == []


def test_every_base_span_has_a_sign():
    sign = re.compile(pii._SIGNS)
    for text in HARD:
        for start, _, _, end in [(m.start(), 0, 0, m.end()) for kind, p in PATTERNS.items() for m in p.finditer(text) if valid(kind, m[0])]:
            assert sign.search(text[start:end])
