import random

import numpy as np
import pytest

from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import substring_dedup, textkit, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


HARD = ["<|endoftext|>", "a <|endoftext|>  <|endoftext|> b", " \n\n  x  ", "it's we'LL ' s x", "12 345é漢字 ԱԳ՘\U0001f600", "᠎ 　 x", "�​\x00\x1c", "x" * 5000, "ກຂ ᚠ \U00016e60꟎", " " * 300 + "end"]


@pytest.mark.parametrize("hot", [100_000, 3, 0])
def test_counts_are_the_library_s(spark, hot):
    """With few or no frequent pre-tokens in the workers, the shuffle join counts the rest."""
    documents = rows(HARD) + [(100 if d[0] is None else 200 + d[0], *d[1:]) for d in odd_documents()]
    got = token_counts.token_counts(spark.createDataFrame(documents, SCHEMA), PATH, hot=hot).collect()
    want = list(zip((d[0] for d in documents), (len((d[1] or "").encode()) for d in documents), library(d[1] for d in documents)))
    assert sorted((r.id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_no_documents(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_word_hashes_follow_the_words():
    r = random.Random(1)
    alphabet = "abAB \t\n\x0b\x0c\r\x1c é漢"
    seen = {}
    for _ in range(2000):
        data = "".join(r.choice(alphabet) for _ in range(r.randrange(40))).encode()
        words = data.lower().split()
        hashes = textkit.word_hashes(data).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_in_pieces():
    words = [w.encode() for w in prose(3, 60_000).split()] + [b"x" * 200_000] + [b"tail"]
    whole = textkit.word_hashes(b" ".join(words))
    assert whole.tolist() == [textkit.word_hashes(w)[0] for w in words]


def gear_by_definition(data):
    """Chunk ends from the rolling hash taken one byte at a time."""
    rolled, h = [], 0
    for b in data:
        rolled.append(h := ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF)
    ends, last = [], 0
    while len(data) - last > 64 or any(rolled[i] >> 12 == 0 for i in range(last + 15, len(data) - 1)):
        near = [i for i in range(last + 15, min(last + 64, len(data) - 1)) if rolled[i] >> 12 == 0]
        last = near[0] + 1 if near else min(range(last + 15, last + 64), key=lambda i: (rolled[i], i)) + 1
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def test_cuts_are_those_of_the_rolling_hash():
    for seed in range(5):
        data = prose(seed, 400).encode()
        assert substring_dedup.cut_points(data) == gear_by_definition(data)
    flat = b"a" * 2000
    assert substring_dedup.cut_points(flat) == gear_by_definition(flat)


def test_chunks_tile_the_text():
    for text in ("", "x", prose(1, 300), "漢字\U0001f600é" * 400):
        _, starts, ends = substring_dedup.chunks(text.encode())
        assert starts.tolist() == [0, *ends.tolist()[:-1]] if text else len(starts) == 0
        assert not text or ends[-1] == len(text)


def spans_by_brute_force(documents, least=100):
    """All chunks in order; a chunk seen before repeats; adjacent repeats form spans."""
    seen, out = {}, set()
    for doc_id, text, *_ in sorted({d[:2] for d in documents}, key=lambda d: (d[0] is not None, d[0])):
        names, starts, ends = substring_dedup.chunks((text or "").encode())
        now = None
        for name, a, b in zip(names.tolist(), starts.tolist(), ends.tolist()):
            if name in seen:
                now = (now[0], b) if now and now[1] == a else (a, b)
                if now[1] - now[0] >= least:
                    out = {s for s in out if s[:2] != (doc_id, now[0])} | {(doc_id, *now)}
            else:
                seen[name] = doc_id
                now = None
    return out


def test_repeated_spans(spark):
    passage = prose(77, 55)
    texts = [prose(i, 60) + " " + (passage + " " if i % 3 == 0 else "") + prose(100 + i, 60) for i in range(30)]
    documents = rows(texts) + [(50 if d[0] is None else 60 + d[0], *d[1:]) for d in odd_documents()]
    docs = spark.createDataFrame(documents, SCHEMA).coalesce(1)
    got = {(r.id, r.start, r.end) for r in substring_dedup.repeated_spans(docs).collect()}
    assert got == spans_by_brute_force(documents)
    found = {s[0] for s in got}
    assert {i for i in range(3, 30, 3)} <= found and not found & {i for i in range(30) if i % 3}
    spread = docs.repartition(6).union(docs.where("doc_id = 65"))
    assert {(r.id, r.start, r.end) for r in substring_dedup.repeated_spans(spread).collect()} == got


def test_short_copies_and_periodic_passages(spark):
    short, period = prose(11, 20)[:73] + "x", "tamo se " * 30
    documents = rows([short, short, short + " x", "word", "word", f"{prose(1, 40)} {period} {prose(2, 40)}", f"{prose(3, 37)} {period} {prose(4, 44)}", "é" * 9, "é" * 9])
    found = {r.id: (r.start, r.end) for r in substring_dedup.repeated_spans(spark.createDataFrame(documents, SCHEMA)).collect()}
    assert found[1] == (0, 74) and found[4] == (0, 4) and found[8] == (0, 9) and not {0, 2, 3, 7} & set(found)
    start, end = found[6]
    at = documents[6][1].index(period)
    assert end - start >= 160 and start >= at - 64 and end <= at + len(period) + 64
    kept = {r.id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(documents, SCHEMA)).collect()}
    assert (kept[0], kept[1], kept[4]) == (short, "", "")


def test_texts_without_repeats(spark):
    passage = prose(78, 80)
    docs = spark.createDataFrame(rows([prose(1, 50) + " " + passage, prose(2, 50) + " " + passage, None, ""]), SCHEMA).coalesce(1)
    out = {r.id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert out[0] == prose(1, 50) + " " + passage and out[2] is None and out[3] == ""
    assert out[1].startswith(prose(2, 50)) and len(out[1]) < len(prose(2, 50)) + len(passage) / 2


def test_no_texts(spark):
    assert substring_dedup.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert np.array_equal(substring_dedup.chunks(b"")[0], np.empty(0, np.int64))
