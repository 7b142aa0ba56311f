"""Small documents that every operator must bear: nulls, empty and long texts, ties, repeats."""

import random

VOCABULARY = [f"{a}{b}" for a in ("ri", "ta", "mo", "se", "lu", "ko", "pe", "na") for b in ("ver", "lin", "dor", "sam", "tek", "bou")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(words))


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t) if t is not None else None) for i, t in enumerate(texts)]


def odd_documents():
    """Null, empty, blank, one word, a very long text, exact and near copies, repeated rows, a null id."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n ", "word", prose(2, 30_000), base, base, " ".join(near), prose(3, 80), "a\x0bb\x1cc d é漢字 \U0001f600"]
    out = rows(texts)
    out.append(out[5])  # a repeated row
    out.append((None, prose(4, 60), None, None, None))
    return out
