"""Equal rows, and one id with different texts."""

import hashlib
import random

import pytest

import corpus_pipeline
from granthi.llm import substring_dedup


def brute(rows):
    first = {}
    for i, text in rows:
        words = (text or "").split()
        for p in range(len(words) - 19):
            w = tuple(words[p: p + 20])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, text in rows:
        words = (text or "").split()
        gone = {p + j for p in range(len(words) - 19) if first[tuple(words[p: p + 20])] < (i, p) for j in range(20)}
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def rows():
    g = random.Random(7)
    say = lambda n: " ".join(g.choices([f"w{i}" for i in range(300)], k=n))
    a, b, shared = say(60), say(40), say(30)
    out = [(1, a), (1, a), (2, shared + " " + a), (2, shared + " " + b), (3, b), (3, b), (3, None), (4, say(20)), (4, say(20) + " " + shared)]
    out += [(5, shared + " " + say(9) + " " + shared), (5, say(3) + " " + shared), (6, a), (7, "x " * 50), (7, "x " * 50), (8, "x " * 30)]
    passages = [say(25) for _ in range(6)]
    out += [(g.randint(10, 40), " ".join(g.choice(passages) if g.random() < 0.5 else say(g.randint(1, 30)) for _ in range(4))) for _ in range(90)]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_passages_of_repeated_rows_and_ids(spark, parts):
    given = rows()
    got = substring_dedup.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(parts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == brute(given)


def test_pipeline_keeps_different_texts_of_one_id(spark):
    g = random.Random(3)
    a, b, c = (" ".join(g.choices([f"v{i}" for i in range(500)], k=80)) for _ in range(3))
    near = b.rsplit(" ", 1)[0] + " end"
    given = [(1, a), (1, a), (1, b), (2, c), (3, near), (4, None), (None, a)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted([(1, a), (1, b), (2, c), (4, None), (None, a)], key=key)
