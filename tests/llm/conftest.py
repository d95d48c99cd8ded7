import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, size long, u string, component string, _id long, _key long, _gone string, good_id long, kept_id long, kept_key string, kept_n long, gone_lines string, _kept_id long"


def _prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "re", "on", "li", "mu", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    base = [_prose(rng, 60) for _ in range(12)]
    passage = _prose(rng, 30)
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " tail", "x " + base[2]]
    words = base[3].split()
    for i in range(16):  # near copies
        w = list(words)
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [_prose(rng, 25) + "\n" + passage + "\n" + _prose(rng, 25) for _ in range(14)]
    texts += [None, "", "  \n\t ", "one", "two words", "two words", "a b c", _prose(rng, 4000), "ab " * 50, "É É b"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, base[5], "en", "s1", 1))
    rows.append((None, "null id alone, nothing else like it in here", None, None, None))
    return [(*r, 1, 2, 3, "u", "c", 4, 5, "g", 6, 7, "k", 8, "l", 9) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Columns that clash with names the operators use inside."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
