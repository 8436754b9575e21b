import random

import pytest

WORDS = "the of and thing station matter orange window river falcon ember quartz meadow violet harbor signal copper lantern".split()


def prose(seed: int, n: int, stock: int = 400) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(stock)] + WORDS
    return " ".join(rng.choice(pool) + ("." if rng.random() < 0.08 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, source): prose, copies, near copies, a shared passage, blanks, nulls, repeated rows, a long text."""
    passage = prose(900, 60)
    rows = [(k, prose(k, 40 + 17 * (k % 9)), f"s{k % 3}") for k in range(40)]
    rows += [(40 + k, rows[k][1], "s0") for k in range(4)]
    near = rows[8][1].split(" ")
    rows += [(44 + k, " ".join([*near[:5], f"edit{k}", *near[6:]]), "s1") for k in range(3)]
    rows += [(47 + k, prose(300 + k, 30) + " " + passage + " " + prose(400 + k, 25), "s2") for k in range(3)]
    rows += [(50, "", "s0"), (51, None, "s0"), (52, " \t\n\x0b\x0c\r ", None), (53, "ö", None), (54, "one two", "s1"), (55, "\u00a0x\u2003y <|endoftext|> z", "s1")]
    rows += [(56, prose(77, 30_000, 60), "s2"), (57, "spam " * 300, "s2"), (58, rows[3][1], "s1"), (58, rows[3][1], "s1"), (None, prose(5000, 70), "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(corpus, schema).repartition(3)
    clashes = ["fp", "key", "kept", "m", "n", "hash", "block", "shard", "epoch", "bucket", "chunk", "spans", "base", "length", "rank", "n_chars"]
    return df.selectExpr("*", *[f"cast(1 as bigint) as {c}" for c in clashes])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
