import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, fp string"


def words(n, seed):
    """n words that follow from the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("abcdefghij"[int(d)] for d in str(x % 100000)))
    return out


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, repeated rows."""
    base = [" ".join(words(120, i)) + "." for i in range(12)]
    shared = " ".join(words(70, 99))
    near = base[1].split()
    near[60] = "changed"
    texts = [*base, base[0], base[0].replace(" ", "\n"), base[0] + "  ", " ".join(near), None, "", " \t\n", "one", "two words",
             " ".join(words(9000, 5)), "x" * 4000, "Same Case Words here", "same case words here", "éè 日本語 \U0001f600 z",
             base[2] + " " + shared, shared + " " + base[3], " ".join(words(20, 7)) + " " + shared, "again again " * 60, "<|endoftext|> in a text", "{}\x00 odd"]
    out = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, len(t) if t is not None else None, i % 5, "s", "f") for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((None, base[5], None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
