"""Small tables with the awkward rows every operator must take."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
# doc_id, text, and columns whose names clash with what operators add
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, id long, rest string, n_lines long, lang_pred string, uid long, node long, keys string, piece int"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def documents(seed=5):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    long_text = words(rng, 30_000, pool)
    base = words(rng, 120, pool)
    passage = "\n".join(words(rng, 12, pool) + "." for _ in range(12))
    texts = [words(rng, rng.randint(1, 200), pool) for _ in range(25)]
    texts += [None, "", " ", "\n\n", "one", "One", "two words", "three short words", "á é中文 \U0001f600 x", "tab\there\x0bvertical", "  led by blanks  ", "<|endoftext|> odd ▁ mark"]
    texts += [base, base, base.upper(), base + " tail", " ".join(base.split()[:-3]), base + " " + words(rng, 40, pool)]
    texts += [f"{words(rng, 9, pool)}\n{passage}\n{words(rng, 8, pool)}" for _ in range(6)]
    texts += [passage + "\n" + passage, long_text, long_text + " end"]
    rows = [(n, t) for n, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (4, "another text under id four"), (None, "text without id"), (None, None)]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    full = [(i, t, "en" if n % 3 else None, "src0", 1, 9, 9, "r", 9, "xx", 9, 9, "k", 9) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
