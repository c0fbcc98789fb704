import random
import re
import zlib
from collections import Counter

from kestrel.llm import queries, spelling

SF = "/root/testdata/sf0.01"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(words, ratio=10):
    """Every word against every other that shares a text with a letter left out."""
    by = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(k, []).append(w)
    near = {w: {x for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by[k] if one_edit(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_near_words_of_all_lengths_and_letters(spark):
    dice = random.Random(5)
    words = {"".join(dice.choice("abé") for _ in range(dice.randint(1, 6))): dice.choice([1, 2, 10, 30, 300, 4000]) for _ in range(500)}
    words |= {("long" * 20)[: 60 + i % 3] + "xyz"[i % 3] * (i % 2): 10 ** (i % 4) for i in range(12)}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(given)) == plain(words)


def test_words_that_agree_in_a_part_and_outside_a_zone_are_still_verified(spark):
    # One bucket of many permutations: few of them are near each other.
    dice = random.Random(1)
    words = {"pre" + "".join(dice.sample("abcdefgh", 8)) + "post": 2 for _ in range(3000)} | {"preabcdefghpost": 50, "preabcdefhpost": 3}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n int"))) == plain(words)


def test_ties_chains_nulls_and_clashing_names(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 20, "aaaaaac": 20, "aaaaabb": 500, "abaaabb": 6000, "zzzzzzz": 5}
    given = spark.createDataFrame([*words.items(), (None, 4), ("", 9)], "word string, n long").selectExpr("word", "n", "'mine' form", "1 key")
    got = {r.word: r for r in spelling.variants(given).collect()}
    assert len(got) == 8 and got[None].root is None and got[None].n_near == 0 and got[""].root == ""
    assert got["aaaaaaa"].form == "aaaaaab" and got["aaaaaaa"].root == "abaaabb" and got["aaaaaaa"].n_near == 2
    assert got["zzzzzzz"].form is None and got["zzzzzzz"].root == "zzzzzzz"
    assert spelling.variants(given.limit(0)).count() == 0


def test_query_equals_counts_in_python(spark):
    lower, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = rows(queries.op13_spelling_variants(spark, SF))
    assert len(got) > 1000 and sum(bool(r[1]) for r in got) > 20
    assert got == plain(words)
