import re

from kestrel.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    words, hit, found = plain_words(text), set(), set()
    for name, body in items:
        own = plain_words(body)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


W20 = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, W20), (10, "Short, item!"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(5, 18))), (5, "Äpfel 東京 ok")]
TEXTS = [
    "prefix " + W20.upper() + " tail", "a short item here; SHORT item", None, "", "w1 w2 w3", " ".join(["w5"] * 9),
    "x " * 400 + W20, "äpfel Äpfel 東京 OK", W20 + " | " + W20, "short item short item", " ".join(f"w{i}" for i in range(4, 17)),
]


def run(spark, texts=TEXTS, items=ITEMS, **more):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in D.decontaminate(docs, bench, **more).collect()}


def test_against_brute_force(spark):
    rows = run(spark)
    for i, t in enumerate(TEXTS):
        n, hit, found = brute(t, ITEMS)
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, hit, found)
        assert rows[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_spans_point_into_the_original(spark):
    r = run(spark)[7]
    assert [TEXTS[7][s.start : s.end] for s in r.hit_spans] == ["Äpfel 東京 OK"]
    assert [TEXTS[8][s.start : s.end] for s in run(spark)[8].hit_spans] == [W20 + " | " + W20]


def test_blocks_give_the_same(spark):
    one, many = run(spark), run(spark, max_bytes=20)
    assert {k: (r.n_words, r.n_hit, r["items"], r.contaminated, r.hit_spans) for k, r in one.items()} == {
        k: (r.n_words, r.n_hit, r["items"], r.contaminated, r.hit_spans) for k, r in many.items()
    }


def test_empty_tables(spark):
    assert all(r.n_hit == 0 and not r.contaminated for r in run(spark, items=[(1, None)]).values())
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
