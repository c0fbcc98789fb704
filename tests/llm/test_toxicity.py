import itertools
import math
import random

from pyspark.sql import functions as F

from kestrel.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = {"".join(rng.choices("abcd", k=rng.randint(5, 7))): rng.uniform(1, 5) for _ in range(40)}
    lexicon = X.Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(3, 9)))
        near = max((w for t, w in terms.items() if distance(t, word) <= 1), default=0.0)
        assert lexicon.near(word) == near
        if not terms.get(word):
            assert lexicon.look(word)[0] == (near if len(word) >= 4 else 0.0)


def test_stems_and_exact_words():
    lexicon = X.Lexicon({"idiot": 3.0, "lowei*": 2.0})
    assert lexicon.look("idiot") == (3.0, 0) and lexicon.look("idi0t") == (3.0, 1)
    assert lexicon.look("loweient") == (2.0, 0) and lexicon.look("lowei")[0] == 0.0 and lexicon.look("other")[0] == 0.0


def test_quotation_weighs_less():
    lexicon = X.Lexicon({"idiot": 3.0})
    plain, quoted = (X.features(*X.hits(lexicon, t)) for t in ("you are such an idiot my friend", 'she said "what an idiot" about it'))
    assert quoted[0] < plain[0] and quoted[4] == 1.0 and plain[4] == 0.0


def corpus(spark, n=600):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 80))
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["grobvul", "schmutzig", "vileness", "trashful"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    rows += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "word " * 50000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = X.learn(docs, labels)
    scored = X.score(docs, model)
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == 603 and rows[600].toxicity == rows[601].toxicity < 0.5 and rows[602].toxicity < 0.5
    held = scored.join(labels, "doc_id").where(X.held_out(F.col("doc_id")))
    right = held.where((F.col("toxicity") >= 0.5) == (F.col("toxic") == 1)).count()
    assert right >= 0.95 * held.count() > 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert X.learn(docs, labels) == X.learn(docs, turned)


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    model = X.learn(docs, labels.limit(0))
    assert X.score(docs, model).count() == 23 and X.score(docs.limit(0), model).count() == 0


def test_spans_where_lower_casing_changes_the_length():
    lexicon = X.Lexicon({"hateword": 3.0, "straße": 2.0})
    for text, term in (("İx hateword here", "hateword"), ("aİb " * 400 + "HATEWORD", "HATEWORD"), ("STRASSE Straße ß İ", "Straße"), ("x " * 200_000 + "İ hateword", "hateword")):
        found, n = X.hits(lexicon, text)
        assert [text[h[1] : h[2]] for h in found] == [term] and n == len(X.words_of(text))


def test_hits_and_features_against_a_plain_form():
    """Every word compared with every term by edit distance; quotation, address and windows read off word by word."""
    rng = random.Random(11)
    terms = {"idiot": 3.0, "stupid": 2.0, "loser": 1.5, "trash": 1.0}
    lexicon = X.Lexicon({**terms, "verm*": 2.5})
    fill = ["the", "you", "said", "a", "house", "tree", "blue", "wrote", "your", "idiot", "idi0t", "stupid", "loserr", "vermin", "verm", "trash", "İl"]
    for _ in range(200):
        text = " ".join(rng.choice(['"', "“", "”", "", "", ","]) + rng.choice(fill) + rng.choice(['"', "", "", "."]) for _ in range(rng.randint(0, 60)))
        words, spans, at = [], [], 0
        for c in [*text, " "]:
            if c.isalnum():
                if not words or spans[-1][1] != at:
                    words.append(""), spans.append([at, at])
                words[-1] += c
                spans[-1][1] = at + 1
            at += 1
        words = [w.lower() for w in words]
        wanted = []
        for k, w in enumerate(words):
            if w in terms or (len(w) > 4 and w.startswith("verm")):
                weight, edits = terms.get(w, 2.5), 0
            else:
                weight, edits = max((v for t, v in terms.items() if len(w) >= 4 and distance(t, w) <= 1), default=0.0), 1
            if weight:
                a, b = spans[k]
                first, last = spans[max(0, k - 8)][0], spans[min(len(words) - 1, k + 8)][1]
                before = [c for c in text[first:a] if c in X.OPENING + X.CLOSING][-1:]
                after = [c for c in text[b:last] if c in X.OPENING + X.CLOSING][:1]
                quoted = bool(before and before[0] in X.OPENING and after and after[0] in X.CLOSING) or any(x in X.REPORTING for x in words[max(0, k - 4) : k])
                addressed = any(x in X.ADDRESS for x in words[max(0, k - 4) : k] + words[k + 1 : k + 5])
                wanted.append((k, a, b, weight, edits, quoted, addressed))
        found, n = X.hits(lexicon, text)
        assert (found, n) == (wanted, len(words))
        felt = [(h[0], h[3] * (0.35 if h[5] else 1.2 if h[6] else 1.0) * (0.6 if h[4] else 1.0)) for h in wanted]
        dense = max((sum(f for j, f in felt if k <= j < k + 20) for k, _ in felt), default=0.0)
        got = X.features(found, n)
        assert abs(got[3] - math.log1p(dense)) < 1e-9 and abs(got[2] - math.log1p(100 * sum(f for _, f in felt) / max(20, n))) < 1e-9


def test_a_whole_word_stays_beside_its_stem():
    counts = {"grobv*": (100, 1), "grobvul": (60, 1), "grobvuls": (40, 0), "grobvu*": (100, 1), "chance": (2, 2)}
    lexicon = X.lexicon_from(counts, 200, 200)
    assert "grobvu*" in lexicon and "grobvul" in lexicon and "chance" not in lexicon
    assert X.Lexicon(lexicon).look("gr0bvul") == (lexicon["grobvul"], 1)


def test_a_lexicon_has_every_telling_term(spark):
    """More terms than any fixed number of entries held before."""
    rng = random.Random(4)
    names = ["".join(p) for p in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rst")]
    rows = [(i, " ".join(rng.choice(names[:600]) if i % 2 else f"plain{rng.randrange(300)}" for k in range(30))) for i in range(1, 2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.learn(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert sum(n in model.weights for n in names[:600]) > 550
