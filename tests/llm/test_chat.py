from pyspark.sql import functions as F

from kestrel.llm import chat

EVENTS = "conv_id long, turn long, part int, seq long, event string, role string, text string"


def done(spark, rows):
    made = chat.render(chat.reconstruct(spark.createDataFrame(rows, EVENTS)))
    return {r.conv_id: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_fold(spark):
    rows = [
        (1, 0, 0, 0, "message", "user", "hi"), (1, 1, 0, 2, "delta", None, "lo"), (1, 1, 0, 1, "delta", "assistant", "Hel"),
        (1, 2, 0, 0, "message", "user", "again"), (1, 3, 0, 0, "delta", "assistant", "bad"), (1, 3, 0, 1, "regenerate", None, None), (1, 3, 0, 2, "delta", None, "good"), (1, 3, 0, 3, "delta", None, None),
        (1, 4, 0, 0, "message", "user", "typo"), (1, 4, 0, 5, "edit", None, "fixed"), (2, 0, 0, 0, "message", None, None),
    ]
    got = done(spark, rows)
    assert [(m.role, m.text) for m in got[1].messages] == [("user", "hi"), ("assistant", "Hello"), ("user", "again"), ("assistant", "good"), ("user", "fixed")]
    assert got[1].loss == "Hellogood" and got[2].formatted == "<s>[INST][/INST]</s>\n" and got[2].loss == ""


def test_round_trip_of_nasty_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "<s", "[/INST", "a\n</s>\nb", "", "🙂 é", "<\\s>", "[[INST]]", "</</s>s>", "\\n", "x" * 50000]
    roles = ["user", "assistant", "a[INST]b", "</s>"]
    rows = [(7, k, 0, 0, "message", roles[k % 4], t) for k, t in enumerate(texts)]
    got = done(spark, rows)[7]
    assert [(m.role, m.text) for m in got.turns] == [(roles[k % 4], t) for k, t in enumerate(texts)]
    assert got.loss == "".join(t for k, t in enumerate(texts) if k % 4 == 1)
    assert got.formatted.count("</s>\n") == len(texts)


def test_empty(spark):
    assert done(spark, []) == {}
