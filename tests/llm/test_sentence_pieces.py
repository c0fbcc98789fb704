import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from kestrel.llm import queries, sentence_pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    """Pieces in any order, runs of blanks (pieces of equal score), signs, unknown letters and what looks like ids."""
    dice = random.Random(7)
    held = [p.replace("▁", " ") for p in sentence_pieces.model(PATH).ids]
    letters = lambda: chr(dice.choice([dice.randint(0, 127), dice.randint(128, 0x2FFF), dice.randint(0x4E00, 0x9FFF), dice.randint(0x1F300, 0x1FFFF)]))
    for _ in range(3000):
        yield "".join(dice.choice(held) for _ in range(dice.randint(1, 8)))
        yield "".join(dice.choice("ab \n\t▁") for _ in range(dice.randint(0, 40)))
        yield "".join(letters() for _ in range(dice.randint(0, 20)))
        yield "".join(dice.choice(["=", "==", "--", "->", "\n", "    ", "\t", "12", "m²", "²."]) for _ in range(dice.randint(1, 20)))
        yield " " * dice.randint(0, 70) + dice.choice(["", "x", "\0", "<s>", "<0x41>", "<unk>"]) + " " * dice.randint(0, 40)


def test_every_text_is_encoded_and_decoded_as_by_the_library(library):
    held = sentence_pieces.model(PATH)
    for text in texts():
        ids = library.encode(text)
        assert held.encode(text).tolist() == ids, text
        assert held.decode(ids) == library.decode(ids)
    for text in (" " * 200_000, "漢" * 50_000, "a" * 200_000, "x1 " * 50_000):
        assert held.encode(text).tolist() == library.encode(text)


def test_any_ids_are_decoded_as_by_the_library(library):
    held, dice = sentence_pieces.model(PATH), random.Random(3)
    for _ in range(5000):
        ids = [dice.choice([dice.randint(0, 31_999), dice.randint(0, 260)]) for _ in range(dice.randint(0, 8))]
        assert held.decode(ids) == library.decode(ids), ids
    for outside in (32_000, -1):
        with pytest.raises(IndexError):
            held.decode([274, outside])


def test_last_pieces_are_those_of_every_prefix(library):
    held = sentence_pieces.model(PATH)
    word = "▁interchangeability"
    for n, piece in enumerate(held.last_pieces(word), 1):
        parts, ranks = list(word[:n]), held.rank
        while True:
            good = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not good:
                break
            i = min(good)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts[-1] == piece


def test_query_equals_the_library_on_whole_tables(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_sentence_pieces(spark, SF).collect()
    assert len(rows) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_nulls_empty_tables_repeats_and_clashing_names(spark, library):
    rows = spark.createDataFrame([(1, None, "kept"), (1, None, "kept"), (None, "", None), (2, " a  b ", "x")], "doc_id long, text string, ids string")
    coded = sentence_pieces.decode(sentence_pieces.encode(rows, PATH), PATH)
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in coded.collect())
    assert got == [(0, [], ""), (1, [], ""), (1, [], ""), (2, library.encode(" a  b "), " a  b ")]
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert sentence_pieces.encode(rows.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([None, 274, None],)], "ids array<int>")
    assert [r.decoded for r in sentence_pieces.decode(odd, PATH).collect()] == ["", library.decode([274])]


def test_a_model_of_another_kind_is_an_error(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_

    held = format_.ModelProto()
    with open(PATH, "rb") as f:
        held.ParseFromString(f.read())
    held.trainer_spec.model_type = format_.TrainerSpec.UNIGRAM
    (tmp_path / "other.model").write_bytes(held.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.Model(str(tmp_path / "other.model"))
